"""WARC archives with an index, read back by byte ranges.

Writing. Every page is a record of its own gzip member. Of pages with equal payloads the one with the largest id is the
``response``; the others are ``revisit`` records that name it and hold no payload. Each task writes archives of about
``archive_bytes`` under names of its own attempt and returns the index: file, offset, length, URL, digest, type. So the
index names only archives of tasks that succeeded. The payload's whole length goes into the header of every record.

Reading. Index rows are range-partitioned and sorted by file and offset. Neighbours closer than ``gap`` are read in one
go, up to ``most_bytes`` at once, and cut into records again; payloads are unpacked, counted and hashed.

Who is the response is found on digests: (SHA-256, length) counted per page without the payload, the largest id per
digest by a pre-aggregated group, joined back; adaptive execution splits a digest that many pages share.

Cases. Null and empty payloads have no bytes; they too revisit each other. Null URLs are written as empty. Rows that
repeat an id with the same payload are all written, as the largest id's rows all as responses. Rows without id are
responses. Empty tables give no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epipanel.llm.common import stage, stage_folder, table_parts

# Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# An extension field: a revisit has no payload to count.
LENGTH_FIELD = "X-Payload-Length"

_INDEX = pa.schema([("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
                    ("url", pa.string()), ("digest", pa.string()), ("record_type", pa.string())])
_INDEX_SQL = "page_id long, file string, offset long, length long, url string, digest string, record_type string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id, url: str, payload: bytes, refers_to, level: int = 3) -> tuple[bytes, str, str]:
    """A gzip member, the payload's digest and the record's type. ``refers_to``: the response's id for a revisit."""
    sha = digest(payload)
    kind = "response" if refers_to is None else "revisit"
    url = "".join(c for c in url if c not in "\r\n")
    fields = [("WARC-Type", kind), ("WARC-Record-ID", _name(page_id)), ("WARC-Date", "1970-01-01T00:00:00Z"),
              ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{sha}"), (LENGTH_FIELD, str(len(payload)))]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    body = head + payload
    if refers_to is not None:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _name(refers_to))]
        body = head
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    text = VERSION + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    data = packer.compress(text.encode() + body + b"\r\n\r\n") + packer.flush()
    return data, sha, kind


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of one gzip member."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != VERSION:
        raise ValueError(f"not a record of {VERSION}")
    fields = dict(line.split(": ", 1) for line in lines)
    body = rest[:int(fields["Content-Length"])]
    return fields, body.partition(b"\r\n\r\n")[2]


def with_responses(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``page_id``, ``url``, ``payload`` and ``refers_to``, the id of the response that the page revisits."""
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
                         F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    keyed = plain.withColumn("sha", F.sha2("payload", 256)).withColumn("bytes", F.octet_length("payload"))
    copies = (keyed.filter(F.col("bytes") >= least_bytes).groupBy("sha", "bytes")
              .agg(F.max("page_id").alias("_response"), F.count("*").alias("_n")).filter("_n > 1").drop("_n"))
    return (keyed.join(copies, ["sha", "bytes"], "left")
            .select("page_id", "url", "payload", F.when(F.col("page_id") != F.col("_response"), F.col("_response")).alias("refers_to")))


def write(pages: DataFrame, folder: str, archive_bytes: int = 256 << 20) -> DataFrame:
    """Write archives of ``with_responses`` rows to ``folder`` (any address pyarrow opens); returns their index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        stem = f"pages-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        sink, name, at, n = None, "", 0, 0
        for batch in table_parts(batches, 4 << 20):
            rows = []
            for row in batch.to_pylist():
                if sink is None:
                    store.create_dir(path, recursive=True)
                    name, at, n = f"{stem}-{n:05d}.warc.gz", 0, n + 1
                    sink = store.open_output_stream(f"{path}/{name}", compression=None)
                data, sha, kind = record(row["page_id"], row["url"], row["payload"], row["refers_to"])
                sink.write(data)
                rows.append((row["page_id"], name, at, len(data), row["url"], sha, kind))
                at += len(data)
                if at >= archive_bytes:
                    sink.close()
                    sink = None
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), _INDEX)], schema=_INDEX)
        if sink is not None:
            sink.close()

    return stage(pages.select("page_id", "url", "payload", "refers_to").mapInArrow(run, _INDEX_SQL))


def ranges(rows: list[dict], gap: int, most_bytes: int) -> Iterator[tuple[int, int, list[dict]]]:
    """Start, end and records of each read, for records of one file in order of offset."""
    held: list[dict] = []
    for row in rows:
        end = held[-1]["offset"] + held[-1]["length"] if held else 0
        if held and (row["offset"] - end > gap or row["offset"] + row["length"] - held[0]["offset"] > most_bytes):
            yield held[0]["offset"], end, held
            held = []
        held.append(row)
    if held:
        yield held[0]["offset"], held[-1]["offset"] + held[-1]["length"], held


_READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
                   ("refers_to", pa.int64()), ("url", pa.string())])
_READ_SQL = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def read(index: DataFrame, folder: str, gap: int = 64 << 10, most_bytes: int = 8 << 20, with_payload: bool = False) -> DataFrame:
    """The records that the index rows name: ``page_id``, ``payload_bytes`` and ``payload_digest`` (of a response, from its
    bytes; of a revisit, from its header), ``record_type``, ``refers_to``, ``url``, and ``payload`` if asked for."""
    schema = pa.schema([*_READ, ("payload", pa.binary())]) if with_payload else _READ

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        file = source = None
        for batch in batches:
            rows = batch.to_pylist()
            while rows:
                own = [r for r in rows if r["file"] == rows[0]["file"]]
                rows = rows[len(own):]
                if own[0]["file"] != file:
                    if source is not None:
                        source.close()
                    file = own[0]["file"]
                    source = store.open_input_file(f"{path}/{file}")
                for start, end, some in ranges(own, gap, most_bytes):
                    data = source.read_at(end - start, start)
                    out = []
                    for r in some:
                        at = r["offset"] - start
                        fields, payload = parse(data[at:at + r["length"]])
                        kind = fields["WARC-Type"]
                        sha = digest(payload) if kind == "response" else fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if f"sha1:{sha}" != fields["WARC-Payload-Digest"]:
                            raise ValueError(f"{file} at {r['offset']}: the payload is not the one that was written")
                        size = len(payload) if kind == "response" else int(fields[LENGTH_FIELD])
                        to = int(fields["WARC-Refers-To"][len("<urn:page:"):-1]) if kind == "revisit" else None
                        out.append((r["page_id"], size, sha, kind, to, fields["WARC-Target-URI"], *([payload] if with_payload else [])))
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        if source is not None:
            source.close()

    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (index.select("page_id", "file", "offset", "length").repartitionByRange(parts, "file", "offset")
               .sortWithinPartitions("file", "offset"))
    return ordered.mapInArrow(run, _READ_SQL + ", payload binary" * with_payload)


def write_and_read(pages: DataFrame) -> DataFrame:
    """Archive all pages, then read every record of the index back."""
    folder = f"{stage_folder(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    return read(write(with_responses(pages), folder), folder)
