"""Table commits: what a crash leaves, what writers at once get, what merging keeps."""

import threading

import pytest
from pyspark.sql import functions as F

from epipanel.sources import snapshots, tables
from epipanel.sources.store import StatStore


def numbers(df):
    return sorted(r["id"] for r in df.collect())


@pytest.mark.parametrize("broken", ["put", "_swap"])
def test_a_crash_leaves_the_old_table(spark, tmp_path, monkeypatch, broken):
    path = tables.write_table(spark.range(3), str(tmp_path / "t"))

    def fails(self, *a, **k):
        raise OSError("lost")

    def half(self, df, partition_by=()):
        df.write.mode("append").parquet(f"{self.path}/data-half")
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(snapshots.Snapshots, broken, half if broken == "put" else fails)
        with pytest.raises(OSError):
            tables.write_table(spark.range(5), path)
        with pytest.raises(OSError):
            tables.append_table(spark.range(5), path)
    assert numbers(tables.read_table(spark, path)) == [0, 1, 2]
    tables.append_table(spark.range(3, 4), path)
    table = snapshots.Snapshots(spark, path)
    assert len(table.vacuum()) >= 1 and numbers(tables.read_table(spark, path)) == [0, 1, 2, 3]


def test_snapshots_stay_readable(spark, tmp_path):
    path = tables.write_table(spark.range(2), str(tmp_path / "t"))
    before = tables.read_table(spark, path)
    tables.write_table(before.withColumn("id", F.col("id") + 10), path)
    assert numbers(before) == [0, 1] and numbers(tables.read_table(spark, path)) == [10, 11]
    assert numbers(snapshots.Snapshots(spark, path).read(1)) == [0, 1]


def test_writers_at_once(spark, tmp_path):
    store, got, lock = StatStore(spark, str(tmp_path / "s"), most=100), [], threading.Lock()

    def add(i):
        rows = spark.createDataFrame([("m", f"g{i}", "2020-01-31", float(i)), ("m", "all", "2020-01-31", float(i))], "metric string, GID_2 string, Date string, mean double")
        n = StatStore(spark, str(tmp_path / "s"), most=100).add(rows)
        with lock:
            got.append((n, i))

    threads = [threading.Thread(target=add, args=(i,)) for i in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(n for n, _ in got) == list(range(1, 7))
    newest = {r["GID_2"]: r["mean"] for r in store.get(spark.createDataFrame([("m", g, "2020-01-31") for g in ["all", *(f"g{i}" for i in range(6))]],
                                                                             "metric string, GID_2 string, Date string")).collect()}
    assert newest == {"all": float(max(got)[1]), **{f"g{i}": float(i) for i in range(6)}}
    store.compact()
    assert len(store.table.newest()[1]) == 1 and store.records.count() == 7
    assert {r["GID_2"]: r["mean"] for r in store.records.collect()} == newest


def test_appends_beside_a_merge(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    for i in range(3):
        tables.append_table(spark.range(i, i + 1), path)
    table = snapshots.Snapshots(spark, path)

    def merge(parts):
        tables.append_table(spark.range(7, 8), path)  # comes while the merge is written
        out = parts[0][1]
        for _, df in parts[1:]:
            out = out.unionByName(df)
        return out

    assert table.compact(merge) == 5
    assert numbers(tables.read_table(spark, path)) == [0, 1, 2, 7] and len(table.newest()[1]) == 2
    assert table.compact(lambda parts: tables.write_table(spark.range(1), path) and parts[0][1]) is None  # replaced meanwhile
    assert numbers(tables.read_table(spark, path)) == [0]


def test_store_merges_by_itself(spark, tmp_path):
    store = StatStore(spark, str(tmp_path / "s"), most=3)
    for i in range(5):
        store.add(spark.createDataFrame([("m", "g", "2020-01-31", float(i)), ("m", f"g{i}", "2020-01-31", 0.0)], "metric string, GID_2 string, Date string, mean double"))
    assert len(store.table.newest()[1]) <= 3
    wanted = spark.createDataFrame([("m", "g", "2020-01-31"), ("m", "none", "2020-01-31")], "metric string, GID_2 string, Date string")
    assert [r["mean"] for r in store.get(wanted).collect()] == [4.0] and store.missing(wanted).count() == 1


def test_plain_files_become_a_table(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(2).write.parquet(path)
    assert numbers(tables.read_table(spark, path)) == [0, 1]
    tables.append_table(spark.range(2, 3), path)
    assert numbers(tables.read_table(spark, path)) == [0, 1, 2]
    tables.compact_table(spark, path)
    assert numbers(tables.read_table(spark, path)) == [0, 1, 2]
