"""Region names to reference ids, and region codes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epipanel.functions.scalars import homogenise, indel_ratio, sort_tokens
from epipanel.schema import DATE, GID_1, GID_2, require_columns
from epipanel.sources.stage import stage


def lookup_gid1(regions: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """State ids, of the named states or of all."""
    if names:
        regions = regions.where(F.col("NAME_1").isin(*names))
    return regions.select(GID_1).distinct()


def _segments(size_a: str, size_b: str, threshold: float) -> dict[str, Column]:
    """How a name of ``size_a`` letters is cut for candidates of ``size_b``: edits allowed, segments, and shifts of a whole one.

    A ratio of at least t allows at most (1 - t)(|a| + |b|) insertions and deletions, and each breaks one segment at most. Of that many
    and one more segments one stays whole. Of the edits, those beyond the difference in length are half insertions and half
    deletions, so it moves by no more than that, plus the difference.
    """
    la, lb = F.col(size_a), F.col(size_b)
    edits = F.floor((la + lb) * (1.0 - threshold / 100.0) + 1e-9)
    return {"_edits": edits, "_n": F.least(edits + 1, la), "_down": F.floor((edits - (lb - la)) / 2), "_up": F.floor((edits + (lb - la)) / 2)}


def _lengths(size: Column, threshold: float) -> Column:
    """Lengths of the names that can match one of ``size`` letters; longer or shorter ones cannot."""
    t = threshold / 100.0
    return F.sequence(F.greatest(F.ceil(size * (t / (2 - t)) - 1e-9), F.lit(1)), F.floor(size * ((2 - t) / t) + 1e-9)).cast("array<long>")


def _segment(size: Column, i: Column, n: Column) -> tuple[Column, Column]:
    """Start and length of segment ``i`` of ``n``."""
    start = F.floor(i * size / n)
    return start, F.floor((i + 1) * size / n) - start


def fuzzy_pairs(asked: DataFrame, known: DataFrame, threshold: float = 90.0) -> DataFrame:
    """Pairs of names ``_a`` and ``_b`` (both with their words in order) that may reach the threshold: none that does is missed.

    An index over (both lengths, segment, its text): a name gives its segments for each length a match can have, a candidate gives
    the stretches where such a segment can lie. Every pair that could match shares an entry.
    """
    one = asked.select("_a").distinct().where(F.length("_a") > 0).withColumn("_la", F.char_length("_a").cast("long"))
    one = one.withColumn("_lb", F.explode(_lengths(F.col("_la"), threshold))).withColumns(_segments("_la", "_lb", threshold))
    one = one.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    start, length = _segment(F.col("_la"), F.col("_i"), F.col("_n"))
    one = one.select("_a", "_la", "_lb", "_i", F.substring("_a", (start + 1).cast("int"), length.cast("int")).alias("_text"))
    two = known.select("_b").distinct().where(F.length("_b") > 0).withColumn("_lb", F.char_length("_b").cast("long"))
    two = two.withColumn("_la", F.explode(_lengths(F.col("_lb"), threshold))).withColumns(_segments("_la", "_lb", threshold))
    two = two.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    start, length = _segment(F.col("_la"), F.col("_i"), F.col("_n"))
    two = two.withColumns({"_from": F.greatest(start - F.col("_down"), F.lit(0)), "_to": F.least(start + F.col("_up"), F.col("_lb") - length), "_len": length})
    two = two.where("_from <= _to").withColumn("_at", F.explode(F.sequence("_from", "_to")))
    two = two.select("_b", "_la", "_lb", "_i", F.substring("_b", (F.col("_at") + 1).cast("int"), F.col("_len").cast("int")).alias("_text"))
    return one.join(two, ["_la", "_lb", "_i", "_text"]).select("_a", "_b").distinct()


def fuzzy_match(names: DataFrame, candidates: DataFrame, name: str, candidate: str,
                order: str, threshold: float = 90.0) -> DataFrame:
    """Best candidate per distinct name by token-sort ratio, from ``threshold`` up.

    Ties go to the first candidate by ``order``. Only pairs that :func:`fuzzy_pairs` lets through are scored.
    """
    asked = names.select(name).distinct().withColumn("_a", sort_tokens(F.col(name)))
    known = candidates.groupBy(candidate).agg(F.min(order).alias("_order")).withColumn("_b", sort_tokens(F.col(candidate)))
    scored = fuzzy_pairs(asked, known, threshold).withColumn("score", indel_ratio(F.col("_a"), F.col("_b"))).where(F.col("score") >= threshold)
    pairs = asked.join(scored, "_a").join(known, "_b")
    best = pairs.groupBy(name).agg(
        F.min(F.struct((-F.col("score")).alias("s"), F.col("_order"), F.col(candidate))).alias("b")
    )
    return best.select(name, F.col("b")[candidate].alias(candidate), (-F.col("b.s")).alias("score"))


def _unique_names(regions: DataFrame, admin1: bool) -> DataFrame:
    """Reference names by homogenised key, one row per key (smallest region id)."""
    keyed = regions.select(
        homogenise(F.col("NAME_1")).alias("_h1"), homogenise(F.col("NAME_2")).alias("_h2"),
        "NAME_1", "NAME_2", GID_2,
    )
    keys = ["_h1", "_h2"] if admin1 else ["_h2"]
    return keyed.groupBy(*keys).agg(
        F.min_by("NAME_1", GID_2).alias("NAME_1"), F.min_by("NAME_2", GID_2).alias("NAME_2")
    )


def match_exact(names: DataFrame, regions: DataFrame, admin1_col: str | None, admin2_col: str) -> DataFrame:
    """Left join on homogenised names; unmatched rows keep null names."""
    keys = ["_h1", "_h2"] if admin1_col else ["_h2"]
    keyed = names.withColumn("_h2", homogenise(F.col(admin2_col)))
    if admin1_col:
        keyed = keyed.withColumn("_h1", homogenise(F.col(admin1_col)))
    return keyed.join(_unique_names(regions, bool(admin1_col)), keys, "left").drop(*keys)


def resolve_names(names: DataFrame, regions: DataFrame, admin1_col: str | None, admin2_col: str,
                  threshold: float = 90.0) -> DataFrame:
    """Distinct input names with the reference names they stand for.

    Exact match first; a state or municipality name left over is matched by
    itself, the municipality among those of the whole country. The distinct
    names are staged as a table.
    """
    given = [c for c in (admin1_col, admin2_col) if c]
    exact = stage(match_exact(names.select(*given).distinct(), regions, admin1_col, admin2_col))
    open_ = exact.where(F.col("NAME_2").isNull())
    two = fuzzy_match(open_, regions, admin2_col, "NAME_2", GID_2, threshold)
    out = exact.join(two.select(admin2_col, F.col("NAME_2").alias("_f2")), admin2_col, "left")
    out = out.withColumn("NAME_2", F.coalesce("NAME_2", "_f2"))
    if admin1_col:
        one = fuzzy_match(open_, regions, admin1_col, "NAME_1", GID_2, threshold)
        out = out.join(one.select(admin1_col, F.col("NAME_1").alias("_f1")), admin1_col, "left")
        out = out.withColumn("NAME_1", F.coalesce("NAME_1", "_f1"))
    return out.select(*given, *(["NAME_1"] if admin1_col else []), "NAME_2")


def align_regions(df: DataFrame, regions: DataFrame, admin1_col: str | None = "ADM1",
                  admin2_col: str = "ADM2", threshold: float = 90.0) -> DataFrame:
    """Replace free-text names by reference names and add region ids.

    Matching works on distinct names only; the rows meet the result in one
    join. Rows that stay unresolved, or hold any null, go.
    """
    given = [c for c in (admin1_col, admin2_col) if c]
    require_columns(df, given)
    resolved = resolve_names(df, regions, admin1_col, admin2_col, threshold)
    if admin1_col:
        ids = regions.groupBy("NAME_1", "NAME_2").agg(
            F.min_by(GID_1, GID_2).alias(GID_1), F.min(GID_2).alias(GID_2))
        mapping = resolved.join(ids, ["NAME_1", "NAME_2"])
    else:
        ids = regions.groupBy("NAME_2").agg(F.min(GID_2).alias(GID_2))
        mapping = resolved.join(ids, "NAME_2")
    out = df.join(mapping, given)
    if admin1_col:
        out = out.withColumn(admin1_col, F.col("NAME_1"))
    out = out.withColumn(admin2_col, F.col("NAME_2")).drop("NAME_1", "NAME_2")
    kept = [c for c in df.columns] + ([GID_1] if admin1_col else []) + [GID_2]
    return out.select(*kept).dropna()


def unmatched_names(df: DataFrame, regions: DataFrame, admin1_col: str | None, admin2_col: str) -> DataFrame:
    """Distinct input names without any reference name."""
    resolved = resolve_names(df, regions, admin1_col, admin2_col)
    lost = F.col("NAME_2").isNull()
    if admin1_col:
        lost = lost | F.col("NAME_1").isNull()
    return resolved.where(lost).select(*[c for c in (admin1_col, admin2_col) if c])


def add_names_by_code(df: DataFrame, codes: DataFrame, code: str = "code") -> DataFrame:
    """State and municipality names by code; unknown codes keep null names."""
    return df.join(codes, code, "left")


def unmatched_codes(df: DataFrame, codes: DataFrame, code: str = "code") -> DataFrame:
    return df.join(codes, code, "left_anti").agg(F.count("*").alias("unmatched"))


def region_codes(df: DataFrame, key: str = GID_2) -> DataFrame:
    """Region ids with their 0-based alphabetical number.

    Ids are range-partitioned and numbered inside their range; each range adds
    the number of ids before it.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = stage(df.select(key).distinct().repartitionByRange(parts, key).withColumn("_p", F.spark_partition_id()))
    sizes = ids.groupBy("_p").agg(F.count("*").alias("_m"))
    before = sizes.select("_p", (F.sum("_m").over(Window.orderBy("_p")) - F.col("_m")).alias("_below"))
    own = F.row_number().over(Window.partitionBy("_p").orderBy(key)) - 1
    return ids.withColumn("_own", own).join(before, "_p").select(
        key, (F.col("_below") + F.col("_own")).cast("int").alias(f"{key}_codes"))


def first_regions(df: DataFrame, n: int = 10) -> DataFrame:
    """Rows of the first ``n`` regions by id."""
    ids = df.select(GID_2).distinct().orderBy(GID_2).limit(n)
    return df.join(ids, GID_2, "left_semi")


def time_index(df: DataFrame, date: str = DATE) -> DataFrame:
    """Dates numbered 1..T in a ``TIME`` column; null dates have no number."""
    dates = df.select(date).where(F.col(date).isNotNull()).distinct()
    numbered = dates.withColumn("TIME", F.row_number().over(Window.orderBy(date)))
    return df.join(numbered, date, "left").select(*df.columns, "TIME")
