"""Ranks, top-k and quotas without a one-task sort of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapmill.storage import materialize

# Orders of priorities and statuses.
PRIORITY_RANK = {"high": 0, "medium": 1, "low": 2, "": 3}
STATUS_RANK = {"matched": 0, "review": 1, "manual": 2, "context": 3, "unmatched": 4, "": 5}
NO_YEAR = 999_999


def lookup_rank(c: Column, ranks: dict[str, int], default: int) -> Column:
    out = F.lit(default)
    for k, v in ranks.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Number all rows from 1 in ``order``.

    Rows are range-partitioned by the order into the session's number of shuffle partitions (which adaptive execution
    merges where they are small), numbered inside each range, and shifted by the sizes of
    the ranges before; only one count a range meets in one task. The order must be total for a
    reproducible result.
    """
    parts = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "rank")
    before = Window.orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)
    counts = parts.groupBy(F.col("_part").alias("_q")).agg(F.count(F.lit(1)).alias("_n"))
    shift = counts.select("_q", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    local = parts.withColumn("_r", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return local.join(F.broadcast(shift), F.col("_part") == F.col("_q")).withColumn(name, (F.col("_r") + F.col("_o")).cast("long")).drop("_part", "_q", "_o", "_r")


def _pieces(df: DataFrame, keys: list[str], order: list[Column], last: list[Column]) -> tuple[DataFrame, DataFrame]:
    """``df`` dealt to ranges of (keys, order), written with its range ``_part`` and its place ``_m`` there, and the ranges that share a key.

    The second frame has (_q, keys as _k0, _k1, ..., _o, _all, _last) for each range of a key that stands in more than one: how many rows of the
    key stand in earlier ranges and in all, and ``last`` of the row right before. Only the first and the last key of a range can be such a key,
    so there are at most two of these rows a range.
    """
    parts = materialize(df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_m")), "rank")
    value = F.max_by(F.struct(*[c.alias(f"v{i}") for i, c in enumerate(last)]), "_m") if last else F.lit(None)
    ends = parts.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_n"), value.alias("_v"))
    w = Window.partitionBy(*keys)
    shared = ends.withColumn("_all", F.sum("_n").over(w)).where(F.col("_all") > F.col("_n"))
    before = F.coalesce(F.sum("_n").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts, shared.select(F.col("_part").alias("_q"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], before.alias("_o"), "_all", F.lag("_v").over(w.orderBy("_part")).alias("_last"))


def _continued(parts: DataFrame, shared: DataFrame, keys: list[str]) -> DataFrame:
    """Each row with ``_o``, ``_all`` and ``_last`` of its range and key, null where the key stands in this range only. ``shared`` has two rows a range at most."""
    same = F.col("_part") == F.col("_q")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return parts.join(F.broadcast(shared), same, "left").drop("_q", *[f"_k{i}" for i in range(len(keys))])


def running_sum(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows up to each one in ``order``: summed inside key ranges, and shifted by one sum a range."""
    parts, _ = _pieces(df.withColumn("_x", value), [], order, [])
    before = Window.orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)
    shift = parts.groupBy(F.col("_part").alias("_q")).agg(F.sum("_x").alias("_n")).select("_q", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    local = parts.withColumn("_r", F.sum("_x").over(Window.partitionBy("_part").orderBy("_m").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return local.join(F.broadcast(shift), F.col("_part") == F.col("_q")).withColumn(name, F.col("_r") + F.col("_o")).drop("_part", "_m", "_x", "_q", "_o", "_r")


def rank_by_key(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank", count: str | None = None) -> DataFrame:
    """Number the rows of each key from 1 in ``order``, however many rows a key has; ``count`` names a column for the rows of the key.

    Rows are range-partitioned by key and order, so that the rows of a hot key fill many ranges; they are numbered inside each range
    and shifted by the rows of their key in the ranges before. A null key is a key of its own. The order must be total inside a key for
    a reproducible result.
    """
    parts, shared = _pieces(df, keys, order, [])
    w = Window.partitionBy("_part", *keys)
    local = parts.withColumn("_r", F.row_number().over(w.orderBy("_m")))
    local = local if count is None else local.withColumn("_c", F.count(F.lit(1)).over(w))
    out = _continued(local, shared, keys).withColumn(name, (F.col("_r") + F.coalesce("_o", F.lit(0))).cast("long"))
    out = out if count is None else out.withColumn(count, F.coalesce("_all", "_c").cast("long"))
    return out.drop("_part", "_m", "_r", "_o", "_all", "_last", "_c")


def path_rows(df: DataFrame, keys: list[str], order: list[Column], x: str, y: str, no: str = "no") -> DataFrame:
    """``df`` with the number of each vertex in the path of its key, from 1, and the vertex before as prev_x and prev_y (null at the start).

    A path is these rows: its length, its parts inside a window or its text are aggregates over them, and no path is one value. The last
    vertex of each range is carried into the next one, so a key with a large share of the rows is split like any other.
    """
    parts, shared = _pieces(df, keys, order, [F.col(x), F.col(y)])
    w = Window.partitionBy("_part", *keys).orderBy("_m")
    before = F.struct(F.col(x).alias("v0"), F.col(y).alias("v1"))
    local = parts.withColumn("_r", F.row_number().over(w)).withColumn("_b", F.lag(before).over(w))
    out = _continued(local, shared, keys).withColumn("_b", F.coalesce("_b", F.when(F.col("_r") == 1, F.col("_last"))))
    out = out.withColumn(no, (F.col("_r") + F.coalesce("_o", F.lit(0))).cast("long"))
    return out.withColumn("prev_x", F.col("_b.v0")).withColumn("prev_y", F.col("_b.v1")).drop("_part", "_m", "_r", "_o", "_all", "_last", "_b")


def best_per_key(df: DataFrame, keys: list[str], score: Column, order: list[Column]) -> DataFrame:
    """The row of the largest score of each key; rows without a score are skipped, ties go to the first in ``order``."""
    w = Window.partitionBy(*keys).orderBy(F.col("_score").desc(), *order)
    return df.withColumn("_score", score).where(F.col("_score").isNotNull()).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_score")


def first_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def top(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def quota_top(df: DataFrame, priority: Column, score: Column, least: float, quota: int, order: list[Column], keys: list[str]) -> DataFrame:
    """Priority rows always, and others of at least ``least`` while fewer than ``quota`` rows are kept, by falling score.

    Until the quota every eligible row is kept and afterwards only priority rows, so the rank
    among eligible rows decides. ``keys`` may be empty: one quota for all rows.
    """
    able = df.withColumn("_p", F.coalesce(priority, F.lit(False))).withColumn("_s", score).where(F.col("_p") | (F.col("_s") >= least))
    return rank_by_key(able, keys, [F.col("_s").desc(), *order], "_rn").where(F.col("_p") | (F.col("_rn") <= quota)).drop("_p", "_s", "_rn")


def filter_ranked(df: DataFrame, level: str | None = None, keyword: str | None = None, level_col: str = "level", text_cols: tuple[str, ...] = ("name", "reason")) -> DataFrame:
    """Rows of a level whose texts hold a keyword; either test may be left out."""
    out = df if level is None else df.where(F.col(level_col) == level)
    if keyword is None:
        return out
    hit = F.lit(False)
    for c in text_cols:
        hit |= F.coalesce(F.contains(F.col(c), F.lit(keyword)), F.lit(False))
    return out.where(hit)


def second_rank(df: DataFrame, subset: Column, order: list[Column], key: str, label: Column, name: str = "curated_rank", label_col: str = "rank_label") -> DataFrame:
    """``df`` with the rank inside a subset (0 outside), whose rows take the label ``label`` made from it."""
    sub = global_rank(df.where(subset), order, "_sub").select(F.col(key).alias("_k"), "_sub")
    out = df.join(sub, F.col(key) == F.col("_k"), "left").withColumn(name, F.coalesce("_sub", F.lit(0)))
    return out.withColumn(label_col, F.when(F.col("_sub").isNotNull(), label).otherwise(F.col(label_col))).drop("_k", "_sub")


def checklist_order(priority: str, status: str, kind: str, name: str) -> list[Column]:
    """Order by priority, status, type and name."""
    return [lookup_rank(F.col(priority), PRIORITY_RANK, 3), lookup_rank(F.col(status), STATUS_RANK, 5), F.col(kind), F.col(name)]


def numeric_order(column: str) -> Column:
    """Order by the number that a text holds; others count as 0."""
    return F.coalesce(F.col(column).try_cast("double"), F.lit(0.0))


def time_order(year: str, priority: str, status: str, name: str) -> list[Column]:
    """Order by year (missing last), priority, status and name."""
    return [F.coalesce(F.col(year), F.lit(NO_YEAR)), lookup_rank(F.col(priority), PRIORITY_RANK, 3), lookup_rank(F.col(status), STATUS_RANK, 5), F.col(name)]


def top_themes(counts: DataFrame, key: str, theme: str, count: str, ordinal: str, n: int) -> DataFrame:
    """(key, themes): the ``n`` themes of the largest positive counts, ties in theme order."""
    entry = F.struct((-F.col(count)).alias("c"), F.col(ordinal).alias("o"), F.col(theme).alias("t"))
    some = counts.where(F.col(count) > 0).groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("_all"))
    return some.select(key, F.transform(F.slice("_all", 1, n), lambda x: x["t"]).alias("themes"))


def playback(df: DataFrame, keys: list[str], order: list[Column], least_ms: int = 900, total_ms: int = 20_000) -> DataFrame:
    """Timeline steps of each key, of any number of rows: step_ms, at_ms and progress in percent."""
    out = rank_by_key(df, keys, order, "_i", "_n").withColumn("_i", F.col("_i") - 1)
    step = F.greatest(F.lit(least_ms), F.floor(F.lit(total_ms) / F.col("_n") + 0.5)).cast("long")
    progress = F.when(F.col("_n") > 1, F.floor(F.col("_i") / (F.col("_n") - 1) * 100 + 0.5)).otherwise(F.lit(100)).cast("long")
    return out.withColumn("step_ms", step).withColumn("at_ms", (F.col("_i") * step).cast("long")).withColumn("progress", progress).drop("_n", "_i")


def path_totals(path: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, vertices, length): of each path of ``path_rows`` the number of its vertices and the length of its line."""
    step = F.coalesce(F.hypot(F.col(x) - F.col("prev_x"), F.col(y) - F.col("prev_y")), F.lit(0.0))
    return path.groupBy(*keys).agg(F.count(F.lit(1)).alias("vertices"), F.sum(step).alias("length"))
