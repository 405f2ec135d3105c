"""A stratified, spatially balanced review sample in four distributed passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapmill.functions import geo
from mapmill.operators.ranking import lookup_rank
from mapmill.storage import materialize

CONFIDENCE_RANK = {"high": 3, "medium": 2, "low": 1}


def review_sample(candidates: DataFrame, size: int, categories: list[str], forced: list[str], cols: int, rows: int, map_col: str = "map_id") -> DataFrame:
    """At most ``size`` candidates of each map, with the phase that took them and their order.

    ``candidates``: (map_id, seq (a number of its own in its map), place_id, name, category, confidence, x, y). All named ones are
    ranked by category priority, confidence, having a centre, and name, all falling, ties by seq.
    Forced names come first, then the best left of each priority category, then the best left of
    each grid cell over the extent, then the best left over. A (place_id, name) is taken once.
    """
    c = candidates.where(F.coalesce(F.trim("name"), F.lit("")) != "").withColumn("name", F.trim("name"))
    c = c.withColumn("place_id", F.coalesce("place_id", F.lit(""))).withColumn("category", F.coalesce("category", F.lit("其他")))
    rank = lookup_rank(F.col("category"), {k: len(categories) - i for i, k in enumerate(categories)}, 0)
    sure = lookup_rank(F.lower(F.coalesce(F.col("confidence"), F.lit(""))), CONFIDENCE_RANK, 0)
    placed = (F.col("x").isNotNull() & F.col("y").isNotNull()).cast("int")
    order: list[Column] = [F.desc("_p"), F.desc("_c"), F.desc("_has"), F.desc("name"), F.asc("seq")]
    c = c.withColumns({"_p": rank, "_c": sure, "_has": placed})
    # One row a key: later rows of a key can never be taken in its phase, but may stand in another stratum.
    extent = c.groupBy(F.col(map_col).alias("_m")).agg(F.struct(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")).alias("_e"))
    c = c.join(extent, F.col(map_col) == F.col("_m")).drop("_m")
    cell = geo.grid_cell(F.col("x"), F.col("y"), F.col("_e"), cols, rows)
    c = materialize(c.withColumn("_cell", F.when(F.col("_has") == 1, cell["row"] * cols + cell["col"])), "sample")
    key = [map_col, "place_id", "name"]
    fresh = lambda df, taken: df if taken is None else df.join(taken.select(*key), key, "left_anti")

    def best_of(df: DataFrame, stratum: Column, strata: int, phase: int, taken: DataFrame | None) -> DataFrame:
        """The best free row of each stratum in stratum order; a key that a lower stratum took is not free.

        Other strata take fewer than ``strata`` keys of a map, so the best so many keys of each stratum are all that can be
        chosen; they are chosen from in one pass over a bounded array a map.
        """
        pool = fresh(df.withColumn("_st", stratum).where(F.col("_st").isNotNull()), taken)
        pool = pool.withColumn("_rn", F.row_number().over(Window.partitionBy(*key, "_st").orderBy(*order))).where("_rn = 1")
        pool = pool.withColumn("_rn", F.row_number().over(Window.partitionBy(map_col, "_st").orderBy(*order))).where(F.col("_rn") <= strata)
        name = F.concat_ws("\u0001", "place_id", "name")
        by = pool.groupBy(F.col(map_col).alias("_m")).agg(F.array_sort(F.collect_list(F.struct(F.col("_st").cast("int").alias("st"), F.col("_rn").cast("int").alias("rn"), name.alias("key"), F.col("seq").cast("long").alias("seq")))).alias("rows"))
        start = F.struct(F.lit(-1).alias("st"), F.array().cast("array<string>").alias("keys"), F.array().cast("array<struct<st:int,seq:bigint>>").alias("picks"))

        def step(acc: Column, x: Column) -> Column:
            takes = (x["st"] > acc["st"]) & ~F.array_contains(acc["keys"], x["key"])
            more = F.struct(x["st"].alias("st"), F.array_append(acc["keys"], x["key"]).alias("keys"), F.array_append(acc["picks"], F.struct(x["st"].alias("st"), x["seq"].alias("seq"))).alias("picks"))
            return F.when(takes, more).otherwise(acc)

        picks = by.select("_m", F.explode(F.aggregate("rows", start, step)["picks"]).alias("p")).select("_m", "p.st", "p.seq")
        got = df.join(picks.withColumnRenamed("seq", "_s"), (F.col(map_col) == F.col("_m")) & (F.col("seq") == F.col("_s"))).drop("_m", "_s")
        return got.withColumn("phase", F.lit(phase)).withColumn("_o", F.struct(F.lit(phase).alias("p"), F.col("st").cast("long").alias("s"))).drop("st")

    first = c.where(F.col("name").isin(forced) if forced else F.lit(False))
    first = first.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rn = 1").drop("_rn")
    ranked = lambda df, phase: df.withColumn("phase", F.lit(phase)).withColumn("_o", F.struct(F.lit(phase).alias("p"), F.row_number().over(Window.partitionBy(map_col).orderBy(*order)).cast("long").alias("s")))
    one = ranked(first, 1)
    by_category = F.lit(None).cast("int")
    for i, name in enumerate(categories):
        by_category = F.when(F.col("category") == name, i).otherwise(by_category)
    two = best_of(c, by_category, len(categories), 2, one)
    taken = materialize(one.select(*key).unionByName(two.select(*key)), "taken")
    three = best_of(c, F.col("_cell"), cols * rows, 3, taken)
    taken = materialize(taken.unionByName(three.select(*key)), "taken")
    last = fresh(c, taken)
    last = last.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rn = 1").drop("_rn")
    # No more than the sample size can be wanted of the last phase.
    last = last.withColumn("_rn", F.row_number().over(Window.partitionBy(map_col).orderBy(*order))).where(F.col("_rn") <= size).drop("_rn")
    every = one.unionByName(two).unionByName(three).unionByName(ranked(last, 4))
    number = F.row_number().over(Window.partitionBy(map_col).orderBy("_o"))
    out = every.withColumn("sample_no", number).where(F.col("sample_no") <= size)
    return out.select(*candidates.columns, "phase", "sample_no")
