"""Mixing sources to target weights (native).

Each row gets a hash-random key. Within a source rows are ordered by key; the key space is cut
into equal ranges, word counts are summed by (source, range) with map-side combine, and prefix
sums over those few rows say which range holds the cut of each source. Only rows of that one
range are ordered one by one; the others are wholly taken or wholly left in the last epoch.
A source with a third of all rows is therefore spread over as many ranges as the table needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapmill.llm.words import n_words, words
from mapmill.storage import bounded, materialize

#: Times its source's size that a target, and so a document, may reach.
MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
#: Rows meant for one key range; the number of ranges follows from the table.
RANGE_ROWS = 4096
BROADCAST_ROWS = 500_000
KEY_BITS = 60


def hash_key(doc_id: Column, seed: str) -> Column:
    """60 random bits from the id: the leading 15 hexadecimal digits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 15), 16, 10).cast("long")


def ordered(df: DataFrame, by: str, name: str) -> DataFrame:
    """Number the rows of ``df`` from 1 in the order of ``by`` (nulls last), without one task for all of them."""
    order = F.col(by).asc_nulls_last()
    parts = materialize(df.repartitionByRange(32, order).withColumn("_p", F.spark_partition_id()), "ordered")
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    counts = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(F.col("_p").alias("_q"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    local = parts.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(order)))
    # One row for each range partition, so always small.
    return local.join(F.broadcast(offsets), F.col("_p") == F.col("_q")).withColumn(name, F.col("_r") + F.col("_o")).drop("_p", "_q", "_o", "_r", "_n")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> tuple[DataFrame, int]:
    """Targets of (source, source_size) rows: weight shares of the total, capped, the excess
    reshared until none is above; and the number of sources."""
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    src = materialize(ordered(sizes, "source", "rank").withColumn("weight", w.cast("long")), "mix_sources")
    cap = max_epochs * F.col("source_size")
    total = src.agg(F.sum("source_size")).first()[0] or 0
    level, last = 0.0, None
    while level != last:  # each round caps more sources, so there are at most as many rounds as sources, and few in fact
        last = level
        above = cap < F.lit(level) * F.col("weight")
        fixed, free = src.agg(F.sum(F.when(above, cap).otherwise(0)), F.sum(F.when(above, 0).otherwise(F.col("weight")))).first()
        level = (total - (fixed or 0)) / free if free else level
    return src.withColumn("target", F.least(cap.cast("double"), F.lit(float(level)) * F.col("weight"))), src.count()


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: str = "mix:",
    extra: list[Column] | None = None,
) -> DataFrame:
    """Words that the mix takes of each row, repeats counted.

    A source's budget is its target rounded to a whole word. It takes every row
    ``floor(budget / source size)`` times, and in the epoch that is left the rows in key order
    until the budget is met; the row at the cut gives only its leading words, so each source
    meets its budget exactly.

    Null texts have size 0 and are taken 0 times; a null source is one source, ordered last. Rows
    are taken one by one, so repeated rows are mixed as often as they stand; ties of the key are
    broken by id, size and a hash of the text. Sizes are those of whole texts, however long. An empty table gives an empty result. Only the
    named columns are read; ``extra`` columns (aliased by the caller) are carried along.
    """
    text = F.col(text_col)
    sized = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(text).alias("size"),
            hash_key(F.col(id_col), seed).alias("key"), F.xxhash64(text).alias("text_hash"), *(extra or []),
        ),
        "mix_sized",
    )
    n = sized.count()
    bits = max(0, min(40, ((n + RANGE_ROWS - 1) // RANGE_ROWS - 1).bit_length()))
    sized = sized.withColumn("range", F.shiftright(F.col("key"), KEY_BITS - bits))
    ranges = materialize(sized.groupBy("source", "range").agg(F.sum("size").alias("range_size")), "mix_ranges")
    targets, n_sources = source_targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, max_epochs)
    targets = targets.withColumn("budget", F.floor(F.col("target") + 0.5).cast("long")).withColumn(
        "epochs", F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0).cast("long")
    )
    targets = targets.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
    before = Window.partitionBy("s").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranges.withColumnRenamed("source", "s").withColumn("range_before", F.coalesce(F.sum("range_size").over(before), F.lit(0)))
    t = targets.select(F.col("source").alias("ts"), "source_size", "target", "epochs", "rest")
    plan = placed.join(bounded(t, n_sources, BROADCAST_ROWS), F.col("s").eqNullSafe(F.col("ts"))).drop("ts").withColumnRenamed("range", "r")
    plan = materialize(plan, "mix_plan")
    rows = sized.join(
        bounded(plan, plan.count(), BROADCAST_ROWS), F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r"))
    )
    cut = (F.col("range_before") < F.col("rest")) & (F.col("rest") < F.col("range_before") + F.col("range_size"))
    whole = rows.where(~cut).withColumn("part", F.when(F.col("range_before") < F.col("rest"), F.col("size")).otherwise(0))
    upto = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.col("range_before") - F.coalesce(F.sum("size").over(upto), F.lit(0))
    split = rows.where(cut).withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), left)))
    out = whole.unionByName(split)
    return out.withColumn("taken", F.col("epochs") * F.col("size") + F.col("part")).drop("s", "r", "range_before", "range_size", "rest", "range", "key", "text_hash")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mixed corpus: a row for each epoch that takes a document, its text cut where the budget cuts it.

    Columns and values are those of ``docs`` (which has doc_id, text, source); documents of no
    words are left out, as the mix takes nothing of them. Only the text of a row cut short
    changes: its leading words, joined by spaces.
    """
    cols = docs.columns
    mine = mix(docs, extra=[F.struct(*[F.col(c) for c in cols]).alias("row")])
    whole = mine.where("size > 0 and epochs > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("epochs").cast("int"))))
    tail = mine.where("part > 0")
    cut = F.when(F.col("part") < F.col("size"), F.array_join(F.slice(words(F.col("row.text")), 1, F.col("part").cast("int")), " ")).otherwise(F.col("row.text"))
    last = [cut.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in cols]
    return whole.select(*[F.col("row")[c].alias(c) for c in cols]).unionByName(tail.select(*last))
