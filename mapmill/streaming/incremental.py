"""Stateless clean-up of streamed labels, and upserts of micro-batches.

The column functions work on streams unchanged; these helpers put the ones that incremental
imports need together. A restarted stream replays a batch, and an upsert of the same rows changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mapmill.functions import text as T
from mapmill.operators.upsert import upsert


def clean_labels(stream: DataFrame, column: str = "text") -> DataFrame:
    """Labels without punctuation, in reading order, with rule, category and CJK count; blank ones are dropped."""
    out = stream.withColumn("_clean", T.without_punctuation(F.coalesce(F.col(column), F.lit("")))).where("_clean <> ''")
    r = T.reading_order(F.col("_clean"))
    out = out.withColumn("label", r["text"]).withColumn("reading_rule", r["rule"]).drop("_clean")
    return out.withColumn("label_category", T.ocr_category(F.col("label"))).withColumn("cjk", T.cjk_count(F.col("label")))


def upsert_batches(current_of: Callable[[], DataFrame], save: Callable[[DataFrame], None], keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that upserts each micro-batch into a table."""

    def apply(batch: DataFrame, _: int) -> None:
        save(upsert(current_of(), batch, keys))

    return apply


def run_upserts(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Start upserts of all data that is there; the query ends when it is done."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
