"""Unions with precedence: upserts, merges and versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapmill.operators.lookup import keep_one


def upsert(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``current`` whose key is not in ``new``, then all rows of ``new``."""
    return current.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new.select(*current.columns))


def merge_master(master: DataFrame, imported: DataFrame, id_col: str, prefix: str) -> DataFrame:
    """The master without imported ids and without rows of the same map (ids that begin with ``prefix``_), then the import."""
    kept = master.join(imported.select(F.col(id_col).alias("_i")), F.col(id_col) == F.col("_i"), "left_anti").where(~F.startswith(F.col(id_col), F.lit(f"{prefix}_")))
    return kept.unionByName(imported.select(*master.columns))


def union_first(sources: list[DataFrame], keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key: of the first source that has it, and there the first in ``order``."""
    every = None
    for i, s in enumerate(sources):
        s = s.withColumn("_src", F.lit(i))
        every = s if every is None else every.unionByName(s)
    return keep_one(every, keys, [F.col("_src"), *order]).drop("_src")


def append_in_order(parts: list[DataFrame], order: str = "part_no") -> DataFrame:
    """The union of frames with a column that keeps their order."""
    out = parts[0].withColumn(order, F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        out = out.unionByName(p.withColumn(order, F.lit(i)))
    return out


def union_passes(passes: dict[str, DataFrame], name: str = "pass_name") -> DataFrame:
    """The rows of several passes of one kind with the name of their pass; columns that a pass lacks are null."""
    out = None
    for label, rows in passes.items():
        rows = rows.withColumn(name, F.lit(label))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def previous_choice(rows: DataFrame, key: str, manual: DataFrame, previous: DataFrame, columns: list[str]) -> DataFrame:
    """Columns by precedence: a manual row, else the previous row, else the row's own value."""
    m = manual.select(F.col(key).alias("_m"), *[F.col(c).alias(f"_m_{c}") for c in columns])
    p = previous.select(F.col(key).alias("_p"), *[F.col(c).alias(f"_p_{c}") for c in columns])
    out = rows.join(m, F.col(key) == F.col("_m"), "left").join(p, F.col(key) == F.col("_p"), "left")
    return out.select(*[F.col(c) for c in rows.columns if c not in columns], *[F.coalesce(f"_m_{c}", f"_p_{c}", c).alias(c) for c in columns])
