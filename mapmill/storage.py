"""Tables that several steps of one operator share.

``materialize`` writes a frame as Parquet in the folder that the cluster names in
``spark.checkpoint.dir`` and reads it back: lineage is cut, every executor can read the
files again after another one is lost, and Spark knows the size of the table afterwards.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
#: Rows meant for one part of a table whose size is known.
PART_ROWS = 50_000
#: Tables made inside the open scratch blocks, innermost last.
_OPEN: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("open", default=())


def shared_dir(spark: SparkSession) -> str:
    """The shared scratch folder; a temporary one only where none is configured and all of Spark runs here (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = "file://" + tempfile.mkdtemp(prefix="spark-mapmill-")
    return _LOCAL["dir"]


def materialize(df: DataFrame, name: str = "t", rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table.

    ``rows`` is about how many rows there are, where that is known: they are then dealt to as many parts
    as they need, so that small steps of an iteration do not pay for many empty tasks.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df if rows is None else df.repartition(1 + rows // PART_ROWS)).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._mapmill_path = path
    for made in _OPEN.get()[-1:]:
        made.append(out)
    return out


@contextmanager
def scratch() -> Iterator[None]:
    """Delete, at its end, every table that is written inside the block, but for those that ``kept`` names."""
    outer, made = _OPEN.get(), []
    token = _OPEN.set((*outer, made))
    try:
        yield
    finally:
        _OPEN.reset(token)
        for t in made:
            release(t)


def kept(df: DataFrame) -> DataFrame:
    """A written table that outlives the scratch block around it (and belongs to the next one outside, if any)."""
    *outer, made = _OPEN.get() or ([],)
    made[:] = [t for t in made if t is not df]
    for m in outer[-1:]:
        m.append(df)
    return df


def release(df: DataFrame | None) -> None:
    """Delete a table made by ``materialize`` that no later step reads."""
    path = getattr(df, "_mapmill_path", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def bounded(df: DataFrame, rows: int, most: int) -> DataFrame:
    """Broadcast ``df`` when its counted ``rows`` are at most ``most``; else leave the join to shuffle."""
    return F.broadcast(df) if rows <= most else df
