"""Points in windows: the first of the windows that hold a value, for window tables of any size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapmill.functions.years import NO_TIME
from mapmill.operators.lookup import small
from mapmill.operators.ranking import global_rank, running_sum
from mapmill.storage import kept, materialize, scratch

#: Window tables up to this counted size become one broadcast array that each row looks through.
FEW = 64
#: Segments of a block; clips inside a block are at most half its square.
BLOCK = 512


def _paint(segments: int):
    """For each block the least window over each of its segments, from clips (s, e, w) inside the block."""

    def work(clips: pd.DataFrame) -> pd.DataFrame:
        least = np.full(segments, np.iinfo(np.int64).max)
        for s, e, w in clips.sort_values("w", ascending=False)[["s", "e", "w"]].itertuples(index=False):
            least[s:e] = w  # windows that come first are laid on last
        at = np.flatnonzero(least < np.iinfo(np.int64).max)
        level, block = int(clips["level"].iloc[0]), int(clips["block"].iloc[0])
        return pd.DataFrame({"level": np.full(len(at), level, np.int32), "index": block * segments + at, "w": least[at]})

    return work


def _clips(size: int, levels: int) -> Column:
    """Array of (level, block, s, e): segments from ``s`` to before ``e`` as at most two clips a level.

    On each level a window is clipped in the block where it begins and in the one where it ends; the whole blocks between are its segments of the
    level above.
    """
    start = F.struct(F.col("s").cast("long").alias("a"), F.col("e").cast("long").alias("b"), F.array().cast("array<struct<level:int,block:long,s:long,e:long>>").alias("out"))
    one = lambda level, block, a, b: F.struct(level.cast("int").alias("level"), block.cast("long").alias("block"), (a - block * size).cast("long").alias("s"), (b - block * size).cast("long").alias("e"))

    def step(acc: Column, level: Column) -> Column:
        a, b = acc["a"], acc["b"]
        first, last = F.floor(a / size), F.floor((b - 1) / size)
        same = F.array(one(level, first, a, b))
        # A window that begins with its first block, or ends with its last, leaves that block to the level above.
        head, tail = a % size != 0, b % size != 0
        up_a, up_b = F.when(head, first + 1).otherwise(first), F.when(tail, last).otherwise(last + 1)
        parts = F.concat(
            F.when(head, F.array(one(level, first, a, (first + 1) * size))).otherwise(F.array().cast("array<struct<level:int,block:long,s:long,e:long>>")),
            F.when(tail, F.array(one(level, last, last * size, b))).otherwise(F.array().cast("array<struct<level:int,block:long,s:long,e:long>>")),
        )
        inside = (first == last) & (head | tail | (level == levels - 1))
        done = F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.concat(acc["out"], same).alias("out"))
        more = F.struct(up_a.cast("long").alias("a"), up_b.cast("long").alias("b"), F.concat(acc["out"], parts).alias("out"))
        return F.when(a >= b, acc).when(inside, done).otherwise(more)

    return F.aggregate(F.sequence(F.lit(0), F.lit(levels - 1)), start, step)["out"]


def first_windows(points: DataFrame, windows: DataFrame, size: int = BLOCK) -> DataFrame:
    """(p, label) of the distinct ``points`` (p) that a window holds: the label of the window (low, high, label, ordinal) of the least ordinal.

    Ends of windows cut the line into segments, numbered in one pass over key ranges together with the points. Each window is laid on
    the segments it covers as clips of blocks of ``size``, on as many levels as needed, and each segment takes the least window of the blocks it
    stands in. No task holds more than a block, and a point is compared with no window at all.
    """
    with scratch():
        # Equal ordinals: the first in (low, high, label) counts. Of windows with the same ends only the first matters.
        told = materialize(global_rank(windows.where("low <= high"), [F.col("ordinal"), F.col("low"), F.col("high"), F.col("label")], "w"), "windows")
        lone = told.groupBy("low", "high").agg(F.min("w").alias("w"))
        ends = lone.select(F.col("low").alias("v"), F.lit(0).alias("side")).union(lone.select("high", F.lit(2))).distinct().withColumn("cut", F.lit(1))
        marks = points.select(F.col("p").alias("v"), F.lit(1).alias("side"), F.lit(0).alias("cut"))
        placed = materialize(running_sum(ends.unionByName(marks), [F.col("v"), F.col("side")], F.col("cut"), "n"), "segments")
        cut = placed.where("cut = 1").select("v", "side", (F.col("n") - 1).alias("segment"))
        at = lambda side, name: cut.where(F.col("side") == side).select(F.col("v").alias(f"_{name}"), F.col("segment").alias(name))
        spans = lone.join(at(0, "s"), F.col("low") == F.col("_s")).join(at(2, "e"), F.col("high") == F.col("_e")).select("w", "s", "e")
        total, levels = cut.count(), 1
        while size**levels < total:
            levels += 1
        clips = spans.select("w", F.explode(_clips(size, levels)).alias("c")).groupBy("c.level", "c.block", "c.s", "c.e").agg(F.min("w").alias("w"))
        least = materialize(clips.groupBy("level", "block").applyInPandas(_paint(size), "level int, index long, w long"), "least")
        found = placed.where("cut = 0 AND n > 0").select(F.col("v").alias("p"), (F.col("n") - 1).alias("segment"), F.lit(None).cast("long").alias("w"))
        for level in range(levels):
            over = least.where(F.col("level") == level).select(F.col("index").alias("_i"), F.col("w").alias("_w"))
            found = found.withColumn("_g", F.floor(F.col("segment") / F.lit(size**level)).cast("long"))
            found = found.join(small(over), F.col("_g") == F.col("_i"), "left").withColumn("w", F.least("w", "_w")).drop("_g", "_i", "_w")
        names = told.select(F.col("w").alias("_w"), "label")
        return kept(materialize(found.where("w IS NOT NULL").join(small(names), F.col("w") == F.col("_w")).select("p", "label"), "held"))


def window_join(df: DataFrame, value: str, windows: DataFrame, default: str = NO_TIME, name: str = "time_type") -> DataFrame:
    """``df`` with the label of the first closed window that holds its value, ``default`` where none does or the value is null.

    ``windows``: (low, high, label, ordinal); the first is the one of the least ordinal, then low, high and label. Windows that end before they begin, or
    lack an end, hold nothing. A table of at most FEW rows is broadcast and looked through; beyond that the distinct values are placed
    among the ends of the windows (``first_windows``) and joined back: by broadcast if
    there are few, else by a shuffle that adaptive execution splits at hot values.
    """
    usable = windows.where("low <= high")
    if usable.limit(FEW + 1).count() <= FEW:
        one = usable.agg(F.array_sort(F.collect_list(F.struct("ordinal", "low", "high", "label"))).alias("_w")).withColumn("_one", F.lit(1))
        held = F.get(F.filter("_w", lambda w: F.col(value).between(w["low"], w["high"])), F.lit(0))["label"]
        return df.withColumn("_one", F.lit(1)).join(F.broadcast(one), "_one").withColumn(name, F.coalesce(held, F.lit(default))).drop("_w", "_one")
    points = df.where(F.col(value).isNotNull()).select(F.col(value).alias("p")).distinct()
    held = first_windows(points, usable).select(F.col("p").alias("_p"), F.col("label").alias("_label"))
    return df.join(small(held), F.col(value) == F.col("_p"), "left").withColumn(name, F.coalesce("_label", F.lit(default))).drop("_p", "_label")
