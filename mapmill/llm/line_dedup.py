"""Line deduplication by winnowing over line hashes (native).

Every window of ``window`` consecutive lines selects its least line hash, so two places that
share a run of at least that many lines select a common fingerprint. Only selected minima leave the texts, each once
a place and with the hashes of the lines around it. Fingerprints that stand at
one place only are dropped; the matches of the others are extended both ways, over all windows that hold
the fingerprint, and matching windows that overlap or follow each other make up the repeated run. Lines of runs that stand
earlier (in the order of id, then place) are deleted. Only hashes and places are shuffled to
find them; first places are map-side combined minima, written before they are joined, so that
a run in a third of all documents is a skewed join that Spark can split.

A line is often a whole paragraph, so windows can count in words too: with ``min_words``, one line
or several, fewer than the window, that hold so many words or are the whole text are a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapmill.llm.words import SPACE_CHARS, let, words
from mapmill.storage import materialize, release

WINDOW = 3
#: Words of a repeated paragraph or of few lines that the query and the pipeline delete.
MIN_WORDS = 50


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def places(lines: Column) -> Column:
    """Numbers (from 0) of the lines that hold a word."""
    numbered = F.transform(lines, lambda x, i: F.when(F.length(F.translate(x, SPACE_CHARS, "")) > 0, i))
    return F.filter(numbered, lambda i: i.isNotNull())


_PRINTS = "array<struct<fp: bigint, at: int, low: int, near: array<struct<h: bigint, n: int>>, lines: int>>"


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(SPACE_CHARS)))


def sizes(window: int, min_words: int | None) -> list[int]:
    return [window] if min_words is None else list(range(1, window + 1))


def is_window(lines: Column, count: Column, window: int, min_words: int | None) -> Column:
    """Whether ``lines`` (h, n) of a text of ``count`` lines are a window: of the full size, of so many words, or the whole text."""
    enough = F.size(lines) == window
    if min_words is None:
        return enough
    return enough | (F.size(lines) == count) | (F.aggregate(lines, F.lit(0), lambda n, e: n + e["n"]) >= min_words)


def fingerprints(text: Column, window: int, min_words: int | None) -> Column:
    """Array of (fp, at, low, near, lines): each selected line hash and its place, the lines around it from ``low`` on, and the text's number of lines."""

    def selected(x: Column, size: int) -> Column:
        """Places of the least line hashes of the windows of ``size`` lines."""
        starts = F.filter(F.sequence(F.lit(0), F.size(x) - size), lambda i: is_window(F.slice(x, i + 1, size), F.size(x), window, min_words))
        least = lambda i: let(F.transform(F.slice(x, i + 1, size), lambda e: e["h"]), lambda h: i + F.array_position(h, F.array_min(h)).cast("int") - 1)
        return F.when(F.size(x) < size, F.array().cast("array<int>")).otherwise(F.transform(starts, least))

    def one(x: Column, p: Column) -> Column:
        low = F.greatest(p - (window - 1), F.lit(0))
        return F.struct(x[p]["h"].alias("fp"), p.alias("at"), low.alias("low"), F.slice(x, low + 1, p + window - low).alias("near"), F.size(x).alias("lines"))

    def line(x: Column) -> Column:
        return F.struct(line_hash(x).alias("h"), (F.lit(0) if min_words is None else F.size(words(x))).alias("n"))

    lines = let(text_lines(text), lambda x: F.transform(places(x), lambda i: line(x[i])))
    spots = lambda x: F.array_distinct(F.concat(*[selected(x, s) for s in sizes(window, min_words)]))
    return let(lines, lambda x: let(spots(x), lambda ps: F.transform(ps, lambda p: one(x, p)))).cast(_PRINTS)


def windows_around(window: int, min_words: int | None) -> Column:
    """Array of (i, size, run): the windows that hold the fingerprint of a row (at, low, near, lines), and the hash of all their lines."""
    near, at, low = F.col("near"), F.col("at"), F.col("low")

    def sized(size: int) -> Column:
        first, last = F.greatest(at - (size - 1), low), F.least(at, low + F.size(near) - size)
        held = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        cut = lambda i: F.slice(near, i - low + 1, size)
        held = F.filter(held, lambda i: is_window(cut(i), F.col("lines"), window, min_words))
        return F.transform(held, lambda i: F.struct(i.alias("i"), F.lit(size).alias("size"), F.xxhash64(F.transform(cut(i), lambda e: e["h"])).alias("run")))

    return F.concat(*[sized(s) for s in sizes(window, min_words)])


def repeated_windows(docs: DataFrame, id_col: str, text_col: str, window: int, min_words: int | None) -> DataFrame:
    """(doc_id, text_hash, starts): the windows of each document that stand earlier, in a document of a smaller id or higher up."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.explode(fingerprints(F.col(text_col), window, min_words)).alias("w"))
    prints = materialize(src.select("doc_id", "text_hash", "w.*"), "prints")
    spot = F.struct("doc_id", "text_hash", "at")
    shared = prints.groupBy("fp").agg(F.min(spot).alias("lo"), F.max(spot).alias("hi")).where("lo <> hi").select(F.col("fp").alias("f"))
    met = prints.join(materialize(shared, "shared"), F.col("fp") == F.col("f"), "left_semi")
    met = met.select("doc_id", "text_hash", F.explode(windows_around(window, min_words)).alias("w"))
    met = materialize(met.select("doc_id", "text_hash", "w.i", "w.size", "w.run"), "met")
    release(prints)
    here = F.struct("doc_id", "text_hash", "i")
    firsts = met.groupBy("run").agg(F.min(here).alias("lo"), F.max(here).alias("hi")).where("lo <> hi").select(F.col("run").alias("r"), "lo")
    later = met.join(materialize(firsts, "firsts"), (F.col("run") == F.col("r")) & (here != F.col("lo")))
    return later.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("i", "size")).alias("starts"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, min_words: int | None = None) -> DataFrame:
    """``docs`` with later repeated runs of at least ``window`` lines deleted from the texts, and n_lines, n_deleted.

    Lines are compared without white space at their ends; lines without a word take no part in
    runs and stay. A run may overlap the earlier run that it repeats. A null text stays null and
    has no lines; a text is handled whole however long. With ``min_words``, fewer lines are a run too if they hold so many words, or are all
    lines of both documents. Rows of the same id and text are one document, so none of them is deleted for
    another; a null id counts as the smallest. Without ``min_words``, a document of fewer
    lines than the window has no run. An empty table stays empty. Other columns of ``docs`` pass through unread.
    """
    cols = docs.columns
    del_ = materialize(repeated_windows(docs, id_col, text_col, window, min_words).select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), F.col("starts").alias("_starts")), "deleted")
    # The deletions have no size bound, so the texts are always shuffled to them, at any size of the table.
    met = docs.join(del_.hint("merge"), F.col(id_col).eqNullSafe(F.col("_d")) & (F.xxhash64(F.col(text_col)) == F.col("_h")), "left")

    def cut(lines: Column) -> Column:
        gone = let(places(lines), lambda p: F.array_distinct(F.flatten(F.transform(F.col("_starts"), lambda i: F.slice(p, i["i"] + 1, i["size"])))))
        left = let(gone, lambda g: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), g))
        return let(left, lambda k: F.struct(F.array_join(F.transform(k, lambda i: lines[i]), "\n").alias("text"), (F.size(lines) - F.size(k)).cast("long").alias("n")))

    some = F.col("_starts").isNotNull()
    met = met.withColumn("_cut", F.when(some, let(text_lines(F.col(text_col)), cut)))
    count = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(F.split(F.col(text_col), "\n"))).cast("long")
    text = F.when(some, F.col("_cut.text")).otherwise(F.col(text_col)).alias(text_col)
    kept = [text if c == text_col else F.col(c) for c in cols if c not in ("n_lines", "n_deleted")]
    return met.select(*kept, count.alias("n_lines"), F.coalesce(F.col("_cut.n"), F.lit(0)).cast("long").alias("n_deleted"))
