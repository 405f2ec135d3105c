"""Substring dedup: near-duplicate paragraphs, and passages repeated inside different paragraphs.

Paragraphs are units like the texts of the near-duplicate operator: MinHash bands tuned for recall,
colliding paragraphs joined, links verified by exact Jaccard similarity on full shingle sets, and
removals clustered by connected components.

A passage inside longer paragraphs is found as one more kind of unit: every text is taken as its
overlapping windows, each window's MinHash over ``GRAM``-word shingles is one band with one row,
and equal minima of neighbouring windows are kept once. Any passage of ``MIN_WORDS`` words that
two documents share holds a whole window of both, so it cannot be missed for its place. A minimum
met in several documents is verified on its surroundings, which are all the runs of ``MIN_WORDS`` words that hold it: where an earlier document has
the same surroundings, all these runs are repeats at once; of the others each run is compared by itself.

Texts are read twice: the first pass gives signatures of paragraphs, and minima of windows with a hash of their surroundings; the second,
of the documents that have met others, shingle sets of these paragraphs and the runs around these minima that are not decided yet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapmill.llm.components import components
from mapmill.llm.near_duplicates import PERCENT, SHINGLE, fingerprint, labelled, link_classes, meeting_classes, set_bits, signatures
from mapmill.llm.ragged import Words, mix, signed, text_slices
from mapmill.llm.words import words
from mapmill.storage import materialize, release

MIN_WORDS = 50
#: Words of a line, or of consecutive shorter lines, that make up a paragraph.
PARAGRAPH = 20
#: Words of a window's shingles; a passage of MIN_WORDS words holds MIN_WORDS - GRAM + 1 of them.
GRAM = 20
#: Bands and minima in each, for paragraphs: of similarity 0.75 they share no band in (1 - 0.75^3)^10 = 0.4 % of cases, of 0.2 one in 8 %.
BANDS, ROWS = 10, 3
_RNG = np.random.default_rng(11)
#: Multipliers of the words of a run, for two hashes of 64 bits.
_RUN = _RNG.integers(0, 2**64, (2, 1024), dtype=np.uint64) | np.uint64(1)


def paragraph_bounds(data: np.ndarray, offsets: np.ndarray, least: int) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words of consecutive texts by line, the first line of each paragraph and the number of lines, and the lines' bounds.

    A line of ``least`` words or more is a paragraph. Consecutive shorter lines are one, up to a line
    without a word, a long line or the text's end.
    """
    bounds = np.unique(np.concatenate([offsets, np.flatnonzero(data == 10) + 1, [0, len(data)]]))
    w = Words(data, bounds)
    count = np.diff(w.first)
    short = (count > 0) & (count < least)
    opens = np.ones(len(count), bool)
    opens[1:] = ~(short[1:] & short[:-1]) | np.isin(bounds[1:-1], offsets)
    return w, np.append(np.flatnonzero(opens), len(count)), bounds


def window_minima(h: np.ndarray, whole: np.ndarray, window: int) -> np.ndarray:
    """Places in ``h`` of the least value of each run of ``window`` values that ``whole`` marks by its start."""
    low, size = h, 1
    while size < window:  # minima of runs twice as long, then of overlapping ones
        step = min(size, window - size)
        low = np.minimum(low[: len(low) - step], low[step:])
        size += step
    low = np.where(whole, low, np.uint64(0))
    high = np.concatenate([np.zeros(window - 1, np.uint64), low, np.zeros(window - 1, np.uint64)])
    size = 1
    while size < window:
        step = min(size, window - size)
        high = np.maximum(high[: len(high) - step], high[step:])
        size += step
    return np.flatnonzero((high == h) & (h > 0))


def surroundings(words: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Hashes of the words from ``low`` to ``high`` and of the place ``at`` among them."""
    out = (at - low).astype(np.uint64) * _RUN[0, -1] + (high - low).astype(np.uint64) * _RUN[0, -2]
    for i in range(0, len(at), 100_000):
        part, lo, hi = out[i : i + 100_000], low[i : i + 100_000], high[i : i + 100_000]
        for k in range(int((hi - lo).max(initial=0))):
            part += np.where(lo + k < hi, words[np.minimum(lo + k, len(words) - 1)] * _RUN[0, k % 1000], np.uint64(0))
    return mix(out)


FIRST = "doc_id long, start long, end long, n long, f1 long, f2 long, halves array<long>, h long, around long"


def first_pass(docs: DataFrame, paragraph: int = PARAGRAPH, gram: int = GRAM, min_words: int = MIN_WORDS) -> DataFrame:
    """Paragraphs (doc_id, start, end, n, f1, f2, halves) and window minima (doc_id, start, end, h, around); the end is that of the surroundings.

    Places count the document's words.
    """
    window = min_words - gram + 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_slices(batch):
                ids = batch.column(0).slice(i, j - i)
                w, lines, bounds = paragraph_bounds(data, offsets, paragraph)
                first_word = w.first[np.searchsorted(bounds, offsets)]  # of each text
                begin, end = w.first[lines[:-1]], w.first[lines[1:]]
                long_ = np.flatnonzero(end - begin >= paragraph)
                begin, end = begin[long_], end[long_]
                w.first = np.append(w.first[lines[:-1]], len(w.hash))
                h, first = w.shingles(SHINGLE)
                counts = first[long_ + 1] - first[long_]
                begins = np.concatenate([[0], np.cumsum(counts)])
                own = np.arange(begins[-1]) + np.repeat(first[long_] - begins[:-1], counts)
                sizes, f1, f2, halves = signatures(h[own], begins, BANDS, ROWS, 1)
                row = np.searchsorted(first_word, begin, "right") - 1
                zero = first_word[row]
                lists = pa.FixedSizeListArray.from_arrays(pa.array(signed(halves.ravel())), BANDS).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(row)), pa.array(begin - zero), pa.array(end - zero), pa.array(sizes), pa.array(signed(f1)), pa.array(signed(f2)), lists, pa.nulls(len(row), pa.int64()), pa.nulls(len(row), pa.int64())],
                    names=["doc_id", "start", "end", "n", "f1", "f2", "halves", "h", "around"],
                )
                w.first = first_word
                h = w.shingles_across(gram)
                at = np.zeros(0, np.int64)
                text = np.repeat(np.arange(j - i), np.diff(first_word))
                if len(h) >= window:
                    starts = len(h) - window + 1
                    at = window_minima(h, text[:starts] == text[min_words - 1 : min_words - 1 + starts], window)
                none = pa.nulls(len(at), pa.int64())
                row = text[at] if len(at) else at
                low, high = np.maximum(at - window + 1, first_word[row]), np.minimum(at + min_words, first_word[row + 1])
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(row)), pa.array(at - first_word[row]), pa.array(high - first_word[row]), none, none, none, pa.nulls(len(at), pa.list_(pa.int64())), pa.array(signed(h[at])), pa.array(signed(surroundings(w.hash, at, low, high)))],
                    names=["doc_id", "start", "end", "n", "f1", "f2", "halves", "h", "around"],
                )

    return docs.select("doc_id", "text").mapInArrow(work, FIRST)


SECOND = "set long, shingles array<long>, bits array<long>, doc_id long, start long, g1 long, g2 long, hi long"


def second_pass(docs: DataFrame, wanted: DataFrame, paragraph: int = PARAGRAPH, gram: int = GRAM, min_words: int = MIN_WORDS) -> DataFrame:
    """Shingle sets (set, shingles) of paragraphs, and runs (doc_id, start, g1, g2, hi) of ``min_words`` words that hold a shingle.

    ``wanted``: (w_id, units, spots), of each document the starts and fingerprints of paragraphs, and the places of shingles with the last document
    of the same surroundings, which comes back as ``hi``. Both hashes
    of a run take all its words, so equal ones are equal runs but for one case in 2^128.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_slices(batch):
                ids = batch.column(0).slice(i, j - i)
                w, lines, bounds = paragraph_bounds(data, offsets, paragraph)
                first_word = w.first[np.searchsorted(bounds, offsets)]
                w.first = np.append(w.first[lines[:-1]], len(w.hash))
                h, first = w.shingles(SHINGLE)
                names, sets = [], []
                for r, units in enumerate(batch.column(2).slice(i, j - i)):
                    for unit in units.as_py() or []:
                        k = int(np.searchsorted(w.first, first_word[r] + unit["start"], "right")) - 1
                        own = np.unique(signed(h[first[k] : first[k + 1]]))
                        if int(signed(fingerprint(own.view(np.uint64), np.zeros(1, np.int64)))[0]) == unit["f1"]:  # else of another row of this id
                            names.append(unit["f1"])
                            sets.append(own)
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                none = pa.nulls(len(names), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), lists, set_bits(flat, ends), none, none, none, none, none], names=["set", "shingles", "bits", "doc_id", "start", "g1", "g2", "hi"])
                column = batch.column(3).slice(i, j - i)
                text = np.repeat(np.arange(j - i), pc.fill_null(pc.list_value_length(column), 0).to_numpy())
                spots = column.flatten()
                at, last = (spots.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2))
                s = (at[:, None] - np.arange(min_words - gram + 1)[None, :]).ravel()
                text = np.repeat(text, min_words - gram + 1)
                ok = (s >= 0) & (s + min_words <= np.diff(first_word)[text])
                z, last = s[ok] + first_word[text[ok]], np.repeat(last, min_words - gram + 1)[ok]
                order = np.lexsort((-last, z))
                z, last = z[order], last[order]
                keep = np.append(True, np.diff(z) != 0) if len(z) else np.zeros(0, bool)
                z, last = z[keep], last[keep]
                g = np.zeros((2, len(z)), np.uint64)
                for k in range(min_words):
                    g += w.hash[z + k] * _RUN[:, k % 1024, None]
                g = mix(g)
                row = np.searchsorted(first_word, z, "right") - 1
                none = pa.nulls(len(z), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [none, pa.nulls(len(z), pa.list_(pa.int64())), pa.nulls(len(z), pa.list_(pa.int64())), ids.take(pa.array(row)), pa.array(z - first_word[row]), pa.array(signed(g[0])), pa.array(signed(g[1])), pa.array(last)],
                    names=["set", "shingles", "bits", "doc_id", "start", "g1", "g2", "hi"],
                )

    # What met has no size bound, so this is a shuffled join at any size of the table.
    met = docs.join(wanted.hint("merge"), F.col("doc_id") == F.col("w_id")).select("doc_id", "text", "units", "spots")
    return met.mapInArrow(work, SECOND)


def islands(spans: DataFrame) -> DataFrame:
    """Merge spans (doc_id, start, end) that overlap or touch, within each document, to (doc_id, start_word, end_word)."""
    before = Window.partitionBy("doc_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy("doc_id").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    new = F.coalesce(F.col("start") > F.max("end").over(before), F.lit(True))
    marked = spans.withColumn("_new", new.cast("int")).withColumn("island", F.sum("_new").over(order))
    return marked.groupBy("doc_id", "island").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word")).drop("island")


def linked_paragraphs(units: DataFrame, classes: DataFrame, keyed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(doc_id, start_word, end_word, removed, cluster_doc_id) of paragraphs that are near duplicates of others."""
    of = materialize(labelled(classes.select("f1", "one", "last"), link_classes(keyed, sets, None, percent), "f1"), "paragraph_labels")
    whole = of.groupBy(F.col("label").alias("l")).agg(F.min("one").alias("first"), F.max("last").alias("hi")).where("first <> hi")
    of = materialize(of.join(whole, F.col("label") == F.col("l")).select(F.col("f1").alias("set"), "first"), "paragraph_of")
    met = units.join(of, F.col("f1") == F.col("set"))
    removed = F.struct("doc_id", "start") != F.col("first")
    return met.select("doc_id", F.col("start").alias("start_word"), F.col("end").alias("end_word"), removed.alias("removed"), F.col("first.doc_id").alias("cluster_doc_id"))


def shared_passages(runs: DataFrame, decided: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, start_word, end_word, removed, cluster_doc_id) of passages that stand in several documents.

    ``decided``: (doc_id, start, end, first_id), spans that an earlier document has.
    """
    ends = runs.groupBy("g1", "g2").agg(F.min("doc_id").alias("lo"), F.max(F.greatest("doc_id", "hi")).alias("hi")).where("lo < hi").select(F.col("g1").alias("k1"), F.col("g2").alias("k2"), "lo")
    same = runs.join(materialize(ends, "run_ends"), (F.col("g1") == F.col("k1")) & (F.col("g2") == F.col("k2"))).groupBy("doc_id", "start").agg(F.min("lo").alias("first_id"))
    same = materialize(same.withColumn("end", F.col("start") + min_words), "same")
    # Documents that share a passage are linked to the one where it stands first, and clustered.
    later = same.where(F.col("doc_id") > F.col("first_id")).unionByName(decided)
    links = later.select("doc_id", "first_id").distinct()
    cluster = components(links, "doc_id", "first_id")
    gone = islands(later).withColumn("removed", F.lit(True))
    kept = islands(same.where(F.col("doc_id") <= F.col("first_id"))).withColumn("removed", F.lit(False))
    out = gone.unionByName(kept).join(cluster, F.col("doc_id") == F.col("node"))
    return out.select("doc_id", "start_word", "end_word", "removed", F.col("component").alias("cluster_doc_id"))


def repeated_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, paragraph: int = PARAGRAPH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, kind, start_word, end_word, removed, cluster_doc_id): a row for each repeated paragraph or passage.

    Words are numbered from 0 in the whole document, ends exclusive. A paragraph is a line of ``paragraph`` words or more, or so many
    words in consecutive shorter lines. Of each group of near-duplicate paragraphs, the one in the smallest document (and
    first in it) stays and the others are
    removed; of a passage of ``min_words`` words or more in several documents, the copy in the
    smallest document stays. ``cluster_doc_id`` is the smallest document of the cluster.

    Null and blank texts have no paragraph. A null id is left out. Rows that repeat an id count as
    copies in one document: their passages are no repeats across documents, their equal
    paragraphs are one. Ties cannot arise, as places differ. Texts are handled whole, however long. An empty table gives an
    empty result. Only the named columns are read.
    """
    src = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    first = materialize(first_pass(src, paragraph, min_words=min_words), "first_pass")
    units, minima = first.where("h is null").drop("h", "around"), first.where("h is not null").select("doc_id", "start", "end", "h", "around")

    place = F.struct("doc_id", "start")
    classes = units.groupBy("f1", "f2", "n").agg(F.min(place).alias("one"), F.max(place).alias("last"), F.first("halves").alias("halves"))
    classes = materialize(classes.groupBy("f1").agg(F.max("n").alias("n"), F.min("one").alias("one"), F.max("last").alias("last"), F.max("halves").alias("halves")), "paragraph_classes")
    units = materialize(units.select("doc_id", "start", "end", "f1"), "units")
    keyed = meeting_classes(classes.select(F.col("f1").alias("rep"), "n", "halves"), None)
    of_units = classes.join(keyed, F.col("f1") == F.col("rep"), "left_semi").groupBy(F.col("one.doc_id").alias("w_id")).agg(F.collect_set(F.struct(F.col("one.start").alias("start"), "f1")).alias("units"))

    met = minima.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select(F.col("h").alias("met"))
    near = materialize(minima.join(materialize(met, "met"), F.col("h") == F.col("met"), "left_semi").select("doc_id", "start", "end", "around"), "near")
    release(first)
    ends = materialize(near.groupBy(F.col("around").alias("a")).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")), "around_ends")
    spots = materialize(near.join(ends, F.col("around") == F.col("a")).select("doc_id", "start", "end", "lo", "hi"), "spots")
    of_spots = spots.where("doc_id = lo").groupBy(F.col("doc_id").alias("w_id")).agg(F.collect_set(F.struct("start", "hi")).alias("spots"))
    # The surroundings of a minimum reach as far as its runs do, but not beyond the text.
    decided = spots.where("doc_id > lo").select("doc_id", F.greatest(F.col("start") - (min_words - GRAM), F.lit(0)).alias("start"), "end", F.col("lo").alias("first_id"))

    second = materialize(second_pass(src, of_units.join(of_spots, "w_id", "full_outer"), paragraph, min_words=min_words), "second_pass")
    # Rows that repeat an id give their sets as often as they stand.
    sets = second.where("set is not null").select(F.col("set").alias("doc_id"), "shingles", "bits").dropDuplicates(["doc_id"])
    near = linked_paragraphs(units, classes, keyed, materialize(sets, "paragraph_sets"), percent)
    same = shared_passages(second.where("set is null").select("doc_id", "start", "g1", "g2", "hi"), decided, min_words)
    out = near.withColumn("kind", F.lit("paragraph")).unionByName(same.withColumn("kind", F.lit("passage")))
    return out.select("doc_id", "kind", "start_word", "end_word", "removed", "cluster_doc_id")


def without_repeats(docs: DataFrame, repeats: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the removed words of ``repeats`` (see ``repeated_text``) cut out; the rest is joined by single spaces where words were cut."""
    spans = repeats.where("removed").groupBy(F.col("doc_id").alias("_d")).agg(F.collect_set(F.struct("start_word", "end_word")).alias("_spans"))
    met = docs.join(spans, F.col(id_col) == F.col("_d"), "left")
    gone = lambda i: F.exists("_spans", lambda s: (i >= s["start_word"]) & (i < s["end_word"]))
    text = F.when(F.col("_spans").isNull(), F.col(text_col)).otherwise(F.array_join(F.filter(words(F.col(text_col)), lambda w, i: ~gone(i)), " "))
    return met.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns])
