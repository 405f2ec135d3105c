"""Quality classifier: a generalised additive model with pairwise interactions.

Features of whole texts are binned; shallow trees over the bins of one feature at a time are
boosted in cycles and add up to a lookup table for each feature, then for the best pairs of
features. A score is the logistic of a sum of table entries, looked up for a whole batch at once.
The model is fitted on a bounded sample of labelled rows, drawn by id hash; everything else
reads all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapmill.llm.ragged import Words, mix, text_slices

#: Labelled rows that the model is fitted on at most.
SAMPLE = 20_000
THRESHOLD = 0.3
BINS, PAIR_BINS, PAIRS = 32, 12, 6
ROUNDS, PAIR_ROUNDS, RATE, LEAVES = 150, 60, 0.15, 3

FEATURES = (
    "log_words", "symbol_share", "mark_share", "upper_share", "digit_share", "bar_share", "word_length", "distinct_share",
    "repeat_next", "distinct_3", "distinct_lines", "log_line_words", "stop_share", "high_share", "log_longest",
)
LN = 10


def _class(chars: str) -> np.ndarray:
    t = np.zeros(256, np.float64)
    t[[ord(c) for c in chars]] = 1
    return t


_SYMBOL, _MARK, _BAR, _STOP = _class("#*$%&<>@^~_=+{}[]\\"), _class("!?"), _class("|"), _class(".,;:")
_UPPER, _DIGIT = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789")
_HIGH, _BREAK = np.r_[np.zeros(128), np.ones(128)], _class("\n")


def _distinct(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Distinct values of each owner."""
    keys = np.unique(mix(values ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))))
    if len(keys) == len(values):
        return np.bincount(owner, minlength=n)
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    return np.bincount(o[new], minlength=n)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES a text."""
    n = len(offsets) - 1
    text = np.repeat(np.arange(n), np.diff(offsets))
    size = np.maximum(np.diff(offsets), 1)
    share = lambda table: np.bincount(text, weights=table[data], minlength=n) / size
    w = Words(data, offsets, lower=True)
    words = np.diff(w.first)
    owner = np.repeat(np.arange(n), words)
    some = np.maximum(words, 1)
    h3, first3 = w.shingles(3)
    n3 = np.diff(first3)
    same = np.zeros(len(owner))
    if len(owner) > 1:
        same[1:] = (w.hash[1:] == w.hash[:-1]) & (owner[1:] == owner[:-1])
    # Lines: a line's hash is the sum of its words' hashes at their places in the line.
    breaks = np.cumsum(data == LN)
    line = (breaks[w.start] if len(w.start) else np.zeros(0, np.int64)) + owner  # a new text is a new line
    starts = np.flatnonzero(np.r_[True, line[1:] != line[:-1]]) if len(line) else np.zeros(0, np.int64)
    if len(starts):
        place = np.arange(len(line)) - np.repeat(starts, np.diff(np.r_[starts, len(line)]))
        lines = np.add.reduceat(mix(w.hash + place.astype(np.uint64)), starts)
        line_owner = owner[starts]
    else:
        lines, line_owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n_lines = np.maximum(np.bincount(line_owner, minlength=n), 1)
    longest = np.zeros(n)
    np.maximum.at(longest, owner, w.length)
    return np.column_stack([
        np.log1p(words), share(_SYMBOL), share(_MARK), share(_UPPER), share(_DIGIT), share(_BAR),
        np.bincount(owner, weights=w.length, minlength=n) / some, _distinct(w.hash, owner, n) / some,
        np.bincount(owner, weights=same, minlength=n) / some, _distinct(h3, np.repeat(np.arange(n), n3), n) / np.maximum(n3, 1),
        _distinct(lines, line_owner, n) / n_lines, np.log1p(words / n_lines), share(_STOP), share(_HIGH), np.log1p(longest),
    ])


@dataclass
class AdditiveModel:
    """Bin edges, a table a feature, and a table a pair of features."""

    bias: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)])

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        if self.edges:
            b = self.bins(x)
            for j, t in enumerate(self.tables):
                z += t[b[:, j]]
            for i, j, t in self.pairs:
                z += t[b[:, i] * PAIR_BINS // BINS, b[:, j] * PAIR_BINS // BINS]
        return 1 / (1 + np.exp(-z))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """Newton steps of a greedily split tree over ordered bins, from sums of gradients and curvatures."""
    cuts, steps = [0, len(g)], np.zeros(len(g))
    gain_of = lambda a, b: a * a / (b + 1.0)
    for _ in range(leaves - 1):
        best, at = 1e-9, None
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if hi - lo < 2:
                continue
            cg, ch = np.cumsum(g[lo:hi]), np.cumsum(h[lo:hi])
            gains = gain_of(cg[:-1], ch[:-1]) + gain_of(cg[-1] - cg[:-1], ch[-1] - ch[:-1]) - gain_of(cg[-1], ch[-1])
            k = int(np.argmax(gains))
            if gains[k] > best:
                best, at = gains[k], lo + k + 1
        if at is None:
            break
        cuts = sorted([*cuts, at])
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        steps[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + 1.0)
    return steps


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """A cut of the first axis and one of the second in each half: the steps of the four cells, and their gain."""
    best, out = 0.0, np.zeros_like(g)
    for cut in range(1, g.shape[0]):
        steps, gain = np.zeros_like(g), 0.0
        for part in (slice(0, cut), slice(cut, None)):
            pg, ph = g[part].sum(0), h[part].sum(0)
            row = _tree(pg, ph, 2)
            steps[part] = row
            gain += float((row * pg).sum())
        if gain > best:
            best, out = gain, steps
    return out, best


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Boost tables in cycles. Without rows the score is one half; with one class only, its smoothed share."""
    n, n1 = len(y), float(y.sum())
    share = (n1 + 0.5) / (n + 1.0)
    model = AdditiveModel(bias=float(np.log(share / (1 - share))))
    if not 0 < n1 < n:
        return model
    model.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    b = model.bins(x)
    model.tables = [np.zeros(BINS) for _ in model.edges]
    z = np.full(n, model.bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j, table in enumerate(model.tables):
            g, h = slopes()
            step = RATE * _tree(np.bincount(b[:, j], g, BINS), np.bincount(b[:, j], h, BINS))
            table += step
            z += step[b[:, j]]
    small = b * PAIR_BINS // BINS
    cell = lambda i, j: small[:, i] * PAIR_BINS + small[:, j]
    grid = lambda i, j, v: np.bincount(cell(i, j), v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)
    g, h = slopes()
    gains = sorted(((-_pair_tree(grid(i, j, g), grid(i, j, h))[1], i, j) for i in range(x.shape[1]) for j in range(i)))[:PAIRS]
    model.pairs = [(i, j, np.zeros((PAIR_BINS, PAIR_BINS))) for _, i, j in gains]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in model.pairs:
            g, h = slopes()
            step = RATE * _pair_tree(grid(i, j, g), grid(i, j, h))[0]
            table += step
            z += step.ravel()[cell(i, j)]
    return model


def held_out(doc_id: Column) -> Column:
    """Rows that no model is fitted on: a fifth, by the CRC of the id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def text_features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, x): the features of whole texts; null counts as empty."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_slices(batch):
                x = features(data, offsets)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists], names=["doc_id", "x"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, "doc_id long, x array<double>")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> AdditiveModel:
    """Fit on the ``sample`` labelled rows outside the held-out fifth that come first by id hash.

    Rows with a null id or label are left out; a repeated id counts once, with the larger half of its labels.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("label_id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("y"))
    drawn = known.orderBy(F.xxhash64("label_id"), "label_id").limit(sample)
    # At most ``sample`` rows, so they fit a broadcast and, as features, the driver.
    rows = docs.join(F.broadcast(drawn), F.col(id_col) == F.col("label_id"), "left_semi")
    x = text_features(rows, id_col, text_col).groupBy("doc_id").agg(F.min("x").alias("x"))
    got = x.join(drawn, F.col("doc_id") == F.col("label_id")).orderBy(F.xxhash64("doc_id"), "doc_id").select("x", "y").collect()
    return fit(np.array([r.x for r in got], np.float64).reshape(len(got), len(FEATURES)), np.array([r.y for r in got], np.float64))


def score(docs: DataFrame, model: AdditiveModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) of every row. Null and empty texts get the score of a text without words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_slices(batch):
                p = model.score(features(data, offsets))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, "doc_id long, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, repeated rows one by one.

    An empty table gives an empty result; without labels every score is one half. A null id is not
    held out; a null text is scored as an empty one, a long one as a whole. Equal texts have equal scores. Only the named columns are read.
    """
    model = train(docs, labels, sample, id_col, text_col)
    out = score(docs, model, id_col, text_col, threshold)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text is accepted, all columns as they are."""
    model = train(docs, labels, sample, "doc_id", text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.concatenate([model.score(features(data, offsets)) >= threshold for _, _, data, offsets in text_slices(batch, text_col)] or [np.zeros(0, bool)])
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(work, docs.schema)
