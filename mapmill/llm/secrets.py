"""Secret scans: base patterns, and a linear-chain conditional random field over tokens.

Texts are cut into tokens of letters, digits and ``+/_.=-`` and of other characters. Tokens of a
secret's shape (six ASCII characters or more with a digit, or 16 or more of mixed case) can be the begin
or inside of a secret; all others are outside, so a Viterbi path splits at them and only short
chains are decoded. Features are the token's shape, its neighbouring words and facts of the
file.

The field is fitted on a bounded sample of documents. The base patterns label it, and so that the field finds what they do not, each
sampled document also goes in with a random value of a known format set into it, in half the cases without any
telling word beside it, and with strings of other uses, which are labelled outside; of a base match, the words around it are
hidden in half the cases.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapmill.llm.ragged import BYTES, LOWER, mix, text_slices
from mapmill.storage import materialize, release

#: Documents with and without base matches that the field is fitted on at most, each.
SAMPLE = 1500
#: Chains of candidates that the field is fitted on at most, in the order of a hash.
CHAINS = 60_000
DIMS = 1 << 13
FEATURES = 17
#: The features that stand for neighbouring words.
NEIGHBOURS = (10, 11, 12, 13)
EPOCHS, RATE, DECAY = 60, 0.5, 1e-4

# The base patterns and their order.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "crf")

# Characters, formats of values that are secret (a fixed start, characters of the rest, least and greatest length of it), words that tell
# of one, and formats of strings that are none.
DIGITS, LOWER_HEX, UPPER, LETTERS = "0123456789", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
FORMATS = (
    ("", LOWER_HEX, 16, 64), ("", DIGITS + LETTERS, 16, 48), ("", DIGITS + LETTERS + "+/", 28, 64), ("", DIGITS + UPPER, 16, 32), ("ghp_", DIGITS + LETTERS, 36, 36), ("sk_live_", DIGITS + LETTERS, 24, 32),
    ("sk-", DIGITS + LETTERS, 40, 48), ("xoxb-", DIGITS + LETTERS + "-", 40, 50), ("glpat-", DIGITS + LETTERS + "_-", 20, 20), ("AIza", DIGITS + LETTERS + "_-", 35, 35), ("eyJ", DIGITS + LETTERS + "._-", 60, 120), ("AKIA", DIGITS + UPPER, 16, 16),
)
TELLING = ("password:", "pwd=", "passphrase", "secret", "token", "key", "api key:", "credential", "credentials:", "auth", "Authorization: Bearer", "Bearer", "signature=", "private key", "access key", "login with", "use", "export KEY=")
HARMLESS = ("d4-d2-d2", "d1.d2.d2", "vd1.d2.d1-rcd1", "d3.d3.d2.d3", "ISBN d3-d1-d4-d5-d1", "d16", "d9", "d6", "l8d2", "L1l5L1l6L1l5d1", "L1l7L1l7", "l4_l6_d2", "https://www.l9.com/l5/d6/l7", "l7d2@l6d1.l7.com", "d2:d2:d2", "l5-d2-l4", "x86_64", "utf-8", "L2-d5", "l6.l3:d4", "d4/d2/d2", "d1,d3,d3.d2")

OUT, BEGIN, INSIDE = 0, 1, 2
SPACE, OTHER, BODY = 0, 1, 2
_KIND = np.full(256, OTHER, np.uint8)
_KIND[[32, 9, 10, 11, 12, 13]] = SPACE
_KIND[128:] = BODY
_KIND[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"]] = BODY
_IS = {name: np.isin(np.arange(256), [ord(c) for c in chars]).astype(np.uint8) for name, chars in (
    ("digit", "0123456789"), ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("lower", "abcdefghijklmnopqrstuvwxyz"), ("hex", "0123456789abcdef"), ("dot", "."), ("sign", "+/_=-"))}
_HIGH = (np.arange(256) >= 128).astype(np.uint8)
_CLASS = np.select([_IS["digit"] > 0, _IS["upper"] > 0, _IS["lower"] > 0], [0, 1, 2], 3).astype(np.uint8)
_VOWEL = np.isin(np.arange(256), [ord(c) for c in "aeiouyAEIOUY"])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base matches, in code points, in order."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def secret_values(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The value parts of base matches, as labels."""
    out = []
    for start, kind, end in spans:
        m = ASSIGN.match(text, start) if kind == 0 else None
        out.append((m.start(2), m.end(2)) if m else (start, end))
    return out


class Tokens:
    """Tokens of consecutive texts, which of them can be secret, and the features of those."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        kind = _KIND[data]
        cut = np.ones(n, bool)
        if n:
            cut[1:] = kind[1:] != kind[:-1]
            cut[offsets[:-1][offsets[:-1] < n]] = True
        start = np.flatnonzero(cut)
        ends = np.r_[start[1:], n] if len(start) else start
        word = kind[start] != SPACE if len(start) else np.zeros(0, bool)
        sums = {k: np.add.reduceat(t[data], start, dtype=np.int64) if len(start) else np.zeros(0, np.int64) for k, t in (*_IS.items(), ("high", _HIGH))}
        size = ends - start
        shaped = (size >= 6) & (sums["digit"] > 0) | (size >= 16) & (sums["upper"] > 0) & (sums["lower"] > 0)
        shaped &= (kind[start] == BODY) if len(start) else shaped
        shaped &= sums["high"] == 0
        # Spaces are no tokens, but part tokens that touch from those that do not.
        self.start, self.end = start[word], ends[word]
        self.can = shaped[word]
        self.text = np.searchsorted(offsets, self.start, "right") - 1
        self.n = len(self.start)
        size = size[word]
        s = {k: v[word] for k, v in sums.items()}
        hashes = np.zeros(self.n, np.uint64)
        at = np.flatnonzero(self.can)
        self.at = at
        # Hashes of the few tokens that stand near a candidate.
        near = np.unique(np.clip((at[:, None] + np.arange(-4, 3)).ravel(), 0, max(self.n - 1, 0))) if len(at) else at
        for i in near.tolist():
            piece = data[self.start[i] : self.end[i]][:64]
            hashes[i] = np.uint64(int((BYTES[LOWER[piece]] * np.arange(1, 2 * len(piece), 2, dtype=np.uint64)).sum(dtype=np.uint64)))
        self.hashes = hashes
        density = np.bincount(self.text, weights=s["digit"], minlength=len(offsets) - 1) / np.maximum(np.diff(offsets), 1)
        self.features = self._features(at, data, size, s, density)

    def _features(self, at, data, size, s, density) -> np.ndarray:
        """Hashed feature numbers, one column a feature."""
        if not len(at):
            return np.zeros((0, FEATURES), np.int64)
        n = size[at]
        level = lambda v: np.minimum((8 * v[at]) // np.maximum(n, 1), 8)
        log = np.minimum(np.log2(n).astype(np.int64) * 2 + (n & (n - 1) > 0), 20)
        mixed = (s["upper"][at] > 0) * 4 + (s["lower"][at] > 0) * 2 + (s["digit"][at] > 0)
        tokens = [data[a:b] for a, b in zip(self.start[at], self.end[at], strict=True)]
        distinct = np.array([len(np.unique(t)) for t in tokens])
        steps = np.array([np.count_nonzero(np.diff(_CLASS[t])) for t in tokens])
        vowels = np.array([8 * np.count_nonzero(_VOWEL[t]) // max(np.count_nonzero((_CLASS[t] == 1) | (_CLASS[t] == 2)), 1) for t in tokens])
        head = np.array([int(BYTES[data[a : a + 4]].sum(dtype=np.uint64)) for a in self.start[at]], np.uint64)
        def word(d: int) -> np.ndarray:
            j = at + d
            ok = (j >= 0) & (j < self.n)
            j = np.clip(j, 0, self.n - 1)
            return np.where(ok & (self.text[j] == self.text[at]), self.hashes[j], np.uint64(0))
        touch = np.zeros(len(at), np.int64)
        before = at > 0
        touch[before] = self.end[at[before] - 1] == self.start[at[before]]
        columns = [np.minimum(steps, 15) * 30 + log, vowels * 30 + np.minimum(log, 10), np.minimum(8 * steps // np.maximum(n, 1), 8) * 30 + mixed, log, level(s["digit"]), level(s["upper"]), level(s["hex"]) * 30 + log, mixed * 30 + log, np.minimum(distinct, 40),
                   head.view(np.int64), word(-1).view(np.int64), word(-2).view(np.int64), word(-3).view(np.int64), word(1).view(np.int64),
                   np.minimum(s["dot"][at], 4) * 8 + np.minimum(s["sign"][at], 7), touch, np.minimum((density[self.text[at]] * 50).astype(np.int64), 20)]
        f = np.column_stack([mix((c.astype(np.int64).view(np.uint64)) + np.uint64(1000003 * (i + 1))) for i, c in enumerate(columns)])
        return (f % np.uint64(DIMS)).astype(np.int64)

    def hide_words(self, which: np.ndarray) -> None:
        """Let the neighbouring words of these candidates (places in ``at``) be unknown."""
        for c in NEIGHBOURS:
            self.features[which, c] = int(mix(np.array([1000003 * (c + 1)], np.uint64))[0] % np.uint64(DIMS))

    def chains(self) -> np.ndarray:
        """Chain number of each candidate: candidates that follow each other in a text are one chain."""
        at = self.at
        if not len(at):
            return at
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) > 1) | (self.text[at[1:]] != self.text[at[:-1]])
        return np.cumsum(new) - 1


@dataclass
class Field:
    """Weights of features by label, and of label steps (outside before and after each chain)."""

    w: np.ndarray
    steps: np.ndarray

    def emissions(self, features: np.ndarray) -> np.ndarray:
        return self.w[features].sum(1) if len(features) else np.zeros((0, 3))

    def decode(self, features: np.ndarray, chain: np.ndarray) -> np.ndarray:
        """Best label of each candidate, by Viterbi in each chain."""
        e, out = self.emissions(features), np.zeros(len(features), np.int64)
        if not len(e):
            return out
        first, last = _bounds(chain)
        place = np.arange(len(chain)) - np.repeat(first, last - first)
        best, back = np.empty_like(e), np.zeros(e.shape, np.int64)
        for p in range(int(place.max()) + 1):
            now = np.flatnonzero(place == p)
            if p == 0:
                best[now] = self.steps[OUT] + e[now]
            else:
                score = best[now - 1][:, :, None] + self.steps[None]
                back[now] = score.argmax(1)
                best[now] = score.max(1) + e[now]
        label = (best[last - 1] + self.steps[:, OUT]).argmax(1)
        length = last - first
        for p in range(int(length.max())):
            live = length > p
            out[last[live] - 1 - p] = label[live]
            label[live] = back[last[live] - 1 - p, label[live]]
        return out


def _bounds(chain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.r_[True, chain[1:] != chain[:-1]])
    return first, np.r_[first[1:], len(chain)]


def fit_field(features: np.ndarray, chain: np.ndarray, labels: np.ndarray) -> Field:
    """Maximum likelihood by forward-backward sums and adaptive steps; without any secret nothing is ever found."""
    field = Field(np.zeros((DIMS, 3)), np.zeros((3, 3)))
    field.steps[OUT, INSIDE] = -1e6  # an inside never follows an outside
    if not len(labels) or not labels.any():
        field.w[:, BEGIN] = -1e3
        return field
    first, last = _bounds(chain)
    place = np.arange(len(chain)) - np.repeat(first, last - first)
    depth = int(place.max()) + 1
    rows = [np.flatnonzero(place == p) for p in range(depth)]
    is_last = np.zeros(len(chain), bool)
    is_last[last - 1] = True
    g2w, g2s = np.full_like(field.w, 1e-6), np.full((3, 3), 1e-6)
    prev = np.where(place == 0, OUT, np.r_[OUT, labels[:-1]])
    seen = np.zeros((3, 3))
    np.add.at(seen, (prev, labels), 1)
    np.add.at(seen, (labels[is_last], np.full(int(is_last.sum()), OUT)), 1)
    lse = lambda x, axis: np.log(np.exp(x - x.max(axis, keepdims=True)).sum(axis)) + x.max(axis)
    for _ in range(EPOCHS):
        e, a, b = field.emissions(features), np.zeros((len(chain), 3)), np.zeros((len(chain), 3))
        for p, r in enumerate(rows):
            a[r] = (field.steps[OUT] if p == 0 else lse(a[r - 1][:, :, None] + field.steps[None], 1)) + e[r]
        b[is_last] = field.steps[:, OUT]
        for p in range(depth - 2, -1, -1):
            r = rows[p][~is_last[rows[p]]]
            b[r] = lse(field.steps[None] + (e[r + 1] + b[r + 1])[:, None, :], 2)
        z = lse(a + b, 1)
        post = np.exp(a + b - z[:, None])
        diff = -post
        diff[np.arange(len(labels)), labels] += 1
        gw = np.zeros_like(field.w)
        for j in range(features.shape[1]):
            np.add.at(gw, features[:, j], diff)
        expected = np.zeros((3, 3))
        r = np.concatenate([np.zeros(0, np.int64), *rows[1:]]) if depth > 1 else np.zeros(0, np.int64)
        expected += np.exp(a[r - 1][:, :, None] + field.steps[None] + (e[r] + b[r])[:, None, :] - z[r][:, None, None]).sum(0) if len(r) else 0
        expected[OUT] += post[rows[0]].sum(0)
        expected[:, OUT] += post[is_last].sum(0)
        gw -= DECAY * len(labels) * field.w / 100
        gs = seen - expected
        g2w += gw * gw
        g2s += gs * gs
        field.w += RATE * gw / np.sqrt(g2w)
        field.steps += RATE * gs / np.sqrt(g2s)
        field.steps[OUT, INSIDE] = -1e6
    return field


def random_value(rng: np.random.Generator, kind: int) -> str:
    head, chars, low, high = FORMATS[kind]
    return head + "".join(rng.choice(list(chars), rng.integers(low, high + 1)))


def harmless_string(rng: np.random.Generator, shape: str) -> str:
    """A string of the shape: ``d``, ``l`` and ``L`` with a number stand for so many digits, small and capital letters."""
    chars = {"d": DIGITS, "l": LETTERS[26:], "L": UPPER}
    return re.sub(r"([dlL])(\d+)", lambda m: "".join(rng.choice(list(chars[m[1]]), int(m[2]))), shape)


def planted(text: str, rng: np.random.Generator, kinds: list[int] | None = None) -> tuple[str, list[tuple[int, int]]]:
    """The text with one value of a secret format (of ``kinds``) and two harmless strings between its words, and the value's bounds."""
    words = text.split(" ")
    value = random_value(rng, int(rng.choice(kinds if kinds is not None else range(len(FORMATS)))))
    before = str(rng.choice(TELLING)) if rng.random() < 0.5 else ""
    quote = str(rng.choice(["", "", '"', "'"]))
    join = "" if before.endswith("=") or not before else " "
    extra = [f"{before}{join}{quote}{value}{quote}", *(harmless_string(rng, str(x)) for x in rng.choice(HARMLESS, 2))]
    for i, x in sorted(zip(rng.integers(0, len(words) + 1, 3).tolist(), extra, strict=True), reverse=True):
        words.insert(i, x)
    out = " ".join(words)
    at = out.index(value)
    return out, [(at, at + len(value))]


def examples(text: str, extra: list[tuple[int, int]], rng: np.random.Generator, hide: bool) -> tuple[Tokens, np.ndarray, np.ndarray]:
    """Tokens of a text, the labels of its candidates and their chains; ``extra`` are secrets besides the base matches."""
    data = np.frombuffer(text.encode(), np.uint8)
    t = Tokens(data, np.array([0, len(data)]))
    label = np.zeros(t.n, np.int64)
    for a, b in [*secret_values(text, base_spans(text)), *extra]:
        x, y = len(text[:a].encode()), len(text[:b].encode())
        inside = np.flatnonzero((t.start < y) & (t.end > x))
        label[inside] = INSIDE
        label[inside[:1]] = BEGIN
    label = label[t.at]
    if hide:
        t.hide_words(np.flatnonzero((label != OUT) & (rng.random(len(label)) < 0.5)))
    return t, label, t.chains()


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features and labels of the chains of candidates of sampled documents, as they are and with values set into them."""
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rng = np.random.default_rng(abs(doc_id))
            made = [examples(text or "", [], rng, True), examples(*planted(text or "", rng), rng, True)]
            rows: list[tuple] = []
            for t, label, chain in made:
                for own in np.split(np.arange(len(chain)), np.flatnonzero(np.diff(chain)) + 1) if len(chain) else []:
                    rows.append((doc_id, len(rows), t.features[own].ravel().tolist(), label[own].tolist()))
            cols = list(zip(*rows, strict=True)) or [[], [], [], []]
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "chain", "features", "labels"])


def train(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", chains: int = CHAINS) -> Field:
    """Fit on at most ``sample`` documents with a base match, and as many others, in the order of an id hash, and on at most ``chains`` chains of them."""
    hit = F.coalesce(F.col(text_col).rlike(r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"), F.lit(False))
    src = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), hit.alias("hit"))
    src = materialize(src.withColumn("o", F.xxhash64("doc_id", F.lit(9))), "hits")  # the texts are read once for both samples
    best = lambda part: src.where(part).orderBy("o", "doc_id").limit(sample)
    ids = best("hit").unionByName(best("not hit")).select(F.col("doc_id").alias("sample_id"))
    rows = docs.join(F.broadcast(ids), F.col(id_col) == F.col("sample_id"), "left_semi").select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    got = rows.groupBy("doc_id").agg(F.min("text").alias("text")).mapInArrow(_examples, "doc_id long, chain long, features array<long>, labels array<long>")
    got = got.orderBy(F.xxhash64("doc_id", "chain"), "doc_id", "chain").limit(chains).collect()
    release(src)
    features = np.array([x for r in got for x in r.features], np.int64).reshape(-1, FEATURES)
    labels = np.array([x for r in got for x in r.labels], np.int64)
    return fit_field(features, np.repeat(np.arange(len(got)), [len(r.labels) for r in got]), labels)


def found_spans(data: np.ndarray, offsets: np.ndarray, field: Field) -> dict[int, list[tuple[int, int]]]:
    """Spans of the field in each of the texts, in code points."""
    t = Tokens(data, offsets)
    chain = t.chains()
    label = field.decode(t.features, chain)
    out: dict[int, list[tuple[int, int]]] = {}
    later = np.flatnonzero((data & 0xC0) == 0x80)  # bytes that begin no character
    points = lambda at: at - np.searchsorted(later, at)
    zero, start, end = points(offsets), points(t.start[t.at]), points(t.end[t.at])
    for c in np.flatnonzero(label != OUT).tolist():
        r = int(t.text[t.at[c]])
        own, a, b = out.setdefault(r, []), int(start[c] - zero[r]), int(end[c] - zero[r])
        if label[c] == INSIDE and own and c and chain[c - 1] == chain[c] and label[c - 1] != OUT:
            own[-1] = (own[-1][0], b)
        else:
            own.append((a, b))
    return out


def all_spans(base: list[tuple[int, int, int]], found: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Base spans, and those found that overlap none of them."""
    starts, ends, far = [s for s, _, _ in base], [], 0
    for _, _, e in base:
        far = max(far, e)
        ends.append(far)
    free = lambda a, b: not (i := bisect_left(starts, b)) or ends[i - 1] <= a
    return sorted([*base, *((a, 3, b) for a, b in found if free(a, b))])


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row, repeated rows one by one.

    A null text counts as empty, a null id comes back. Spans are ``kind:start:end`` in code points, by start and then
    kind; spans that the field adds have the kind ``crf`` and never overlap a base span. Texts are scanned whole, in time that grows with their length. An empty
    table gives an empty result. Only the two named columns are read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_slices(batch):
                found = found_spans(data, offsets, field)
                cols: list[list] = [[], [], [], [], []]
                for r in range(j - i):
                    base = base_spans(data[offsets[r] : offsets[r + 1]].tobytes().decode("utf-8", "replace"))
                    kinds = [k for _, k, _ in base]
                    for col, v in zip(cols, (kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(written(base).encode()).hexdigest(), written(all_spans(base, found.get(r, [])))), strict=True):
                        col.append(v)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *[pa.array(c, pa.int64()) for c in cols[:3]], *[pa.array(c, pa.string()) for c in cols[3:]]], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(work, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def scan_secrets(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fit the field on a bounded sample and scan every row; see ``scan``."""
    return scan(docs, train(docs, sample, id_col, text_col), id_col, text_col)
