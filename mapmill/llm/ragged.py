"""Words, shingles and their hashes for a batch of texts at once, on flat numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_RNG = np.random.default_rng(20240607)
#: A random 64-bit value per byte, and odd multipliers for places in a word and words in a shingle.
BYTES = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
PLACE = U(int(_RNG.integers(2**62, 2**63)) | 1)
IN_SHINGLE = _RNG.integers(0, 2**64, 64, dtype=np.uint64) | U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes of text handled at once; one longer text is handled by itself.
SLICE = 4_000_000
#: Bytes whose words are hashed in one step.
BLOCK = 1_000_000


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _blocks(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of blocks of about BLOCK bytes that end at a text's end or behind white space, so that no word is cut."""
    lo, n = 0, len(data)
    while lo < n:
        hi = min(lo + BLOCK, n)
        if hi < n:
            end = int(offsets[np.searchsorted(offsets, hi)])
            while hi < end:
                space = np.flatnonzero(IS_SPACE[data[hi : hi + 4096]])
                if len(space):
                    hi += int(space[0]) + 1
                    break
                hi += 4096
            hi = min(hi, end)
        yield lo, hi
        lo = hi


class Words:
    """Words of consecutive texts: byte bounds, 64-bit hashes, and each text's first word number.

    Bytes are handled in blocks, so that a long text takes memory for its words alone.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True):
        parts = [self._block(data[lo:hi], lo, offsets, lower) for lo, hi in _blocks(data, offsets)]
        join = lambda k, kind: np.concatenate([x[k] for x in parts]) if parts else np.zeros(0, kind)
        self.start, self.length, self.hash = join(0, np.int64), join(1, np.int64), join(2, np.uint64)
        self.first = np.searchsorted(self.start, offsets)  # words before each text

    @staticmethod
    def _block(data: np.ndarray, lo: int, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, hash) of the words of one block that begins at byte ``lo``."""
        n = len(data)
        inside = ~IS_SPACE[data]
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        firsts = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, lo + n)] - lo
        opens[firsts] = inside[firsts]  # texts lie side by side: a word ends with its text
        start = np.flatnonzero(opens)
        if not len(start):
            return start, start, np.zeros(0, np.uint64)
        place = np.arange(n) - start[np.maximum(np.cumsum(opens) - 1, 0)]
        length = np.add.reduceat(inside.astype(np.int64), start)
        powers = np.cumprod(np.concatenate([[U(1)], np.full(max(int(length.max()) - 1, 0), PLACE, np.uint64)]))
        part = BYTES[LOWER[data] if lower else data]
        part[~inside] = 0
        part *= powers[np.minimum(np.maximum(place, 0), len(powers) - 1)]
        return start + lo, length, mix(np.add.reduceat(part, start))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of k-word shingles of all texts and each text's first shingle.

        A text with fewer words, but one at least, has its whole word sequence as one shingle.
        """
        counts = np.diff(self.first)
        out_n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
        first = np.concatenate([[0], np.cumsum(out_n)])
        total = int(first[-1])
        at = np.arange(total) - np.repeat(first[:-1], out_n) + np.repeat(self.first[:-1], out_n)
        size = np.repeat(np.minimum(counts, k), out_n)
        h = size.astype(np.uint64)
        last = max(len(self.hash) - 1, 0)
        for j in range(k):
            part = self.hash[np.minimum(at + j, last)] * IN_SHINGLE[j] if total else h
            if j and len(size) and size.min() <= j:
                part = np.where(size > j, part, U(0))
            h = mix(h + part) if j in (k // 2,) else h + part
        return mix(h), first

    def shingles_across(self, k: int) -> np.ndarray:
        """Hashes of all k-word shingles of the words in a row, those that cross texts included, in a step each however large k."""
        sums, inverse = _power_sums(self.hash)
        n = len(self.hash) - k + 1
        return mix((sums[k:] - sums[:-k]) * inverse[:n]) if n > 0 else np.zeros(0, np.uint64)


def _power_sums(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of hashes times powers of PLACE, and the powers' inverses."""
    n = len(hashes)
    powers = np.cumprod(np.concatenate([[U(1)], np.full(max(n - 1, 0), PLACE, np.uint64)]))[:n]
    inverse = np.cumprod(np.concatenate([[U(1)], np.full(n, U(pow(int(PLACE), -1, 1 << 64)), np.uint64)]))
    return np.concatenate([[U(0)], np.cumsum(hashes * powers, dtype=np.uint64)]), inverse


def text_slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices (from row, to row, bytes, offsets) of a text column, each of SLICE bytes or one text; null is empty."""
    arr = batch.column(batch.schema.get_field_index(column))
    if arr.null_count:
        arr = arr.fill_null("")
    arr = arr.cast(pa.large_string())
    bounds = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
    raw = arr.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(arr):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + SLICE, "right")) - 1)
        j = min(j, len(arr))
        yield i, j, data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
        i = j


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def reduce_min(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Minimum of each run values[first[i]:first[i+1]]; empty runs get the largest value."""
    out = np.full(len(first) - 1, np.iinfo(np.uint64).max, np.uint64)
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        out[full] = np.minimum.reduceat(values, first[:-1][full])
    return out
