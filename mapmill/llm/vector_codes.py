"""Compression of vectors to codes: integer product quantisation with exact early elimination.

Components become integers, vectors 16 parts, and each part position has a codebook of 64 entries fitted by two rounds of Lloyd's
method. The nearest entry is found without floating point: parts and entries are padded with zeros to a power of two and sent
through the integer Walsh-Hadamard transform, whose squared differences sum to the squared distance times the padded width. These are
added in sequency order (few sign changes first, where most of the difference of smooth vectors lies), and an entry leaves as soon as
its partial sum is over the best full distance known. What is left at the end is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapmill.storage import kept, materialize, scratch

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Integer components are held to 32 bits: |x| from 2**31 / SCALE on counts as that bound.
BOUND = 2**31 - 1
#: Rows whose distances to all entries are held at a time.
LOT = 4096
#: Distinct labels up to which their sums are broadcast (two longs each); more are joined by shuffle, rows of one label dealt over SALT keys.
BROADCAST_LABELS = 100_000
SALT = 16
LONG_MAX = 2**63 - 1


def sequency_matrix(n: int) -> np.ndarray:
    """The Hadamard matrix of size ``n`` (a power of two), rows by rising number of sign changes."""
    h = np.ones((1, 1), np.int64)
    while len(h) < n:
        h = np.block([[h, h], [h, -h]])
    return h[np.argsort((h[:, 1:] != h[:, :-1]).sum(axis=1), kind="stable")]


def spectrum(parts: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard coefficients of rows of integers, after padding with zeros, in sequency order."""
    width = parts.shape[1]
    n = 1 << max(width - 1, 0).bit_length()
    return parts @ sequency_matrix(n)[:, :width].T.astype(parts.dtype)


def safe(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as 64-bit integers where no sum of squared coefficients can leave 62 bits, else as Python integers."""
    n = 1 << max(parts.shape[1] - 1, 0).bit_length()
    most = max((int(np.abs(a).max()) for a in (parts, entries) if a.size), default=0)
    kind = np.int64 if (2 * most * n) ** 2 * n < 2**62 else object
    return parts.astype(kind), entries.astype(kind)


def nearest_entries(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index and squared distance of the nearest entry of each part (ties to the lower index), and how many coefficients were added up.

    The entry of the smallest first coefficient difference gives each part an upper bound: its full distance. Pairs over their bound are left out
    after every further coefficient.
    """
    parts, entries = safe(parts, entries)
    p, e = spectrum(parts), spectrum(entries)
    rows, n = len(p), p.shape[1]
    first = (p[:, :1] - e[:, 0][None, :]) ** 2
    guess = first.argmin(axis=1) if first.dtype != object else np.array([min(range(len(e)), key=r.__getitem__) for r in first], np.int64)
    bound = ((p - e[guess]) ** 2).sum(axis=1)
    row, entry = np.nonzero((first <= bound[:, None]).astype(bool))
    total, added = first[row, entry], first.size + p.size
    for s in range(1, n):
        total = total + (p[row, s] - e[entry, s]) ** 2
        added += len(row)
        stay = (total <= bound[row]).astype(bool)
        row, entry, total = row[stay], entry[stay], total[stay]
    if total.dtype == object:
        order = np.array(sorted(range(len(row)), key=lambda i: (row[i], total[i], entry[i])), np.int64)
    else:
        order = np.lexsort((entry, total, row))
    row, entry, total = row[order], entry[order], total[order]
    at = np.searchsorted(row, np.arange(rows))
    return entry[at], total[at] // n, added


def _vectors(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    """The component lists of a batch as rows of ``dims`` integers, short ones padded with zeros."""
    lists = batch.column(batch.schema.get_field_index("parts"))
    out = np.zeros((len(lists), dims), np.int64)
    sizes = np.diff(np.asarray(lists.offsets))
    out[np.arange(dims)[None, :] < sizes[:, None]] = np.asarray(lists.flatten())
    return out


def _lots(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for i in range(0, batch.num_rows, LOT):
            some = batch.slice(i, LOT)
            yield some, _vectors(some, dims)


def integers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component, as longs."""
    low, high = F.lit(float(-BOUND)), F.lit(float(BOUND))
    return F.transform(vector, lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, low), high)).cast("long"))


def clean(vector: Column) -> Column:
    """Vectors that are there, with every component there and finite."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def first_codebooks(rows: DataFrame, id_col: str, dims: int, parts: int, entries: int) -> np.ndarray:
    """(parts, entries, width): the parts of the rows of the smallest ids; null ids come last, equal ids by components."""
    first = rows.orderBy(F.col(id_col).asc_nulls_last(), "parts").limit(entries).collect()  # at most ``entries`` vectors
    seed = np.zeros((len(first), dims), np.int64)
    for i, r in enumerate(first):
        seed[i, : len(r.parts)] = r.parts
    return seed.reshape(len(first), parts, dims // parts).transpose(1, 0, 2)


def refine(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: every entry that is nearest to any part becomes the floor of the mean of those parts.

    Tasks add up their own parts; what is shuffled and returned is one row an entry and component, whatever the number of vectors.
    """
    parts, entries, width = books.shape
    dims = parts * width

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for _, v in _lots(batches, dims):
            for k in range(parts):
                x = v[:, k * width : (k + 1) * width]
                code = nearest_entries(x, books[k])[0]
                np.add.at(sums[k], code, x)
                counts[k] += np.bincount(code, minlength=entries)
        k, j = np.nonzero(counts)
        lists = pa.FixedSizeListArray.from_arrays(pa.array(sums[k, j].ravel(), pa.int64()), width).cast(pa.list_(pa.int64())) if width else pa.array([[]] * len(k), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(j), pa.array(counts[k, j]), lists], names=["part", "entry", "n", "sums"])

    partial = rows.select("parts").mapInArrow(add, "part long, entry long, n long, sums array<long>")
    # A task's sum of 32-bit components fits a long; the sum of tasks is taken in 38 digits, where it cannot wrap.
    place = F.posexplode_outer("sums").alias("at", "s")
    found = partial.select("part", "entry", "n", place).groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out = books.copy()
    for r in found.where("at is not null").collect():  # at most parts * entries * width rows
        out[r.part, r.entry, r.at] = int(r.s) // r.n
    return out


def digest(books: np.ndarray) -> str:
    """Hash of all components of the codebooks, in decimal, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(rows: DataFrame, books: np.ndarray, carry: list[str]) -> DataFrame:
    """(carry, code, error) of each row: the index of the nearest entry of each part in two hex digits, and the sum of squared distances."""
    parts, entries, width = books.shape
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.select(*carry).dtypes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, v in _lots(batches, parts * width):
            codes, errors = np.zeros((len(v), parts), np.uint8), np.zeros(len(v), object)
            for k in range(parts):
                codes[:, k], e, _ = nearest_entries(v[:, k * width : (k + 1) * width], books[k])
                errors = errors + e
            text = pa.array([c.tobytes().hex() for c in codes], pa.string())
            error = pa.array([min(int(e), LONG_MAX) for e in errors], pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in carry], text, error], names=[*carry, "code", "error"])

    return rows.select(*carry, "parts").mapInArrow(work, f"{schema}, code string, error long")


def with_label_errors(coded: DataFrame, label: str) -> DataFrame:
    """``coded`` with label_error, the sum of ``error`` over the rows of the same label (null is one label); a hot label is added up before the shuffle."""
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG_MAX)).cast("long")
    sums = materialize(coded.groupBy(F.col(label).alias("_l")).agg(total.alias("label_error")), "label_errors")
    same = F.col(label).eqNullSafe(F.col("_l"))
    if sums.count() <= BROADCAST_LABELS:
        return coded.join(F.broadcast(sums), same).drop("_l")
    salted = sums.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    dealt = coded.withColumn("_t", F.pmod(F.xxhash64("code", "error"), F.lit(SALT)).cast("int"))
    return dealt.join(salted, same & (F.col("_t") == F.col("_s"))).drop("_l", "_s", "_t")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every row with a clean vector.

    Rows without a vector, or with null or non-finite components, are left out. Repeated rows and ids are rows of their own; a null id is
    kept and comes last among ids. Vectors that are shorter than the longest one, or than a multiple of ``parts``, count as
    padded with zeros; an empty vector is all zeros. Components of 2**31 / 256 and more count as that bound, distances stay exact there
    too, and an error over a long is the largest long. With fewer than ``entries`` rows there is an entry for each row. An empty table gives
    no row. Only the three named columns are read.
    """
    v = F.col(vector_col)
    rows = vectors.where(clean(v)).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), integers(v).alias("parts"))
    with scratch():
        # Written once: the rounds read 64-bit integers that Parquet packs to about the size of the vectors.
        rows = materialize(rows, "integers")
        longest = rows.agg(F.max(F.size("parts"))).first()[0] or 0
        books = first_codebooks(rows, "vec_id", -(-longest // parts) * parts, parts, entries)
        for _ in range(rounds):
            books = refine(rows, books)
        coded = kept(materialize(encode(rows, books, ["vec_id", "label"]), "coded"))
    out = with_label_errors(coded, "label")
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
