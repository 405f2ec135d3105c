"""Vector codes against plain integer product quantisation."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mapmill.llm import vector_codes
from mapmill.llm.vector_codes import compress, nearest_entries, sequency_matrix, spectrum

VEC = "vec_id long, embedding array<double>, label int"


def brute(rows, parts=16, entries=64, rounds=2):
    bound = vector_codes.BOUND
    kept = []
    for i, v, lab in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(max(-bound, min(bound, 256 * x))) for x in v], lab))
    if not kept:
        return []
    width = -(-max(len(v) for _, v, _ in kept) // parts)
    cut = lambda v: [(v + [0] * (width * parts - len(v)))[k * width : (k + 1) * width] for k in range(parts)]
    pieces = [cut(v) for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0] or 0, kept[r][1]))[:entries]
    books = [[pieces[r][k] for r in first] for k in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda p, k: min((dist(p[k], e), j) for j, e in enumerate(books[k]))
    for _ in range(rounds):
        new = []
        for k in range(parts):
            groups = {}
            for p in pieces:
                groups.setdefault(near(p, k)[1], []).append(p[k])
            new.append([[sum(c) // len(groups[j]) for c in zip(*groups[j], strict=True)] if j in groups else e for j, e in enumerate(books[k])])
        books = new
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, by_label = [], {}
    for (i, _, lab), p in zip(kept, pieces, strict=True):
        found = [near(p, k) for k in range(parts)]
        error = sum(d for d, _ in found)
        by_label[lab] = by_label.get(lab, 0) + error
        out.append((i, "".join(f"{j:02x}" for _, j in found), error, lab))
    return sorted(((i, c, min(e, 2**63 - 1), min(by_label[lab], 2**63 - 1), sha) for i, c, e, lab in out), key=str)


def rows_of(n, dims, seed=1, spread=1.0):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, spread) for _ in range(dims)], rng.choice([None, 0, 0, 0, 1, 2])) for i in range(n)]
    odd = [(n, None, 0), (n + 1, [0.5] * (dims - 1) + [None], 0), (n + 2, [float("nan")] * dims, 1), (n + 3, [float("inf")] + [0.0] * (dims - 1), 1)]
    return rows + odd + [(None, [0.25] * dims, 1), rows[5], rows[5], (n + 4, [0.0] * dims, None), (7, [-0.001] * dims, 2)]


def got(spark, rows):
    return sorted((tuple(r) for r in compress(spark.createDataFrame(rows, VEC)).collect()), key=str)


@pytest.mark.parametrize(("n", "dims"), [(300, 64), (150, 48), (20, 40)])
def test_codes_are_exact(spark, n, dims):
    """Parts of four, three (padded) and two and a half components; nulls, non-finite ones, ties, repeats and null ids; fewer rows than entries."""
    rows = rows_of(n, dims)
    assert got(spark, rows) == brute(rows)


def test_other_lengths_and_large_components(spark):
    rows = [*rows_of(40, 16, 2), (100, [], 0), (101, [1.0] * 5, 0), (102, [3e6, -8e6] * 8, 3), (103, [1e300, -1e300] * 8, 3)]
    assert got(spark, rows) == brute(rows)


def test_empty_tables(spark):
    assert got(spark, []) == [] and got(spark, [(1, None, 0)]) == []
    (only,) = got(spark, [(1, [], 0)])
    assert only == (1, "00" * 16, 0, 0, hashlib.sha256(b"").hexdigest())


def test_salted_label_join(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", 1)
    rows = rows_of(120, 32, 3)
    wide = spark.createDataFrame([(*r, 1, "x") for r in rows], VEC + ", code long, error string")
    assert sorted((tuple(r) for r in compress(wide).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("width", [1, 2, 3, 4, 7, 16])
def test_transform_keeps_scaled_distances(width):
    rng = np.random.default_rng(width)
    a, b = rng.integers(-500, 500, (40, width)), rng.integers(-500, 500, (30, width))
    h = sequency_matrix(16)
    assert (np.abs(np.diff(h, axis=1)).sum(axis=1) // 2 == np.arange(16)).all()
    scaled = ((spectrum(a)[:, None] - spectrum(b)[None]) ** 2).sum(axis=2)
    plain = ((a[:, None] - b[None]) ** 2).sum(axis=2)
    assert (scaled == plain * spectrum(a).shape[1]).all()
    code, error, _ = nearest_entries(a, b)
    assert (code == plain.argmin(axis=1)).all() and (error == plain.min(axis=1)).all()


def test_smooth_vectors_end_early():
    """On smooth parts most entries are left out after few coefficients."""
    rng = np.random.default_rng(1)
    smooth = lambda n: (np.cumsum(rng.normal(0, 4, (n, 16)), axis=1) + rng.normal(0, 200, (n, 1))).astype(np.int64)
    a, b = smooth(500), smooth(64)
    _, _, added = nearest_entries(a, b)
    assert added < 0.25 * a.shape[0] * b.shape[0] * 16


def test_result_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame(rows_of(200, 32, 4), VEC)
    one, many = (sorted(map(str, compress(df.repartition(n, F.col("vec_id"))).collect())) for n in (1, 9))
    assert one == many
