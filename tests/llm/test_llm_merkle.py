"""The Merkle manifest against a tree built whole in memory."""

import hashlib
import random
import zlib

import pytest

from mapmill.llm.merkle import manifest

DOC = "doc_id long, source string, lang string, n_chars long, text string"


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    """Root, and for each leaf the nodes before and after it in its run, level by level."""
    proofs, pos = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(pos):
            run = nodes[p - p % 3 : p - p % 3 + 3]
            proofs[i].append(("".join(run[: p % 3]), "".join(run[p % 3 + 1 :])))
        pos = [p // 3 for p in pos]
        nodes = [digest("".join(nodes[j : j + 3])) for j in range(0, len(nodes), 3)]
    return nodes[0], proofs


def brute(rows):
    by_source, out = {}, []
    for r in rows:
        by_source.setdefault(r[1], []).append((r[0], digest("".join(map(field, r))), r))
    trees = {}
    for k, v in by_source.items():
        v.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1]))
        trees[k] = tree([t[1] for t in v])
    order = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    root, over = tree([trees[k][0] for k in order]) if order else (None, [])
    for k, top in zip(order, over, strict=True):
        for (i, leaf, r), own in zip(by_source[k], trees[k][1], strict=True):
            steps = own + top
            folded = leaf
            if i is not None and zlib.crc32(str(i).encode()) % 2 == 0 and r[4]:
                folded = digest("".join(map(field, (*r[:4], r[4].replace("\n", "")))))
            for before, after in steps:
                folded = digest(before + folded + after)
            out.append((i, leaf, trees[k][0], root, digest("".join(b + a for b, a in steps)), folded, folded == root))
    return sorted(out, key=str)


def odd(n, seed=1):
    rng = random.Random(seed)
    sources = ["hot"] * 20 + ["é", None, "", "zz"] + [f"h{k}" for k in range(12)]
    texts = [None, "", "x\ny", "é\n" + "z" * 5000, "\n"]
    return [(rng.randrange(n) if rng.random() > 0.05 else None, rng.choice(sources), rng.choice(["en", None]), rng.choice([None, 3]), rng.choice(texts)) for _ in range(n)]


@pytest.mark.parametrize(("every", "n"), [(2, 300), (5, 500)])
def test_manifest_is_the_tree(spark, every, n):
    """Blocks of 9 and 243 nodes; one source holds over half of the rows, ids repeat or are null, rows repeat."""
    rows = odd(n)
    rows += rows[:10]
    got = sorted((tuple(r) for r in manifest(spark.createDataFrame(rows, DOC), every).collect()), key=str)
    assert got == brute(rows)


@pytest.mark.parametrize("n", [1, 4, 10])
def test_small_trees(spark, n):
    rows = [(i, "only", "en", 1, f"a\n{i}") for i in range(n)]
    assert sorted((tuple(r) for r in manifest(spark.createDataFrame(rows, DOC), 1).collect()), key=str) == brute(rows)


def test_empty_and_clashing_columns(spark):
    assert manifest(spark.createDataFrame([], DOC)).collect() == []
    rows = odd(40, seed=2)
    wide = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], DOC + ", pos long, digest string, block long")
    assert sorted((tuple(r) for r in manifest(wide).collect()), key=str) == brute(rows)
