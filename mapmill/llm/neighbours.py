"""Nearest neighbours by largest inner product: a vantage-point tree per shard.

Shards hold like vectors: rows go to the nearest of a few centers that are fitted on a bounded sample, and
large clusters are split by a hash. Against the same sample each query learns a score that its k-th neighbour has at least, and is sent
only to shards whose ball can hold better ones. In a shard the vectors get one more coordinate that makes all
norms equal, so that a larger inner product is a smaller angle, and a vantage-point tree is
built over the distinct vectors. Queries of a batch first look into the leaf that they lie in, then walk down the tree together, so that
a batch comes to a leaf twice at most; a child is
left out for a query when ``factor`` times the triangle inequality's lower bounds from the vantage points above it exceeds the
angle of the query's k-th score so far. Factor one is exact; a larger factor prunes more, here and among shards. Rows and queries of a
shard reach one task sorted, rows first: the tree is built once and the queries stream through it. Each shard gives a query at most its k
best, none below the score from the sample, of which the k best over all shards are ranked. Queries are numbered once in a written table: candidates carry that number
instead of the query's vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mapmill.storage import materialize

LEAF = 64
#: Rows of a shard at least and at most, and shards meant for a table between.
SHARD_ROWS, SHARDS = (1024, 65_536), 16
#: Rows that centers and first bounds are taken from, and centers at most.
SAMPLE, CENTERS = 4096, 256
#: Queries of a shard in one task, which its rows are copied for.
BLOCK = 262_144
#: Allowance for rounding in angles and scores.
SLACK = 1e-6
#: Rows that are compared with the sample, or scored, at a time.
CHUNK = 1024

PLACED = "shard int, block int, asked boolean, id long, v array<double>, bound double, no long"


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v array<double>) of vectors that are not null, zero, or partly null or non-finite."""
    v = F.col(vector_col)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    ok = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0)
    return df.where(ok & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("v"))


def unit_of(top):
    """The power of two at or below ``top``: to divide by it rounds nothing, so that equal scores stay equal."""
    return np.ldexp(0.5, np.frexp(top)[1])


def scaled(x: np.ndarray) -> np.ndarray:
    """Each row divided by the power of two of its largest component."""
    return x / unit_of(np.abs(x).max(1, initial=0))[:, None] if len(x) else x


class Tree:
    """Vantage-point tree over unit vectors, by their angles."""

    def __init__(self, unit: np.ndarray, leaf: int = LEAF):
        self.unit, self.leaf = unit, leaf
        self.root = self._build(np.arange(len(unit)), 0)

    def _build(self, rows: np.ndarray, depth: int):
        if len(rows) <= self.leaf or depth > 40:
            return rows
        # The farthest row from any one lies at the border, from where angles differ most.
        start = rows[(len(rows) * 7 + depth) % len(rows)]
        vp = rows[np.argmin(self.unit[rows] @ self.unit[start])]
        d = np.arccos(np.clip(self.unit[rows] @ self.unit[vp], -1, 1))
        order = np.argsort(d, kind="stable")
        # The widest gap near the middle parts clusters rather than cuts them.
        low, high = len(rows) * 3 // 10, len(rows) * 7 // 10
        gaps = np.diff(d[order[low : high + 1]])
        half = low + 1 + int(gaps.argmax()) if gaps.max() > 0 else len(rows) // 2
        near, far = order[:half], order[half:]
        return (vp, d[near[0]], d[near[-1]], d[far[0]], d[far[-1]], self._build(rows[near], depth + 1), self._build(rows[far], depth + 1))


class Shard:
    """Vectors of a shard, of which a tree holds the distinct ones. Rows equal in id and vector count once."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        whole = np.ascontiguousarray(self.x + 0.0).view(f"V{self.x.shape[1] * 8}").ravel()  # equal vectors, equal bytes: no negative zeros
        _, first, group = np.unique(whole, return_index=True, return_inverse=True)
        place = np.argsort(first, kind="stable")  # groups in the order of their smallest ids
        first, group = first[place], np.argsort(place)[group.ravel()]
        self.by_group = np.argsort(group, kind="stable")
        again = (np.diff(group[self.by_group]) == 0) & (np.diff(self.ids[self.by_group]) == 0)
        self.by_group = self.by_group[np.append(True, ~again)]
        self.starts = np.searchsorted(group[self.by_group], np.arange(len(first)))
        self.sizes = np.diff(np.append(self.starts, len(self.by_group)))
        self.low, self.high = self.ids[self.by_group[self.starts]], self.ids[self.by_group[self.starts + self.sizes - 1]]
        self.top = float(unit_of(np.abs(self.x).max()))
        self.points = self.x[first] / self.top
        norms = (self.points * self.points).sum(1)
        self.norm = float(np.sqrt(norms.max()))
        unit = np.hstack([self.points, np.sqrt(np.maximum(self.norm**2 - norms, 0))[:, None]]) / self.norm
        self.tree = Tree(unit)


class Search:
    """k largest inner products of each query (scaled) against the distinct vectors of a shard (scaled).

    ``bound``: scores that k rows have anyway; ``own``: ids of the queries, of which vectors that only they have are left out.
    """

    def __init__(self, shard: Shard, q: np.ndarray, k: int, factor: float, bound: np.ndarray | None = None, own: np.ndarray | None = None):
        self.shard, self.q, self.k, self.factor, self.own = shard, q, k, factor, own
        self.reach = np.sqrt((q * q).sum(1)) * shard.norm
        self.bound = np.full(len(q), -np.inf) if bound is None else bound - SLACK * self.reach
        self.score = np.full((len(q), k), -np.inf)
        self.row = np.full((len(q), k), -1, np.int64)
        self.hits, self.waiting = [], 0
        self.home = np.full(len(q), -1, np.int64)  # first row of the leaf that a query lies in
        self.visited = 0
        self._descend(shard.tree.root, np.arange(len(q)), np.zeros(len(q)))
        self._merge()
        self._walk(shard.tree.root, np.arange(len(q)), np.zeros(len(q)))
        self._merge()

    def _descend(self, node, who: np.ndarray, low: np.ndarray) -> None:
        """Each query into one leaf, the likeliest."""
        if isinstance(node, np.ndarray):
            self.home[who] = node[0]
            self._leaf(node, who)
            return
        low_near, low_far = self._lows(node, who, low)
        first = low_near <= low_far
        for side, child, bound in ((first, node[-2], low_near), (~first, node[-1], low_far)):
            if side.any():
                self._descend(child, who[side], bound[side])

    def _walk(self, node, who: np.ndarray, low: np.ndarray) -> None:
        """Every query into all leaves but its own that can hold better rows; ``low``: the largest lower bound of the angle from the vantage points above."""
        open_ = self.factor * low <= self._angle(who) + SLACK
        who, low = who[open_], low[open_]
        if not len(who):
            return
        if isinstance(node, np.ndarray):
            # A whole batch is not copied to leave some queries out.
            self._leaf(node, who if len(who) == len(self.q) else who[self.home[who] != node[0]], again=True)
            return
        low_near, low_far = self._lows(node, who, low)
        sides = [(node[-2], low_near), (node[-1], low_far)]
        for child, bound in sides if 2 * (low_near <= low_far).sum() >= len(who) else sides[::-1]:
            self._walk(child, who, bound)

    def _lows(self, node, who: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``low`` of the two children of a node."""
        vp, n0, n1, f0, f1, *_ = node
        d = np.arccos(np.clip(self._vectors(who) @ self.shard.points[vp] / self.reach[who], -1, 1))
        return np.maximum(low, np.maximum(n0 - d, d - n1)), np.maximum(low, np.maximum(f0 - d, d - f1))

    def _vectors(self, who: np.ndarray) -> np.ndarray:
        return self.q if len(who) == len(self.q) else self.q[who]

    def _least(self, who: np.ndarray) -> np.ndarray:
        """The score that a row must have to be among the query's k best."""
        return np.maximum(self.score[who, -1], self.bound[who])

    def _angle(self, who: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(self._least(who) / self.reach[who], -1, 1))

    def _leaf(self, rows: np.ndarray, who: np.ndarray, again: bool = False) -> None:
        self.visited += len(rows) * len(who)
        s = self._vectors(who) @ self.shard.points[rows].T
        i, j = np.nonzero(s >= self._least(who)[:, None])
        if again:
            new = self.home[who[i]] != rows[0]
            i, j = i[new], j[new]
        if self.own is not None:
            other = (self.shard.low[rows[j]] != self.own[who[i]]) | (self.shard.high[rows[j]] != self.own[who[i]])
            i, j = i[other], j[other]
        self.hits.append((who[i], rows[j], s[i, j]))
        self.waiting += len(i)
        if self.waiting > len(self.q):
            self._merge()

    def _merge(self) -> None:
        """Rank the rows that came in together with the k best so far, ties to the smaller row number."""
        if self.waiting:
            q, row, s = (np.concatenate(c) for c in zip(*self.hits, strict=True))
            who = np.unique(q)
            q = np.concatenate([q, np.repeat(who, self.k)])
            row, s = np.concatenate([row, self.row[who].ravel()]), np.concatenate([s, self.score[who].ravel()])
            order = np.lexsort((row, -s, q))
            q = q[order]
            top = order[np.arange(len(q)) - np.searchsorted(q, q) < self.k]
            self.score[who], self.row[who] = s[top].reshape(-1, self.k), row[top].reshape(-1, self.k)
        self.hits, self.waiting = [], 0


def products(q: np.ndarray, qi: np.ndarray, x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products in double precision of the named rows, from the first component to the last."""
    score = np.zeros(len(rows))
    with np.errstate(over="ignore", invalid="ignore"):
        for at in range(0, len(rows), CHUNK):
            each = q[qi[at : at + CHUNK]] * x[rows[at : at + CHUNK]]
            for j in range(each.shape[1]):
                score[at : at + CHUNK] += each[:, j]
    return score


def best_in_shard(shard: Shard, qids: np.ndarray, q: np.ndarray, bound: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, id, score) of the k best rows of one shard for each query, ties to the smaller id, without the query's own id.

    Scores are those of ``products`` on the original vectors.
    """
    found = Search(shard, scaled(q), min(k, len(shard.points)), factor, bound, qids)
    qi, slot = np.nonzero((found.row >= 0) & (found.score >= found.bound[:, None]))
    g = found.row[qi, slot]
    # Of rows of equal vectors the smallest ids are all that can be ranked: k, and the query's own.
    times = np.minimum(shard.sizes[g], k + 1)
    off = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    qi, g = np.repeat(qi, times), np.repeat(g, times)
    rows = shard.by_group[shard.starts[g] + off]
    score = products(q, qi, shard.x, rows)
    ids = shard.ids[rows]
    keep = ids != qids[qi]
    qi, ids, score = qi[keep], ids[keep], score[keep]
    order = np.lexsort((ids, -score, qi))
    qi, ids, score = qi[order], ids[order], score[order]
    place = np.arange(len(qi)) - np.searchsorted(qi, qi)
    return qi[place < k], ids[place < k], score[place < k]


def centers_of(sample: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """``count`` centers of the (bounded) sample: rows far from each other, then means of their nearest rows."""
    count = min(count, len(sample))
    if not count:
        return sample
    picked, far = [0], ((sample - sample[0]) ** 2).sum(1)
    while len(picked) < count:
        picked.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[picked[-1]]) ** 2).sum(1))
    centers = sample[picked]
    for _ in range(rounds):
        own = nearest_center(sample, centers)[0]
        for c in range(count):
            if (own == c).any():
                centers[c] = sample[own == c].mean(0)
    return centers


def nearest_center(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = (x * x).sum(1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(1)
    own = d.argmin(1)
    return own, np.sqrt(((x - centers[own]) ** 2).sum(1))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    factor: float = 1.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k rows of largest inner product, ties to smaller ids.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do
    vectors of another length than most have, nor rows without an id. Rows that repeat an id are rows of their own, but those equal in
    id and vector count once, as candidates and as queries; no row of a query's own id is among its answers. Components may be as large as doubles are;
    a score beyond them is infinite. With fewer than k candidates all are returned. Empty tables give an empty result. Other columns
    are not read. ``factor`` relaxes the pruning; 1 searches exactly.
    """
    every = usable(vectors, id_col, vector_col)
    asked = usable(queries, id_col, vector_col)
    top = F.max(F.array_max(F.transform("v", F.abs))).alias("top")
    common = every.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), top).orderBy(F.desc("n"), "d").first()
    dim, n, top = (common["d"], common["n"], float(unit_of(common["top"]))) if common else (1, 0, 1.0)
    every, asked = every.where(F.size("v") == dim), asked.where(F.size("v") == dim)
    per = min(max(n // SHARDS, SHARD_ROWS[0]), SHARD_ROWS[1])
    sample = every.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id", "v").limit(SAMPLE).collect()
    some = {(r["vec_id"], tuple(r["v"])) for r in sample}
    some_ids = np.array([i for i, _ in some], np.int64)
    some_x = np.array([v for _, v in some], np.float64).reshape(-1, dim) / top
    order = np.lexsort((*some_x.T, some_ids))
    some_ids, some_x = some_ids[order], some_x[order]
    centers = centers_of(some_x, min(CENTERS, -(-n // per)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, far = nearest_center(_matrix(batch.column(1), dim) / top, centers)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own.astype(np.int32)), pa.array(far)], names=["vec_id", "v", "center", "far"])

    placed = every.mapInArrow(place, "vec_id long, v array<double>, center int, far double")
    stats = {r["center"]: r for r in placed.groupBy("center").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()}
    radius = np.array([stats[c]["far"] if c in stats else -np.inf for c in range(len(centers))])
    parts = np.array([-(-stats[c]["n"] // per) if c in stats else 0 for c in range(len(centers))], np.int64)
    begins = np.concatenate([[0], np.cumsum(parts)])
    asked = materialize(asked.dropDuplicates().withColumn("no", F.monotonically_increasing_id()), "asked")
    blocks = max(1, -(-asked.count() // BLOCK))

    def known(ids: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The k-th best score of each query in the sample."""
        s = q @ some_x.T
        s[ids[:, None] == some_ids[None, :]] = -np.inf
        return np.partition(s, -k, axis=1)[:, -k] if s.shape[1] >= k else np.full(len(q), -np.inf)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query to all shards that can hold one of its k best."""
        for batch in batches:
            ids, q = batch.column(0).to_numpy(), scaled(_matrix(batch.column(1), dim))
            bound = np.concatenate([known(ids[at : at + CHUNK], q[at : at + CHUNK]) for at in range(0, max(len(q), 1), CHUNK)])
            norm = np.sqrt((q * q).sum(1))
            bound = bound - SLACK * norm  # in units of the table's largest component, which may be far larger than a shard's
            best = q @ centers.T + norm[:, None] * np.maximum(radius, 0)[None, :] / factor
            row, c = np.nonzero((best >= bound[:, None]) & (parts > 0)[None, :])
            row, c = np.repeat(row, parts[c]), np.repeat(c, parts[c])
            sub = np.arange(len(row)) - np.searchsorted(row * len(centers) + c, row * len(centers) + c)
            block = (ids[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(blocks)
            yield pa.RecordBatch.from_arrays(
                [pa.array((begins[c] + sub).astype(np.int32)), pa.array(block.astype(np.int32)), pa.array(np.ones(len(row), bool)), pa.array(ids[row]), batch.column(1).take(pa.array(row)), pa.array(bound[row]), batch.column(2).take(pa.array(row))],
                names=["shard", "block", "asked", "id", "v", "bound", "no"],
            )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a shard, then its queries."""
        key, rows, shard = None, [], None
        for batch in batches:
            code = batch.column(0).to_numpy().astype(np.int64) * blocks + batch.column(1).to_numpy()
            is_query = batch.column(2).to_numpy(zero_copy_only=False)
            ids, x, bound = batch.column(3).to_numpy(), _matrix(batch.column(4), dim), batch.column(5).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(code) != 0) | (np.diff(is_query.astype(np.int8)) != 0)) + 1
            for own in np.split(np.arange(len(code)), cuts):
                if code[own[0]] != key:
                    key, rows, shard = code[own[0]], [], None
                if not is_query[own[0]]:
                    again = np.append(False, (np.diff(ids[own]) == 0) & (x[own[1:]] == x[own[:-1]]).all(1))  # copies of a row stand together
                    rows.append((ids[own[~again]], x[own[~again]]))
                    continue
                if shard is None and rows:
                    shard = Shard(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]))
                if shard is not None:
                    with np.errstate(over="ignore", invalid="ignore"):
                        least = np.nan_to_num(bound[own] * (top / shard.top), nan=-np.inf, posinf=np.inf, neginf=-np.inf)
                    qi, found, score = best_in_shard(shard, ids[own], x[own], least, k, factor)
                    at = pa.array(own[qi])
                    yield pa.RecordBatch.from_arrays([batch.column(6).take(at), batch.column(3).take(at), pa.array(found), pa.array(score)], names=["no", "query_id", "vec_id", "score"])

    shard = F.element_at(F.array(*[F.lit(int(b)) for b in begins[:-1]]), F.col("center") + 1) + F.pmod(F.xxhash64("vec_id", "v"), F.element_at(F.array(*[F.lit(int(max(m, 1))) for m in parts]), F.col("center") + 1))
    if not len(centers):
        return every.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    rows = placed.select(shard.cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(False).alias("asked"), F.col("vec_id").alias("id"), "v", F.lit(None).cast("double").alias("bound"), F.lit(None).cast("long").alias("no"))
    every_row = rows.unionByName(asked.mapInArrow(ask, PLACED)).repartition(int(max(1, begins[-1] * blocks)), "shard", "block")
    found = every_row.sortWithinPartitions("shard", "block", "asked", "id", "v").mapInArrow(search, "no long, query_id long, vec_id long, score double")
    best = Window.partitionBy("no").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
