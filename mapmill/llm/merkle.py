"""Merkle manifest of a table: one ternary tree a source, one tree over their roots, and a proof for every row.

Nodes are stored only at every ``every``-th level (checkpoints). On the way up, each block of ``3 ** every`` neighbouring
nodes is reduced to the one node above it and the levels between are thrown away. On the way down, each block regenerates
those levels from its stored nodes, gives every one of them its siblings, appends the proof of the block's top and
throws the levels away again. A block never holds more than ``3 ** every`` digests, whatever the size of a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapmill.llm.words import let
from mapmill.operators.ranking import rank_by_key
from mapmill.storage import kept, materialize, release, scratch

#: Children of a node.
FAN = 3
#: Levels between two stored ones: a block holds 243 digests of 64 characters.
EVERY = 5
#: Fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _field(c: Column) -> Column:
    """Length and value of a field, ``-`` for null."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*map(_field, fields)), 256)


def tampered(doc_id: Column) -> Column:
    """Rows whose copy is tampered with: an even CRC of the decimal id. A null id is left alone."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.lit(False))


def _joined(digests: Column) -> Column:
    return F.array_join(digests, "")


def _above(nodes: Column) -> Column:
    """The next level of one block."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FAN).cast("int")), lambda j: F.sha2(_joined(F.slice(nodes, j * FAN + 1, FAN)), 256))


def _levels_left(count: Column, every: int) -> Column:
    """Levels that a block of a tree of ``count`` nodes is reduced by: up to the top, at most ``every``."""
    left = F.lit(0)
    for k in range(every):
        left = left + (count > FAN**k).cast("int")
    return left


def _levels(digests: Column, count: Column, every: int) -> Column:
    """All levels of a block: array of levels, each an array of digests, the stored nodes first and the top last."""
    steps = F.when(_levels_left(count, every) > 0, F.sequence(F.lit(1), _levels_left(count, every))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.array(digests), lambda acc, _: let(F.element_at(acc, -1), lambda top: F.concat(acc, F.array(_above(top)))))


def _blocks(nodes: DataFrame, keys: list[str], every: int, carry: list[str]) -> DataFrame:
    """(keys, block, count, nodes): neighbouring nodes by position; at most ``FAN ** every`` in a row."""
    entry = F.struct("pos", "digest", *carry)
    return nodes.groupBy(*keys, F.floor(F.col("pos") / FAN**every).alias("block")).agg(F.first("count").alias("count"), F.array_sort(F.collect_list(entry)).alias("nodes"))


def _digests(nodes: str = "nodes") -> Column:
    return F.transform(nodes, lambda e: e["digest"])


def climb(nodes: DataFrame, keys: list[str], every: int = EVERY) -> tuple[list[DataFrame], DataFrame]:
    """The stored levels of the trees of ``nodes`` (keys, pos from 0, digest, count of the key), and (keys, digest) of their tops.

    Each level is a written table with one row for ``FAN ** every`` rows of the level below.
    """
    levels = [nodes]
    while True:
        below = levels[-1]
        if below.agg(F.max("count")).first()[0] in (None, 0, 1):
            break
        block = _blocks(below.where("count > 1"), keys, every, [])
        top = F.element_at(F.element_at(_levels(_digests(), F.col("count"), every), -1), 1)
        size = F.ceil(F.col("count") / FAN**every).cast("long")
        levels.append(materialize(block.select(*keys, F.col("block").alias("pos"), top.alias("digest"), size.alias("count")), "nodes"))
    tops = levels[0].where("count = 1")
    for level in levels[1:]:
        tops = tops.select(*keys, "digest").unionByName(level.where("count = 1").select(*keys, "digest"))
    return levels, tops.select(*keys, "digest")


STEP = "array<struct<before:string,after:string>>"


def _own_steps(levels: Column, place: Column) -> Column:
    """The siblings of the node at ``place`` of a block, level by level: those before and those after it in its run."""

    def step(level: Column, k: Column) -> Column:
        pos = F.floor(place / F.pow(F.lit(float(FAN)), k)).cast("int")
        before = _joined(F.slice(level, pos - pos % FAN + 1, pos % FAN))
        after = _joined(F.slice(level, pos + 2, FAN - 1 - pos % FAN))
        return F.struct(before.alias("before"), after.alias("after"))

    return F.transform(F.slice(levels, 1, F.size(levels) - 1), step)


def _descend(level: DataFrame, above: DataFrame, keys: list[str], every: int, carry: list[str]) -> DataFrame:
    """(keys, pos, digest, carry, steps, top columns) of each node of ``level``, from the proofs of the blocks' tops in ``above``.

    ``above`` has (keys, pos, steps and further columns); its rows are one a block, so blocks and proofs meet on the same key that the
    blocks are grouped by.
    """
    more = [c for c in above.columns if c not in (*keys, "pos", "steps")]
    block = _blocks(level, keys, every, carry)
    a = above.select(*[F.col(k).alias(f"_a{i}") for i, k in enumerate(keys)], F.col("pos").alias("_ap"), F.col("steps").alias("_rest"), *more)
    same = F.col("block") == F.col("_ap")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_a{i}"))
    met = block.join(a, same)

    def told(levels: Column) -> Column:
        return F.transform("nodes", lambda e: F.struct(*[e[c].alias(c) for c in ("pos", "digest", *carry)], _own_steps(levels, (e["pos"] % FAN**every).cast("int")).alias("own")))

    out = met.select(*keys, "_rest", *more, F.explode(let(_levels(_digests(), F.col("count"), every), told)).alias("e"))
    return out.select(*keys, *[F.col(f"e.{c}").alias(c) for c in ("pos", "digest", *carry)], F.concat("e.own", "_rest").alias("steps"), *more)


def prove(levels: list[DataFrame], tops: DataFrame, keys: list[str], every: int = EVERY, carry: tuple[str, ...] = ()) -> DataFrame:
    """(keys, pos, digest, carry, steps and the further columns of ``tops``) of every node of the lowest level.

    ``tops`` has one row a tree: its keys, the ``steps`` that go on above its top, and further columns for every row of the tree.
    ``carry`` names columns of the lowest level that go along.
    """
    above = None
    for k in range(len(levels) - 1, -1, -1):
        level, own = levels[k], list(carry) if k == 0 else []
        ended = level.where("count = 1").withColumnsRenamed({c: f"_t{i}" for i, c in enumerate(keys)})
        same = F.lit(True)
        for i, c in enumerate(keys):
            same &= F.col(c).eqNullSafe(F.col(f"_t{i}"))
        more = [c for c in tops.columns if c not in (*keys, "steps")]
        found = ended.join(tops, same).select(*keys, "pos", "digest", *own, "steps", *more)
        if above is not None:
            found = found.unionByName(_descend(level.where("count > 1"), above, keys, every, own))
        if k:
            done, above = above, materialize(found.drop("digest"), "proofs")
            for t in (level, done):
                release(t)
        else:
            above = found
    return above


def proof_digest(steps: Column) -> Column:
    """Hash of all siblings, level by level, left to right."""
    return F.sha2(_joined(F.transform(steps, lambda s: F.concat(s["before"], s["after"]))), 256)


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(steps, leaf, lambda acc, s: F.sha2(F.concat(s["before"], acc, s["after"]), 256))


def positions(leaves: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """``leaves`` with pos, from 0 inside each key, and the count of their key, written to the shared folder."""
    with scratch():
        return kept(materialize(rank_by_key(leaves, keys, order, "_rank", "count").withColumn("pos", F.col("_rank") - 1).drop("_rank"), name))


def manifest(docs: DataFrame, every: int = EVERY) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    Rows of a source stand by doc_id (null first) and, where ids are the same, by leaf; repeated rows are leaves of their own with equal
    digests. A null source is a source, the first one. Null fields count as null, empty texts as empty. A tree of one leaf is that leaf,
    with a proof of the steps above it. An empty table gives no row and has no root. Only the five fields are read, others may stand beside
    them. A text goes through one hash as a whole.
    """
    fields = [F.col(c) for c in FIELDS]
    cleaned = [F.replace(c, F.lit("\n"), F.lit("")) if c_name == "text" else c for c_name, c in zip(FIELDS, fields, strict=True)]
    leaf = leaf_digest(fields)
    other = F.when(tampered(F.col("doc_id")) & F.contains(F.col("text"), F.lit("\n")), leaf_digest(cleaned))
    leaves = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", leaf.alias("digest"), other.alias("changed"))
    placed = positions(leaves, ["source"], [F.col("doc_id"), F.col("digest")], "leaves")
    levels, tops = climb(placed, ["source"], every)
    hosts = positions(tops.select(F.lit(0).alias("tree"), F.col("source").alias("host"), "digest"), ["tree"], [F.col("host")], "hosts")
    upper, root = climb(hosts, ["tree"], every)
    peak = root.select("tree", F.col("digest").alias("root"), F.array().cast(STEP).alias("steps"))
    with scratch():
        over = prove(upper, materialize(peak, "peak"), ["tree"], every, ("host",))
        over = kept(materialize(over.select(F.col("host").alias("source"), F.col("digest").alias("subroot"), "root", "steps"), "over"))
    release(hosts)
    rows = prove(levels, over, ["source"], every, ("doc_id", "changed"))
    folded = fold(F.coalesce("changed", "digest"), F.col("steps"))
    out = rows.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
