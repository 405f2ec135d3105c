"""Near-duplicate texts by MinHash with tensored banding, and links verified on full sets.

Two collections of ``side`` half-keys are made, each half-key from ``rows`` minima; table (i, j)
is keyed by half-key i of the first and j of the second collection, so side^2 tables need only
2 * side half-keys. Texts of equal shingle sets are one class, and only one id of it goes on.
A half-key that no other class has cannot meet in any table, so it is dropped before the pairs
of half-keys are formed.

The tables (i, i) come first: in each bucket every member is compared with one head. Heads are drawn by a hash of the class
alone, so the buckets of a dense group have few different ones and it costs few pairs a member; verified links join components.
What the heads leave open ends in one exact comparison over all
tables: of the classes that still share a table with another component, shingles are ordered rare ones
first, and every pair of different components whose sets can be similar meets in a shingle of both
prefixes, while what many texts have in common stands behind the prefixes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapmill.llm.components import components
from mapmill.llm.ragged import Words, mix, reduce_min, signed, text_slices
from mapmill.storage import materialize, release

SHINGLE = 5
PERCENT = 75
#: Half-keys a side and minima in each: 256 tables of six minima from 96; a pair of similarity 0.75 shares
#: a table but for 2 * (1 - 0.75^3)^16 = 0.03 % of cases, one of 0.2 in 1.6 %.
SIDE, ROWS = 16, 3
#: Bits of a set that bound from below how much two sets differ, before they are compared.
BITS = 1024
_RNG = np.random.default_rng(7)
_MULT = _RNG.integers(0, 2**64, 4096, dtype=np.uint64) | np.uint64(1)

SIGNATURE = "doc_id long, text_hash long, n_shingles long, f1 long, f2 long, halves array<long>"


def fingerprint(hashes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """A hash of each set of shingle hashes; ``begins`` are the starts of the sets, none of which is empty."""
    return np.add.reduceat(mix(hashes ^ np.uint64(0x9E3779B97F4A7C15)), begins)


def signatures(h: np.ndarray, first: np.ndarray, side: int, rows: int, collections: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(set sizes, two set fingerprints, ``collections * side`` keys) of runs of shingle hashes; empty sets have no meaning but size 0."""
    n = len(first) - 1
    sizes, f1, f2 = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    text = np.repeat(np.arange(n), np.diff(first))
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(text[order], kind="stable")]
    hs, ts = h[order], text[order]
    new = np.ones(len(hs), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (ts[1:] != ts[:-1])
    hs, ts = hs[new], ts[new]
    sizes = np.bincount(ts, minlength=n).astype(np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    full = np.flatnonzero(sizes)
    if len(full):
        f1[full] = fingerprint(hs, begins[:-1][full])
        f2[full] = np.add.reduceat(mix(hs + np.uint64(0xD1B54A32D192ED03)), begins[:-1][full])
    halves = np.zeros((n, collections * side), np.uint64)
    for s in range(collections * side):
        key = np.full(n, s, np.uint64)
        for r in range(rows):
            key = mix(key * np.uint64(31) + reduce_min(hs * _MULT[s * rows + r], begins))
        halves[:, s] = key
    return sizes, f1, f2, halves


def sign(docs: DataFrame, id_col: str, text_col: str, k: int = SHINGLE, side: int = SIDE, rows: int = ROWS) -> DataFrame:
    """(doc_id, text_hash, n_shingles, f1, f2, halves) of each row; halves is null for an empty set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_slices(batch):
                sizes, f1, f2, halves = signatures(*Words(data, offsets).shingles(k), side, rows)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(signed(halves.ravel())), 2 * side).cast(pa.list_(pa.int64()))
                lists = pc.if_else(pa.array(sizes == 0), pa.scalar(None, lists.type), lists)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(sizes), pa.array(signed(f1)), pa.array(signed(f2)), lists],
                    names=["doc_id", "text_hash", "n_shingles", "f1", "f2", "halves"],
                )

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    return src.mapInArrow(work, SIGNATURE)


def set_bits(hashes: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Lists of BITS bits, as longs, of sets of hashes that end at ``ends[1:]``: whether an odd number of hashes falls on each.

    Two sets differ in as many elements at least as their bits do in places.
    """
    n = len(ends) - 1
    place = np.repeat(np.arange(n) * BITS, np.diff(ends)) + (mix(hashes.view(np.uint64)) % np.uint64(BITS)).astype(np.int64)
    odd = (np.bincount(place, minlength=n * BITS) & 1).astype(np.uint8)
    return pa.FixedSizeListArray.from_arrays(pa.array(np.packbits(odd).view(np.int64)), BITS // 64).cast(pa.list_(pa.int64()))


def shingle_sets(texts: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(doc_id, shingles, bits) of ``texts`` (doc_id, text): the sorted distinct shingle hashes of each whole text, and their ``set_bits``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_slices(batch):
                h, first = Words(data, offsets).shingles(k)
                sets = [np.unique(signed(h[first[r] : first[r + 1]])) for r in range(j - i)]
                bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists, set_bits(flat, bounds)], names=["doc_id", "shingles", "bits"])

    return texts.mapInArrow(work, "doc_id long, shingles array<long>, bits array<long>")


def with_component(frame: DataFrame, comp: DataFrame | None) -> DataFrame:
    """``frame`` with the component ``c`` of each ``rep``; a class without links is its own."""
    if comp is None:
        return frame.withColumn("c", F.col("rep"))
    return frame.join(comp, F.col("rep") == F.col("node"), "left").withColumn("c", F.coalesce("component", "rep")).drop("node", "component")


def keys_in_common(frame: DataFrame, side: int | None) -> DataFrame:
    """``frame`` (rep, n, own, and c if there are components) with those keys of ``own`` only that others have too: classes of other components,
    or without components any other class. Classes without any such key are left out.
    """
    linked = "c" in frame.columns
    keys = frame.select("rep", *["c"] * linked, F.explode("own").alias("x")).select("rep", *["c"] * linked, "x.s", "x.hk")
    ends = keys.groupBy("hk").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi") if linked else keys.groupBy("hk").count().where("count > 1")
    own = keys.drop("c").join(materialize(ends.select(F.col("hk").alias("common_hk")), "common"), F.col("hk") == F.col("common_hk"))
    own = own.groupBy(F.col("rep").alias("r")).agg(F.collect_list(F.struct("s", "hk")).alias("own"))
    if side is not None:
        own = own.where(F.exists("own", lambda x: x["s"] < side) & F.exists("own", lambda x: x["s"] >= side))
    return frame.drop("own").join(own, F.col("rep") == F.col("r")).drop("r")


def in_tables(frame: DataFrame, side: int | None, diagonal: bool) -> DataFrame:
    """(rep, n, c, tkey) for the tables (i, i), or for all tables. Without ``side`` each key is a table."""
    own = F.col("own")
    if side is None:
        tkeys = F.transform(own, lambda x: x["hk"])
    else:
        firsts = F.filter(own, lambda x: x["s"] < side)
        second = lambda x: F.filter(own, lambda y: y["s"] == x["s"] + side if diagonal else y["s"] >= side)
        tkeys = F.flatten(F.transform(firsts, lambda x: F.transform(second(x), lambda y: F.xxhash64(x["hk"], y["hk"]))))
    return frame.select("rep", "n", "c", F.explode(tkeys).alias("tkey"))


def head_pairs(keys: DataFrame, percent: int) -> DataFrame:
    """(a, b, ca, cb): the head of each bucket with its members of other components and of a size that allows the similarity."""
    head = F.struct(F.xxhash64("rep").alias("o"), "rep", "n", "c")
    heads = keys.groupBy("tkey").agg(F.min(head).alias("h"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1")
    heads = materialize(heads.select(F.col("tkey").alias("k"), "h"), "heads")
    near = (F.col("tkey") == F.col("k")) & (F.col("c") != F.col("h.c")) & (100 * F.least("n", "h.n") >= percent * F.greatest("n", "h.n"))
    return keys.join(heads, near).select(F.col("h.rep").alias("a"), F.col("rep").alias("b"), F.col("h.c").alias("ca"), F.col("c").alias("cb")).distinct()


def open_members(frame: DataFrame, side: int | None) -> DataFrame:
    """(rep, n, c): the classes of ``frame`` (rep, n, c, own) that share a table with another component."""
    keys = materialize(in_tables(keys_in_common(frame, side), side, False), "open_tables")
    ends = keys.groupBy("tkey").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select(F.col("tkey").alias("k"))
    return keys.join(materialize(ends, "open_ends"), F.col("tkey") == F.col("k"), "left_semi").select("rep", "n", "c").distinct()


def prefix_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All pairs of ``members`` (rep, n, c) of different components that can have the similarity, by prefixes of their sets.

    Shingles are ordered by the members that have them, rare ones first; before all stand those of a
    single component, which no pair shares. Two sets of a similar pair meet in the first shingles of the larger one, all but percent / 100 of its
    size, and in still fewer of the smaller one, all but 2 * percent / (100 + percent) of its. The pair has percent * (n + m) / (100 + percent)
    shingles in common, so at the first of them in this order at least so many are left in both sets; and its sets differ in no
    more elements than the similarity allows, which their bits tell from below.
    Of the members that meet in a shingle, those of its main component are not compared with each other.
    """
    own = members.select(F.col("rep").alias("m_rep"), F.col("n").alias("m_n"), F.col("c").alias("m_c"))
    full = sets.join(own, F.col("doc_id") == F.col("m_rep")).select("m_rep", "m_n", "m_c", F.explode("shingles").alias("s"))
    live = full.groupBy("s").agg(F.count(F.lit(1)).cast("int").alias("f"), F.min("m_c").alias("c0"), F.max("m_c").alias("c1")).where("c0 < c1").select(F.col("s").alias("k"), "f")
    met = full.select("m_rep", "m_n", "s").join(materialize(live, "live"), F.col("s") == F.col("k"))
    lists = met.groupBy("m_rep", "m_n").agg(F.sort_array(F.collect_set(F.struct("f", "s"))).alias("xs"))
    least, size = F.ceil(F.col("m_n") * percent / 100).cast("int"), F.size("xs")
    # With a partner that is not smaller a set shares more; only so few of its shingles are looked up among those of the larger ones.
    most = F.ceil(F.col("m_n") * 2 * percent / (100 + percent)).cast("int")
    lists = lists.where(size >= least).select("m_rep", size.alias("size"), (size - most + 1).alias("few"), F.posexplode(F.slice("xs", 1, size - least + 1)).alias("i", "x"))
    bits = sets.select("doc_id", "bits").join(members, F.col("doc_id") == F.col("rep"))
    pre = bits.join(lists, F.col("rep") == F.col("m_rep")).select("rep", "c", F.col("n").cast("long").alias("n"), "bits", F.col("x.s").alias("s"), (F.col("size") - F.col("i")).alias("left"), (F.col("i") < F.col("few")).alias("short"))
    pre = materialize(pre, "prefixes")
    tops = pre.groupBy("s", "c").agg(F.count(F.lit(1)).alias("k")).groupBy("s").agg(F.max(F.struct("k", "c"))["c"].alias("main"), F.count(F.lit(1)).alias("parts"))
    tops = materialize(tops.where("parts > 1").select(F.col("s").alias("k"), "main"), "tops")
    others = pre.join(tops, (F.col("s") == F.col("k")) & (F.col("c") != F.col("main"))).drop("k")
    # Of two members outside the main component, each pair is formed once.
    once = (F.col("y.c") == F.col("x.main")) | (F.col("x.c") < F.col("y.c"))
    enough = (100 + percent) * F.least("x.left", "y.left") >= percent * (F.col("x.n") + F.col("y.n"))
    apart = sum((F.bit_count(F.get("x.bits", F.lit(i)).bitwiseXOR(F.get("y.bits", F.lit(i)))) for i in range(BITS // 64)), F.lit(0))
    close = (100 + percent) * apart <= (100 - percent) * (F.col("x.n") + F.col("y.n"))
    smaller = (F.col("x.short") & (F.col("x.n") <= F.col("y.n"))) | (F.col("y.short") & (F.col("y.n") <= F.col("x.n")))
    pairs = others.alias("x").join(pre.alias("y"), (F.col("x.s") == F.col("y.s")) & (F.col("x.c") != F.col("y.c")) & smaller & once & enough & close)
    return pairs.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"), F.least("x.c", "y.c").alias("ca"), F.greatest("x.c", "y.c").alias("cb")).distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """(ca, cb) of the pairs whose full sets have the similarity, None without any; only the sets of these pairs are shuffled."""
    pairs = materialize(pairs, "pairs")
    if pairs.isEmpty():
        return None
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("wanted_id")).distinct()
    some = materialize(sets.join(wanted, F.col("doc_id") == F.col("wanted_id"), "left_semi"), "some_sets")
    of = lambda side: some.select(F.col("doc_id").alias(f"{side}_id"), F.col("shingles").alias(f"{side}_set"))
    both = pairs.join(of("a"), F.col("a") == F.col("a_id")).join(of("b"), F.col("b") == F.col("b_id"))
    common = F.size(F.array_intersect("a_set", "b_set")).cast("long")
    both = both.select("ca", "cb", common.alias("common"), (F.size("a_set") + F.size("b_set")).cast("long").alias("total"))
    found = materialize(both.where(100 * F.col("common") >= percent * (F.col("total") - F.col("common"))).select("ca", "cb").distinct(), "found")
    release(some)
    release(pairs)
    return None if found.isEmpty() else found


def joined(comp: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components ``comp`` (node, component) after ``links`` (ca, cb) between them."""
    new = components(links, "ca", "cb")
    if comp is None:
        return new
    to = new.select(F.col("node").alias("old"), F.col("component").alias("now"))
    moved = comp.join(to, F.col("component") == F.col("old"), "left").select("node", F.coalesce("now", "component").alias("component"))
    out = materialize(moved.unionByName(new.join(comp.select("node"), "node", "left_anti")), "comp")
    release(comp)
    return out


def meeting_classes(reps: DataFrame, side: int | None) -> DataFrame:
    """(rep, n, own) of the classes of ``reps`` (rep, n, halves) that have a key with another class, and these keys.

    With ``side``, the halves are two collections of so many half-keys, and one of each is needed; without, each one is a table of its own.
    """
    keyed = reps.select("rep", "n", F.transform("halves", lambda x, i: F.struct(i.cast("int").alias("s"), x.alias("hk"))).alias("own"))
    return materialize(keys_in_common(keyed, side), "keyed")


def link_classes(keyed: DataFrame, sets: DataFrame, side: int | None, percent: int = PERCENT) -> DataFrame | None:
    """(node, component) of linked classes, None without any. ``keyed``: see ``meeting_classes``; ``sets``: (doc_id, shingles) by class."""
    found = verified(head_pairs(in_tables(with_component(keyed, None), side, True), percent), sets, percent)
    comp = None if found is None else joined(None, found)
    members = materialize(open_members(with_component(keyed, comp), side), "members")
    # Of all tables, members of different components are compared exactly.
    found = None if members.isEmpty() else verified(prefix_pairs(members, sets, percent), sets, percent)
    return comp if found is None else joined(comp, found)


def labelled(classes: DataFrame, comp: DataFrame | None, rep: str) -> DataFrame:
    """``classes`` with the ``label`` of their component; a class without links has its own ``rep``."""
    if comp is None:
        return classes.withColumn("label", F.col(rep))
    return classes.join(comp, F.col(rep) == F.col("node"), "left").withColumn("label", F.coalesce("component", rep)).drop("node", "component")


def groups(docs: DataFrame, id_col: str, text_col: str, side: int, rows: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The signatures of all rows, and (set, component_id, one): the group of each set ``f1``.

    ``component_id`` is the smallest id of the group and ``one`` the row (none, doc_id, text_hash) that stays of it, where
    ``none`` says that it has no id: rows without an id come last.
    """
    sig = materialize(sign(docs, id_col, text_col, SHINGLE, side, rows), "signatures")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    classes = sig.where("n_shingles > 0").groupBy("f1", "f2", "n_shingles").agg(F.min(row).alias("one"), F.first("halves").alias("halves"))
    classes = materialize(classes.groupBy("f1").agg(F.max("n_shingles").alias("n"), F.min("one").alias("one"), F.max("halves").alias("halves")), "classes")

    keyed = meeting_classes(classes.select(F.col("f1").alias("rep"), "n", "halves"), side)
    wanted = classes.join(keyed, F.col("f1") == F.col("rep"), "left_semi").select("f1", F.col("one.doc_id").alias("w_id"), F.col("one.text_hash").alias("w_hash"))
    # The sets have no size bound, so this is a shuffled join at any size of the table.
    met = docs.join(wanted.hint("merge"), F.col(id_col).cast("long").eqNullSafe(F.col("w_id")) & (F.xxhash64(text_col) == F.col("w_hash")))
    # Rows that repeat an id and its text are one set.
    once = met.select(F.col("f1").alias("doc_id"), F.col(text_col).alias("text")).dropDuplicates(["doc_id"])
    sets = materialize(shingle_sets(once), "sets")
    comp = link_classes(keyed, sets, side, percent)
    release(sets)
    of = materialize(labelled(classes.select(F.col("f1").alias("set"), "one"), comp, "set"), "labels")
    whole = materialize(of.groupBy(F.col("label").alias("l")).agg(F.min("one").alias("one")), "groups")
    return sig, of.drop("one").join(whole, F.col("label") == F.col("l")).select("set", F.col("one.doc_id").alias("component_id"), "one")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", side: int = SIDE, rows: int = ROWS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row.

    A-Z are lower-cased; the set of a text is its distinct five-word shingles, or its whole word
    sequence with fewer words. Texts with 100 * common >= 75 * union are linked. A null or blank
    text has an empty set and is linked with nothing. Each row is a document of its own: rows that
    repeat an id are kept or not as their groups say. A row without an id takes part; a group without any id has a null
    component_id, and kept compares null with null as equal. An empty table gives an
    empty result. A text is handled whole however long, in blocks of ``ragged.SLICE`` bytes. Only the two named columns are read.
    """
    sig, of = groups(docs, id_col, text_col, side, rows, percent)
    out = sig.where("n_shingles > 0").join(of, F.col("f1") == F.col("set")).select("doc_id", "n_shingles", "component_id")
    out = out.unionByName(sig.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", side: int = SIDE, rows: int = ROWS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each group of near duplicates: the one of the smallest id, a row without an id only where no other is.

    Rows equal in id (or both without one) and text are one document, of which one row stays, blank texts included; other
    blank texts all stay. Other columns pass through unread; which of such rows' values stay is open where they differ.
    """
    sig, of = groups(docs, id_col, text_col, side, rows, percent)
    stay = of.select("one.doc_id", "one.text_hash").unionByName(sig.where("n_shingles = 0").select("doc_id", "text_hash")).distinct()
    key = lambda frame, i, h: frame.withColumns({"_no_id": F.col(i).isNull(), "_id": F.coalesce(F.col(i).cast("long"), F.lit(0)), "_hash": h})
    stay = key(stay, "doc_id", F.col("text_hash")).select("_no_id", "_id", "_hash")
    # Repeated rows are combined on the map side; the join finds them dealt by its own keys. What stays has no size bound.
    once = key(docs, id_col, F.xxhash64(text_col)).dropDuplicates(["_no_id", "_id", "_hash"])
    return once.join(stay.hint("merge"), ["_no_id", "_id", "_hash"], "left_semi").select(*docs.columns)
