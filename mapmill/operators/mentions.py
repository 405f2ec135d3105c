"""Mentions of dictionary names in a corpus: positions, counts, contexts, years and themes."""

from __future__ import annotations

from bisect import insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapmill.functions import years
from mapmill.functions.text import context, sentence_window, surface_count
from mapmill.operators.lookup import BROADCAST_ROWS, small
from mapmill.operators.ranking import first_n
from mapmill.storage import kept, materialize, release, scratch

#: Names that one automaton holds; a larger dictionary is joined instead.
AUTOMATON_NAMES = 200_000
#: Places that a task keeps in mind at most to tell the first mentions of each name; beyond that all are passed on.
LOCAL_FIRSTS = 2_000_000
#: Characters of an anchor, and the largest bitmap of anchors (16 MB).
ANCHOR, ANCHOR_BITS = 4, 1 << 27
#: Mentions that a task holds at most before it passes them on.
PIECE = 8192
#: Names up to which counting by replacement is cheaper than finding places.
REPLACE_NAMES = 8


def mention_positions(docs: DataFrame, names: DataFrame, id_col: str = "doc_id", text_col: str = "text", name_col: str = "name") -> DataFrame:
    """(doc_id, name, pos): leftmost non-overlapping occurrences of each name, from 0, in code points.

    A dictionary of a checked size is compiled to an automaton that reads each text once in Arrow
    batches, with no shuffle at all; a larger one takes the join of ``anchored_mentions``.
    """
    return _mentions(docs, names, None, None, (), False, id_col, text_col, name_col)


def first_places(docs: DataFrame, names: DataFrame, id_col: str = "doc_id", text_col: str = "text", name_col: str = "name") -> DataFrame:
    """``mention_positions`` with no place of a name behind its first in a text (a dictionary too large for an automaton gives all)."""
    return _mentions(docs, names, None, 1, ("doc_id", "name"), False, id_col, text_col, name_col)


def mention_excerpts(docs: DataFrame, names: DataFrame, radius: int, first: int | None = None, keys: tuple[str, ...] = ("name",), rest: bool = False, id_col: str = "doc_id", text_col: str = "text", name_col: str = "name") -> DataFrame:
    """(doc_id, name, pos, excerpt, at): mentions with the text up to ``radius`` characters before and behind them, and their place in it.

    ``first`` limits the result to the first mentions of each of ``keys``, (name) or (doc_id, name), by document and place. Texts are read once and
    go nowhere: the pass that finds a mention cuts its excerpt, and each task drops what is not among the first it has seen, so
    only a few excerpts a name and task are shuffled. The first of each name and document are not shuffled at all, but for
    those of an id that several rows have (``_first_of_each_text``). With ``rest`` (for the first of each name)
    there is a column ``n`` more, the mentions that a row stands for: those that cannot be among the first are counted in rows without a place.
    """
    if first is not None and keys != ("name",):
        return _first_of_each_text(docs, names, radius, first, keys, id_col, text_col, name_col)
    found = _mentions(docs, names, radius, first, keys, rest, id_col, text_col, name_col)
    return found if first is None or rest else first_n(found, list(keys), [F.col("doc_id"), F.col("pos")], first)


def _first_of_each_text(docs: DataFrame, names: DataFrame, radius: int, first: int, keys: tuple[str, ...], id_col: str, text_col: str, name_col: str) -> DataFrame:
    """The first mentions of each name and document, with their excerpts.

    All excerpts of a text take several times its room, so none is shuffled. What the pass finds first in a text is the result where one row only
    has the id. Texts whose id is repeated are written with a number of their own: their places, without excerpts, are ranked, and
    those that lead meet their text by its number. If more ids are repeated than a broadcast takes, or the names are too many for
    an automaton, all texts go that way.
    """
    dictionary, some = _dictionary(names, name_col)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if len(some) > AUTOMATON_NAMES:
        return _first_of_repeated(src, lambda texts: anchored_mentions(texts, dictionary), radius, first, keys)
    places = lambda texts: _scan(texts, some, None, first, keys, False)
    repeated = materialize(src.groupBy(F.col("doc_id").alias("_id")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_id"), "repeated")
    n = repeated.limit(BROADCAST_ROWS + 1).count()
    if n == 0:
        release(repeated)
        return _scan(src, some, radius, first, keys, False)
    if n > BROADCAST_ROWS:
        release(repeated)
        return _first_of_repeated(src, places, radius, first, keys)
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    once, again = (src.join(F.broadcast(repeated), same, how) for how in ("left_anti", "left_semi"))
    return _scan(once, some, radius, first, keys, False).unionByName(_first_of_repeated(again, places, radius, first, keys))


def _first_of_repeated(src: DataFrame, places: Callable[[DataFrame], DataFrame], radius: int, first: int, keys: tuple[str, ...]) -> DataFrame:
    """``_first_of_each_text`` for ids that several rows have: each text is written and shuffled once, however many mentions ``places`` finds in it."""
    texts = materialize(src.where(F.col("text").isNotNull()).withColumn("_row", F.monotonically_increasing_id()), "texts")
    found = places(texts.select(F.struct("doc_id", "_row").alias("doc_id"), "text"))
    lead = first_n(found.select("doc_id.doc_id", "doc_id._row", "name", "pos"), list(keys), [F.col("doc_id"), F.col("pos"), F.col("_row")], first)
    lead = lead.groupBy("_row").agg(F.collect_list(F.struct("name", "pos")).alias("_found"))
    left = lambda m: F.greatest(m["pos"] - radius, F.lit(0))
    cut = lambda m: F.struct(m["name"].alias("name"), m["pos"].alias("pos"), context(F.col("text"), m["pos"], F.length(m["name"]), radius).alias("excerpt"), (m["pos"] - left(m)).alias("at"))
    return texts.join(lead, "_row").select("doc_id", F.inline(F.transform("_found", cut)))


def _dictionary(names: DataFrame, name_col: str) -> tuple[DataFrame, list[str]]:
    """The distinct names, and a list of them, which has one name more than an automaton holds where they are too many."""
    dictionary = names.select(F.col(name_col).alias("name")).where(F.length("name") > 0).distinct()
    return dictionary, [r.name for r in dictionary.limit(AUTOMATON_NAMES + 1).collect()]


def _mentions(docs: DataFrame, names: DataFrame, radius: int | None, first: int | None, keys: tuple[str, ...], rest: bool, id_col: str, text_col: str, name_col: str) -> DataFrame:
    dictionary, some = _dictionary(names, name_col)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if len(some) > AUTOMATON_NAMES:
        found = anchored_mentions(src.where(F.col("text").isNotNull()), dictionary, radius)
        return found.withColumn("n", F.lit(1).cast("long")) if rest else found
    return _scan(src, some, radius, first, keys, rest)


def _scan(src: DataFrame, some: list[str], radius: int | None, first: int | None, keys: tuple[str, ...], rest: bool) -> DataFrame:
    """The automaton pass over (doc_id, text)."""
    src = src.where(F.col("text").isNotNull())
    schema = f"doc_id {src.schema['doc_id'].dataType.simpleString()}, name string, pos int" + (", excerpt string, at int" if radius is not None else "") + (", n long" if rest else "")
    columns, by_text = [c.split(" ")[0] for c in schema.split(", ")], first is not None and keys != ("name",)
    by_name = first is not None and keys == ("name",) and first * len(some) <= LOCAL_FIRSTS

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for n in some:
            automaton.add_word(n, n)
        if some:
            automaton.make_automaton()
        leading: dict[str, list] = {}  # the first places of each name that this task has seen
        bar: dict[str, tuple] = {}  # the last of them, where there are enough

        for batch in batches:
            rows, found, places, cuts, ats = [], [], [], [], []
            others: dict[str, int] = {}
            ids, texts = batch.column(0), batch.column(1)

            def piece() -> pa.RecordBatch:
                """What was found since the last piece, and the counts of ``others``."""
                none = [None] * len(others)
                ids_out = pa.concat_arrays([ids.take(pa.array(rows, pa.int64())), pa.nulls(len(others), ids.type)])
                arrays = [ids_out, pa.array(found + list(others), pa.string()), pa.array(places + none, pa.int32())]
                arrays += [pa.array(cuts + none, pa.string()), pa.array(ats + none, pa.int32())] if radius is not None else []
                arrays += [pa.array([1] * len(rows) + list(others.values()), pa.int64())] if rest else []
                for made in (rows, found, places, cuts, ats, others):
                    made.clear()
                return pa.RecordBatch.from_arrays(arrays, names=columns)

            for r in range(batch.num_rows):
                text = texts[r].as_py()
                doc = ids[r].as_py() if by_name else None
                free: dict[str, int] = {}
                seen: dict[str, int] = {}
                for end, name in automaton.iter(text) if some else ():
                    begin = end - len(name) + 1
                    if begin < free.get(name, 0):
                        continue
                    free[name] = end + 1
                    if by_name:
                        key = (doc is not None, doc, begin)
                        if name in bar and bar[name] <= key:
                            if rest:
                                others[name] = others.get(name, 0) + 1
                            continue
                        best = leading.setdefault(name, [])
                        insort(best, key)
                        if len(best) >= first:
                            del best[first:]
                            bar[name] = best[-1]
                    elif by_text:
                        seen[name] = seen.get(name, 0) + 1
                        if seen[name] > first:
                            continue
                    rows.append(r)
                    found.append(name)
                    places.append(begin)
                    if radius is not None:
                        left = max(begin - radius, 0)
                        cuts.append(text[left : end + 1 + radius])
                        ats.append(begin - left)
                    if len(rows) >= PIECE:
                        yield piece()
            if rows or others:
                yield piece()

    return src.mapInArrow(find, schema)


def _gram_hashes(text: str, q: int) -> np.ndarray:
    """Hashes of all runs of ``q`` characters of a text."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = len(points) - q + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h = np.full(n, q * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for k in range(q):
        h = (h ^ points[k : n + k]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h


def anchored_mentions(src: DataFrame, dictionary: DataFrame, radius: int | None = None, most_bits: int = ANCHOR_BITS) -> DataFrame:
    """The mentions of a dictionary of any size: each name is looked for where its anchor stands.

    The anchor of a name is the one of its runs of ANCHOR characters (the whole name, if it is shorter) that the fewest names have. A bitmap of a
    checked size, made by Spark from the hashes of all anchors, lets a scan of the texts drop nearly all other places; what is left meets
    the names on the anchor, and is compared with them. Texts are not shuffled: a place takes along as many characters as the longest name has
    on both sides, and ``radius`` more.
    """
    with scratch():
        q = F.least(F.length("name"), F.lit(ANCHOR))
        runs = F.transform(F.sequence(F.lit(1), F.length("name") - q + 1), lambda i: F.substring(F.col("name"), i, q))
        each = dictionary.select("name", F.posexplode(runs).alias("off", "g"))
        often = each.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
        anchors = each.join(often, "g").groupBy("name").agg(F.min_by(F.struct("g", "off"), F.struct("n", "off")).alias("a"))
        # Only a name that ends as it begins can overlap itself.
        again = F.exists(F.sequence(F.lit(1), F.greatest(F.length("name") - 1, F.lit(1))), lambda k: (k < F.length("name")) & (F.substring(F.col("name"), F.lit(1), k) == F.right(F.col("name"), k)))
        anchors = kept(materialize(anchors.select("name", "a.g", "a.off", again.alias("again")), "anchors"))
    size = anchors.agg(F.count(F.lit(1)).alias("n"), F.max(F.length("name")).alias("m"), F.collect_set(F.length("g")).alias("q")).first()
    reach, lengths = (size.m or 0) + (radius or 0), sorted(size.q)
    bits = 64
    while bits < most_bits and bits < 16 * size.n:
        bits *= 2

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.array([_gram_hashes(g, len(g))[0] % np.uint64(bits) for g in batch.column(0).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["word", "bit"])

    words = anchors.select("g").distinct().mapInArrow(marks, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("b")).toArrow()  # at most bits / 64 rows
    bitmap = np.zeros(bits // 64, np.uint64)
    bitmap[words.column("word").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    shared = src.sparkSession.sparkContext.broadcast(bitmap)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = np.uint64(1)
        for batch in batches:
            rows, grams, places, cuts, ats = [], [], [], [], []

            def piece() -> pa.RecordBatch:
                at = pa.array(rows, pa.int64())
                arrays = [batch.column(0).take(at), batch.column(2).take(at), pa.array(grams, pa.string()), pa.array(places, pa.int32()), pa.array(cuts, pa.string()), pa.array(ats, pa.int32())]
                for made in (rows, grams, places, cuts, ats):
                    made.clear()
                return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "_row", "g", "i", "around", "c"])

            for r in range(batch.num_rows):
                text = batch.column(1)[r].as_py()
                for q in lengths:
                    h = _gram_hashes(text, q) % np.uint64(bits)
                    for i in np.flatnonzero(shared.value[(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63)) & one).tolist():
                        left = max(i - reach, 0)
                        rows.append(r)
                        grams.append(text[i : i + q])
                        places.append(i)
                        cuts.append(text[left : i + reach])
                        ats.append(i - left)
                        if len(rows) >= PIECE:
                            yield piece()
            if rows:
                yield piece()

    id_type = src.schema["doc_id"].dataType.simpleString()
    spots = src.select("doc_id", "text", F.monotonically_increasing_id().alias("_row")).mapInArrow(scan, f"doc_id {id_type}, _row long, g string, i int, around string, c int")
    begin = F.col("c") - F.col("off")
    hits = spots.join(small(anchors), "g").where((begin >= 0) & (F.substring(F.col("around"), begin + 1, F.length("name")) == F.col("name")))
    hits = hits.select("_row", "doc_id", "name", "again", (F.col("i") - F.col("off")).cast("int").alias("pos"), *([] if radius is None else [context(F.col("around"), begin, F.length("name"), radius).alias("excerpt"), F.least(begin, F.lit(radius)).cast("int").alias("at")]))
    free = hits.where("NOT again").drop("_row", "again")
    own = hits.where("again").groupBy("_row", "doc_id", "name").agg(F.array_sort(F.collect_list(F.struct(*[c for c in free.columns if c not in ("doc_id", "name")]))).alias("all"))
    start = F.slice("all", 1, 0)
    keep = F.aggregate("all", start, lambda a, p: F.when((F.size(a) == 0) | (p["pos"] >= F.get(a, F.size(a) - 1)["pos"] + F.length("name")), F.concat(a, F.array(p))).otherwise(a))
    return free.unionByName(own.select("doc_id", "name", F.inline(keep)))


def mention_counts(docs: DataFrame, names: DataFrame, text_col: str = "text", name_col: str = "name", id_col: str = "doc_id") -> DataFrame:
    """(name, mentions): occurrences over the corpus, also of names that do not occur."""
    every = names.select(F.col(name_col).alias("name")).distinct()
    if every.limit(REPLACE_NAMES + 1).count() <= REPLACE_NAMES:
        some = [r.name for r in every.collect()]
        sums = docs.agg(*[F.sum(surface_count(F.col(text_col), F.lit(n))).alias(f"c{i}") for i, n in enumerate(some)])
        pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.coalesce(F.col(f"c{i}"), F.lit(0)).alias("mentions")) for i, n in enumerate(some)])
        return sums.select(F.inline(pairs)) if some else every.withColumn("mentions", F.lit(0).cast("long"))
    counted = mention_positions(docs, names, id_col, text_col, name_col).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return every.join(counted, "name", "left").select("name", F.coalesce("n", F.lit(0)).cast("long").alias("mentions"))


def first_mentions(positions: DataFrame, n: int, keys: tuple[str, ...] = ("name",)) -> DataFrame:
    """The first ``n`` mentions of each name, by document and place."""
    return first_n(positions, list(keys), [F.col("doc_id"), F.col("pos")], n)


def contexts(excerpts: DataFrame, radius: int) -> DataFrame:
    """``excerpts`` (of ``mention_excerpts``, of this radius or more) with the text around each mention in place of the excerpt."""
    return excerpts.withColumn("context", context(F.col("excerpt"), F.col("at"), F.length("name"), radius)).drop("excerpt", "at")


def sentences(excerpts: DataFrame, radius: int = 260, marks: str = "。；！？") -> DataFrame:
    """``excerpts`` (of this radius or more) with the sentence (fragment) around each mention, and the mention's place in it (local), in place of the excerpt."""
    cut = sentence_window(F.col("excerpt"), F.col("at"), F.length("name"), radius, marks)
    return excerpts.withColumn("_s", cut).select(*[c for c in excerpts.columns if c not in ("excerpt", "at")], "_s.fragment", "_s.local")


def temporal_context(mentions: DataFrame, anchors: DataFrame | None = None, most: int = 80, patterns: dict[str, str] | None = None, windows=years.TIME_WINDOWS, no_time: str = years.NO_TIME) -> DataFrame:
    """Years of each name from its sentences: primary, earliest, latest, list, count, window, samples.

    ``mentions``: (name, doc_id, pos, fragment, local). The primary year is the least of the years
    nearest to each mention, unless ``anchors`` (name, anchor_year, anchor_note) sets it.
    """
    some = first_n(mentions, ["name"], [F.col("doc_id"), F.col("pos")], most)
    hit = some.withColumn("hits", years.year_hits(F.col("fragment"), patterns)).withColumn("near", years.nearest_year(F.col("hits"), F.col("local")))
    hit = hit.withColumn("_order", F.row_number().over(Window.partitionBy("name").orderBy(F.size("hits") == 0, "doc_id", "pos")))
    sample = F.array_sort(F.collect_list(F.when((F.size("hits") > 0) & (F.col("_order") <= 3), F.struct("_order", "fragment"))))
    agg = hit.groupBy("name").agg(
        F.min("near").alias("near"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform("hits", lambda h: h["year"]))))).alias("years"),
        F.substring(F.array_join(F.transform(sample, lambda s: s["fragment"]), " || "), 1, 900).alias("time_context"),
    )
    out = agg.join(small(anchors), "name", "left") if anchors is not None else agg.withColumn("anchor_year", F.lit(None).cast("int")).withColumn("anchor_note", F.lit(None).cast("string"))
    primary = F.coalesce("anchor_year", "near")
    source = F.when(F.col("anchor_year").isNotNull(), "manual_anchor").when(F.col("near").isNotNull(), "context_sentence")
    return out.select(
        "name", primary.alias("primary_year"), F.array_min("years").alias("earliest_year"), F.array_max("years").alias("latest_year"),
        F.array_join(F.transform(F.slice("years", 1, 18), lambda y: y.cast("string")), ";").alias("year_list"), F.size("years").alias("year_count"),
        years.time_window(primary, windows, no_time).alias("time_type"), source.alias("year_source"), F.col("anchor_note").alias("time_anchor_note"), "time_context",
    )


def theme_counts(contexts_: DataFrame, keywords: DataFrame, key: str, text: str = "context") -> DataFrame:
    """(key, theme, ordinal, n): occurrences of each theme's keywords in the texts of a key.

    ``keywords``: (theme, ordinal, keyword), a configuration table. Its words become one aggregate
    each, so the texts are read once and only sums are shuffled.
    """
    rows = keywords.orderBy("ordinal", "keyword").collect()
    themes = sorted({(r.ordinal, r.theme) for r in rows})
    total = lambda o: sum((surface_count(F.col(text), F.lit(r.keyword)) for r in rows if r.ordinal == o), F.lit(0).cast("long"))
    sums = contexts_.groupBy(key).agg(*[F.sum(total(o)).alias(f"t{o}") for o, _ in themes])
    cells = F.array(*[F.struct(F.lit(t).alias("theme"), F.lit(o).alias("ordinal"), F.coalesce(F.col(f"t{o}"), F.lit(0)).alias("n")) for o, t in themes])
    return sums.select(key, F.inline(cells))


def suffix_candidates(docs: DataFrame, suffixes: list[str], head: str = r"[\x{4e00}-\x{9fff}A-Za-z0-9·（）()]{1,24}", text_col: str = "text", id_col: str = "doc_id", quote: bool = True) -> DataFrame:
    """(doc_id, raw): greedy non-overlapping candidates that end with one of the suffixes, in order of preference."""
    ends = "|".join(("\\Q" + s + "\\E") if quote else s for s in suffixes)
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"({head}(?:{ends}))"), F.lit(1))).alias("raw"))


def seed_presence(docs: DataFrame, seeds: DataFrame, text_col: str = "text", id_col: str = "doc_id", name_col: str = "name") -> DataFrame:
    """(name): seeds that stand somewhere in the corpus; a task passes on no mention of a seed behind the first that it has seen."""
    return _mentions(docs, seeds, None, 1, ("name",), False, id_col, text_col, name_col).select("name").distinct()


def name_frequency(candidates: DataFrame, present_seeds: DataFrame, name: str = "name") -> DataFrame:
    """(name, n): how often each candidate was extracted, and one more for a seed found in the text."""
    return candidates.select(F.col(name).alias("name")).unionByName(present_seeds.select("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def rank_label(rank: Column, name: Column, count: Column) -> Column:
    return F.concat(rank.cast("string"), F.lit(". "), name, F.lit("（"), count.cast("string"), F.lit("次）"))
