"""Pairs of names that are contained in each other or similar, found without comparing all of them, and without losing any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapmill.functions.text import let
from mapmill.storage import materialize

#: The commonest grams that are told apart by their counts; all others come before them.
COMMON = 128
#: Kept off the bounds so that rounding never loses a pair.
EPS = 1e-6


def gram_list(name: Column, q: int) -> Column:
    """All runs of ``q`` characters of a name; none if it is shorter."""
    return F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.length(name) - (q - 1), F.lit(1))), lambda i: i + (q - 1) <= F.length(name)), lambda i: F.substring(name, i, F.lit(q)))


def tokens(name: Column, q: int) -> Column:
    """The runs of ``q`` characters with a number for each repetition, so that common tokens count common runs as often as they stand."""
    return let(F.array_sort(gram_list(name, q)), lambda s: F.transform(s, lambda g, i: F.concat(g, F.lit("\x00"), (i - F.array_position(s, g)).cast("string"))))


def contained_pairs(whole: DataFrame, x: str, part: DataFrame, y: str) -> DataFrame:
    """(x, y): each distinct name of ``part`` with the names of ``whole`` that contain it (or are it).

    A part is looked up by one of its runs of two characters only, the one that the fewest names of ``whole`` have; a part with a run that none has is
    dropped. Parts of one character are looked up by it.
    """
    runs = lambda c: F.concat(gram_list(c, 2), gram_list(c, 1))
    at = whole.select(x, F.explode(F.array_distinct(runs(F.col(x)))).alias("_g"))
    seen = at.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    own = F.when(F.length(y) > 1, gram_list(F.col(y), 2)).otherwise(gram_list(F.col(y), 1))
    asked = part.select(y, F.explode(F.array_distinct(own)).alias("_g")).join(seen, "_g", "left")
    anchor = asked.groupBy(y).agg(F.min_by("_g", F.struct("_n", "_g")).alias("_g"), F.count_if(F.col("_n").isNull()).alias("_gone")).where("_gone = 0").drop("_gone")
    return at.join(anchor, "_g").where(F.contains(F.col(x), F.col(y))).select(x, y)


class Bound:
    """What a similarity of at least ``t`` says about lengths and common runs. ``t`` may be a column or a number.

    ``levenshtein``: at most (1 - t) of the longer length is edited, and an edit takes at most two runs of two characters.
    ``ratio``: at least t / 2 of all characters stand in common blocks, and between two blocks a character is left over.
    """

    def __init__(self, metric: str, t):
        self.edit, self.t = metric == "levenshtein", t

    def shortest(self, n: Column) -> Column:
        """Length of the shortest partner of a name of ``n`` characters."""
        return n * self.t - EPS if self.edit else n * self.t / (2 - self.t) - EPS

    def longest(self, n: Column) -> Column:
        return n / self.t + EPS if self.edit else n * (2 - self.t) / self.t + EPS

    def common(self, q: int, a: Column, b: Column) -> Column:
        """Tokens of ``q`` characters that names of lengths ``a`` and ``b`` share at least."""
        t = self.t
        if self.edit:
            m = F.greatest(a, b)
            return m * t - EPS if q == 1 else m * (2 * t - 1) - 1 - EPS
        return (a + b) * t / 2 - EPS if q == 1 else (a + b) * (1.5 * t - 1) - 1 - EPS

    def least(self, q: int, n: Column) -> Column:
        """The same for any partner of a name of ``n`` characters, where it is positive."""
        return self.common(q, n, n if self.edit else n * self.t / (2 - self.t))

    def by_two(self, n: Column) -> Column:
        """Whether runs of two characters can find every partner that they can find, too."""
        return self.least(2, n) > 0


def _prefix(name: Column, q: int, keep: Column, common: list[str]) -> Column:
    """The ``keep`` rarest tokens of a name, in an order that is the same for all names."""
    known = F.array(*[F.lit(g) for g in common]) if common else F.array().cast("array<string>")
    ordered = F.array_sort(F.transform(tokens(name, q), lambda g: F.struct(F.array_position(known, F.substring(g, 1, q)).alias("r"), g.alias("g"))))
    return F.transform(F.slice(ordered, 1, F.greatest(keep, F.lit(0)).cast("int")), lambda e: e["g"])


def _common(names: DataFrame) -> list[str]:
    """The commonest runs of one and two characters, the rarest of them first; at most COMMON."""
    runs = F.concat(gram_list(F.col("n"), 1), gram_list(F.col("n"), 2))
    return [r.g for r in reversed(names.select(F.explode(runs).alias("g")).groupBy("g").count().orderBy(F.desc("count"), "g").limit(COMMON).collect())]


def similar_pairs(left: DataFrame, x: str, right: DataFrame, y: str, metric: str, least: float, own: str | None = None) -> DataFrame:
    """Distinct (x, y) among which are all pairs of a similarity of at least ``least``, or of the column ``own`` of ``left``, which is never smaller.

    Two names that share k of their tokens share one among the rarest of each (all but k - 1), so only these meet: runs of two characters where so
    similar names must share one, single characters where a name is short. Pairs that meet are held against a bound of length, and then against
    the edit distance itself or a bound by their common characters, before they are returned.
    """
    low = Bound(metric, least)
    mine = Bound(metric, F.col("_t")) if own else low
    a = left.where(F.length(x) > 0).select(x, *([F.col(own).alias("_t")] if own else []), F.length(x).alias("_la")).distinct()
    b = right.where(F.length(y) > 0).select(y, F.length(y).alias("_lb")).distinct()
    common = _common(a.select(F.col(x).alias("n")).union(b.select(y)))

    def rarest(df: DataFrame, c: str, length: str, bound: Bound) -> DataFrame:
        n, none = F.col(length), F.array().cast("array<string>")
        keep = lambda q: n - (q - 1) - F.greatest(F.ceil(bound.least(q, n)), F.lit(1)) + 1
        pick = lambda q: _prefix(F.col(c), q, keep(q), [g for g in common if len(g) == q])
        # Where a name, or any that it may be similar to, is too short for runs of two, characters must do.
        one = F.when(~low.by_two(F.ceil(low.shortest(n))), pick(1)).otherwise(none)
        return df.select("*", F.explode(F.concat(F.when(bound.by_two(n), pick(2)).otherwise(none), one)).alias("_g"))

    la, lb = F.col("_la"), F.col("_lb")
    near = (lb >= mine.shortest(la)) & (lb <= mine.longest(la))
    met = rarest(a, x, "_la", mine).join(rarest(b, y, "_lb", low), "_g").where(near).drop("_g").distinct()
    if metric == "levenshtein":
        return met.where(F.levenshtein(x, y) <= (1 - mine.t) * F.greatest(la, lb) + EPS).select(x, y)
    for shared in (F.least(_held(x, y), _held(y, x)), F.size(F.array_intersect(tokens(F.col(x), 1), tokens(F.col(y), 1)))):
        met = met.where(shared >= mine.common(1, la, lb))
    return met.select(x, y)


def _held(x: str, y: str) -> Column:
    """Characters of ``x`` that stand anywhere in ``y``."""
    return F.length(x) - F.length(F.call_function("translate", F.col(x), F.col(y), F.lit("")))


def scored_pairs(pairs: DataFrame, x: str, y: str, similarity, name: str = "pairs") -> DataFrame:
    """``pairs`` with sim, written, so that each is scored once."""
    return materialize(pairs.withColumn("sim", similarity(F.col(x), F.col(y))), name)
