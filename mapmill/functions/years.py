"""Years in text: hits with places, and time windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mapmill.functions.text import let

# The year patterns, in order, and the time windows with their label for no year.
BCE = r"公元前\s*(\d{1,4})\s*年?"
BEFORE = r"(?<!公元)前\s*(\d{1,4})\s*年?"
RANGE = r"(\d{3,4})\s*[—\-－~～至]\s*(\d{2,4})"
YEAR = r"(?<!\d)((?:[7-9]\d{2})|(?:1\d{3})|(?:20\d{2}))\s*年"
BRACKETED = r"（\s*((?:[7-9]\d{2})|(?:1\d{3})|(?:20\d{2}))\s*）"
TIME_WINDOWS = [
    (-9999, 1911, "古代-清末"), (1912, 1948, "民国时期"), (1949, 1977, "集体化与农业建设"), (1978, 1991, "改革开放初期"),
    (1992, 2003, "开发区建设"), (2004, 2013, "社区成立与城市更新"), (2014, 2099, "运河文旅更新"),
]
NO_TIME = "无明确时间"
EARLIEST, LATEST = -6000, 2099


def matches(text: Column, pattern: str, groups: int = 1) -> Column:
    """Array of (pos, g array): where each match begins (from 0), and its groups. The pattern must not match nothing."""
    found = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    parts = F.struct(F.split(text, pattern).alias("between"), found(0).alias("whole"), *[found(g).alias(f"g{g}") for g in range(1, groups + 1)])

    def placed(p: Column) -> Column:
        # One running sum over what stands between the matches and the matches themselves.
        pairs = F.arrays_zip(F.slice(p["between"], 1, F.size(p["whole"])).alias("between"), p["whole"].alias("whole"))
        start = F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("all"))

        def step(acc: Column, x: Column) -> Column:
            pos = acc["end"] + F.length(x["between"])
            return F.struct((pos + F.length(x["whole"])).alias("end"), F.concat(acc["all"], F.array(pos)).alias("all"))

        one = lambda pos, k: F.struct(pos.alias("pos"), F.array(*[F.get(p[f"g{g}"], k) for g in range(1, groups + 1)]).alias("g"))
        return F.transform(F.aggregate(pairs, start, step)["all"], one)

    return let(parts, placed)


def year_hits(fragment: Column, patterns: dict[str, str] | None = None) -> Column:
    """Array of (year, pos) in the order of the patterns: BCE, bare 'before', ranges (both ends), years, bracketed years."""
    p = {"bce": BCE, "before": BEFORE, "range": RANGE, "year": YEAR, "bracketed": BRACKETED} | (patterns or {})
    as_int = lambda m, k: m["g"][k].try_cast("int")
    hit = lambda year, m: F.struct(year.alias("year"), m["pos"].alias("pos"))
    single = lambda name, sign: F.transform(matches(fragment, p[name]), lambda m: hit(sign * as_int(m, 0), m))
    end = lambda m: F.when(as_int(m, 1) < 100, F.floor(as_int(m, 0) / 100).cast("int") * 100 + as_int(m, 1)).otherwise(as_int(m, 1))
    both = F.flatten(F.transform(matches(fragment, p["range"], 2), lambda m: F.array(hit(as_int(m, 0), m), hit(end(m), m))))
    every = F.concat(single("bce", -1), single("before", -1), both, single("year", 1), single("bracketed", 1))
    return F.filter(every, lambda x: x["year"].between(EARLIEST, LATEST))


def nearest_year(hits: Column, local: Column) -> Column:
    """The year of the hit nearest to a place; of equally near hits, the earlier in the array."""
    keyed = F.transform(hits, lambda h, i: F.struct(F.abs(h["pos"] - local).alias("d"), i.alias("i"), h["year"].alias("year")))
    return F.array_min(keyed)["year"]


def time_window(year: Column, windows=TIME_WINDOWS, default: str = NO_TIME) -> Column:
    """The label of the first closed window that holds the year."""
    out = F.lit(default)
    for low, high, name in reversed(windows):
        out = F.when(year.between(low, high), name).otherwise(out)
    return out


def has_year(line: Column) -> Column:
    """Whether a line holds a year from 1800 to 2099 as a number of its own."""
    return line.rlike(r"(?<!\d)(?:1[89]\d{2}|20\d{2})(?!\d)")
