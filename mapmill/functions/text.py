"""Text columns: cleaning, names, counts, contexts and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the place vocabulary.
TRADITIONAL = "門橋寶陽淨報聖學圖廟觀縣營馬龍灣錢"
SIMPLIFIED = "门桥宝阳净报圣学图庙观县营马龙湾钱"
PLACE_SUFFIXES = "街巷坊弄路橋桥河湖港堤塘門门城府署局倉仓营營兵寺廟庙院觀观山"
PLACE_TERMS = PLACE_SUFFIXES + "井市池園园巖岩"
OCR_PUNCTUATION = r"[\s·•,.;:!?，。；：！？、|/\\_\-—~`'\"“”‘’()\[\]{}<>《》]+"
CJK = r"[\x{3400}-\x{9fff}\x{f900}-\x{faff}]"
#: Ordered (characters, category) of OCR labels; the last entry has no characters and is the default.
OCR_CATEGORIES = (
    ("街巷坊弄路橋桥", "ocr_街巷道路"), ("河湖港堤塘池井", "ocr_水系"), ("門门城府署局倉仓营營兵", "ocr_城防官署"),
    ("寺廟庙院觀观", "ocr_寺观"), ("山巖岩", "ocr_山体"), ("", "ocr_文字"),
)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row."""
    return F.transform(F.array(value), body)[0]


def blank(c: Column) -> Column:
    """Whether a text is missing: null or only white space."""
    return c.isNull() | (F.trim(c) == "")


def present(c: Column) -> Column:
    """The text, or null if it is blank."""
    return F.when(~blank(c), c)


def squeeze(text: Column) -> Column:
    """Text without byte-order marks and any white space."""
    return F.regexp_replace(F.replace(text, F.lit("﻿"), F.lit("")), r"(?U)\s+", "")


def squeeze_lines(text: Column) -> Column:
    """As ``squeeze``, but line breaks stay."""
    return F.regexp_replace(F.replace(text, F.lit("﻿"), F.lit("")), r"[ \t\r\f\x0B]+", "")


def normal_name(name: Column) -> Column:
    """A name for matching: no brackets, middle dots or spaces, lower case."""
    return F.lower(F.translate(name, "（）()· ", ""))


def simplified(name: Column) -> Column:
    """A map label for matching: trimmed, no spaces, dots or full stops, simplified characters."""
    return F.translate(F.translate(F.trim(F.coalesce(name, F.lit(""))), " 　·。", ""), TRADITIONAL, SIMPLIFIED)


def without_punctuation(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), OCR_PUNCTUATION, "")


def cjk_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(CJK))


def has_term(text: Column, terms: str = PLACE_TERMS) -> Column:
    return text.rlike(f"[{terms}]")


def reading_order(text: Column, suffixes: str = PLACE_SUFFIXES) -> Column:
    """Struct (text, rule): labels that begin, but do not end, with a place suffix are read backwards."""
    turned = (F.length(text) >= 2) & text.rlike(f"^[{suffixes}]") & ~text.rlike(f"[{suffixes}]$")
    return F.struct(F.when(turned, F.reverse(text)).otherwise(text).alias("text"), F.when(turned, "reverse_suffix_first").otherwise("as_detected").alias("rule"))


def ocr_category(text: Column, rules=OCR_CATEGORIES) -> Column:
    """The category of the first rule that has a character of the text."""
    out = F.lit(rules[-1][1])
    for chars, name in reversed(rules[:-1]):
        out = F.when(text.rlike(f"[{chars}]"), name).otherwise(out)
    return out


def surface_count(text: Column, name: Column) -> Column:
    """Non-overlapping occurrences of ``name`` in ``text``."""
    gone = F.length(F.replace(text, name, F.lit("")))
    return F.when(F.length(name) > 0, ((F.length(text) - gone) / F.length(name)).cast("long")).otherwise(F.lit(0).cast("long"))


def context(text: Column, at: Column, size: Column, radius: int) -> Column:
    """The text around a mention at ``at`` (from 0) of ``size`` characters."""
    begin = F.greatest(at - radius, F.lit(0))
    return F.substring(text, begin + 1, at + size + radius - begin)


def sentence_window(text: Column, at: Column, size: Column, radius: int = 260, marks: str = "。；！？") -> Column:
    """Struct (fragment, local): the sentence around a mention, within ``radius``, and the mention's place in it.

    It begins after the nearest mark before the mention and ends with the nearest one after it.
    """
    begin = F.greatest(at - radius, F.lit(0))
    left = F.substring(text, begin + 1, at - begin)
    right = F.substring(text, at + size + 1, F.lit(radius))
    cls = "[" + "".join("\\" + m for m in marks) + "]" if marks.isascii() else f"[{marks}]"
    back = F.regexp_instr(F.reverse(left), F.lit(cls))
    ahead = F.regexp_instr(right, F.lit(cls))
    own_left = F.when(back > 0, F.substring(left, F.length(left) - back + 2, back - 1)).otherwise(left)
    own_right = F.when(ahead > 0, F.substring(right, F.lit(1), ahead)).otherwise(right)
    return F.struct(F.concat(own_left, F.substring(text, at + 1, size), own_right).alias("fragment"), F.length(own_left).alias("local"))


def ellipsis(text: Column, size: int) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def slug(text: Column) -> Column:
    """A name for files and ids; 'map' if nothing is left."""
    out = F.btrim(F.regexp_replace(F.trim(text), "[^0-9A-Za-z_-]+", "_"), F.lit("_"))
    return F.when(out == "", "map").otherwise(out)


def alternatives(first: list[Column], joined: Column) -> Column:
    """Distinct non-blank texts in order: ``first``, then the parts of ``joined`` cut at pipe, semicolon or comma."""
    parts = F.concat(F.array(*first), F.split(F.coalesce(joined, F.lit("")), "[|;,，]"))
    return F.array_distinct(F.filter(F.transform(parts, lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != ""))


def strip_to_tail(name: Column, prefix: str, markers: list[str]) -> Column:
    """Drop a leading ``prefix`` pattern and keep what follows each marker (if two characters or more), until nothing changes.

    Each round shortens the name or changes nothing, so a name has as many rounds at most as it has characters; after the first one that changes
    nothing the rest pass at once.
    """
    cuts = F.array(*[F.lit(m) for m in markers]) if markers else F.array().cast("array<string>")
    tail = lambda a, m: let(F.call_function("substring_index", a, m, F.lit(-1)), lambda t: F.when((F.call_function("instr", a, m) > 0) & (F.length(t) >= 2), t).otherwise(a))
    once = lambda n: F.aggregate(cuts, F.regexp_replace(n, prefix, ""), tail)
    start = F.struct(name.alias("n"), F.lit(False).alias("done"))
    step = lambda acc, _: F.when(acc["done"], acc).otherwise(let(once(acc["n"]), lambda t: F.struct(t.alias("n"), (t == acc["n"]).alias("done"))))
    return F.when(name.isNotNull(), F.aggregate(F.sequence(F.lit(1), F.length(name) + 1), start, step)["n"])


def clean_candidate(raw: Column, trims: str, lead: str, prefix: str, markers: list[str]) -> Column:
    """Clean a raw candidate: outer punctuation, leading date characters, prefix phrases and text before markers."""
    inner = F.regexp_replace(F.btrim(raw, F.lit(trims)), lead, "")
    return F.btrim(strip_to_tail(inner, prefix, markers), F.lit(trims))


def simple_name(raw: Column, lead: str, particles: str, trims: str) -> Column:
    """A short clean-up: leading date characters go, then leading particles and marks, then outer punctuation."""
    return F.btrim(F.regexp_replace(F.regexp_replace(raw, f"^(?:{lead})+", ""), f"^(?:{particles})+", ""), F.lit(trims))


def short_name(name: Column, bad_parts: list[str], low: int = 2, high: int = 18) -> Column:
    """Whether a name is neither too short nor too long and has none of the bad parts."""
    ok = F.length(name).between(low, high)
    return ok & ~name.rlike("|".join("\\Q" + w + "\\E" for w in bad_parts)) if bad_parts else ok


def popup(title: Column, parts: list[tuple[str, Column]], mark: str = "：") -> Column:
    """A title and one line for each label and value; a missing value is blank."""
    return F.concat_ws("\n", F.coalesce(title, F.lit("")), *[F.concat(F.lit(label + mark), F.coalesce(value.cast("string"), F.lit(""))) for label, value in parts])


def type_by_suffix(name: Column, rules: list[tuple[str, str]], default: str = "place") -> Column:
    """The type of the first rule whose suffix ends the name."""
    out = F.lit(default)
    for suffix, kind in reversed(rules):
        out = F.when(F.endswith(name, F.lit(suffix)), kind).otherwise(out)
    return out


def valid_name(name: Column, kind: Column, reserved: list[str], digits: str, bad_prefixes: list[str], bad_parts: list[str], caps: dict[str, int], seed: Column) -> Column:
    """Length 2 to 18, not reserved, not digits only, no bad beginning or part, and within its type's length unless a seed."""
    quoted = lambda words: "|".join("\\Q" + w + "\\E" for w in words)
    ok = F.length(name).between(2, 18) & ~name.isin(reserved) & ~name.rlike(f"^(?:{digits})+$")
    if bad_prefixes:
        ok &= ~name.rlike(f"^(?:{quoted(bad_prefixes)})")
    if bad_parts:
        ok &= ~name.rlike(quoted(bad_parts))
    for k, most in caps.items():
        ok &= ~((kind == k) & ~seed & (F.length(name) > most))
    return ok


def first_tag(tags: Column, keys: list[str]) -> Column:
    """``key:value`` of the first key that a tag map has."""
    return F.coalesce(*[F.when(present(F.try_element_at(tags, F.lit(k))).isNotNull(), F.concat(F.lit(f"{k}:"), F.try_element_at(tags, F.lit(k)))) for k in keys], F.lit(""))


def compact_json(columns: list[str]) -> Column:
    """JSON of the non-null columns, in order."""
    return F.to_json(F.struct(*columns))


def flag(text: Column, words: tuple[str, ...] = ("1", "true", "yes", "y")) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin(*words), F.lit(False))


def rgba(text: Column) -> Column:
    """Four integers of ``r,g,b[,a]``; alpha is 255 if missing."""
    nums = F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("int"))
    return F.slice(F.concat(nums, F.array(F.lit(255))), 1, 4)


def safe_int(value: Column, fallback: int = 0) -> Column:
    return F.coalesce(value.try_cast("double").try_cast("int"), F.lit(fallback))


def safe_double(value: Column, fallback: float = 0.0) -> Column:
    return F.coalesce(value.try_cast("double"), F.lit(fallback))


def band(value: Column, bands: list[tuple[int, str]], default: str) -> Column:
    """The label of the first lower bound, in falling order, that the value reaches."""
    out = F.lit(default)
    for low, name in sorted(bands):
        out = F.when(value >= low, name).otherwise(out)
    return out


# Mention bands.
MENTION_BANDS = [(200, "极高频"), (80, "高频"), (30, "中高频"), (10, "中频")]


def mention_level(count: Column) -> Column:
    return band(count, MENTION_BANDS, "低频")


def coordinate_quality(coord_status: Column, match_status: Column, lon: Column, lat: Column) -> Column:
    usable = coord_status.isin("fallback_coord", "local_anchor_coord")
    return (
        F.when(usable & (match_status == "matched"), "已匹配坐标").when(usable, "可用坐标_需复核").when(coord_status == "derived_coord", "推导坐标_需复核")
        .when(lon.isNotNull() & lat.isNotNull(), "有坐标_需复核").otherwise("缺坐标")
    )


def reason(custom: Column, label: Column, count: Column, themes: Column, year: Column) -> Column:
    """Why a place matters: a custom sentence, or one built from its type, count, themes (array) and year."""
    theme = F.when(F.size(themes) > 0, F.array_join(themes, "、")).otherwise("志书叙事")
    when = F.when(year.isNotNull(), F.concat(F.lit("主要时间锚点为"), year.cast("string"), F.lit("年"))).otherwise("未提取到明确时间锚点")
    made = F.concat(F.lit("该地名属于"), F.coalesce(label, F.lit("地名")), F.lit("，在志书中约出现"), count.cast("string"), F.lit("次，主要关联"), theme, F.lit("；"), when, F.lit("。"))
    return F.coalesce(custom, made)
