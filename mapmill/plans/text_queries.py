"""Registered queries over texts, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapmill.functions import text as T
from mapmill.functions import years
from mapmill.operators import lookup, mentions, ranking
from mapmill.sources import tables
from mapmill.storage import materialize

Q: dict = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None, name: str | None = None):
    """Register a query function, and its SQL."""

    def add(f):
        key = name or f"q_{f.__name__}"
        Q[key] = f
        if sql:
            SQL[key] = sql
        return f

    return add


#: The dictionary of the queries: the 200 most frequent lower-case tokens of the benchmark texts.
DICTIONARY = 200
D_SQL = f"""dict AS (
  SELECT name, n, row_number() OVER (ORDER BY n DESC, name) AS ord
  FROM (SELECT name, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{{4,}}')) AS name FROM benchmark) GROUP BY name) ORDER BY n DESC, name LIMIT {DICTIONARY}
)"""


def dictionary(spark: SparkSession, sf_dir: str, n: int = DICTIONARY) -> DataFrame:
    """(name, n, ord)"""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("name"))
    top = words.groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(n)
    return top.withColumn("ord", F.row_number().over(ranking.Window.orderBy(F.desc("n"), "name")))


LEVEL_SQL = "CASE WHEN {0} >= 200 THEN '极高频' WHEN {0} >= 80 THEN '高频' WHEN {0} >= 30 THEN '中高频' WHEN {0} >= 10 THEN '中频' ELSE '低频' END"


def ranked_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", T.squeeze_lines(F.col("text")).alias("text"))
    counts = mentions.mention_counts(docs, dictionary(spark, sf_dir))
    ranked = ranking.global_rank(counts, [F.desc("mentions"), F.asc("name")], "rank")
    return ranked.withColumn("level", T.mention_level(F.col("mentions"))).withColumn("label", mentions.rank_label(F.col("rank"), F.col("name"), F.col("mentions")))


RANKED_SQL = f"""WITH {D_SQL}, t AS (SELECT doc_id, regexp_replace(text, '[ \\t\\r\\f\\x0B]+', '', 'g') AS text FROM documents), c AS (
  SELECT name, sum((length(text) - length(replace(text, name, ''))) // length(name))::BIGINT AS mentions FROM t, dict GROUP BY name
), r AS (
  SELECT name, mentions, row_number() OVER (ORDER BY mentions DESC, name) AS rank FROM c
), m AS (
  SELECT name, mentions, rank, {LEVEL_SQL.format('mentions')} AS level, rank || '. ' || name || '（' || mentions || '次）' AS label FROM r
) """


@query(RANKED_SQL + "SELECT * FROM m ORDER BY rank LIMIT 80")
def mention_rank(spark, sf_dir):
    """The 80 most mentioned names, ranked and banded."""
    return ranking.top(ranked_mentions(spark, sf_dir), [F.col("rank")], 80)


@query(RANKED_SQL + "SELECT name, mentions, rank, level FROM m WHERE level = '极高频' AND (contains(name, 'th') OR contains(label, '10'))")
def rank_filter(spark, sf_dir):
    """Names of one level whose name or label holds a keyword."""
    held = F.contains(F.col("name"), F.lit("th")) | F.contains(F.col("label"), F.lit("10"))
    return ranking.filter_ranked(ranked_mentions(spark, sf_dir), "极高频").where(held).select("name", "mentions", "rank", "level")


@query(RANKED_SQL + """SELECT name, rank, coalesce(sub, 0) AS curated_rank, CASE WHEN sub IS NULL THEN label ELSE sub || '. ' || name || '（' || mentions || '次）' END AS rank_label
FROM m LEFT JOIN (SELECT name AS k, row_number() OVER (ORDER BY rank) AS sub FROM m WHERE length(name) % 2 = 0) ON name = k""")
def curated_rank(spark, sf_dir):
    """A second rank inside a curated subset, which also renames those rows in the full table."""
    full = ranked_mentions(spark, sf_dir).withColumnRenamed("label", "rank_label")
    out = ranking.second_rank(full, F.length("name") % 2 == 0, [F.asc("rank")], "name", mentions.rank_label(F.col("curated_rank"), F.col("name"), F.col("mentions")))
    return out.select("name", "rank", "curated_rank", "rank_label")


@query(f"WITH {D_SQL} SELECT * FROM (SELECT doc_id, name, ((length(text) - length(replace(text, name, ''))) // length(name))::BIGINT AS n FROM documents, dict) WHERE n > 0")
def mention_count_by_doc(spark, sf_dir):
    """Occurrences of each name in each document."""
    return mentions.mention_positions(table(spark, sf_dir, "documents"), dictionary(spark, sf_dir)).groupBy("doc_id", "name").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {D_SQL}, p AS (
  SELECT doc_id, name, strpos(text, name) - 1 AS pos, text FROM documents, dict WHERE contains(text, name)
) SELECT doc_id, name, pos::INTEGER AS pos, substr(text, greatest(pos - 48, 0)::BIGINT + 1, pos::BIGINT + length(name) + 48 - greatest(pos - 48, 0)::BIGINT) AS context
FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY doc_id, pos) AS rn FROM p) WHERE rn = 1""")
def first_context(spark, sf_dir):
    """The first mention of each name in the corpus, with its context."""
    docs = table(spark, sf_dir, "documents")
    return mentions.contexts(mentions.mention_excerpts(docs, dictionary(spark, sf_dir), 48, 1), 48)


@query(f"""WITH {D_SQL}, p AS (
  SELECT doc_id, name, strpos(text, name) - 1 AS pos, text FROM documents, dict WHERE contains(text, name)
), f AS (
  SELECT doc_id, name, pos::BIGINT AS pos, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, name ORDER BY pos) AS rn FROM p) WHERE rn = 1
), s AS (
  SELECT *, substr(text, greatest(pos - 260, 0) + 1, pos - greatest(pos - 260, 0)) AS l, substr(text, pos + length(name) + 1, 260) AS r FROM f
), w AS (
  SELECT doc_id, name, pos, regexp_extract(l, '[^.;!?]*$') AS a, CASE WHEN regexp_matches(r, '[.;!?]') THEN regexp_extract(r, '^[^.;!?]*[.;!?]') ELSE r END AS b FROM s
) SELECT doc_id, name, pos::INTEGER AS pos, a || name || b AS fragment, length(a)::INTEGER AS local FROM w""")
def sentence_window(spark, sf_dir):
    """The sentence around the first mention of each name in each document."""
    docs = table(spark, sf_dir, "documents")
    return mentions.sentences(mentions.mention_excerpts(docs, dictionary(spark, sf_dir), 260, 1, ("doc_id", "name")), 260, ".;!?")


@query(f"""WITH {D_SQL}, p AS (
  SELECT name, doc_id, strpos(text, name) - 1 AS pos FROM documents, dict WHERE contains(text, name)
) SELECT name, doc_id, pos::INTEGER AS pos, rn::INTEGER AS nth FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY doc_id) AS rn FROM p) WHERE rn <= 12""")
def mention_positions(spark, sf_dir):
    """The first place of each name in each of its first twelve documents."""
    every = mentions.first_places(table(spark, sf_dir, "documents"), dictionary(spark, sf_dir))
    first = every.groupBy("name", "doc_id").agg(F.min("pos").alias("pos"))
    nth = F.row_number().over(ranking.Window.partitionBy("name").orderBy("doc_id"))
    return first.withColumn("nth", nth).where("nth <= 12")


def themes(spark, sf_dir):
    return dictionary(spark, sf_dir, 24).select(F.concat(F.lit("theme_"), F.col("ord") % 4).alias("theme"), (F.col("ord") % 4).alias("ordinal"), F.col("name").alias("keyword"))


THEME_SQL = f"""WITH {D_SQL}, k AS (SELECT 'theme_' || (ord % 4) AS theme, (ord % 4)::INTEGER AS ordinal, name AS keyword FROM dict WHERE ord <= 24), c AS (
  SELECT source, theme, ordinal, sum((length(text) - length(replace(text, keyword, ''))) // length(keyword))::BIGINT AS n FROM documents, k GROUP BY ALL
) """


@query(THEME_SQL + "SELECT source, theme, ordinal, n FROM c")
def theme_counts(spark, sf_dir):
    """Keyword occurrences of each theme in the documents of each source."""
    return mentions.theme_counts(table(spark, sf_dir, "documents"), themes(spark, sf_dir), "source", "text")


@query(THEME_SQL + "SELECT source, list(theme ORDER BY rn) AS themes FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, ordinal) AS rn FROM c WHERE n > 0) WHERE rn <= 2 GROUP BY source")
def theme_top2(spark, sf_dir):
    """The two leading themes of each source."""
    counts = mentions.theme_counts(table(spark, sf_dir, "documents"), themes(spark, sf_dir), "source", "text")
    return ranking.top_themes(counts, "source", "theme", "n", "ordinal", 2)


SUFFIXES = [("tion", "action"), ("ment", "state"), ("eaux", "plural"), ("ing", "process")]
CANDIDATE_SQL = f"""WITH r AS (
  SELECT unnest(regexp_extract_all(text, '([A-Za-z]{{1,24}}(?:tion|ment|eaux|ing))', 1)) AS raw FROM documents
), c AS (
  SELECT regexp_replace(raw, '^(?:the|of|and)', '') AS name FROM r
), v AS (
  SELECT name, CASE WHEN ends_with(name, 'tion') THEN 'action' WHEN ends_with(name, 'ment') THEN 'state' WHEN ends_with(name, 'eaux') THEN 'plural' WHEN ends_with(name, 'ing') THEN 'process' ELSE 'place' END AS place_type FROM c
), n AS (
  SELECT name, place_type FROM v WHERE length(name) BETWEEN 2 AND 18 AND name NOT IN ('tion', 'ment', 'ing') AND NOT regexp_matches(name, '^(?:on|er)') AND NOT (place_type = 'plural' AND length(name) > 12)
) """


def candidates(spark, sf_dir):
    raw = mentions.suffix_candidates(table(spark, sf_dir, "documents"), [s for s, _ in SUFFIXES], "[A-Za-z]{1,24}")
    distinct = raw.groupBy("raw").agg(F.count(F.lit(1)).alias("n"))  # the clean-up runs once a distinct string
    name = T.clean_candidate(F.col("raw"), " .", "^[0-9]+", "^(?:the|of|and)", [])
    typed = distinct.withColumn("name", name).withColumn("place_type", T.type_by_suffix(F.col("name"), SUFFIXES))
    ok = T.valid_name(F.col("name"), F.col("place_type"), ["tion", "ment", "ing"], "[0-9]", ["on", "er"], [], {"plural": 12}, F.lit(False))
    return typed.where(ok)


@query("""WITH RECURSIVE r AS (
  SELECT p_partkey, repeat('the of ', (p_size % 40)::INTEGER) || p_name || CASE p_partkey % 5 WHEN 0 THEN ' at the ' || p_brand WHEN 1 THEN ' by of of x by ' || p_type || ' at y' WHEN 2 THEN repeat(' at ', (p_size % 9)::INTEGER) || 'z' ELSE '' END AS n, 0 AS i FROM part
  UNION ALL
  SELECT p_partkey, c, i + 1 FROM (
    SELECT p_partkey, n, i, CASE WHEN contains(b, ' by ') AND length(split_part(b, ' by ', -1)) >= 2 THEN split_part(b, ' by ', -1) ELSE b END AS c FROM (
      SELECT p_partkey, n, i, CASE WHEN contains(a, ' at ') AND length(split_part(a, ' at ', -1)) >= 2 THEN split_part(a, ' at ', -1) ELSE a END AS b FROM (
        SELECT p_partkey, n, i, regexp_replace(n, '^(?:the |of )', '') AS a FROM r))) WHERE c <> n
) SELECT p_partkey, arg_max(n, i) AS name FROM r GROUP BY p_partkey""")
def clean_names(spark, sf_dir):
    """Names of any length without their leading words and without what stands before their split markers, cleaned until nothing changes."""
    k, size = F.col("p_partkey"), F.col("p_size")
    by_key = lambda *cases: F.when(k % 5 == 0, cases[0]).when(k % 5 == 1, cases[1]).when(k % 5 == 2, cases[2]).otherwise("")
    end = by_key(F.concat(F.lit(" at the "), "p_brand"), F.concat(F.lit(" by of of x by "), "p_type", F.lit(" at y")), F.concat(F.call_function("repeat", F.lit(" at "), (size % 9).cast("int")), F.lit("z")))
    raw = F.concat(F.call_function("repeat", F.lit("the of "), (size % 40).cast("int")), "p_name", end)
    return table(spark, sf_dir, "part").select("p_partkey", T.strip_to_tail(raw, "^(?:the |of )", [" at ", " by "]).alias("name"))


@query(CANDIDATE_SQL.replace("regexp_replace(raw, '^(?:the|of|and)', '')", "regexp_replace(raw, '^(?:the|of|and)+', '')") + "SELECT name, place_type, count(*)::BIGINT AS n FROM n GROUP BY ALL")
def suffix_candidates(spark, sf_dir):
    """Names by suffix pattern, cleaned, typed, validated and counted."""
    return candidates(spark, sf_dir).groupBy("name", "place_type").agg(F.sum("n").alias("n"))


@query(CANDIDATE_SQL.replace("regexp_replace(raw, '^(?:the|of|and)', '')", "regexp_replace(raw, '^(?:the|of|and)+', '')") + f""", {D_SQL}, s AS (
  SELECT name AS seed, ord FROM dict WHERE ord <= 40
), b AS (
  SELECT name, seed, row_number() OVER (PARTITION BY name ORDER BY length(seed) DESC, ord) AS rn FROM (SELECT DISTINCT name FROM n) JOIN s ON contains(name, seed) AND name <> seed
) SELECT coalesce(seed, n.name) AS name, count(*)::BIGINT AS n FROM n LEFT JOIN b ON n.name = b.name AND rn = 1 GROUP BY 1""")
def seed_reduce(spark, sf_dir):
    """Names reduced to the longest seed that they contain."""
    seeds = dictionary(spark, sf_dir, 40).select(F.col("name").alias("seed"), F.lit("seed").alias("seed_type"), F.col("ord").alias("ordinal"))
    found = materialize(candidates(spark, sf_dir), "candidates")
    fits = found.select(F.lit("seed").alias("seed_type"), "place_type").distinct()
    out = lookup.seed_reduce(found, "name", "place_type", seeds, fits)
    return out.groupBy("name").agg(F.sum("n").alias("n"))


@query(f"""WITH {D_SQL}, c AS (SELECT unnest(regexp_extract_all(text, '([a-z]{{1,24}}(?:tion|ment))', 1)) AS name FROM documents), s AS (
  SELECT name FROM dict WHERE EXISTS (SELECT 1 FROM documents WHERE contains(text, name))
) SELECT name, count(*)::BIGINT AS n FROM (SELECT name FROM c UNION ALL SELECT name FROM s) GROUP BY name""")
def seeded_frequency(spark, sf_dir):
    """Candidate frequencies, one higher for each seed that stands in the corpus."""
    docs = table(spark, sf_dir, "documents")
    raw = mentions.suffix_candidates(docs, ["tion", "ment"], "[a-z]{1,24}").select(F.col("raw").alias("name"))
    return mentions.name_frequency(raw, mentions.seed_presence(docs, dictionary(spark, sf_dir)))


def sentences_of_orders(spark, sf_dir):
    y = F.year("o_orderdate")
    s = F.concat(
        F.lit("单"), "o_orderkey", F.lit("于"), y, F.lit("年完成，参见"), y - 5, F.lit("—"), F.lpad((y % 100).cast("string"), 2, "0"), F.lit("，公元前"), F.col("o_orderkey") % 500 + 1, F.lit("年。"), F.lit("（"), y - 90, F.lit("）")
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", y.alias("y"), s.alias("sentence"))


HITS_SQL = """WITH o AS (SELECT o_orderkey, o_orderpriority, year(o_orderdate) AS y, o_orderkey % 500 + 1 AS b FROM orders), h AS (
  SELECT *, [(-b)::INTEGER, (y - 5)::INTEGER, ((y - 5) // 100 * 100 + y % 100)::INTEGER, y::INTEGER, (y - 90)::INTEGER] AS years FROM o
) """


@query(HITS_SQL + "SELECT o_orderkey, years, y::INTEGER AS near FROM h")
def year_hits(spark, sf_dir):
    """Years of a sentence by five patterns, and the one nearest to its beginning."""
    s = sentences_of_orders(spark, sf_dir).withColumn("hits", years.year_hits(F.col("sentence")))
    return s.select("o_orderkey", F.transform("hits", lambda h: h["year"]).alias("years"), years.nearest_year(F.col("hits"), F.lit(0)).alias("near"))


@query(HITS_SQL + """, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS rn FROM h) WHERE rn <= 80), u AS (
  SELECT DISTINCT o_orderpriority, unnest(years) AS v FROM f
) SELECT o_orderpriority AS name, min(v)::INTEGER AS earliest_year, max(v)::INTEGER AS latest_year, count(*)::INTEGER AS year_count,
  (SELECT min(y)::INTEGER FROM f WHERE f.o_orderpriority = u.o_orderpriority) AS primary_year, array_to_string(list(v ORDER BY v)[1:18], ';') AS year_list FROM u GROUP BY 1""")
def year_context(spark, sf_dir):
    """Primary, earliest and latest year, count and list of the first 80 mentions of a name."""
    s = sentences_of_orders(spark, sf_dir).select(F.col("o_orderpriority").alias("name"), F.col("o_orderkey").alias("doc_id"), F.lit(0).alias("pos"), F.col("sentence").alias("fragment"), F.lit(0).alias("local"))
    return mentions.temporal_context(s).select("name", "earliest_year", "latest_year", "year_count", "primary_year", "year_list")


@query("""WITH w(lo, hi, label) AS (VALUES (1900, 1994, 'early'), (1995, 1996, 'middle'), (1997, 1998, 'late')), o AS (SELECT coalesce(label, 'none') AS time_type FROM orders LEFT JOIN w ON year(o_orderdate) BETWEEN lo AND hi)
SELECT time_type, count(*)::BIGINT AS n FROM o GROUP BY 1""")
def time_window(spark, sf_dir):
    """Orders by time window."""
    y = years.time_window(F.year("o_orderdate"), [(1900, 1994, "early"), (1995, 1996, "middle"), (1997, 1998, "late")], "none")
    return table(spark, sf_dir, "orders").groupBy(y.alias("time_type")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH t AS (SELECT o_orderkey AS doc_id, 'order ' || o_orderkey || chr(10) || ' placed  in ' || year(o_orderdate) || ' ok' || chr(10) || 'no ' || (100000 + o_orderkey) || chr(10) || year(o_orderdate) || '1' AS text FROM orders),
l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no, regexp_replace(unnest(string_split(text, chr(10))), '\\s+', '', 'g') AS line FROM t)
SELECT doc_id, line_no::INTEGER AS line_no, length(line)::INTEGER AS n FROM l WHERE regexp_matches(line, '(^|[^0-9])(1[89][0-9]{2}|20[0-9]{2})([^0-9]|$)')""")
def year_lines(spark, sf_dir):
    """Lines that hold a year."""
    y = F.year("o_orderdate")
    text = F.concat(F.lit("order "), "o_orderkey", F.lit("\n placed  in "), y, F.lit(" ok\nno "), 100000 + F.col("o_orderkey"), F.lit("\n"), y, F.lit("1"))
    return tables.year_lines(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))).select("doc_id", "line_no", F.length("line").alias("n"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '井百坊' || c_custkey || '巷' WHEN c_custkey % 3 = 1 THEN c_custkey || '井街' ELSE '街井' || c_custkey END AS label,
CASE WHEN c_custkey % 3 = 2 THEN reverse('街井' || c_custkey) WHEN c_custkey % 3 = 0 THEN '井百坊' || c_custkey || '巷' ELSE c_custkey || '井街' END AS read_as,
CASE WHEN c_custkey % 3 = 2 THEN 'reverse_suffix_first' ELSE 'as_detected' END AS rule, 'ocr_街巷道路' AS category, (CASE WHEN c_custkey % 3 = 0 THEN 4 ELSE 2 END)::INTEGER AS cjk FROM customer""")
def reading_order(spark, sf_dir):
    """Map labels turned to reading order, categorised and counted."""
    k = F.col("c_custkey")
    label = F.when(k % 3 == 0, F.concat(F.lit("井百坊"), k, F.lit("巷"))).when(k % 3 == 1, F.concat(k, F.lit("井街"))).otherwise(F.concat(F.lit("街井"), k))
    r = T.reading_order(F.col("label"))
    return table(spark, sf_dir, "customer").select("c_custkey", label.alias("label")).select("c_custkey", "label", r["text"].alias("read_as"), r["rule"].alias("rule"), T.ocr_category(F.col("label")).alias("category"), T.cjk_count(F.col("label")).alias("cjk"))


@query("""SELECT p_partkey, CASE WHEN p_type IN (p_name, p_brand) THEN [p_name, p_brand] ELSE [p_name, p_brand, p_type] END AS texts FROM part""")
def alternatives(spark, sf_dir):
    """Distinct alternative texts of a label, in order."""
    joined = F.concat_ws("|", "p_brand", F.lit(" "), "p_type", "p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", T.alternatives([F.col("p_name"), F.lit(None).cast("string")], joined).alias("texts"))


@query("SELECT p_partkey, CASE WHEN s = '' THEN 'map' ELSE s END AS slug, CASE WHEN length(p_name) > 6 THEN substr(p_name, 1, 6) || '...' ELSE p_name END AS short FROM (SELECT p_partkey, p_name, trim(regexp_replace(trim(p_brand || ' / ' || p_name), '[^0-9A-Za-z_-]+', '_', 'g'), '_') AS s FROM part)")
def slugs(spark, sf_dir):
    """File names and shortened labels."""
    return table(spark, sf_dir, "part").select("p_partkey", T.slug(F.concat("p_brand", F.lit(" / "), "p_name")).alias("slug"), T.ellipsis(F.col("p_name"), 6).alias("short"))


@query("""SELECT s_suppkey, [(s_suppkey % 256)::INTEGER, (s_nationkey * 10)::INTEGER, 7, CASE WHEN s_suppkey % 2 = 0 THEN 255 ELSE 80 END]::INTEGER[] AS rgba, s_suppkey % 4 IN (0, 1) AS on_, (CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey ELSE -1 END)::INTEGER AS n FROM supplier""")
def parsed_values(spark, sf_dir):
    """Colours, flags and numbers parsed from texts, with defaults."""
    k = F.col("s_suppkey")
    colour = F.concat(k % 256, F.lit(", "), F.col("s_nationkey") * 10, F.lit(",7"), F.when(k % 2 == 0, "").otherwise(",80"))
    word = F.when(k % 4 == 0, " Yes").when(k % 4 == 1, "TRUE").when(k % 4 == 2, "no").otherwise(F.lit(None))
    number = F.when(k % 3 == 0, F.concat(k, F.lit(".4"))).otherwise("n/a")
    return table(spark, sf_dir, "supplier").select("s_suppkey", T.rgba(colour).alias("rgba"), T.flag(word).alias("on_"), T.safe_int(number, -1).alias("n"))


@query("""WITH m AS (SELECT c_custkey, c_mktsegment, c_nationkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 1900 + c_custkey % 90 END AS y FROM customer)
SELECT c_custkey, '该地名属于' || c_mktsegment || '，在志书中约出现' || c_nationkey || '次，主要关联' || CASE WHEN c_custkey % 2 = 0 THEN '甲、乙' ELSE '志书叙事' END || '；' || CASE WHEN y IS NULL THEN '未提取到明确时间锚点' ELSE '主要时间锚点为' || y || '年' END || '。' AS reason,
CASE WHEN c_custkey % 5 IN (0, 1) AND c_nationkey % 2 = 0 THEN '已匹配坐标' WHEN c_custkey % 5 IN (0, 1) THEN '可用坐标_需复核' WHEN c_custkey % 5 = 2 THEN '推导坐标_需复核' WHEN c_custkey % 5 = 3 THEN '有坐标_需复核' ELSE '缺坐标' END AS quality FROM m""")
def reasons(spark, sf_dir):
    """Reason sentences and coordinate quality labels."""
    k = F.col("c_custkey")
    year = F.when(k % 4 != 0, 1900 + k % 90)
    status = F.when(k % 5 == 0, "fallback_coord").when(k % 5 == 1, "local_anchor_coord").when(k % 5 == 2, "derived_coord").otherwise("")
    place = F.when(k % 5 == 3, 1.0)
    themes_ = F.when(k % 2 == 0, F.array(F.lit("甲"), F.lit("乙"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", T.reason(F.lit(None).cast("string"), F.col("c_mktsegment"), F.col("c_nationkey"), themes_, year).alias("reason"),
        T.coordinate_quality(status, F.when(F.col("c_nationkey") % 2 == 0, "matched").otherwise("review"), place, place).alias("quality"),
    )
