"""Registered queries over lookups, ranks, merges and matches, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from mapmill.functions import text as T
from mapmill.functions import years
from mapmill.operators import lookup, match, ranking, upsert
from mapmill.plans import jobs
from mapmill.plans.text_queries import dictionary, table
from mapmill.sources import ocr, tables

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f"q_{f.__name__}"] = f
        if sql:
            SQL[f"q_{f.__name__}"] = sql
        return f

    return add


def part_rules(spark, sf_dir):
    """One rule for each part type of even length, made from the parts themselves, and a fallback."""
    by = table(spark, sf_dir, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n"), F.max("p_size").alias("w"))
    rules = by.where(F.length("p_type") % 2 == 0).select(F.col("p_type").alias("category"), F.concat(F.lit("layer_"), F.lower("p_type")).alias("target_layer"), F.col("w").alias("width"))
    other = by.agg(F.lit("其他").alias("category"), F.lit("layer_other").alias("target_layer"), F.min("w").alias("width"))
    return rules.unionByName(other)


RULES_SQL = """WITH b AS (SELECT p_type, max(p_size) AS w FROM part GROUP BY p_type), r AS (
  SELECT p_type AS category, 'layer_' || lower(p_type) AS target_layer, w AS width FROM b WHERE length(p_type) % 2 = 0 UNION ALL SELECT '其他', 'layer_other', min(w) FROM b
) """


@query(RULES_SQL + """SELECT p_partkey, coalesce(r.target_layer, 'layer_other') AS target_layer, coalesce(r.width, (SELECT width FROM r WHERE category = '其他')) AS width FROM part LEFT JOIN r ON p_type = r.category""")
def rule_fallback(spark, sf_dir):
    """Layer rules by category, with the fallback row."""
    out = lookup.with_fallback(table(spark, sf_dir, "part").select("p_partkey", "p_type"), F.col("p_type"), part_rules(spark, sf_dir), "category", "其他", ["target_layer", "width"])
    return out.select("p_partkey", "target_layer", "width")


@query(RULES_SQL + """SELECT 'part_' || printf('%03d', row_number() OVER (ORDER BY p_partkey)) AS place_id, trim(p_name) AS name, p_type AS category, coalesce(r.target_layer, 'layer_other') AS target_layer, 'v4' AS version FROM part LEFT JOIN r ON p_type = r.category""")
def standardize(spark, sf_dir):
    """Raw rows in the standard form: trimmed, numbered in source order, with constants and rules."""
    raw = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit(" "), "p_name").alias("Name"), F.col("p_type").alias("Category"))
    out = jobs.standardize(raw, part_rules(spark, sf_dir).select("category", "target_layer"), [F.asc("p_partkey")], "part_", {"version": "v4"})
    return out.select("place_id", "name", "category", "target_layer", "version")


@query(RULES_SQL + "SELECT p_partkey, p_type FROM part WHERE p_type NOT IN (SELECT category FROM r)")
def unmatched_rules(spark, sf_dir):
    """Rows whose layer has no rule."""
    return lookup.unmatched(table(spark, sf_dir, "part"), "p_type", part_rules(spark, sf_dir), "category").select("p_partkey", "p_type")


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE upper(s_name) END ELSE s_name END AS s_name, s_suppkey % 3 = 0 AS in_curated FROM supplier""")
def curated_merge(spark, sf_dir):
    """Curated columns win where the curated row exists, even if blank."""
    full = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    curated = full.where("s_suppkey % 3 = 0").withColumn("s_name", F.when(F.col("s_suppkey") % 2 == 0, "").otherwise(F.upper("s_name")))
    return lookup.curated_first(full, curated, "s_suppkey", ["s_name"])


@query("""SELECT l_partkey, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_suppkey) AS rn FROM lineitem) WHERE rn = 1""")
def best_per_key(spark, sf_dir):
    """The line of the largest price of each part."""
    l = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    return ranking.best_per_key(l, ["l_partkey"], F.col("l_extendedprice"), [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey")]).drop("l_suppkey")


@query("""WITH v AS (SELECT p_name AS name, min(p_partkey) AS k FROM part GROUP BY p_name HAVING min(p_partkey) % 2 = 0), a AS (
  SELECT p_partkey, p_name AS name, 0 AS ordinal FROM part UNION ALL SELECT p_partkey, replace(p_name, 'blue', 'red'), 1 FROM part WHERE contains(p_name, 'blue') UNION ALL SELECT p_partkey, 'small ring', 2 FROM part WHERE contains(p_name, 'ring')
), h AS (SELECT p_partkey, a.name, k, row_number() OVER (PARTITION BY p_partkey ORDER BY ordinal) AS rn FROM a JOIN v ON a.name = v.name)
SELECT p.p_partkey, h.name AS matched_name, h.k FROM part p LEFT JOIN h ON p.p_partkey = h.p_partkey AND rn = 1""")
def fallback_chain(spark, sf_dir):
    """The first of several names that has a row: the exact one, a replaced one, a fixed one."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    values = p.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("k")).where("k % 2 = 0")
    ring = p.where("p_name = 'small ring'").select(F.lit("ring").alias("contains_token"), F.col("p_name").alias("alt_name"), F.lit(2).alias("priority")).distinct()
    alternates = lookup.trigger_alternates(p, "p_partkey", F.col("p_name"), ring).unionByName(p.where(F.contains("p_name", F.lit("blue"))).select("p_partkey", F.regexp_replace("p_name", "blue", "red").alias("name"), F.lit(1).alias("ordinal")))
    return lookup.first_present(p, alternates, "p_partkey", values, "name", ["k"]).select("p_partkey", "matched_name", "k")


def supplier_points(spark, sf_dir):
    k = F.col("s_suppkey")
    lon = F.when(k % 4 != 0, 100 + k * 0.5)
    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", lon.alias("lon"), F.when(k % 4 != 0, 30 + k * 0.25).alias("lat"), F.when(k % 4 != 0, "own").otherwise("missing").alias("coord_status"))


@query("""WITH n AS (SELECT s_suppkey AS k, s_name, CASE WHEN s_suppkey % 4 <> 0 THEN 100 + s_suppkey * 0.5::DOUBLE END AS lon, CASE WHEN s_suppkey % 4 <> 0 THEN 30 + s_suppkey * 0.25::DOUBLE END AS lat FROM supplier), a AS (
  SELECT k, s_name, CASE WHEN k % 8 = 4 AND k + 1 <= (SELECT max(s_suppkey) FROM supplier) THEN 100 + (k + 1) * 0.5::DOUBLE WHEN k = 7 THEN 101.5::DOUBLE ELSE lon END AS lon, CASE WHEN k % 8 = 4 AND k + 1 <= (SELECT max(s_suppkey) FROM supplier) THEN 30 + (k + 1) * 0.25::DOUBLE WHEN k = 7 THEN 30.75::DOUBLE ELSE lat END AS lat,
         CASE WHEN k % 8 = 4 AND k + 1 <= (SELECT max(s_suppkey) FROM supplier) THEN 'alias' WHEN k = 7 THEN 'anchor' WHEN lon IS NULL THEN 'missing' ELSE 'own' END AS coord_status FROM n
), m AS (SELECT round(avg(lon), 7) AS lon, round(avg(lat), 7) AS lat FROM a WHERE k IN (1, 2, 3))
SELECT k AS s_suppkey, s_name, CASE WHEN k = 8 THEN m.lon ELSE a.lon END AS lon, CASE WHEN k = 8 THEN m.lat ELSE a.lat END AS lat, CASE WHEN k = 8 THEN 'derived' ELSE coord_status END AS coord_status FROM a, m""")
def alias_anchor_fill(spark, sf_dir):
    """Coordinates copied from aliases (if missing) and an anchor (always), and filled with a centroid."""
    n = supplier_points(spark, sf_dir)
    name = lambda i: f"Supplier#{i:09d}"
    names = n.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("target"))
    alias = names.where("k % 8 = 4").withColumn("source", F.format_string("Supplier#%09d", F.col("k") + 1))
    n = lookup.copy_coordinates(n, "s_name", alias, ["lon", "lat"], False, "alias")
    n = lookup.copy_coordinates(n, "s_name", names.where("k = 7").withColumn("source", F.lit(name(3))), ["lon", "lat"], True, "anchor")
    return lookup.fill_centroid(n, "s_name", [name(8)], [name(1), name(2), name(3)], ["lon", "lat"], "derived")


@query("""WITH q AS (SELECT * FROM (SELECT s_nationkey, s_acctbal, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS rn FROM supplier WHERE contains(s_name, '7')) WHERE rn = 1)
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal ELSE s_acctbal END AS lon, CASE WHEN c_custkey % 3 = 0 THEN 'own' WHEN s_suppkey IS NULL THEN 'missing' ELSE 'poi' END AS coord_status FROM customer LEFT JOIN q ON c_nationkey = s_nationkey""")
def poi_fallback(spark, sf_dir):
    """Rows without coordinates take the first point of interest that lies in the right place."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("name"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal")).alias("lon"), F.when(F.col("c_custkey") % 3 == 0, "own").otherwise("missing").alias("coord_status"))
    pois = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("query_name"), F.col("s_suppkey").alias("poi_order"), F.lit(None).cast("string").alias("district"), F.col("s_name").alias("address"), F.col("s_acctbal").alias("lon"))
    # Names asked for hold a digit 7 for some nations, so the test is on the address alone.
    pois = pois.withColumn("query_name", F.translate("query_name", "0123456789", "abcdefghij"))
    c = c.withColumn("name", F.translate("name", "0123456789", "abcdefghij"))
    return lookup.poi_fallback(c, "name", pois, ["7"], ["lon"], "poi").select("c_custkey", "lon", "coord_status")


@query("""WITH a AS (SELECT c_custkey AS id, c_name AS name, NULL AS pixel_x, NULL AS map_x FROM customer), b AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'img' || c_custkey END AS name, c_custkey::VARCHAR AS pixel_x FROM customer), c AS (
  SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'osm' || c_custkey END AS name, (c_custkey * 2)::VARCHAR AS map_x FROM customer WHERE c_custkey % 4 = 0)
SELECT a.id, coalesce(nullif(c.name, ''), nullif(b.name, ''), a.name) AS name, b.pixel_x, c.map_x FROM a LEFT JOIN b ON a.id = b.id LEFT JOIN c ON a.id = c.id""")
def control_overlay(spark, sf_dir):
    """Control points with the attributes of image and map features, the later layer first where it is not blank."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_name")
    base = c.select("id", F.col("c_name").alias("name"))
    image = c.select("id", F.when(F.col("id") % 3 == 0, "").otherwise(F.concat(F.lit("img"), "id")).alias("name"), F.col("id").cast("string").alias("pixel_x"))
    osm = c.where("id % 4 = 0").select("id", F.when(F.col("id") % 5 == 0, F.concat(F.lit("osm"), "id")).alias("name"), (F.col("id") * 2).cast("string").alias("map_x"))
    return lookup.overlay(base, "id", [image, osm], ["name", "pixel_x", "map_x"])


@query("""WITH u AS (SELECT p_name AS name, p_partkey AS k, 0 AS src, p_partkey AS o FROM part WHERE p_partkey % 7 = 0 UNION ALL SELECT p_type, p_partkey, 1, p_partkey FROM part UNION ALL SELECT p_name, p_partkey, 2, p_partkey FROM part)
SELECT name, k FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY src, o) AS rn FROM u) WHERE rn = 1""")
def named_first(spark, sf_dir):
    """Named rows of several layers; the first layer that has a name wins."""
    p = table(spark, sf_dir, "part")
    one = p.where("p_partkey % 7 = 0").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("k"))
    return upsert.union_first([one, p.select(F.col("p_type").alias("name"), F.col("p_partkey").alias("k")), p.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("k"))], ["name"], [F.col("k")])


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'manual' WHEN p_partkey % 3 = 0 THEN 'previous' ELSE lower(p_type) END AS choice FROM part""")
def previous_choice(spark, sf_dir):
    """Manual choices before previous ones before rules."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_type").alias("choice"))
    return upsert.previous_choice(p, "p_partkey", p.where("p_partkey % 5 = 0").withColumn("choice", F.lit("manual")), p.where("p_partkey % 3 = 0").withColumn("choice", F.lit("previous")), ["choice"])


@query("""WITH m AS (SELECT 'map' || (p_size % 10) || '_' || p_partkey AS place_id, p_name AS name FROM part), i AS (SELECT 'map3_' || p_partkey AS place_id, upper(p_name) AS name FROM part WHERE p_size % 10 = 3)
SELECT * FROM m WHERE place_id NOT IN (SELECT place_id FROM i) AND NOT starts_with(place_id, 'map3_') UNION ALL SELECT * FROM i""")
def merge_master(spark, sf_dir):
    """A master table after the import of one map."""
    p = table(spark, sf_dir, "part")
    m = p.select(F.concat(F.lit("map"), F.col("p_size") % 10, F.lit("_"), "p_partkey").alias("place_id"), F.col("p_name").alias("name"))
    i = p.where("p_size % 10 = 3").select(F.concat(F.lit("map3_"), "p_partkey").alias("place_id"), F.upper("p_name").alias("name"))
    return upsert.merge_master(m, i, "place_id", "map3")


@query("""SELECT p_partkey, p_name FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT p_partkey, upper(p_name) FROM part WHERE p_partkey % 3 = 0""")
def upsert_rows(spark, sf_dir):
    """A table after an upsert by key."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return upsert.upsert(p, p.where("p_partkey % 3 = 0").withColumn("p_name", F.upper("p_name")), ["p_partkey"])


@query("""SELECT o_orderkey, row_number() OVER (ORDER BY CASE WHEN o_orderkey % 9 = 0 THEN 999999 ELSE year(o_orderdate) END, CASE left(o_orderpriority, 1) WHEN '1' THEN 0 WHEN '2' THEN 0 WHEN '3' THEN 1 WHEN '4' THEN 2 ELSE 3 END, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 4 ELSE 1 END, lpad(o_orderkey::VARCHAR, 12, '0')) AS rank FROM orders""")
def sort_keys(spark, sf_dir):
    """Rank by year (missing last), priority, status and name over the whole table."""
    p = F.substring("o_orderpriority", 1, 1)
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 9 != 0, F.year("o_orderdate")).alias("year"), F.when(p.isin("1", "2"), "high").when(p == "3", "medium").when(p == "4", "low").otherwise("").alias("priority"),
        F.when(F.col("o_orderstatus") == "F", "matched").when(F.col("o_orderstatus") == "O", "unmatched").otherwise("review").alias("status"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("name"),
    )
    return ranking.global_rank(o, ranking.time_order("year", "priority", "status", "name"), "rank").select("o_orderkey", "rank")


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer WHERE c_nationkey = 7 OR c_acctbal >= 5000)
SELECT c_custkey, c_mktsegment FROM e WHERE c_nationkey = 7 OR rn <= 35""")
def quota_topk(spark, sf_dir):
    """Priority rows always, and others of a least score up to a quota, by segment."""
    c = table(spark, sf_dir, "customer")
    return ranking.quota_top(c, F.col("c_nationkey") == 7, F.col("c_acctbal"), 5000.0, 35, [F.col("c_custkey")], ["c_mktsegment"]).select("c_custkey", "c_mktsegment")


@query("""SELECT event_id, user_id, greatest(900, floor(20000 / count(*) OVER w + 0.5))::BIGINT AS step_ms, ((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) * greatest(900, floor(20000 / count(*) OVER w + 0.5)))::BIGINT AS at_ms,
CASE WHEN count(*) OVER w > 1 THEN floor((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) / (count(*) OVER w - 1) * 100 + 0.5) ELSE 100 END::BIGINT AS progress FROM events WINDOW w AS (PARTITION BY user_id)""")
def playback(spark, sf_dir):
    """Timeline steps of each user's events."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return ranking.playback(e, ["user_id"], [F.col("ts"), F.col("event_id")]).drop("ts")


@query("""SELECT user_id, event_id, row_number() OVER w AS no, lag(event_id::DOUBLE) OVER w AS prev_x, lag(value) OVER w AS prev_y FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def path(spark, sf_dir):
    """The ordered path of each user's events, a row a vertex with the vertex before it."""
    return event_path(spark, sf_dir).select("user_id", "event_id", "no", "prev_x", "prev_y")


def event_path(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value", F.col("event_id").cast("double").alias("x"))
    return ranking.path_rows(e, ["user_id"], [F.col("ts"), F.col("event_id")], "x", "value")


@query("""WITH s AS (SELECT user_id, sqrt((event_id::DOUBLE - lag(event_id::DOUBLE) OVER w) ** 2 + (value - lag(value) OVER w) ** 2) AS step FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, count(*) AS vertices, round(coalesce(sum(step), 0), 3) AS length FROM s GROUP BY user_id""")
def path_totals(spark, sf_dir):
    """Vertices and length of each user's path."""
    return ranking.path_totals(event_path(spark, sf_dir), ["user_id"], "x", "value").withColumn("length", F.round("length", 3))


@query("""SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank, count(*) OVER (PARTITION BY event_type) AS n FROM events""")
def rank_in_type(spark, sf_dir):
    """The rank of each event among those of its type, of which there are few with very many rows."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return ranking.rank_by_key(e, ["event_type"], [F.col("value").desc(), F.col("event_id")], "rank", "n").drop("value")


@query("""SELECT p_type, count(*)::BIGINT AS total, array_to_string(list(p_name ORDER BY p_partkey)[1:80], '、') AS line FROM part GROUP BY p_type""")
def grouped_index(spark, sf_dir):
    """The first 80 names of each type in one line."""
    return tables.grouped_index(table(spark, sf_dir, "part"), "p_type", "p_name", [F.col("p_partkey")], 80)


@query("""WITH r AS (SELECT row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank, c_name, c_mktsegment FROM customer)
SELECT line_no, line FROM (SELECT -4 AS line_no, '# Customers' AS line UNION ALL SELECT -3, '' UNION ALL SELECT -2, '| rank | c_name | c_mktsegment |' UNION ALL SELECT -1, '| --- | --- | --- |' UNION ALL SELECT rank, '| ' || rank || ' | ' || c_name || ' | ' || c_mktsegment || ' |' FROM r WHERE rank <= 30)""")
def ranked_report(spark, sf_dir):
    """A Markdown report of the 30 leading rows."""
    c = ranking.global_rank(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_name", "c_mktsegment"), [F.desc("c_acctbal"), F.asc("c_custkey")], "rank")
    return tables.ranked_report(c, "Customers", ["rank", "c_name", "c_mktsegment"], "rank", 30)


@query("""SELECT 'total' AS section, '' AS key, count(*)::BIGINT AS n FROM customer UNION ALL SELECT 'negative', '', count(*) FILTER (WHERE c_acctbal < 0) FROM customer UNION ALL SELECT 'third', '', count(*) FILTER (WHERE c_nationkey = 3) FROM customer
UNION ALL SELECT 'by_c_mktsegment', c_mktsegment, count(*) FROM customer GROUP BY 2 UNION ALL SELECT 'by_c_nationkey', c_nationkey::VARCHAR, count(*) FROM customer GROUP BY 2 UNION ALL SELECT 'by_digit', (c_custkey % 10)::VARCHAR, count(*) FROM customer GROUP BY 2""")
def summary(spark, sf_dir):
    """Totals and the value counts of three columns, as rows, from one scan."""
    c = table(spark, sf_dir, "customer").withColumn("digit", F.col("c_custkey") % 10)
    return tables.summary(c, {"negative": F.col("c_acctbal") < 0, "third": F.col("c_nationkey") == 3}, ["c_mktsegment", "c_nationkey", "digit"])


@query("""WITH s AS (SELECT *, row_number() OVER (ORDER BY s_nationkey, s_suppkey) AS no FROM supplier WHERE s_suppkey % 3 = 0), g AS (SELECT s_nationkey::VARCHAR AS k, count(*) AS n FROM s GROUP BY 1)
SELECT -4 AS line_no, '# Sample' AS line UNION ALL SELECT -3, '' UNION ALL SELECT -2, '| s_suppkey | s_name | s_nationkey |' UNION ALL SELECT -1, '| --- | --- | --- |'
UNION ALL SELECT no, '| ' || s_suppkey || ' | ' || s_name || ' | ' || s_nationkey || ' |' FROM s UNION ALL SELECT row_number() OVER (ORDER BY k) - 1000000000, '- ' || k || ': ' || n FROM g""")
def sample_report(spark, sf_dir):
    """The report of a sample: how many rows of each group it has, and its rows."""
    s = table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0")
    return tables.sample_report(s, "Sample", ["s_suppkey", "s_name", "s_nationkey"], [F.col("s_nationkey"), F.col("s_suppkey")], "s_nationkey")


PLACES_SQL = """WITH p AS (
  SELECT row_number() OVER (ORDER BY name, pos) AS seq, *, CASE WHEN pos % 2 = 0 THEN 'road' ELSE 'park' END AS place_type FROM (
    SELECT DISTINCT p_name AS base, p_size % length(p_name) AS pos, overlay AS name FROM (SELECT p_name, p_size, left(p_name, p_size % length(p_name)) || 'x' || substr(p_name, p_size % length(p_name) + 2) AS overlay FROM part))
), f AS (
  SELECT row_number() OVER (ORDER BY osm_name) AS feature_seq, osm_name, CASE WHEN n % 2 = 0 THEN 'way' ELSE 'node' END AS osm_type, CASE WHEN n % 3 = 0 THEN 'highway:residential' WHEN n % 3 = 1 THEN 'leisure:park' ELSE 'named' END AS osm_class, n
  FROM (SELECT p_name AS osm_name, count(*) AS n FROM part GROUP BY p_name)
) """


def misspelt(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    pos = F.col("p_size") % F.length("p_name")
    names = p.select(F.col("p_name").alias("base"), pos.alias("pos"), F.concat(F.substring(F.col("p_name"), F.lit(1), pos), F.lit("x"), F.substring(F.col("p_name"), pos + 2, F.length("p_name"))).alias("name")).distinct()
    places = ranking.global_rank(names, [F.asc("name"), F.asc("pos")], "seq").withColumn("place_type", F.when(F.col("pos") % 2 == 0, "road").otherwise("park")).select("seq", "name", "place_type")
    by = p.groupBy(F.col("p_name").alias("osm_name")).agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    features = ranking.global_rank(by, [F.asc("osm_name")], "feature_seq").select(
        "feature_seq", "osm_name", F.when(n % 2 == 0, "way").otherwise("node").alias("osm_type"), F.when(n % 3 == 0, "highway:residential").when(n % 3 == 1, "leisure:park").otherwise("named").alias("osm_class"),
        n.cast("double").alias("lon"), (-n).cast("double").alias("lat"),
    )
    compat = p.select(F.explode(F.array(F.struct(F.lit("road").alias("place_type"), F.lit("highway:").alias("token")), F.struct(F.lit("park").alias("place_type"), F.lit("leisure:").alias("token")))).alias("c")).distinct().select("c.*")
    return places, features, compat


@query(PLACES_SQL + """, s AS (
  SELECT p.seq, p.name, f.*, (place_type = 'road' AND contains(osm_class, 'highway:')) OR (place_type = 'park' AND contains(osm_class, 'leisure:')) AS fits, lower(replace(name, ' ', '')) AS pn, lower(replace(osm_name, ' ', '')) AS fn FROM p, f
), t AS (
  SELECT *, CASE WHEN pn = fn THEN 1.0::DOUBLE WHEN fits AND (contains(pn, fn) OR contains(fn, pn)) THEN least(length(pn), length(fn)) / greatest(length(pn), length(fn)) ELSE 1 - levenshtein(pn, fn) / greatest(length(pn), length(fn)) END AS score,
         CASE WHEN pn = fn THEN 'exact' WHEN fits AND (contains(pn, fn) OR contains(fn, pn)) THEN 'contains' ELSE 'fuzzy' END AS method FROM s
), r AS (
  SELECT *, row_number() OVER (PARTITION BY seq ORDER BY score + CASE WHEN fits THEN 0.08::DOUBLE ELSE 0.0 END + CASE WHEN osm_type = 'way' THEN 0.04::DOUBLE ELSE 0.0 END DESC, feature_seq) AS rn FROM t
), b AS (
  SELECT *, CASE WHEN fits AND method IN ('exact', 'contains') THEN 'matched' WHEN round(score, 3) >= 0.72 THEN 'review' ELSE 'unmatched' END AS match_status FROM r WHERE rn = 1
) SELECT seq, match_status, CASE WHEN match_status = 'unmatched' THEN '' ELSE method END AS match_method, CASE WHEN match_status = 'unmatched' THEN 0.0 ELSE round(score, 3) END AS match_score, CASE WHEN match_status <> 'unmatched' THEN osm_name END AS osm_name FROM b""")
def fuzzy_match(spark, sf_dir):
    """Misspelt names and their best reference feature, by edit distance."""
    places, features, compat = misspelt(spark, sf_dir)
    return match.match_places(places, features, compat, "levenshtein").select("seq", "match_status", "match_method", "match_score", "osm_name")


@query()
def fuzzy_match_ratio(spark, sf_dir):
    """The same by common blocks, which SQL lacks; a test holds the matcher against all pairs."""
    places, features, compat = misspelt(spark, sf_dir)
    return match.match_places(places, features, compat, "ratio").select("seq", "match_status", "match_method", "match_score", "osm_name")


@query()
def label_match(spark, sf_dir):
    """Misspelt labels with alternatives and their best master name by common blocks; by edit distance see q_label_match_edit."""
    places, features, _ = misspelt(spark, sf_dir)
    labels = places.select("seq", F.array("name", F.reverse("name")).alias("texts"))
    master = features.select(F.col("feature_seq").alias("master_seq"), F.col("osm_name").alias("name"), F.when(F.col("osm_class") == "named", "桥梁").otherwise("其他").alias("category"))
    return match.match_labels(labels, master, [("redring", "^red.*g$", "special_ring", 0.9)])


@query("""WITH v AS (SELECT k, o, row_number() OVER (PARTITION BY k ORDER BY o DESC) AS rn, bal FROM (SELECT s_nationkey AS k, s_suppkey AS o, s_acctbal AS bal FROM supplier))
SELECT c_custkey, bal FROM customer LEFT JOIN v ON c_nationkey = k AND rn = 1""")
def last_wins(spark, sf_dir):
    """Lookup in a table with repeated names, of which the last row counts."""
    v = lookup.keep_one(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), "s_suppkey", F.col("s_acctbal").alias("bal")), ["k"], [F.desc("s_suppkey")])
    return table(spark, sf_dir, "customer").join(v, F.col("c_nationkey") == F.col("k"), "left").select("c_custkey", "bal")


@query("""WITH e AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_name END AS name, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_acctbal END AS lon, s_nationkey AS n FROM supplier)
SELECT id AS osm_id, coalesce(name, 'zh' || id) AS osm_name, CASE WHEN n % 2 = 0 THEN 'way' ELSE 'node' END AS osm_type, CASE WHEN n % 2 = 0 THEN 'highway:n' || n ELSE 'natural:water' END AS osm_class, coalesce(nullif(lon, 0), 1.5) AS lon, 2.5::DOUBLE AS lat FROM e WHERE name IS NOT NULL OR id % 2 = 0""")
def osm_extract(spark, sf_dir):
    """Named and located elements of a map extract, with their first class tag."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    no_name, no_lon = F.lit(None).cast("string"), F.lit(None).cast("double")
    tags = F.map_filter(F.create_map(F.lit("name"), F.when(k % 3 != 0, F.col("s_name")).otherwise(no_name), F.lit("name:zh"), F.when(k % 2 == 0, F.concat(F.lit("zh"), k)), F.lit("natural"), F.lit("water"), F.lit("highway"), F.when(n % 2 == 0, F.concat(F.lit("n"), n))), lambda _, v: v.isNotNull())
    element = F.struct(F.when(n % 2 == 0, "way").otherwise("node").alias("type"), k.alias("id"), F.when(k % 4 != 0, F.col("s_acctbal")).otherwise(no_lon).alias("lon"), F.when(k % 4 != 0, 2.5).alias("lat"), F.struct(F.lit(1.5).alias("lon"), F.lit(2.5).alias("lat")).alias("center"), tags.alias("tags"))
    return ocr.osm_features(table(spark, sf_dir, "supplier").select(F.array(element).alias("elements")), ["highway", "natural"]).drop("feature_seq")


@query("""SELECT e.event_id, 'T' || e.event_id AS title, CASE WHEN length(e.event_type || ' ' || e.props) > 12 THEN left(e.event_type || ' ' || e.props, 12) || '...' ELSE e.event_type || ' ' || e.props END AS short,
CASE WHEN year(ts) BETWEEN 2014 AND 2099 THEN '运河文旅更新' ELSE '无明确时间' END AS time_type, n.n_name FROM events e LEFT JOIN nation n ON 'NATION_' || (user_id % 30) = n.n_name""")
def milestones(spark, sf_dir):
    """Events with their place, time window and shortened text."""
    e = table(spark, sf_dir, "events").withColumn("k", F.concat(F.lit("NATION_"), F.col("user_id") % 30))
    n = table(spark, sf_dir, "nation").select("n_name")
    out = e.join(lookup.small(n), F.col("k") == F.col("n_name"), "left")
    return out.select("event_id", F.concat(F.lit("T"), "event_id").alias("title"), T.ellipsis(F.concat("event_type", F.lit(" "), "props"), 12).alias("short"), years.time_window(F.year("ts")).alias("time_type"), "n_name")


@query("""SELECT p_partkey, to_json({'p_name': p_name, 'p_brand': p_brand, 'p_size': p_size})::VARCHAR AS notes FROM part""")
def notes_json(spark, sf_dir):
    """Compact JSON notes of chosen columns."""
    return table(spark, sf_dir, "part").select("p_partkey", T.compact_json(["p_name", "p_brand", "p_size"]).alias("notes"))


@query("""WITH d AS (SELECT item_id, length(text) AS n FROM benchmark) SELECT item_id, n::INTEGER AS n, row_number() OVER (ORDER BY n DESC, item_id) AS part_rank FROM d""")
def benchmark_rank(spark, sf_dir):
    """Global rank without a one-task sort."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.length("text").alias("n"))
    return ranking.global_rank(b, [F.desc("n"), F.asc("item_id")], "part_rank")


