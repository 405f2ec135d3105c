"""Registered queries over sources, sinks and user-level jobs, each with its DuckDB twin."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from mapmill.functions import geo
from mapmill.functions import text as T
from mapmill.operators import boxes, georef, intervals, lookup, match, mentions, ranking, upsert
from mapmill.plans import jobs
from mapmill.plans.geo_queries import BOX_SQL, LONLAT_SQL, SAMPLE_SQL, box_table, lonlat, sample_rows
from mapmill.plans.table_queries import PLACES_SQL, RULES_SQL, misspelt
from mapmill.plans.text_queries import CANDIDATE_SQL, D_SQL, LEVEL_SQL, SUFFIXES, dictionary, table
from mapmill.sources import geojson, ocr, tables
from mapmill.sources.versions import VersionedTable
from mapmill.storage import shared_dir

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        Q[f"q_{f.__name__}"], SQL[f"q_{f.__name__}"] = f, sql
        return f

    return add


def scratch(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("""SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_name END AS name, '{"name":"' || p_name || '","brand":"' || p_brand || '"}' AS notes, p_name || chr(10) || p_type AS lines, NULL::VARCHAR AS missing FROM part""")
def csv_roundtrip(spark, sf_dir):
    """A table written as CSV with an exact field list and read again: JSON, line breaks and blanks in fields."""
    p = table(spark, sf_dir, "part")
    notes = F.concat(F.lit('{"name":"'), "p_name", F.lit('","brand":"'), "p_brand", F.lit('"}'))
    rows = p.select(F.col("p_partkey").alias("k"), F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.col("p_name")).alias("name"), notes.alias("notes"), F.concat("p_name", F.lit("\n"), "p_type").alias("lines"), F.lit(1).alias("extra"))
    path = scratch(spark, "csv")
    tables.write_csv(rows, path, ["k", "name", "notes", "lines", "missing"])
    return tables.read_csv(spark, path, "k bigint, name string, notes string, lines string, missing string")


@query("""SELECT CASE WHEN s_suppkey % 4 = 2 THEN 'm2' ELSE 'f' || s_suppkey END AS map_id, 0 AS seq, s_name AS text, NULL AS name, s_suppkey::DOUBLE AS x1 FROM supplier
UNION ALL SELECT CASE WHEN s_suppkey % 4 = 2 THEN 'm2' ELSE 'f' || s_suppkey END, 1, NULL, 'b', NULL FROM supplier WHERE s_suppkey % 2 = 0""")
def ocr_payloads(spark, sf_dir):
    """Candidates of payload texts: objects with a map id or without, and bare lists, whose map is the file's stem."""
    k = F.col("s_suppkey")
    one = F.concat(F.lit('{"text":"'), "s_name", F.lit('","bbox_pixel":['), k, F.lit(',2,3,4]}'))
    whole = F.concat(F.lit("{"), F.when(k % 4 == 2, '"map_id":"m2",').otherwise(""), F.lit('"candidates":['), one, F.lit(',{"name":"b"}]}'))
    texts = table(spark, sf_dir, "supplier").select(F.when(k % 2 == 0, whole).otherwise(F.concat(F.lit("["), one, F.lit("]"))).alias("value"), F.concat(F.lit("f"), k, F.lit("_text_candidates")).alias("stem"))
    return ocr.candidates_of(texts, "value", F.col("stem")).select("map_id", "seq", "text", "name", F.get("bbox_pixel", F.lit(0)).alias("x1"))


@query("SELECT doc_id, md5(text) AS hash, length(text)::INTEGER AS n FROM documents")
def decoded_texts(spark, sf_dir):
    """Whole texts of bytes of which some are no text."""
    part = lambda *at: F.encode(F.substring("text", *at), "utf-8")
    content = F.concat(part(1, 3), F.unhex(F.lit("FF")), part(4, 2_000_000_000), F.unhex(F.lit("C3")))
    texts = table(spark, sf_dir, "documents").select("doc_id", tables.decoded(content).alias("text"))
    return texts.select("doc_id", F.md5("text").alias("hash"), F.length("text").alias("n"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey::DOUBLE AS x1, (l_suppkey + l_linenumber)::DOUBLE AS y2 FROM lineitem WHERE l_linenumber % 2 = 1 AND l_discount * 1000 >= 50""")
def word_boxes(spark, sf_dir):
    """Words of a recogniser's table with enough confidence, and their boxes."""
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (4 + F.col("l_linenumber") % 2).alias("level"), F.col("l_partkey").alias("left"), F.col("l_suppkey").alias("top"), F.lit(7).alias("width"), F.col("l_linenumber").alias("height"), (F.col("l_discount") * 1000).alias("conf"))
    return tables.words_of(t, 50).select("l_orderkey", "l_linenumber", F.col("bbox_pixel")[0].alias("x1"), F.col("bbox_pixel")[3].alias("y2"))


@query("""SELECT p_type AS target_layer, (CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 2 ELSE 1 END)::INTEGER AS version, count(*)::BIGINT AS n, sum(p_partkey)::BIGINT AS total FROM part GROUP BY ALL""")
def layers_rerun(spark, sf_dir):
    """Layers written twice: the second run replaces those that it writes and no other."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("target_layer"), F.lit(1).alias("version"))
    path = scratch(spark, "layers")
    tables.write_layers(p, path)
    tables.write_layers(p.where(F.col("target_layer").isin("ECONOMY", "SMALL")).withColumn("version", F.lit(2)), path)
    return spark.read.parquet(path).groupBy("target_layer", "version").agg(F.count(F.lit(1)).alias("n"), F.sum("p_partkey").alias("total"))


@query("""WITH m AS (SELECT 'map' || (p_size % 10) || '_' || p_partkey AS place_id, p_name AS name FROM part), i AS (SELECT 'map3_' || p_partkey AS place_id, upper(p_name) AS name FROM part WHERE p_size % 10 = 3)
SELECT 1 AS version, place_id, name FROM m UNION ALL SELECT 3, place_id, name FROM m WHERE NOT starts_with(place_id, 'map3_') UNION ALL SELECT 3, * FROM i""")
def master_versions(spark, sf_dir):
    """A master table, the import of a map, and its rerun as three versions: the first, pinned before the others, and the one in force."""
    p = table(spark, sf_dir, "part")
    m = p.select(F.concat(F.lit("map"), F.col("p_size") % 10, F.lit("_"), "p_partkey").alias("place_id"), F.col("p_name").alias("name"))
    i = p.where("p_size % 10 = 3").select(F.concat(F.lit("map3_"), "p_partkey").alias("place_id"), F.upper("p_name").alias("name"))
    master = VersionedTable(spark, scratch(spark, "master"))
    master.commit(m, 0)
    pinned = master.read()
    for _ in range(2):
        jobs.import_into(master, i, "map3")
    return pinned.select(F.lit(1).alias("version"), "*").unionByName(master.read().select(F.lit(master.current()).alias("version"), "*"))


STANDARD_SQL = RULES_SQL + """, c AS (
  SELECT p_partkey AS k, p_partkey % 3 AS m, row_number() OVER (PARTITION BY p_partkey % 3 ORDER BY p_partkey) AS no, CASE WHEN p_partkey % 7 = 0 THEN 'n' || p_partkey WHEN p_partkey % 7 = 1 THEN '' ELSE p_name END AS name,
         CASE WHEN p_partkey % 11 = 0 THEN '其他' ELSE p_type END AS category, p_retailprice AS r, p_size::DOUBLE AS s FROM part
), d AS (
  SELECT CASE WHEN k % 5 = 0 THEN 'own' || k ELSE 'map_' || m || '_' || printf('%03d', no) END AS place_id, m, name, category, coalesce(r.target_layer, 'layer_other') AS target_layer,
         CASE k % 4 WHEN 0 THEN c.r WHEN 1 THEN s WHEN 2 THEN 13375000 + 5 * (s + 5) END AS x, CASE k % 4 WHEN 0 THEN c.r WHEN 1 THEN s WHEN 2 THEN 3539000 - 5 * (s + 10) END AS y,
         CASE WHEN k % 2 = 0 THEN 'high' ELSE 'medium' END AS confidence,
         CASE WHEN m = 1 THEN 'rmse above limit' WHEN k % 4 = 3 OR (k % 4 = 2 AND m = 2) THEN 'needs x/y, map_x/map_y, or a box and a transform' END AS problem
  FROM c LEFT JOIN r USING (category) WHERE name <> ''
) """


def standard_places(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size").cast("double")
    p = table(spark, sf_dir, "part")
    none = lambda *names: {n: F.lit(None).cast("string") for n in names}
    c = p.select(
        F.concat(F.lit("map "), k % 3).alias("map_id"), k.alias("seq"), F.when(k % 7 == 0, " ").when(k % 7 != 1, F.col("p_name")).alias("text"), F.when(k % 7 == 0, F.concat(F.lit("n"), k)).alias("name"), F.when(k % 11 != 0, F.col("p_type")).alias("category"),
        F.when(k % 5 == 0, F.concat(F.lit("own"), k)).alias("place_id"), F.when(k % 2 == 0, "high").alias("confidence"), F.when(k % 4 == 0, F.col("p_retailprice")).alias("x"), F.when(k % 4 == 0, F.col("p_retailprice")).alias("y"),
        F.when(k % 4 == 1, s).alias("map_x"), F.when(k % 4 == 1, s).alias("map_y"), F.when(k % 4 == 2, F.array(s, s, s + 10, s + 20)).alias("bbox_pixel"),
    ).withColumns(none("orientation", "notes", "source_map", "source_stage", "reference_logic"))
    by = p.groupBy("p_type").agg(F.max("p_size").alias("w"))
    rules = by.where(F.length("p_type") % 2 == 0).select(F.col("p_type").alias("category"), F.concat(F.lit("layer_"), F.lower("p_type")).alias("target_layer")).unionByName(by.agg(F.lit("其他").alias("category"), F.lit("layer_other").alias("target_layer")))
    rules = rules.withColumns({n: F.lit("x") for n in ("display_name", "qgis_geometry", "semantic_geometry", "geometry_level")})
    first = F.col("map_id") == "map 0"
    numbers = {"x_origin": 13375000.0, "pixel_width": 5.0, "x_rotation": 0.0, "y_origin": 3539000.0, "y_rotation": 0.0, "pixel_height": -5.0}
    t = c.select("map_id").distinct().where("map_id <> 'map 2'").select("map_id", F.lit("loaded").alias("status"), F.lit(5).alias("control_point_count"), F.when(first, 10.0).otherwise(80.0).alias("rmse_m"), F.when(first, 20.0).otherwise(90.0).alias("max_error_m"), F.struct(*[F.lit(v).alias(n) for n, v in numbers.items()]).alias("coefficients"))
    return jobs.standard_places(c, rules, t, "v1")


@query(STANDARD_SQL + "SELECT place_id, name, category, target_layer, x, y, confidence FROM d WHERE problem IS NULL")
def place_import(spark, sf_dir):
    """Recognised candidates as standard places: numbered by map before unnamed ones go, with rules, defaults and coordinates."""
    return standard_places(spark, sf_dir)[0].select("place_id", "name", "category", "target_layer", "x", "y", "confidence")


@query(STANDARD_SQL + "SELECT place_id, name, problem FROM d WHERE problem IS NOT NULL")
def place_problems(spark, sf_dir):
    """Candidates that cannot be imported, and why."""
    return standard_places(spark, sf_dir)[1]


@query(STANDARD_SQL + """, p AS (SELECT * FROM d WHERE problem IS NULL), i AS (SELECT place_id, name FROM p WHERE m = 0), h AS (SELECT place_id, upper(name) AS name FROM p UNION ALL SELECT 'map_0_old' || r_regionkey, r_name FROM region)
SELECT * FROM h WHERE place_id NOT IN (SELECT place_id FROM i) AND NOT starts_with(place_id, 'map_0_') UNION ALL SELECT * FROM i""")
def import_map(spark, sf_dir):
    """The master table after one map's standard places were imported again."""
    p = standard_places(spark, sf_dir)[0]
    old = table(spark, sf_dir, "region").select(F.concat(F.lit("map_0_old"), "r_regionkey").alias("place_id"), F.col("r_name").alias("name"))
    master = p.select("place_id", F.upper("name").alias("name")).unionByName(old)
    return jobs.import_map(master, p.where("source_map = 'map 0'").select("place_id", "name"), "map_0")


@query("""SELECT p_partkey, p_name FROM part WHERE p_partkey % 50 = 0 OR (NOT contains(p_name, 'bolt') AND regexp_matches(p_name, 'ring|widget|red') AND NOT (p_type = 'SMALL' AND length(p_name) > 8) AND p_size >= 10)""")
def curated_places(spark, sf_dir):
    """The curated subset: seeds stay, noise goes, and the rest needs a local word, a length by type and a count."""
    return jobs.curated(table(spark, sf_dir, "part"), F.col("p_partkey") % 50 == 0, ["bolt"], ["ring", "widget", "red"], {"SMALL": 8}, 10, "p_name", "p_type", "p_size").select("p_partkey", "p_name")


@query("""SELECT p_partkey, p_size::DOUBLE AS pixel_x, p_retailprice AS pixel_y, 1.5::DOUBLE AS map_x FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 4 <> 1""")
def usable_pairs(spark, sf_dir):
    """Control points whose arrays hold exactly two numbers."""
    k = F.col("p_partkey")
    pair = F.array(F.col("p_size").cast("string"), F.when(k % 4 == 1, "x").otherwise(F.col("p_retailprice").cast("string")))
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(k % 3 == 0, F.array_append(pair, F.lit("0"))).otherwise(pair).alias("pixel"), F.array(F.lit("1.5"), F.lit("2")).alias("map"))
    return georef.usable_pairs(p).select("p_partkey", "pixel_x", "pixel_y", "map_x")


@query("""WITH c AS (SELECT c_custkey, c_custkey % 3 <> 0 AS there, coalesce(CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 2 = 0 END, FALSE) AS chosen FROM customer)
SELECT 'mapped' AS part, c_custkey FROM c WHERE there UNION ALL SELECT 'missing', c_custkey FROM c WHERE NOT there UNION ALL SELECT 'mapped_curated', c_custkey FROM c WHERE there AND chosen UNION ALL SELECT 'missing_curated', c_custkey FROM c WHERE NOT there AND chosen""")
def split_by_coordinates(spark, sf_dir):
    """Places with and without coordinates, in full and curated."""
    k = F.col("c_custkey")
    place = F.when(k % 3 != 0, F.col("c_acctbal"))
    c = table(spark, sf_dir, "customer").select("c_custkey", place.alias("lon"), place.alias("lat"), F.when(k % 5 != 0, k % 2 == 0).alias("in_curated_checklist"))
    return upsert.union_passes({n: d.select("c_custkey") for n, d in jobs.split_by_coordinates(c).items()}, "part")


def layer_rows(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", F.when(k % 3 == 0, "matched").when(k % 3 == 1, "review").otherwise("unmatched").alias("match_status"), k.alias("rank"), F.col("c_mktsegment").alias("time_type"))


@query("SELECT c_custkey FROM customer WHERE c_custkey % 3 IN (0, 1) AND c_custkey <= 500 AND c_mktsegment = 'BUILDING'")
def layer_subset(spark, sf_dir):
    """A map layer's rows: of some statuses, up to a rank, of one time."""
    return jobs.layer_subset(layer_rows(spark, sf_dir), ["matched", "review"], 500, "BUILDING").select("c_custkey")


@query("SELECT 'all' AS part, c_custkey FROM customer UNION ALL SELECT 'one', c_custkey FROM customer WHERE c_mktsegment = 'FURNITURE'")
def time_filter(spark, sf_dir):
    """Rows of one time window, and of all of them."""
    rows = layer_rows(spark, sf_dir)
    return upsert.union_passes({"all": jobs.time_filter(rows, "全部").select("c_custkey"), "one": jobs.time_filter(rows, "FURNITURE").select("c_custkey")}, "part")


@query("SELECT c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END AS lon, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey END AS height FROM customer")
def linked_selection(spark, sf_dir):
    """The point and the column of each selected name."""
    c = table(spark, sf_dir, "customer")
    points = c.where("c_custkey % 2 = 0").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("lon"), F.col("c_acctbal").alias("lat"))
    columns = c.where("c_custkey % 3 = 0").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("height_m"), F.array(F.col("c_acctbal")).alias("ring"))
    return jobs.linked_selection(c.select(F.col("c_name").alias("name")), points, columns).select("name", F.col("point.lon").alias("lon"), F.col("column.height_m").alias("height"))


LABEL_SQL = PLACES_SQL + """, t AS (
  SELECT seq, 0 AS text_no, name AS source_text, replace(trim(name), ' ', '') AS tn FROM p UNION ALL SELECT seq, 1, reverse(name), replace(trim(reverse(name)), ' ', '') FROM p
), m AS (
  SELECT feature_seq AS master_seq, osm_name AS name, replace(osm_name, ' ', '') AS mn, CASE WHEN n % 3 = 2 THEN '桥梁' ELSE '其他' END AS category FROM f
), s AS (
  SELECT *, round(1 - levenshtein(tn, mn) / greatest(length(tn), length(mn)), 3) AS sim FROM t, m
), l AS (
  SELECT *, CASE WHEN tn = mn THEN 'normalized_exact' WHEN mn = 'redring' AND regexp_matches(tn, '^red.*g$') THEN 'special_ring' WHEN length(mn) >= 3 AND contains(tn, mn) THEN 'contains_standard_name'
    WHEN category = '桥梁' AND length(tn) >= 2 AND contains(mn, tn) THEN 'partial_structural_name' WHEN category = '桥梁' AND sim >= 0.72 THEN 'fuzzy_structural_name' WHEN length(mn) >= 3 AND sim >= 0.84 THEN 'fuzzy_name' END AS match_type FROM s
), o AS (
  SELECT *, CASE match_type WHEN 'normalized_exact' THEN 1.0 WHEN 'special_ring' THEN 0.9 WHEN 'contains_standard_name' THEN 0.88 WHEN 'partial_structural_name' THEN 0.84 ELSE sim END::DOUBLE AS match_score FROM l WHERE match_type IS NOT NULL
), b AS (
  SELECT *, row_number() OVER (PARTITION BY seq ORDER BY match_score DESC, length(mn) DESC, text_no, master_seq) AS rn FROM o WHERE match_score >= 0.86 OR match_type = 'special_ring'
) """
SPECIALS = [("redring", "^red.*g$", "special_ring", 0.9)]


def labels_and_master(spark, sf_dir):
    places, features, _ = misspelt(spark, sf_dir)
    labels = places.select("seq", F.array("name", F.reverse("name")).alias("texts"), F.concat(F.lit("o"), F.col("seq") % 50).alias("ocr_id"), F.col("seq").cast("double").alias("pixel_x"), F.lit(1.0).alias("pixel_y"))
    return labels, features.select(F.col("feature_seq").alias("master_seq"), F.col("osm_name").alias("name"), F.when(F.col("osm_class") == "named", "桥梁").otherwise("其他").alias("category"))


@query(LABEL_SQL + "SELECT seq, source_text, name AS matched_name, category AS matched_category, match_type, match_score FROM b WHERE rn = 1")
def label_match_edit(spark, sf_dir):
    """Labels with alternatives and their best master name by the ladder of rules, by edit distance."""
    labels, master = labels_and_master(spark, sf_dir)
    return match.match_labels(labels.select("seq", "texts"), master, SPECIALS, "levenshtein")


@query(LABEL_SQL + """, k AS (SELECT *, 'o' || (seq % 50) AS ocr_id FROM b WHERE rn = 1), d AS (SELECT *, row_number() OVER (PARTITION BY ocr_id, name ORDER BY match_score DESC, seq) AS nth FROM k), e AS (
  SELECT *, row_number() OVER (ORDER BY match_score DESC, name, ocr_id) AS no FROM d WHERE nth = 1
) SELECT 'cp_' || printf('%03d', no) AS control_id, name AS matched_name, match_type, match_score, ocr_id, seq::DOUBLE AS pixel_x, CASE WHEN match_score >= 0.94 THEN 1.0 ELSE 0.7 END::DOUBLE AS weight, 0 AS part_no FROM e
UNION ALL SELECT 'anchor_' || r_regionkey, r_name, 'manual', 0.0, '', 0.0, 1.0, 1 FROM region""")
def control_points(spark, sf_dir):
    """Control-point rows of matched labels, one a label and name, with manual rows after them."""
    labels, master = labels_and_master(spark, sf_dir)
    manual = table(spark, sf_dir, "region").select(F.concat(F.lit("anchor_"), "r_regionkey").alias("control_id"), F.lit("false").alias("enabled"), F.col("r_name").alias("matched_name"), F.lit("manual").alias("match_type"), F.lit(0.0).alias("match_score"), F.lit("").alias("ocr_id"), F.lit("").alias("source_text"), F.lit(0.0).alias("pixel_x"), F.lit(0.0).alias("pixel_y"), F.lit(1.0).alias("weight"))
    return jobs.control_point_table(labels, master, SPECIALS, manual, "levenshtein").select("control_id", "matched_name", "match_type", "match_score", "ocr_id", "pixel_x", "weight", "part_no")


@query(f"""WITH b AS (SELECT seq, '路' || label AS text, q, (round(x1, 2) + round(x1 + w, 2)) / 2 AS cx FROM {BOX_SQL}), m AS (SELECT '路' || (s_suppkey % 10) AS name, max(s_acctbal) AS x FROM supplier GROUP BY 1), e AS (
  SELECT *, row_number() OVER (ORDER BY q DESC, seq) AS rn FROM b WHERE text IN ('路1', '路2') OR q >= 0.01
), c AS (SELECT *, row_number() OVER (ORDER BY q DESC, seq) AS no FROM e WHERE text IN ('路1', '路2') OR rn <= 35)
SELECT 'cp_' || printf('%03d', no) AS control_id, c.text AS name, round(cx, 3) AS pixel_x, x AS map_x, CASE WHEN name IS NULL THEN '' ELSE 'standard_place_exact_match' END AS osm_reference FROM c LEFT JOIN m ON c.text = m.name""")
def priority_control_points(spark, sf_dir):
    """Control points of named labels always and of other good ones up to a quota, with the coordinates of the same name."""
    b = box_table(spark, sf_dir).select("seq", "text", "quality", F.transform("bbox", lambda v: F.round(v, 2)).alias("bbox_pixel"), F.lit("").alias("ocr_id"))
    master = table(spark, sf_dir, "supplier").select(F.concat(F.lit("路"), F.col("s_suppkey") % 10).alias("name"), F.col("s_acctbal").alias("x"), F.col("s_acctbal").alias("y"))
    out = jobs.priority_control_points(b, ["路1", "路2"], master, 0.01, 35)
    return out.select("control_id", "name", F.col("pixel_x").cast("double").alias("pixel_x"), "map_x", "osm_reference")


@query("""WITH c AS (SELECT 'p' || p_partkey AS name, p_partkey AS k, p_type AS t FROM part), d AS (
  SELECT name, t AS place_type, CASE WHEN k % 13 = 0 THEN 'matched' WHEN k % 7 = 0 THEN CASE WHEN k % 2 = 0 THEN 'review' ELSE 'context' END WHEN t = 'ECONOMY' THEN 'manual' WHEN length(t) % 2 = 0 THEN 'review' ELSE 'unmatched' END AS match_status,
    CASE WHEN k % 13 = 0 THEN 'high' WHEN k % 7 = 0 THEN 'medium' WHEN t = 'ECONOMY' OR length(t) % 2 = 0 THEN 'medium' ELSE 'low' END AS visual_priority,
    CASE WHEN k % 13 = 0 THEN 'check' WHEN k % 7 = 0 THEN '' WHEN t = 'ECONOMY' THEN 'historic' WHEN length(t) % 2 = 0 THEN 'visible' ELSE 'human' END AS check_action FROM c
) SELECT *, row_number() OVER (ORDER BY CASE visual_priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END, CASE match_status WHEN 'matched' THEN 0 WHEN 'review' THEN 1 WHEN 'manual' THEN 2 WHEN 'context' THEN 3 WHEN 'unmatched' THEN 4 ELSE 5 END, place_type, name) AS rank FROM d""")
def checklist(spark, sf_dir):
    """Status, priority and action of places by manual choice, earlier checklist and type, in checklist order."""
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), k).alias("name"), k.alias("k"), F.col("p_type").alias("place_type"))
    three = lambda a, b, c: [x.alias(n) for x, n in zip((a, b, c), ("match_status", "visual_priority", "check_action"), strict=True)]
    manual = p.where("k % 13 = 0").select("name", *three(F.lit("matched"), F.lit("high"), F.lit("check")))
    previous = p.where("k % 7 = 0").select("name", *three(F.when(F.col("k") % 2 == 1, "context"), F.lit(None).cast("string"), F.lit(None).cast("string")))
    kind = F.col("place_type")
    rules = p.select("place_type").distinct().where((kind == "ECONOMY") | (F.length(kind) % 2 == 0)).select("place_type", *three(F.when(kind == "ECONOMY", "manual").otherwise("review"), F.lit("medium"), F.when(kind == "ECONOMY", "historic").otherwise("visible")))
    rules = rules.unionByName(rules.agg(F.lit("*").alias("place_type"), *three(F.lit("unmatched"), F.lit("low"), F.lit("human"))))
    return jobs.checklist(p.select("name", "place_type"), manual, previous, rules).select("name", "place_type", "match_status", "visual_priority", "check_action", "rank")


@query(f"SELECT seq FROM (SELECT seq, map_id, CASE WHEN seq % 3 = 0 THEN (seq % 100) / 100.0::DOUBLE ELSE q END AS v FROM {BOX_SQL}) ORDER BY v DESC, map_id, seq LIMIT 180")
def boxes_to_label(spark, sf_dir):
    """The 180 boxes of the largest quality, or confidence where that is 0."""
    b = box_table(spark, sf_dir).withColumn("confidence", F.col("seq") % 100 / 100).withColumn("quality", F.when(F.col("seq") % 3 == 0, 0.0).otherwise(F.col("quality")))
    return boxes.to_label(b).select("seq")


@query(f"SELECT seq, row_number() OVER (ORDER BY map_id, y1, x1, seq) AS reading_no FROM {BOX_SQL}")
def reading_sort(spark, sf_dir):
    """Boxes numbered in reading order."""
    return boxes.reading_rank(box_table(spark, sf_dir)).select("seq", "reading_no")


@query("SELECT event_id, row_number() OVER (ORDER BY CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id % 97 + 0.5 END, event_id) AS rank FROM events")
def milestone_order(spark, sf_dir):
    """Events by the number that their order text holds."""
    order = F.when(F.col("event_id") % 5 == 0, "n/a").otherwise(F.concat(F.col("event_id") % 97, F.lit(".5")))
    return ranking.global_rank(table(spark, sf_dir, "events").select("event_id", order.alias("order")), [ranking.numeric_order("order"), F.col("event_id")]).select("event_id", "rank")


@query("SELECT p_partkey AS seq, p_name AS text, NULL AS tile, 'full' AS pass_name FROM part UNION ALL SELECT p_partkey, p_type, p_size, 'tile' FROM part UNION ALL SELECT p_partkey, p_brand, p_size, 'red' FROM part")
def union_passes(spark, sf_dir):
    """Candidates of several recogniser passes with the name of their pass."""
    p = table(spark, sf_dir, "part").withColumn("seq", F.col("p_partkey"))
    tile = F.col("p_size").alias("tile")
    return upsert.union_passes({"full": p.select("seq", F.col("p_name").alias("text")), "tile": p.select("seq", F.col("p_type").alias("text"), tile), "red": p.select("seq", F.col("p_brand").alias("text"), tile)})


@query("SELECT c_custkey, c_name AS name, length(c_name) BETWEEN 2 AND 18 AND NOT contains(c_name, '77') AS valid FROM customer")
def simple_names(spark, sf_dir):
    """Names after the short clean-up, and whether they are valid."""
    raw = F.concat(F.lit("第12年"), F.col("c_custkey") % 10, F.lit("、与"), "c_name", F.lit("；，"))
    name = T.simple_name(raw, "[年月日第0-9]", "[，、；与]", "，、；")
    return table(spark, sf_dir, "customer").select("c_custkey", name.alias("name"), T.short_name(name, ["77"]).alias("valid"))


@query("SELECT c_custkey, translate(translate(trim(' ' || c_custkey || '門·橋　寶 陽。' || c_mktsegment || ' '), ' 　·。', ''), '門橋寶陽', '门桥宝阳') AS label FROM customer")
def simplified_labels(spark, sf_dir):
    """Labels in simplified characters without blanks and dots."""
    return table(spark, sf_dir, "customer").select("c_custkey", T.simplified(F.concat(F.lit(" "), "c_custkey", F.lit("門·橋　寶 陽。"), "c_mktsegment", F.lit(" "))).alias("label"))


@query(f"SELECT seq, CASE WHEN h > (CASE WHEN seq % 2 = 0 THEN sqrt(w * w + w * w / 4) ELSE w END) * 1.35::DOUBLE THEN 'vertical' WHEN seq % 2 = 0 THEN 'diagonal' ELSE 'horizontal' END AS orientation FROM {BOX_SQL}")
def quad_orientation(spark, sf_dir):
    """Orientation of quads by their sides and tilt."""
    x, y, w, h = F.col("bbox")[0], F.col("bbox")[1], F.col("bbox")[2] - F.col("bbox")[0], F.col("bbox")[3] - F.col("bbox")[1]
    t = F.when(F.col("seq") % 2 == 0, w / 2).otherwise(0.0)
    quad = F.array(F.array(x, y), F.array(x + w, y + t), F.array(x + w, y + h + t), F.array(x, y + h))
    return box_table(spark, sf_dir).select("seq", geo.quad_orientation(quad).alias("orientation"))


@query("""SELECT p_partkey, p_size + 5.0::DOUBLE AS center_x, -(p_size + 10.0::DOUBLE) AS center_y, 10.0::DOUBLE AS width_px, 20.0::DOUBLE AS height_px, CASE WHEN p_partkey % 3 <> 0 THEN '[[' || p_size || '.0,' || p_size || '.0],[' || (p_size + 10) || '.0,' || p_size || '.0]]' END AS quad_json FROM part""")
def image_space(spark, sf_dir):
    """Candidates in image space, with centre, size and the quad as JSON."""
    s = F.col("p_size").cast("double")
    c = table(spark, sf_dir, "part").select("p_partkey", F.array(s, s, s + 10, s + 20).alias("bbox_pixel"), F.when(F.col("p_partkey") % 3 != 0, F.array(F.array(s, s), F.array(s + 10, s))).alias("quad_pixel"))
    return jobs.image_space_boxes(c).select("p_partkey", "center_x", "center_y", "width_px", "height_px", "quad_json")


@query(SAMPLE_SQL + "SELECT map_id, 'stratified' AS strategy, count(*)::BIGINT AS n, max(CASE WHEN sample_no = 1 THEN name END) AS first_name, max(CASE WHEN sample_no = 40 THEN name END) AS last_name FROM sampled GROUP BY map_id")
def review_payload(spark, sf_dir):
    """The payload of a review sample: metadata, strategy and the sampled candidates in order."""
    value = jobs.review_payload(*sample_rows(spark, sf_dir), "stratified")
    get = lambda path: F.get_json_object("value", path)
    return value.select("map_id", get("$.sample_strategy").alias("strategy"), get("$.sample_size").cast("long").alias("n"), get("$.candidates[0].name").alias("first_name"), get("$.candidates[39].name").alias("last_name"))


@query(CANDIDATE_SQL.replace("regexp_replace(raw, '^(?:the|of|and)', '')", "regexp_replace(raw, '^(?:the|of|and)+', '')") + f""", {D_SQL}, s AS (SELECT name AS seed, ord FROM dict WHERE ord <= 40), b AS (
  SELECT name, seed, row_number() OVER (PARTITION BY name ORDER BY length(seed) DESC, ord) AS rn FROM (SELECT DISTINCT name FROM v) JOIN s ON contains(name, seed) AND name <> seed
), d AS (
  SELECT coalesce(seed, v.name) AS name FROM v LEFT JOIN b ON v.name = b.name AND rn = 1
), t AS (
  SELECT name, name IN (SELECT seed FROM s) AS known, CASE WHEN name IN (SELECT seed FROM s) THEN 'seed' WHEN ends_with(name, 'tion') THEN 'action' WHEN ends_with(name, 'ment') THEN 'state' WHEN ends_with(name, 'eaux') THEN 'plural' WHEN ends_with(name, 'ing') THEN 'process' ELSE 'place' END AS place_type FROM d
), g AS (
  SELECT name FROM t WHERE length(name) BETWEEN 2 AND 18 AND name NOT IN ('tion', 'ment', 'ing') AND NOT regexp_matches(name, '^(?:on|er)') AND NOT (place_type = 'plural' AND NOT known AND length(name) > 12)
  UNION ALL SELECT seed FROM s WHERE EXISTS (SELECT 1 FROM documents WHERE contains(text, seed))
) SELECT name, CASE WHEN name IN (SELECT seed FROM s) THEN 'seed' WHEN ends_with(name, 'tion') THEN 'action' WHEN ends_with(name, 'ment') THEN 'state' WHEN ends_with(name, 'eaux') THEN 'plural' WHEN ends_with(name, 'ing') THEN 'process' ELSE 'place' END AS place_type, count(*)::BIGINT AS occurrence_count FROM g GROUP BY ALL""")
def extract_places(spark, sf_dir):
    """Place candidates of a corpus: found by suffix, cleaned, reduced to seeds, validated, counted."""
    seeds = dictionary(spark, sf_dir, 40).select(F.col("name").alias("seed"), F.lit("seed").alias("seed_type"), F.col("ord").alias("ordinal"))
    kinds = seeds.select("seed_type").distinct().select("seed_type", F.explode(F.array(*[F.lit(k) for k in ("action", "state", "plural", "process", "place")])).alias("place_type"))
    clean = {"trims": " .", "lead": "^[0-9]+", "prefix": "^(?:the|of|and)", "markers": []}
    valid = {"reserved": ["tion", "ment", "ing"], "digits": "[0-9]", "bad_prefixes": ["on", "er"], "bad_parts": [], "caps": {"plural": 12}}
    found = jobs.extract_places(table(spark, sf_dir, "documents").select("doc_id", "text"), SUFFIXES, seeds, kinds, clean, valid, "[A-Za-z]{1,24}")
    return found.select("name", "place_type", "occurrence_count")


@query("""WITH o AS (SELECT o_orderpriority AS name, o_orderkey, year(o_orderdate) AS y FROM orders), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY o_orderkey) AS rn FROM o) WHERE rn <= 80), u AS (
  SELECT name, min(y)::INTEGER AS primary_year, min(y)::INTEGER AS earliest_year, max(y)::INTEGER AS latest_year, count(DISTINCT y)::INTEGER AS year_count, string_agg(DISTINCT y::VARCHAR, ';' ORDER BY y::VARCHAR) AS year_list FROM f GROUP BY name
) SELECT name, CASE WHEN name < '3' THEN 'checked' ELSE 'found' END AS note, name < '3' AS in_curated_checklist, primary_year, earliest_year, latest_year, year_count, year_list, CASE WHEN primary_year BETWEEN 1978 AND 1991 THEN '改革开放初期' WHEN primary_year BETWEEN 1992 AND 2003 THEN '开发区建设' ELSE '?' END AS time_type FROM u""")
def temporal_places(spark, sf_dir):
    """Places with curated columns and the years of their sentences."""
    text = F.concat("o_orderpriority", F.lit("建于"), F.year("o_orderdate"), F.lit("年。另见"), "o_orderkey", F.lit("号。"))
    corpus = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))
    places = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("name")).distinct().withColumn("note", F.lit("found"))
    out = jobs.temporal_places(corpus, places, places.where("name < '3'").withColumn("note", F.lit("checked")), ["note"])
    return out.select("name", "note", "in_curated_checklist", "primary_year", "earliest_year", "latest_year", "year_count", "year_list", "time_type")


@query("""WITH n AS (SELECT s_suppkey AS k, s_name AS name, (SELECT max(s_suppkey) FROM supplier) AS top FROM supplier), b AS (
  SELECT k, name, CASE WHEN k % 10 = 2 AND k + 2 <= top THEN k + 2 WHEN k % 2 = 0 THEN k WHEN k % 10 = 1 THEN k - 1 END AS src, CASE WHEN k % 10 = 2 AND k + 2 <= top THEN 'local_anchor_coord' WHEN k % 2 = 0 THEN 'fallback_coord' WHEN k % 10 = 1 THEN 'derived_coord' WHEN k % 10 = 3 THEN 'poi_coord' WHEN k = 5 THEN 'derived_coord' ELSE 'missing' END AS coord_status FROM n
) SELECT name, CASE WHEN k = 5 THEN 20.5::DOUBLE WHEN k % 10 = 3 THEN 5.5::DOUBLE WHEN src IS NOT NULL THEN 20 + src * 0.25::DOUBLE END AS lon, CASE WHEN k = 5 THEN 61.0::DOUBLE WHEN k % 10 = 3 THEN 62.0::DOUBLE WHEN src IS NOT NULL THEN 61.0::DOUBLE END AS lat, coord_status FROM b""")
def geocode_places(spark, sf_dir):
    """Coordinates of places by matches, aliases, anchors, a centroid and points of interest, in this order."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("name"))
    row = lambda score, lon, lat, seq: F.struct(F.lit(score).alias("match_score"), lon.alias("lon"), F.lit(lat).alias("lat"), F.lit(seq).alias("seq"))
    found = F.array(row(0.8, 10 + k * 0.25, 60.0, 0), row(0.9, 20 + k * 0.25, 61.0, 1), row(0.99, F.lit(None).cast("double"), 61.0, 2))
    matches = s.where(k % 2 == 0).select("name", F.explode(found).alias("m")).select("name", "m.*")
    to = s.select(F.col("s_suppkey").alias("k2"), F.col("name").alias("source"))
    pair = lambda rest, step: s.where(k % 10 == rest).join(to, k + step == F.col("k2")).select(F.col("name").alias("target"), "source")
    pois = s.where(k % 10 == 3).select(F.col("name").alias("query_name"), k.alias("poi_order"), F.lit("吴中").alias("district"), F.lit(None).cast("string").alias("address"), F.lit(5.5).alias("lon"), F.lit(62.0).alias("lat"))
    name = lambda i: f"Supplier#{i:09d}"
    return jobs.geocode_places(s.select("name"), matches, pair(1, -1), pair(2, 2), ([name(5)], [name(0), name(4)]), pois, ["吴中"]).select("name", "lon", "lat", "coord_status")


@query("""WITH e AS (SELECT *, event_id % 4 AS c FROM events), n AS (SELECT n_name, 100 + n_nationkey * 0.5::DOUBLE AS lon, 30 + n_nationkey * 0.25::DOUBLE AS lat FROM nation WHERE n_nationkey % 4 <> 0), m AS (
  SELECT *, CASE WHEN c = 1 THEN 'NATION_3' WHEN c = 0 THEN 'NATION_' || (user_id % 25) END AS p FROM e
) SELECT event_id, n.n_name AS matched_name, lon, lat, CASE WHEN year(ts) BETWEEN 2014 AND 2099 THEN '运河文旅更新' ELSE '无明确时间' END AS time_type, CASE WHEN length(event_type || ' ' || props) > 22 THEN left(event_type || ' ' || props, 22) || '...' ELSE event_type || ' ' || props END AS short_text FROM m LEFT JOIN n ON p = n.n_name""")
def milestone_points(spark, sf_dir):
    """Events with the coordinates of their place or of a fallback, time window and short texts."""
    c, n = F.col("event_id") % 4, F.col("n_nationkey")
    place = F.when(c == 0, F.concat(F.lit("NATION_"), F.col("user_id") % 25)).when(c == 1, F.concat(F.lit("old bridge "), "event_type")).otherwise("nowhere")
    e = table(spark, sf_dir, "events").select("event_id", place.alias("gazetteer_place"), F.year("ts").alias("start_year"), F.concat("event_type", F.lit(" "), "props").alias("source_text"))
    places = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.when(n % 4 != 0, 100 + n * 0.5).alias("lon"), (30 + n * 0.25).alias("lat"))
    triggers = places.where("name = 'NATION_3'").select(F.lit("bridge").alias("contains_token"), F.col("name").alias("alt_name"), F.lit(1).alias("priority"))
    return jobs.milestone_points(e, places, triggers).select("event_id", "matched_name", "lon", "lat", "time_type", "short_text")


@query(f"""WITH {D_SQL}, c AS (SELECT name, sum((length(text) - length(replace(text, name, ''))) // length(name))::BIGINT AS raw FROM documents, dict GROUP BY name), p AS (
  SELECT name, n, ord, raw, CASE WHEN length(name) % 2 = 0 THEN '双' ELSE 'odd' END AS label, CASE WHEN ord % 3 <> 0 THEN 1900 + ord END AS y, row_number() OVER (ORDER BY n DESC, name) AS rank FROM dict JOIN c USING (name)
), d AS (
  SELECT name, doc_id, text, string_split(text, name) AS s FROM documents, dict WHERE contains(text, name) QUALIFY row_number() OVER (PARTITION BY name ORDER BY doc_id) <= 12
), o AS (
  SELECT name, doc_id, text, (list_sum(list_transform(s[1:k], lambda x: length(x))) + (k - 1) * length(name))::BIGINT AS pos FROM d, unnest(range(1, len(s))) AS g(k) QUALIFY row_number() OVER (PARTITION BY name ORDER BY doc_id, pos) <= 12
), x AS (
  SELECT name, substr(text, greatest(pos - 64, 0) + 1, pos + length(name) + 64 - greatest(pos - 64, 0)) AS c FROM o
), k AS (
  SELECT name, theme, ordinal, sum((length(c) - length(replace(c, word, ''))) // length(word)) AS hits FROM x, (VALUES ('冠词', 0, 'the'), ('连词', 1, 'and'), ('连词', 1, 'und'), ('介词', 2, 'de')) AS w(theme, ordinal, word) GROUP BY 1, 2, 3
), h AS (
  SELECT name, array_to_string(list(theme ORDER BY hits DESC, ordinal)[1:2], '、') AS themes FROM k WHERE hits > 0 GROUP BY name
) SELECT name, rank, raw AS raw_surface_count, {LEVEL_SQL.format('n')} AS mention_level, rank || '. ' || name || '（' || n || '次）' AS rank_label, CASE WHEN ord % 2 = 0 THEN '已匹配坐标' ELSE '缺坐标' END AS coordinate_quality, ord % 2 = 0 AS has_coord,
  CASE WHEN ord % 10 = 0 THEN 'custom ' || name ELSE '该地名属于' || label || '，在志书中约出现' || n || '次，主要关联' || coalesce(themes, '志书叙事') || '；' || CASE WHEN y IS NULL THEN '未提取到明确时间锚点' ELSE '主要时间锚点为' || y || '年' END || '。' END AS reason FROM p LEFT JOIN h USING (name)""")
def mention_statistics(spark, sf_dir):
    """Ranked statistics of places over a corpus."""
    d, o = dictionary(spark, sf_dir), F.col("ord")
    place = F.when(o % 2 == 0, 1.0)
    places = d.select("name", F.when(F.length("name") % 2 == 0, "even").otherwise("odd").alias("place_type"), F.col("n").alias("occurrence_count"), place.alias("lon"), place.alias("lat"), F.when(o % 2 == 0, "fallback_coord").otherwise("missing").alias("coord_status"), F.lit("matched").alias("match_status"), F.when(o % 3 != 0, 1900 + o).alias("primary_year"))
    keywords = spark.createDataFrame([("冠词", 0, "the"), ("连词", 1, "and"), ("连词", 1, "und"), ("介词", 2, "de")], "theme string, ordinal int, keyword string")
    labels = d.limit(1).select(F.lit("even").alias("place_type"), F.lit("双").alias("type_label"))
    custom = d.where(o % 10 == 0).select("name", F.concat(F.lit("custom "), "name").alias("custom_reason"))
    out = jobs.mention_statistics(table(spark, sf_dir, "documents").select("doc_id", "text"), places, keywords, labels, custom)
    return out.select("name", "rank", "raw_surface_count", "mention_level", "rank_label", "coordinate_quality", "has_coord", "reason")


RANKED_CUSTOMERS_SQL = f"""WITH r AS (
  SELECT c_custkey AS k, c_name AS name, c_nationkey + 1 AS c, row_number() OVER (ORDER BY c_nationkey DESC, c_custkey) AS rank, CASE WHEN c_custkey % 4 <> 0 THEN lon END AS lon, CASE WHEN c_custkey % 4 <> 0 THEN lat END AS lat FROM customer JOIN {LONLAT_SQL} l ON c_custkey = l.k
) """


def ranked_customers(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), (F.col("c_nationkey") + 1).alias("occurrence_count"))
    there = F.col("k") % 4 != 0
    c = c.join(lonlat(spark, sf_dir).select("k", "lon", "lat"), "k").withColumn("lon", F.when(there, F.col("lon"))).withColumn("lat", F.when(there, F.col("lat")))
    return ranking.global_rank(c, [F.desc("occurrence_count"), F.asc("k")])


@query(RANKED_CUSTOMERS_SQL + """, h AS (
  SELECT *, round(18 + sqrt(c) * 5.4::DOUBLE, 2) AS tall, round(20 + sqrt(c) * 1.55::DOUBLE, 2) AS radius_m, CASE WHEN k % 5 = 0 THEN rank ELSE k % 5 END AS o, radians(lon) * 6378137 AS x, ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137 AS y FROM r WHERE lon IS NOT NULL
) SELECT k, tall AS height_m, radius_m, round(42 + least(o, 20) * 1.8::DOUBLE, 2) AS label_offset_m, round(tall + 12, 2) AS label_z_m, round(x + cos((o % 8) * (pi() / 4)) * (42 + least(o, 20) * 1.8::DOUBLE), 3) AS lx, round(y + sin((o % 8) * (pi() / 4)) * (42 + least(o, 20) * 1.8::DOUBLE), 3) AS ly, round(x + radius_m, 3) AS ring_x,
  name || ' ' || c || '次' AS label, 'no ' || rank || chr(10) || '提及次数：' || c || ' 次' || chr(10) || '柱高：' || tall || ' m' || chr(10) || '原因：' || left(repeat('why ', 20), 48) || '...' AS label_detail FROM h""")
def mention_columns(spark, sf_dir):
    """Columns of ranked places and the labels beside them."""
    r = ranked_customers(spark, sf_dir).withColumn("curated_rank", F.col("k") % 5).withColumn("rank_label", F.concat(F.lit("no "), "rank")).withColumn("reason", F.repeat(F.lit("why "), F.lit(20)))
    out = jobs.mention_labels(jobs.mention_columns(r))
    at = F.col("label_point")
    return out.select("k", "height_m", "radius_m", "label_offset_m", "label_z_m", F.round(at[0], 3).alias("lx"), F.round(at[1], 3).alias("ly"), F.round(F.col("ring")[0][0], 3).alias("ring_x"), "label", "label_detail")


@query(f"""WITH c AS (SELECT *, seg = 'BUILDING' AS round_, CASE WHEN seg = 'BUILDING' THEN 50.0 ELSE 20.0 END::DOUBLE AS hw FROM {LONLAT_SQL}), v AS (
  SELECT k, i::INTEGER AS i, lon, lat, 50 * cos(2 * pi() * i / 36) AS dx, 50 * sin(2 * pi() * i / 36) AS dy FROM c, range(37) t(i) WHERE round_
  UNION ALL SELECT k, i, lon, lat, 20.0 * sx, 15.0 * sy FROM c, (VALUES (0, -1, -1), (1, 1, -1), (2, 1, 1), (3, -1, 1), (4, -1, -1)) t(i, sx, sy) WHERE NOT round_
), g AS (SELECT k, i, lon + dx / (111320 * greatest(0.2::DOUBLE, cos(radians(lat)))) AS lon, lat + dy / 110540 AS lat FROM v)
SELECT k, i, round(radians(lon) * 6378137, 2) AS x, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137, 2) AS y FROM g""")
def scene_blocks(spark, sf_dir):
    """Vertices of the blocks of a scene in EPSG:3857, with their style by type or the default one."""
    layers = scene(spark, sf_dir)
    return layers["blocks_3857"].select(F.col("name").alias("k"), F.posexplode("ring").alias("i", "v")).select("k", "i", F.round(F.col("v")[0], 2).alias("x"), F.round(F.col("v")[1], 2).alias("y"))


def scene_milestones(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "event_type", F.when(F.col("event_id") % 3 != 0, 1900 + F.col("event_id") % 100).cast("int").alias("start_year"), (F.col("user_id") % 100).cast("double").alias("lon"), (F.col("user_id") % 50).cast("double").alias("lat"), (F.col("event_id") % 7).alias("order_no"))


def scene(spark, sf_dir):
    points = lonlat(spark, sf_dir).select(F.col("k").alias("name"), F.col("seg").alias("place_type"), "lon", "lat")
    styles = points.select("place_type").distinct().where("place_type = 'BUILDING'").select("place_type", F.lit("hall").alias("scene_class"), F.lit("circle").alias("shape"), F.lit(100.0).alias("width_m"), F.lit(100.0).alias("depth_m"), F.lit(9.0).alias("height_m"))
    e = table(spark, sf_dir, "events")
    heights = e.select("event_type").distinct().where("event_type = 'click'").select("event_type", F.lit(95.0).alias("base_height"))
    return jobs.scene_layers(points, styles, {"scene_class": "block", "shape": "rect", "width_m": 40.0, "depth_m": 30.0, "height_m": 10.0}, scene_milestones(spark, sf_dir), heights)


@query("""SELECT event_id, CASE WHEN event_type = 'click' THEN 95.0 ELSE 78.0 END::DOUBLE + 2 * (event_id % 7) AS height_m, round(radians((user_id % 100) + 24 / (111320 * greatest(0.2::DOUBLE, cos(radians(user_id % 50))))) * 6378137, 2) AS x FROM events""")
def scene_columns(spark, sf_dir):
    """Milestone columns of a scene: heights by event type and order, and the first vertex in EPSG:3857."""
    return scene(spark, sf_dir)["columns_3857"].select("event_id", "height_m", F.round(F.col("ring")[0][0], 2).alias("x"))


@query("""WITH o AS (SELECT event_id, round(radians(user_id % 100) * 6378137, 2) AS x, CASE WHEN event_id % 3 <> 0 THEN 1900 + event_id % 100 ELSE 999999 END AS y FROM events)
SELECT event_id, row_number() OVER w AS no, x, lag(x) OVER w AS prev_x FROM o WINDOW w AS (ORDER BY y, event_id)""")
def scene_path(spark, sf_dir):
    """The path through the milestones of a scene in EPSG:3857, a row a vertex."""
    return jobs.scene_path(scene_milestones(spark, sf_dir)).select("event_id", "no", F.round("x", 2).alias("x"), F.round("prev_x", 2).alias("prev_x"))


KEYFRAME_SQL = f"""WITH c AS (SELECT k, lon, lat FROM {LONLAT_SQL}), t AS (
  SELECT k, lon, lat FROM c UNION ALL SELECT a.k, b.lon, b.lat FROM c a JOIN c b ON b.k = a.k // 2 WHERE a.k % 2 = 0 AND a.k % 6 <> 0
), f AS (SELECT k, avg(lon) AS lon, avg(lat) AS lat FROM t GROUP BY k) """


def keyframes(spark, sf_dir):
    k = F.col("k")
    places = lonlat(spark, sf_dir).select(F.concat(F.lit("p"), k).alias("name"), "lon", "lat", "k")
    frame = F.concat(F.lit("K"), F.lpad(k.cast("string"), 9, "0"))
    alt = lambda target, name, ordinal: F.struct(F.lit(target).alias("target_no"), name.alias("name"), F.lit(ordinal).alias("ordinal"))
    second = F.when(k % 6 == 0, "gone").otherwise(F.concat(F.lit("p"), (k / 2).cast("long")))
    names = F.when(k % 2 == 0, F.array(alt(1, F.lit("none"), 0), alt(1, F.col("name"), 1), alt(2, second, 0))).otherwise(F.array(alt(1, F.lit("none"), 0), alt(1, F.col("name"), 1)))
    alternates = places.select(frame.alias("keyframe"), F.explode(names).alias("a")).select("keyframe", "a.*")
    return jobs.keyframes(places.select(frame.alias("keyframe"), "k"), alternates, places.drop("k"))


@query(KEYFRAME_SQL + "SELECT k, round(lon, 6) AS target_lon, round(radians(lon) * 6378137, 2) AS target_x FROM f")
def keyframe_targets(spark, sf_dir):
    """Key frames with the mean of their targets, each the first present of its names."""
    return keyframes(spark, sf_dir)[0].select("k", F.round("target_lon", 6).alias("target_lon"), F.round("target_x_3857", 2).alias("target_x"))


@query(f"SELECT 'K' || lpad(k::VARCHAR, 9, '0') AS keyframe, 2 AS target_no FROM {LONLAT_SQL} WHERE k % 6 = 0")
def keyframe_gaps(spark, sf_dir):
    """Targets of key frames of which no name is present."""
    return keyframes(spark, sf_dir)[1]


@query(KEYFRAME_SQL + """, o AS (SELECT k, round(radians(lon) * 6378137, 2) AS x, row_number() OVER (ORDER BY k) AS no, count(*) OVER () AS n FROM f)
SELECT k, no, x, lag(x) OVER (ORDER BY no) AS prev_x, round((no - 1) * 20.0 / greatest(n - 1, 1), 6)::DOUBLE AS at_s FROM o""")
def camera_path(spark, sf_dir):
    """The camera's line through the targets of the key frames, a row a vertex, with its time in the flight."""
    path = jobs.camera_path(keyframes(spark, sf_dir)[0])
    return path.select("k", "no", F.round("target_x_3857", 2).alias("x"), F.round("prev_x", 2).alias("prev_x"), F.round("at_s", 6).alias("at_s"))


WEB_SQL = RANKED_CUSTOMERS_SQL + f", w AS (SELECT *, {LEVEL_SQL.format('c')} AS level, CASE WHEN c >= 10 THEN '#f00' ELSE '#888888' END AS colour FROM r) "


def web_rows(spark, sf_dir):
    r = ranked_customers(spark, sf_dir).withColumn("mention_level", T.mention_level(F.col("occurrence_count")))
    colours = r.select("mention_level").distinct().where("mention_level = '中频'").withColumn("colour", F.lit("#f00"))
    milestones = table(spark, sf_dir, "events").select("event_id", F.col("value").cast("string").alias("order"))
    return r, jobs.web_views(r, milestones, colours)


@query(WEB_SQL + "SELECT name, rank, colour FROM w WHERE lon IS NOT NULL ORDER BY rank LIMIT 50")
def web_points(spark, sf_dir):
    """The leading places of the map page with the colour of their level."""
    return web_rows(spark, sf_dir)[1]["points"].select("name", "rank", "colour")


@query(WEB_SQL + """SELECT name, rank, round(18 + sqrt(c) * 5.4, 2) AS height_m, 49 AS vertices, round(lon + (round(20 + sqrt(c) * 1.55, 2)) / (111320 * greatest(0.2::DOUBLE, cos(radians(lat)))), 6) AS first_lon FROM w WHERE lon IS NOT NULL ORDER BY rank LIMIT 50""")
def web_columns(spark, sf_dir):
    """The columns of the leading places of the map page: height, and ring in degrees."""
    ring = F.col("ring")
    return web_rows(spark, sf_dir)[1]["columns"].select("name", "rank", "height_m", F.size(ring).alias("vertices"), F.round(ring[0][0], 6).alias("first_lon"))


@query("SELECT event_id, row_number() OVER (ORDER BY value, event_id) AS no FROM events")
def web_milestones(spark, sf_dir):
    """The milestones of the map page in their order."""
    milestones = table(spark, sf_dir, "events").select("event_id", F.col("value").cast("string").alias("order"))
    return jobs.web_milestones(milestones).select("event_id", "no")


@query(WEB_SQL + "SELECT name, rank, level AS mention_level FROM w ORDER BY rank LIMIT 30")
def web_rankings(spark, sf_dir):
    """The ranking list of the map page."""
    return web_rows(spark, sf_dir)[1]["rankings"].select("name", "rank", "mention_level")


@query(WEB_SQL + "SELECT name, rank FROM w WHERE lon IS NULL ORDER BY rank LIMIT 30")
def web_missing(spark, sf_dir):
    """The leading places without coordinates."""
    return jobs.web_statistics(ranked_customers(spark, sf_dir))["missing_top"].select("name", "rank")


@query(WEB_SQL + "SELECT count(lon)::BIGINT AS mapped_columns, count(*)::BIGINT AS curated_places, (count(*) - count(lon))::BIGINT AS missing_count, arg_min(name, CASE WHEN lon IS NOT NULL THEN rank END) AS top_name, arg_min(c, CASE WHEN lon IS NOT NULL THEN rank END)::INTEGER AS top_count FROM w")
def web_summary(spark, sf_dir):
    """Totals of the map page."""
    return jobs.web_statistics(ranked_customers(spark, sf_dir))["summary"]


def each_parsed(features):
    """Features of one JSON Feature a row, parsed row by row."""
    return geojson.parse_features(features.select(F.concat(F.lit('{"features":['), "value", F.lit("]}")).alias("value")))


@query("""SELECT 'c' || c_custkey AS control_id, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN '1' ELSE 'no' END AS enabled, CASE WHEN c_custkey % 5 = 0 THEN 'x' ELSE c_custkey || '.0' END AS pixel_x, CASE WHEN c_custkey % 5 = 0 THEN '7' ELSE '7.0' END AS pixel_y, c_nationkey || '.5' AS map_x, '3.0' AS map_y FROM customer""")
def control_features(spark, sf_dir):
    """Control points as image and map features and back; points without a number keep their texts."""
    k = F.col("c_custkey")
    p = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), k).alias("control_id"), F.when(k % 2 == 0, "1").otherwise("no").alias("enabled"), F.col("c_name").alias("name"), F.when(k % 5 == 0, "x").otherwise(k.cast("string")).alias("pixel_x"), F.lit("7").alias("pixel_y"),
        F.concat("c_nationkey", F.lit(".5")).alias("map_x"), F.lit("3").alias("map_y"), F.lit(None).cast("string").alias("notes"),
    )
    image, ground = jobs.control_features(p)
    return jobs.control_points_back(p, each_parsed(image), each_parsed(ground)).select("control_id", "name", "enabled", "pixel_x", "pixel_y", "map_x", "map_y")


@query("""WITH m AS (SELECT 'map' || s_suppkey AS map_id, s_name AS title FROM supplier), n AS (SELECT 'map' || (s_suppkey * 2) AS map_id, upper(s_name) AS title FROM supplier) SELECT * FROM m WHERE map_id NOT IN (SELECT map_id FROM n) UNION ALL SELECT * FROM n""")
def register_maps(spark, sf_dir):
    """The catalogue of maps after some were registered again."""
    s = table(spark, sf_dir, "supplier")
    row = lambda key, title: s.select(F.concat(F.lit("map"), key).alias("map_id"), title.alias("title"))
    return jobs.register_maps(row(F.col("s_suppkey"), F.col("s_name")), row(F.col("s_suppkey") * 2, F.upper("s_name")))


@query("SELECT o_orderkey, CASE WHEN year(o_orderdate) <= 1996 THEN 'y' || year(o_orderdate) ELSE 'none' END AS time_type FROM orders")
def window_join(spark, sf_dir):
    """Orders with the label of their time window, from a table of windows of which the first that fits counts."""
    y = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"))
    w = y.select("y").distinct().where("y <= 1996").select(F.col("y").alias("low"), (F.col("y") + 1).alias("high"), F.concat(F.lit("y"), "y").alias("label"), (-F.col("y")).alias("ordinal"))
    w = w.withColumn("high", F.least("high", F.lit(1996)))
    return intervals.window_join(y, "y", w, "none").select("o_orderkey", "time_type")


@query("""WITH w AS (SELECT o_custkey * 7 % 60000 AS low, o_custkey * 7 % 60000 + o_orderkey % 50 AS high, 'w' || o_orderkey AS label, -o_orderkey AS ordinal FROM orders WHERE o_orderkey % 9 <> 0
  UNION ALL SELECT o_orderkey, o_orderkey + 20000, 'long' || o_orderkey, o_orderkey FROM orders WHERE o_orderkey % 1000 = 0)
SELECT o_orderkey, coalesce(arg_min(label, ordinal), 'none') AS time_type FROM orders LEFT JOIN w ON o_orderkey BETWEEN low AND high GROUP BY o_orderkey""")
def window_join_large(spark, sf_dir):
    """Orders with the first window that holds their number, from as many windows as there are orders, some of them very wide."""
    o = table(spark, sf_dir, "orders")
    key, low = F.col("o_orderkey"), F.col("o_custkey") * 7 % 60000
    each = o.where(key % 9 != 0).select(low.alias("low"), (low + key % 50).alias("high"), F.concat(F.lit("w"), key).alias("label"), (-key).alias("ordinal"))
    wide = o.where(key % 1000 == 0).select(key.alias("low"), (key + 20000).alias("high"), F.concat(F.lit("long"), key).alias("label"), key.alias("ordinal"))
    return intervals.window_join(o.select("o_orderkey"), "o_orderkey", each.unionByName(wide), "none")


@query(f"SELECT k, CASE k % 3 WHEN 0 THEN 'Point' WHEN 1 THEN 'LineString' ELSE 'Polygon' END AS geom_type, (CASE k % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 4 END)::INTEGER AS n, round(radians(lon + CASE WHEN k % 3 = 0 THEN 0 ELSE 0.1::DOUBLE END) * 6378137, 2) AS x, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137, 2) AS y FROM {LONLAT_SQL}")
def reproject_types(spark, sf_dir):
    """Points, lines and polygons in EPSG:3857."""
    k, lon, lat = F.col("k"), F.col("lon"), F.col("lat")
    at, on = F.array(lon, lat), F.array(lon + 0.1, lat)
    kind = F.when(k % 3 == 0, "Point").when(k % 3 == 1, "LineString").otherwise("Polygon")
    rings = F.array(F.when(k % 3 == 0, F.array(at)).when(k % 3 == 1, F.array(at, on)).otherwise(F.array(at, on, on, at)))
    out = geo.reproject_geometry(kind, rings)[0]
    last = F.element_at(out, F.when(k % 3 == 2, -2).otherwise(-1))
    return lonlat(spark, sf_dir).select("k", kind.alias("geom_type"), F.size(out).alias("n"), F.round(last[0], 2).alias("x"), F.round(last[1], 2).alias("y"))


@query("SELECT event_id, year(ts) || ' ' || event_type AS map_label, event_type || chr(10) || '地点：' || user_id || chr(10) || '意义：' || chr(10) || '志文：' || props AS milestone_popup FROM events")
def popups(spark, sf_dir):
    """Labels and popups of milestones."""
    popup = T.popup(F.col("event_type"), [("地点", F.col("user_id")), ("意义", F.lit(None)), ("志文", F.col("props"))])
    return table(spark, sf_dir, "events").select("event_id", F.concat_ws(" ", F.year("ts"), "event_type").alias("map_label"), popup.alias("milestone_popup"))


@query(f"WITH {D_SQL}, f AS (SELECT doc_id, name, strpos(text, name) AS at FROM documents, dict WHERE contains(text, name)) SELECT name, count(*)::BIGINT AS docs, min(doc_id)::BIGINT AS first_doc FROM f GROUP BY name")
def seed_documents(spark, sf_dir):
    """In how many documents each name stands, and the first of them."""
    found = mentions.first_places(table(spark, sf_dir, "documents"), dictionary(spark, sf_dir)).groupBy("name", "doc_id").agg(F.min("pos").alias("pos"))
    return found.groupBy("name").agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("first_doc"))


@query("WITH n AS (SELECT DISTINCT p_name AS name FROM part), s AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS part FROM part) SELECT name, part FROM n JOIN s ON contains(name, part)")
def contained_names(spark, sf_dir):
    """Names with the words that they contain."""
    p = table(spark, sf_dir, "part")
    return lookup.containing(p.select(F.col("p_name").alias("name")).distinct(), "name", p.select(F.explode(F.split("p_name", " ")).alias("part")).distinct(), "part")
