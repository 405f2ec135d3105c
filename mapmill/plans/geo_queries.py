"""Registered queries over coordinates, boxes, fits and layers, each with its DuckDB twin."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from mapmill.functions import geo
from mapmill.functions import text as T
from mapmill.operators import boxes, georef, ranking, sample
from mapmill.plans import jobs
from mapmill.plans.text_queries import table
from mapmill.sources import geojson, ocr
from mapmill.storage import shared_dir

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f"q_{f.__name__}"] = f
        if sql:
            SQL[f"q_{f.__name__}"] = sql
        return f

    return add


LONLAT_SQL = "(SELECT c_custkey AS k, 70 + (c_custkey * 37 % 700) / 10.0::DOUBLE AS lon, 1 + (c_custkey * 53 % 600) / 10.0::DOUBLE AS lat, c_mktsegment AS seg FROM customer)"


def lonlat(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("k"), (70 + (k * 37 % 700) / 10).alias("lon"), (1 + (k * 53 % 600) / 10).alias("lat"), F.col("c_mktsegment").alias("seg"))


@query(f"""WITH c AS {LONLAT_SQL}, d AS (SELECT *, lon - 105 AS x, lat - 35 AS y, radians(lat) AS r FROM c), e AS (
  SELECT *, sqrt(abs(x)) AS q, (20 * sin(6 * x * pi()) + 20 * sin(2 * x * pi())) * 2 / 3 AS f, 1 - 0.00669342162296594323::DOUBLE * sin(r) * sin(r) AS m FROM d
), g AS (
  SELECT *, -100 + 2 * x + 3 * y + 0.2::DOUBLE * y * y + 0.1::DOUBLE * x * y + 0.2::DOUBLE * q + f + (20 * sin(y * pi()) + 40 * sin(y / 3 * pi())) * 2 / 3 + (160 * sin(y / 12 * pi()) + 320 * sin(y * pi() / 30)) * 2 / 3 AS a,
            300 + x + 2 * y + 0.1::DOUBLE * x * x + 0.1::DOUBLE * x * y + 0.1::DOUBLE * q + f + (20 * sin(x * pi()) + 40 * sin(x / 3 * pi())) * 2 / 3 + (150 * sin(x / 12 * pi()) + 300 * sin(x / 30 * pi())) * 2 / 3 AS b FROM e
), h AS (
  SELECT *, a * 180 / (6378245.0::DOUBLE * (1 - 0.00669342162296594323::DOUBLE) / (m * sqrt(m)) * pi()) AS dlat, b * 180 / (6378245.0::DOUBLE / sqrt(m) * cos(r) * pi()) AS dlon, lon BETWEEN 72.004 AND 137.8347 AND lat BETWEEN 0.8293 AND 55.8271 AS inside FROM g
) SELECT k, round(CASE WHEN inside THEN lon + dlon ELSE lon END, 6) AS lon, round(CASE WHEN inside THEN lat + dlat ELSE lat END, 6) AS lat FROM h""")
def gcj02(spark, sf_dir):
    """Coordinates moved to GCJ-02 inside its box."""
    g = geo.gcj02(F.col("lon"), F.col("lat"))
    return lonlat(spark, sf_dir).select("k", F.round(g["lon"], 6).alias("lon"), F.round(g["lat"], 6).alias("lat"))


@query(f"SELECT k, round(radians(lon) * 6378137, 3) AS x, round(ln(tan(pi() / 4 + radians(least(lat * 1.48::DOUBLE, 89.5::DOUBLE)) / 2)) * 6378137, 3) AS y FROM {LONLAT_SQL}")
def mercator(spark, sf_dir):
    """Coordinates in EPSG:3857, the latitude clamped."""
    m = geo.mercator(F.col("lon"), F.col("lat") * 1.48)  # some lie beyond the clamp
    return lonlat(spark, sf_dir).select("k", F.round(m["x"], 3).alias("x"), F.round(m["y"], 3).alias("y"))


@query(f"SELECT k, round(lon + k / (111320 * greatest(0.2::DOUBLE, cos(radians(lat)))), 7) AS lon, round(lat - 50 / 110540.0::DOUBLE, 7) AS lat FROM {LONLAT_SQL}")
def offset(spark, sf_dir):
    """Coordinates moved by metres."""
    o = geo.offset(F.col("lon"), F.col("lat"), F.col("k"), F.lit(-50.0))
    return lonlat(spark, sf_dir).select("k", F.round(o[0], 7).alias("lon"), F.round(o[1], 7).alias("lat"))


@query("""WITH p AS (SELECT p_partkey AS k, p_size AS s, p_retailprice AS r FROM part), v AS (
  SELECT k, i::INTEGER AS i, round(r + s * cos(2 * pi() * i / 24), 6) AS x, round(s + s * sin(2 * pi() * i / 24), 6) AS y FROM p, range(25) t(i) WHERE k % 2 = 0
  UNION ALL SELECT k, i, round(r + s * dx / 2, 6), round(s + s * dy / 4, 6) FROM p, (VALUES (0, -1, -1), (1, 1, -1), (2, 1, 1), (3, -1, 1), (4, -1, -1)) t(i, dx, dy) WHERE k % 2 = 1
) SELECT * FROM v""")
def rings(spark, sf_dir):
    """Vertices of circles and rectangles."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("double").alias("s"), F.col("p_retailprice").alias("r"))
    ring = F.when(F.col("k") % 2 == 0, geo.ellipse(F.col("r"), F.col("s"), F.col("s"), F.col("s"), F.lit(24))).otherwise(geo.rectangle(F.col("r"), F.col("s"), F.col("s"), F.col("s") / 2))
    return p.select("k", F.posexplode(ring).alias("i", "v")).select("k", "i", F.round(F.col("v")[0], 6).alias("x"), F.round(F.col("v")[1], 6).alias("y"))


@query("""SELECT p_partkey AS k, round(18 + sqrt(greatest(p_size, 1)) * 5.4::DOUBLE, 2) AS height, round(20 + sqrt(greatest(p_size, 1)) * 1.55::DOUBLE, 2) AS radius,
round(p_retailprice + cos((p_size % 8) * (pi() / 4)) * (42 + least(p_size, 20) * 1.8::DOUBLE), 4) AS lx, round(p_retailprice + sin((p_size % 8) * (pi() / 4)) * (42 + least(p_size, 20) * 1.8::DOUBLE), 4) AS ly, round(round(18 + sqrt(greatest(p_size, 1)) * 5.4::DOUBLE, 2) + 12, 4) AS lz FROM part""")
def columns(spark, sf_dir):
    """Column heights and radii by count, and label points beside them."""
    h = geo.column_height(F.col("p_size"))
    l = geo.label_point(F.col("p_retailprice"), F.col("p_retailprice"), F.col("p_size"), h)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), h.alias("height"), geo.column_radius(F.col("p_size")).alias("radius"), *[F.round(l[i], 4).alias(n) for i, n in enumerate(("lx", "ly", "lz"))])


POINTS_SQL = """WITH p AS (SELECT l_returnflag || l_linestatus AS g, l_quantity AS px, l_discount * 1000 AS py, 13375000 + 5 * l_quantity + (l_linenumber % 3) AS mx, 3539000 - 5 * l_discount * 1000 + (l_linenumber % 2) AS my, l_linenumber::DOUBLE AS w FROM lineitem),
 m AS (SELECT g, count(*) AS n, sum(w * px) / sum(w) AS a, sum(w * py) / sum(w) AS b, sum(w * mx) / sum(w) AS c, sum(w * my) / sum(w) AS d FROM p GROUP BY g),
 s AS (SELECT g, any_value(n) AS n, any_value(a) AS a, any_value(b) AS b, any_value(c) AS c, any_value(d) AS d, sum(w * (px - a) * (px - a)) AS xx, sum(w * (px - a) * (py - b)) AS xy, sum(w * (py - b) * (py - b)) AS yy, sum(w * (px - a) * (mx - c)) AS xu, sum(w * (py - b) * (mx - c)) AS yu, sum(w * (px - a) * (my - d)) AS xv, sum(w * (py - b) * (my - d)) AS yv FROM p JOIN m USING (g) GROUP BY g),
 f AS (SELECT g, n, a, b, c, d, (xu * yy - yu * xy) / (xx * yy - xy * xy) AS b1, (yu * xx - xu * xy) / (xx * yy - xy * xy) AS c1, (xv * yy - yv * xy) / (xx * yy - xy * xy) AS b2, (yv * xx - xv * xy) / (xx * yy - xy * xy) AS c2 FROM s) """


def control_points(spark, sf_dir):
    n = F.col("l_linenumber")
    l = table(spark, sf_dir, "lineitem")
    return l.select(F.concat("l_returnflag", "l_linestatus").alias("g"), F.col("l_quantity").alias("pixel_x"), (F.col("l_discount") * 1000).alias("pixel_y"), (13375000 + 5 * F.col("l_quantity") + n % 3).alias("map_x"), (3539000 - 5 * F.col("l_discount") * 1000 + n % 2).alias("map_y"), n.cast("double").alias("w"))


@query(POINTS_SQL + "SELECT g, n, round(c - b1 * a - c1 * b, 3) AS x_origin, round(b1, 6) AS pixel_width, round(c1, 6) AS x_rotation, round(d - b2 * a - c2 * b, 3) AS y_origin, round(b2, 6) AS y_rotation, round(c2, 6) AS pixel_height FROM f")
def affine_fit(spark, sf_dir):
    """Weighted affine fits by group."""
    f = georef.fit_affine(control_points(spark, sf_dir), ["g"], F.col("w"))
    return f.select("g", "n", *[F.round(F.col("coefficients")[c], 3 if "origin" in c else 6).alias(c) for c in ("x_origin", "pixel_width", "x_rotation", "y_origin", "y_rotation", "pixel_height")])


@query(POINTS_SQL + """, e AS (SELECT g, round(sqrt((c + b1 * (px - a) + c1 * (py - b) - mx) * (c + b1 * (px - a) + c1 * (py - b) - mx) + (d + b2 * (px - a) + c2 * (py - b) - my) * (d + b2 * (px - a) + c2 * (py - b) - my)), 3) AS error FROM p JOIN f USING (g))
SELECT g, count(*)::BIGINT AS control_point_count, round(sqrt(avg(error * error)), 3) AS rmse_m, round(avg(error), 3) AS mean_error_m, round(max(error), 3) AS max_error_m, sqrt(avg(error * error)) <= 60 AND max(error) <= 120 AS accepted FROM e GROUP BY g""")
def affine_quality(spark, sf_dir):
    """Residual figures and acceptance of the fits."""
    t = georef.fit_transforms(control_points(spark, sf_dir), ["g"], F.col("w"))
    return t.select("g", "control_point_count", "rmse_m", "mean_error_m", "max_error_m", "accepted")


@query("""WITH t AS (SELECT p_partkey AS k, CASE WHEN p_size % 5 = 0 THEN 'missing' WHEN p_size % 5 = 1 THEN 'loaded_without_accuracy' ELSE 'loaded' END AS status, p_size % 7 AS n, p_size * 1.5::DOUBLE AS rmse, p_size * 3.0::DOUBLE AS mx FROM part)
SELECT k, CASE WHEN status = 'missing' THEN NULL WHEN status = 'loaded_without_accuracy' THEN 'no accuracy report' WHEN n > 0 AND n < 3 THEN 'fewer than 3 control points' WHEN rmse > 60 THEN 'rmse above limit' WHEN mx > 120 THEN 'point error above limit' END AS gate FROM t""")
def import_gate(spark, sf_dir):
    """The gate that transforms pass before an import."""
    s = F.col("p_size")
    t = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.when(s % 5 == 0, "missing").when(s % 5 == 1, "loaded_without_accuracy").otherwise("loaded").alias("status"), (s % 7).alias("control_point_count"), (s * 1.5).alias("rmse_m"), (s * 3.0).alias("max_error_m"))
    return georef.import_gate(t).select("k", "gate")


@query("""SELECT p_type AS map_id, count(*) FILTER (WHERE p_size % 3 = 0)::BIGINT AS enabled_count, count(*) FILTER (WHERE p_size % 3 = 0) >= 3 AS ready FROM part GROUP BY p_type""")
def control_gate(spark, sf_dir):
    """Maps that have enough enabled control points."""
    p = table(spark, sf_dir, "part").select(F.col("p_type").alias("map_id"), F.when(F.col("p_size") % 3 == 0, " Yes ").when(F.col("p_size") % 3 == 1, "").otherwise("no").alias("enabled"))
    return georef.enough_points(p, ["map_id"])


@query("""SELECT p_type AS map_id, count(*)::BIGINT AS n, round(sum(p_size)::DOUBLE, 3) AS total FROM part WHERE p_size % 4 <> 1 AND p_size % 5 <> 2 GROUP BY p_type""")
def enabled_points(spark, sf_dir):
    """Control points that are enabled and whose numbers parse."""
    s = F.col("p_size")
    p = table(spark, sf_dir, "part").select(F.col("p_type").alias("map_id"), F.when(s % 4 == 0, "是").when(s % 4 == 1, "false").when(s % 4 == 2, "").otherwise(F.lit(None)).alias("enabled"), F.when(s % 5 == 2, "n/a").otherwise(s.cast("string")).alias("pixel_x"), F.lit("1").alias("pixel_y"), F.lit("2.5").alias("map_x"), F.lit("3").alias("map_y"))
    return georef.enabled_points(p).groupBy("map_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("pixel_x"), 3).alias("total"))


BOX_SQL = "(SELECT vec_id AS seq, 'm' || (vec_id % 3) AS map_id, label, 1000 + 1000 * embedding[1]::DOUBLE AS x1, 1000 + 1000 * embedding[2]::DOUBLE AS y1, 20 + 200 * abs(embedding[3]::DOUBLE) AS w, 20 + 200 * abs(embedding[4]::DOUBLE) AS h, embedding[5]::DOUBLE AS q FROM embeddings WHERE len(embedding) >= 5)"


def box_table(spark, sf_dir):
    e = lambda i: F.col("embedding")[i].cast("double")
    x, y, w, h = 1000 + 1000 * e(0), 1000 + 1000 * e(1), 20 + 200 * F.abs(e(2)), 20 + 200 * F.abs(e(3))
    rows = table(spark, sf_dir, "embeddings").where(F.size("embedding") >= 5)
    return rows.select(F.col("vec_id").alias("seq"), F.concat(F.lit("m"), F.col("vec_id") % 3).alias("map_id"), F.concat(F.lit("路"), F.col("label")).alias("text"), e(4).alias("quality"), F.array(x, y, x + w, y + h).alias("bbox"))


DEDUPE_SQL = f"""WITH RECURSIVE b AS {BOX_SQL}, p AS (
  SELECT a.map_id, a.seq AS a, b.seq AS b, a.q AS qa, greatest(0, least(a.x1 + a.w, b.x1 + b.w) - greatest(a.x1, b.x1)) * greatest(0, least(a.y1 + a.h, b.y1 + b.h) - greatest(a.y1, b.y1)) AS i, a.w * a.h AS sa, b.w * b.h AS sb,
    sqrt(pow((2 * a.x1 + a.w - 2 * b.x1 - b.w) / 2, 2) + pow((2 * a.y1 + a.h - 2 * b.y1 - b.h) / 2, 2)) AS dist, a.w AS aw, a.h AS ah, b.w AS bw, b.h AS bh
  FROM b a JOIN b b ON a.map_id = b.map_id AND (a.q > b.q OR (a.q = b.q AND a.seq < b.seq))
), e AS (
  SELECT * FROM p WHERE i / (sa + sb - i) > 0.25 OR (dist < greatest(8, sqrt(greatest(sa, sb)) * 0.18::DOUBLE) AND abs(aw - bw) <= greatest(12, greatest(aw, bw) * 0.45::DOUBLE) AND abs(ah - bh) <= greatest(12, greatest(ah, bh) * 0.45::DOUBLE))
), n AS (
  SELECT b.map_id, b.seq, row_number() OVER (PARTITION BY b.map_id ORDER BY b.q DESC, b.seq) AS i, coalesce(w.better, []) AS better FROM b LEFT JOIN (SELECT b, list(a) AS better FROM e GROUP BY b) w ON w.b = b.seq
), r AS (
  SELECT map_id, 0::BIGINT AS i, []::BIGINT[] AS kept FROM (SELECT DISTINCT map_id FROM b)
  UNION ALL SELECT r.map_id, r.i + 1, CASE WHEN list_has_any(r.kept, n.better) THEN r.kept ELSE list_append(r.kept, n.seq) END FROM r JOIN n ON n.map_id = r.map_id AND n.i = r.i + 1
), k AS (
  SELECT unnest(kept) AS seq FROM (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY i DESC) AS rn FROM r) WHERE rn = 1
), d AS (
  SELECT host, seq, text, q FROM (SELECT e.a AS host, e.b AS seq, '路' || b.label AS text, b.q AS q, row_number() OVER (PARTITION BY e.b ORDER BY e.qa DESC, e.a) AS rn FROM e JOIN k ON e.a = k.seq JOIN b ON b.seq = e.b) WHERE rn = 1
), c AS (
  SELECT host, count(*)::BIGINT AS alternative_count FROM d GROUP BY host
), t AS (
  SELECT d.host, d.text, d.q, d.seq, row_number() OVER (PARTITION BY d.host, d.text ORDER BY d.q DESC, d.seq) AS rn FROM d JOIN b ON b.seq = d.host WHERE d.text <> '路' || b.label
), u AS (
  SELECT host, string_agg(text, ' | ' ORDER BY nth) AS alternative_texts FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY q DESC, seq) AS nth FROM t WHERE rn = 1) WHERE nth <= 8 GROUP BY host
) SELECT b.map_id, b.seq, row_number() OVER (PARTITION BY b.map_id ORDER BY b.q DESC, b.seq)::INTEGER AS ocr_no, coalesce(alternative_texts, '') AS alternative_texts, coalesce(alternative_count, 0)::BIGINT AS alternative_count FROM b JOIN k ON b.seq = k.seq LEFT JOIN c ON c.host = b.seq LEFT JOIN u ON u.host = b.seq"""


@query(DEDUPE_SQL)
def dedupe_boxes(spark, sf_dir):
    """Greedy de-duplication of overlapping boxes."""
    return boxes.dedupe_boxes(box_table(spark, sf_dir)).select("map_id", "seq", "ocr_no", "alternative_texts", "alternative_count")


@query(f"""WITH b AS {BOX_SQL}, s AS (SELECT seq, label, (round_even((x1 + x1 + w) / 2 / 12, 0) * 12)::BIGINT AS snap_x, (round_even((y1 + y1 + h) / 2 / 12, 0) * 12)::BIGINT AS snap_y FROM b)
SELECT seq, snap_x, snap_y FROM (SELECT *, row_number() OVER (PARTITION BY label, snap_x, snap_y ORDER BY seq) AS rn FROM s) WHERE rn = 1""")
def snap_dedupe(spark, sf_dir):
    """The first box of each text and snapped centre."""
    c = geo.centre(F.col("bbox"))
    return boxes.snap_dedupe(box_table(spark, sf_dir), c["x"], c["y"]).select("seq", "snap_x", "snap_y")


@query(f"""WITH b AS {BOX_SQL}, p AS (SELECT a.seq AS a, b.seq AS b, greatest(0, least(a.x1 + a.w, b.x1 + b.w) - greatest(a.x1, b.x1)) * greatest(0, least(a.y1 + a.h, b.y1 + b.h) - greatest(a.y1, b.y1)) AS i, a.w * a.h AS sa, b.w * b.h AS sb,
 sqrt(pow((2 * a.x1 + a.w - 2 * b.x1 - b.w) / 2, 2) + pow((2 * a.y1 + a.h - 2 * b.y1 - b.h) / 2, 2)) AS dist, a.label = b.label AS same, a.w AS aw, a.h AS ah, b.w AS bw, b.h AS bh
 FROM b a JOIN b b ON a.map_id = b.map_id AND (a.q > b.q OR (a.q = b.q AND a.seq < b.seq)))
SELECT a, b FROM p WHERE i / (sa + sb - i) > 0.25 OR (dist < greatest(8, sqrt(greatest(sa, sb)) * 0.18::DOUBLE) AND abs(aw - bw) <= greatest(12, greatest(aw, bw) * 0.45::DOUBLE) AND abs(ah - bh) <= greatest(12, greatest(ah, bh) * 0.45::DOUBLE))""")
def box_edges(spark, sf_dir):
    """Pairs of boxes that stand for one place (all texts here hold a place term, so overlap above a quarter is enough)."""
    return boxes.box_edges(box_table(spark, sf_dir)).select("a", "b")


@query(f"""WITH b AS {BOX_SQL} SELECT seq, list_transform([[x1, y1], [x1 + w, y1], [x1 + w, y1 + h], [x1, y1 + h], [x1, y1]], lambda v: [round(13375000 + 5 * v[1] + 0.5::DOUBLE * v[2], 3), round(3539000 - 0.25::DOUBLE * v[1] - 5 * v[2], 3)]) AS ring,
round(13375000 + 5 * (x1 + x1 + w) / 2 + 0.5::DOUBLE * (y1 + y1 + h) / 2, 3) AS center_x, round(3539000 - 0.25::DOUBLE * (x1 + x1 + w) / 2 - 5 * (y1 + y1 + h) / 2, 3) AS center_y FROM b WHERE map_id <> 'm2'""")
def project_boxes(spark, sf_dir):
    """Rings and centres of boxes on the map, for maps whose transform is not refused."""
    b = box_table(spark, sf_dir).withColumn("bbox_pixel", F.col("bbox")).withColumn("quad_pixel", F.lit(None).cast("array<array<double>>"))
    t = b.select("map_id").distinct().withColumn("accepted", F.col("map_id") != "m2").withColumn("coefficients", F.struct(F.lit(13375000.0).alias("x_origin"), F.lit(5.0).alias("pixel_width"), F.lit(0.5).alias("x_rotation"), F.lit(3539000.0).alias("y_origin"), F.lit(-0.25).alias("y_rotation"), F.lit(-5.0).alias("pixel_height")))
    return georef.project_boxes(b, t, "map_id").select("seq", "ring", "center_x", "center_y")


@query(f"""WITH b AS {BOX_SQL} SELECT seq, [[x1, -y1], [x1 + w, -y1], [x1 + w, -(y1 + h)], [x1, -(y1 + h)], [x1, -y1]] AS ring, CASE WHEN h > w * 1.6::DOUBLE THEN 'vertical' WHEN w > h * 1.6::DOUBLE THEN 'horizontal' ELSE 'unknown' END AS orientation FROM b""")
def image_boxes(spark, sf_dir):
    """Boxes in image space with the y axis upwards."""
    b = box_table(spark, sf_dir)
    w, h = F.col("bbox")[2] - F.col("bbox")[0], F.col("bbox")[3] - F.col("bbox")[1]
    ring = geo.image_ring(F.col("bbox"))
    return b.select("seq", ring.alias("ring"), F.when(h > w * 1.6, "vertical").when(w > h * 1.6, "horizontal").otherwise("unknown").alias("orientation"))


@query(f"""WITH b AS {BOX_SQL} SELECT map_id, seq, CASE WHEN seq % 2 = 0 THEN 'parallel' ELSE 'nested' END AS style, '路' || label AS text, (seq % 100) / 100.0::DOUBLE AS score, CASE WHEN (seq % 100) / 100.0 >= 0.85 THEN 'high' ELSE 'medium' END AS confidence,
CASE WHEN round(h, 2) > round(w, 2) * 1.6::DOUBLE THEN 'vertical' WHEN round(w, 2) > round(h, 2) * 1.6::DOUBLE THEN 'horizontal' ELSE 'unknown' END AS orientation FROM b""")
def ocr_normalize(spark, sf_dir):
    """Recogniser outputs of two nestings as one table."""
    b = box_table(spark, sf_dir)
    w, h = F.round(F.col("bbox")[2] - F.col("bbox")[0], 2), F.round(F.col("bbox")[3] - F.col("bbox")[1], 2)
    quad = F.to_json(F.array(F.array(F.lit(0.0), F.lit(0.0)), F.array(w, F.lit(0.0)), F.array(w, h), F.array(F.lit(0.0), h)))
    score = (F.col("seq") % 100 / 100).cast("string")
    new = F.concat(F.lit('{"dt_polys":['), quad, F.lit('],"rec_texts":["'), "text", F.lit('"],"rec_scores":['), score, F.lit("]}"))
    old = F.concat(F.lit("[["), quad, F.lit(',["'), "text", F.lit('",'), score, F.lit("]]]"))
    texts = b.select(F.concat_ws("/", "map_id", "seq").alias("map_id"), F.when(F.col("seq") % 2 == 0, new).otherwise(old).alias("value"))
    out = ocr.normalize_detections(texts).withColumn("_m", F.split("map_id", "/"))
    return out.select(F.col("_m")[0].alias("map_id"), F.col("_m")[1].cast("long").alias("seq"), "style", "text", "score", "confidence", "orientation")


@query(f"""WITH b AS {BOX_SQL}, t AS (SELECT seq, map_id, '·路' || CASE WHEN label % 2 = 0 THEN '宝' ELSE '' END || ' ' || label AS raw, CASE WHEN label % 2 = 0 THEN label || '宝路' ELSE label || '路' END AS txt, (seq % 100) / 100.0::DOUBLE AS conf, w, h FROM b)
SELECT map_id, seq, txt AS text, round(conf + 0.08::DOUBLE + (CASE WHEN txt LIKE '%宝%' THEN 2 ELSE 1 END) * 0.01::DOUBLE + CASE WHEN seq % 2 = 0 THEN 0.03::DOUBLE ELSE 0 END, 6) AS quality, 'ocr_街巷道路' AS category FROM t WHERE conf >= 0.48 AND round((40 + round(w, 2)) / 2 - 20, 2) >= 3 AND round((40 + round(h, 2)) / 2 - 20, 2) >= 3 AND round((40 + round(w, 2)) / 2 - 20, 2) * round((40 + round(h, 2)) / 2 - 20, 2) BETWEEN 20 AND 4000 * 3000 * 0.08::DOUBLE""")
def ocr_keep(spark, sf_dir):
    """Detections that are kept, with text in reading order, quality and category."""
    b = box_table(spark, sf_dir)
    w, h = F.round(F.col("bbox")[2] - F.col("bbox")[0], 2), F.round(F.col("bbox")[3] - F.col("bbox")[1], 2)
    label = F.substring("text", 2, 9)
    raw = F.concat(F.lit("·路"), F.when(label.cast("int") % 2 == 0, "宝").otherwise(""), F.lit(" "), label)
    points = F.array(F.array(F.lit(0.0), F.lit(0.0)), F.array(w, F.lit(0.0)), F.array(w, h), F.array(F.lit(0.0), h))
    d = b.select("map_id", "seq", raw.alias("raw_text"), (F.col("seq") % 100 / 100).cast("string").alias("raw_confidence"), points.alias("points"), F.lit(40.0).alias("tile_x"), F.lit(40.0).alias("tile_y"), F.lit(2.0).alias("scale"), F.lit(4000).alias("width"), F.lit(3000).alias("height"), F.when(F.col("seq") % 2 == 0, "tile").otherwise("full").alias("pass_name"))
    return boxes.ocr_candidates(d).select("map_id", "seq", "text", "quality", "category")


@query("""WITH i AS (SELECT p_partkey AS k, p_size * 100 AS w, p_size * 70 AS h FROM part), s AS (
  SELECT k, w, h, CASE WHEN w <= 1600 THEN [0] ELSE list_distinct(range(0, w - 1600 + 1, 1360) || [w - 1600]) END AS xs, CASE WHEN h <= 1600 THEN [0] ELSE list_distinct(range(0, h - 1600 + 1, 1360) || [h - 1600]) END AS ys FROM i
), t AS (SELECT k, w, h, unnest(xs) AS x0, ys FROM s), u AS (SELECT k, w, h, x0, unnest(ys) AS y0 FROM t)
SELECT k, x0::INTEGER AS x0, y0::INTEGER AS y0, least(w, x0 + 1600)::INTEGER AS x1, least(h, y0 + 1600)::INTEGER AS y1 FROM u""")
def tile_plan(spark, sf_dir):
    """Overlapping tiles of images."""
    i = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), (F.col("p_size") * 100).alias("width"), (F.col("p_size") * 70).alias("height"))
    return boxes.tile_plan(i).select("k", "x0", "y0", "x1", "y1")


SAMPLE_SQL = f"""WITH RECURSIVE c AS (
  SELECT (k % 4)::VARCHAR AS map_id, k AS seq, 'n' || (k % 300) AS name, seg, CASE WHEN k % 3 = 0 THEN 3 ELSE 1 END AS sure, CASE seg WHEN 'BUILDING' THEN 2 WHEN 'MACHINERY' THEN 1 ELSE 0 END AS p, CASE WHEN k % 11 <> 0 THEN lon END AS x, CASE WHEN k % 11 <> 0 THEN lat END AS y FROM {LONLAT_SQL}
), o AS (
  SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY p DESC, sure DESC, x IS NOT NULL DESC, name DESC, seq) AS o, min(x) OVER m AS x0, max(x) OVER m AS x1, min(y) OVER m AS y0, max(y) OVER m AS y1 FROM c WINDOW m AS (PARTITION BY map_id)
), forced AS (
  SELECT map_id, name, seq, row_number() OVER (PARTITION BY map_id ORDER BY o) AS s FROM (SELECT *, row_number() OVER (PARTITION BY map_id, name ORDER BY o) AS rn FROM o WHERE name IN ('n7', 'n8')) WHERE rn = 1
), st AS (
  SELECT map_id, name, seq, o, p AS st FROM (SELECT *, CASE seg WHEN 'BUILDING' THEN 0 ELSE 1 END AS p FROM (SELECT * EXCLUDE p FROM o)) WHERE seg IN ('BUILDING', 'MACHINERY')
  UNION ALL SELECT map_id, name, seq, o, 2 + greatest(0, least(2, floor((y - y0) / (y1 - y0) * 3)))::INTEGER * 4 + greatest(0, least(3, floor((x - x0) / (x1 - x0) * 4)))::INTEGER FROM o WHERE x IS NOT NULL
), r AS (
  SELECT m.map_id, -1 AS st, coalesce(list(f.name) FILTER (WHERE f.name IS NOT NULL), []::VARCHAR[]) AS taken, NULL::BIGINT AS seq FROM (SELECT DISTINCT map_id FROM c) m LEFT JOIN forced f ON m.map_id = f.map_id GROUP BY m.map_id
  UNION ALL SELECT r.map_id, r.st + 1, CASE WHEN count(st.seq) = 0 THEN r.taken ELSE list_append(r.taken, arg_min(st.name, st.o)) END, arg_min(st.seq, st.o) FROM r LEFT JOIN st ON st.map_id = r.map_id AND st.st = r.st + 1 AND NOT list_contains(r.taken, st.name) WHERE r.st < 13 GROUP BY r.map_id, r.st, r.taken
), rest AS (
  SELECT o.map_id, o.name, o.seq, row_number() OVER (PARTITION BY o.map_id ORDER BY o.o) AS s FROM (SELECT *, row_number() OVER (PARTITION BY map_id, name ORDER BY o) AS rn FROM o) o JOIN r ON r.map_id = o.map_id AND r.st = 13 AND NOT list_contains(r.taken, o.name) WHERE o.rn = (
    SELECT min(q.rn) FROM (SELECT map_id, name, row_number() OVER (PARTITION BY map_id, name ORDER BY o) AS rn FROM o) q WHERE q.map_id = o.map_id AND q.name = o.name)
), every AS (
  SELECT map_id, seq, name, 1 AS phase, s FROM forced UNION ALL SELECT r.map_id, r.seq, c.name, CASE WHEN r.st < 2 THEN 2 ELSE 3 END, r.st FROM r JOIN c ON c.seq = r.seq WHERE r.seq IS NOT NULL UNION ALL SELECT map_id, seq, name, 4, s FROM rest
), sampled AS (
  SELECT map_id, seq, name, phase::INTEGER AS phase, sample_no::INTEGER AS sample_no FROM (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY phase, s) AS sample_no FROM every) WHERE sample_no <= 40
) """


def sample_rows(spark, sf_dir):
    """Candidates, and the size, categories, names and grid of the review sample."""
    c = lonlat(spark, sf_dir)
    rows = c.select((F.col("k") % 4).cast("string").alias("map_id"), F.col("k").alias("seq"), F.lit("").alias("place_id"), F.concat(F.lit("n"), F.col("k") % 300).alias("name"), F.col("seg").alias("category"), F.when(F.col("k") % 3 == 0, "high").otherwise("low").alias("confidence"), "lon", "lat")
    rows = rows.select("map_id", "seq", "place_id", "name", "category", "confidence", F.when(F.col("seq") % 11 != 0, F.col("lon")).alias("x"), F.when(F.col("seq") % 11 != 0, F.col("lat")).alias("y"))
    return rows, 40, ["BUILDING", "MACHINERY"], ["n7", "n8"], 4, 3


@query(SAMPLE_SQL + "SELECT * FROM sampled")
def review_sample(spark, sf_dir):
    """A stratified sample of customers."""
    return sample.review_sample(*sample_rows(spark, sf_dir)).select("map_id", "seq", "name", "phase", "sample_no")


@query(f"""WITH c AS {LONLAT_SQL}, e AS (SELECT min(lon) AS x0, max(lon) AS x1, min(lat) AS y0, max(lat) AS y1 FROM c)
SELECT k, greatest(0, least(3, floor((lon - x0) / (x1 - x0) * 4)))::INTEGER AS col, greatest(0, least(2, floor((lat - y0) / (y1 - y0) * 3)))::INTEGER AS row FROM c, e""")
def grid_cells(spark, sf_dir):
    """Grid cells of points over their extent."""
    c = lonlat(spark, sf_dir)
    e = c.agg(F.struct(F.min("lon").alias("x0"), F.min("lat").alias("y0"), F.max("lon").alias("x1"), F.max("lat").alias("y1")).alias("e"))
    cell = geo.grid_cell(F.col("lon"), F.col("lat"), F.col("e"), 4, 3)
    return c.withColumn("one", F.lit(1)).join(F.broadcast(e.withColumn("one", F.lit(1))), "one").select("k", cell["col"].alias("col"), cell["row"].alias("row"))


@query(f"""WITH c AS {LONLAT_SQL}, e AS (SELECT seg, min(lon) AS x0, max(lon) AS x1, min(lat) AS y0, max(lat) AS y1 FROM c GROUP BY seg), f AS (
  SELECT seg, (x0 + x1) / 2 AS lon, (y0 + y1) / 2 AS lat, greatest(2400, (x1 - x0) * 111320 * cos(radians((y0 + y1) / 2)) + 700) / 2 AS w, greatest(1800, (y1 - y0) * 110540 + 700) / 2 AS h FROM e
) SELECT seg, i, round(lon + sx * w / (111320 * greatest(0.2::DOUBLE, cos(radians(lat)))), 6) AS x, round(lat + sy * h / 110540, 6) AS y FROM f, (VALUES (0, -1, -1), (1, 1, -1), (2, 1, 1), (3, -1, 1), (4, -1, -1)) t(i, sx, sy)""")
def stage(spark, sf_dir):
    """The ground rectangle under each group's extent."""
    e = lonlat(spark, sf_dir).groupBy("seg").agg(F.struct(F.min("lon").alias("x0"), F.min("lat").alias("y0"), F.max("lon").alias("x1"), F.max("lat").alias("y1")).alias("e"))
    return e.select("seg", F.posexplode(geo.stage_ring(F.col("e"))).alias("i", "v")).select("seg", "i", F.round(F.col("v")[0], 6).alias("x"), F.round(F.col("v")[1], 6).alias("y"))


@query("""WITH t AS (SELECT p_partkey AS k, p_retailprice AS a, p_size AS s FROM part) SELECT k, printf('%.12f', s / 4.0::DOUBLE) AS pixel_width, printf('%.12f', -s / 4.0::DOUBLE) AS pixel_height, round(a + s / 8.0::DOUBLE, 6) AS x, round(a + 50 * s - s / 8.0::DOUBLE, 6) AS y FROM t""")
def world_file(spark, sf_dir):
    """World-file numbers of north-up rasters."""
    a, s = F.col("p_retailprice"), F.col("p_size")
    t = geo.extent_affine(a, a, a + 100 * s, a + 50 * s, F.lit(400), F.lit(200))
    w = geo.world_file(F.col("t"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), t.alias("t")).select("k", w[0].alias("pixel_width"), w[3].alias("pixel_height"), F.round(w[4].cast("double"), 6).alias("x"), F.round(w[5].cast("double"), 6).alias("y"))


@query("""WITH r AS (SELECT p_type AS target_layer, CASE WHEN length(p_type) % 3 = 0 THEN 'Point' WHEN length(p_type) % 3 = 1 THEN 'LineString' ELSE 'Polygon' END AS kind, max(p_size) AS w FROM part WHERE p_type <> 'ECONOMY' GROUP BY 1, 2)
SELECT p_partkey, p_type AS target_layer, kind AS geom_type, (CASE kind WHEN 'Point' THEN 1 WHEN 'LineString' THEN 2 ELSE CASE WHEN w % 2 = 0 THEN 25 ELSE 5 END END)::INTEGER AS vertices, round(CASE kind WHEN 'Point' THEN p_retailprice WHEN 'LineString' THEN p_retailprice - w / 2.0 ELSE CASE WHEN w % 2 = 0 THEN p_retailprice + 45 ELSE p_retailprice - w / 2.0 END END, 4) AS first_x FROM part JOIN r ON p_type = target_layer""")
def route_layers(spark, sf_dir):
    """Places routed to layers, with the geometry that the layer's rule gives; rows without a rule are left to the error report."""
    p = table(spark, sf_dir, "part")
    n = F.length("p_type") % 3
    rules = p.where("p_type <> 'ECONOMY'").groupBy(F.col("p_type").alias("target_layer")).agg(F.max("p_size").cast("double").alias("width_m")).select(
        "target_layer", F.when(F.length("target_layer") % 3 == 0, "Point").when(F.length("target_layer") % 3 == 1, "LineString").otherwise("Polygon").alias("qgis_geometry"), F.when(F.col("width_m") % 2 == 0, "circle").otherwise("rect").alias("shape"),
        "width_m", F.lit(None).cast("double").alias("height_m"), F.lit(None).cast("double").alias("radius_m"), F.lit(None).cast("int").alias("segments"),
    )
    places = p.select("p_partkey", F.col("p_type").alias("target_layer"), F.col("p_retailprice").alias("x"), F.col("p_size").cast("double").alias("y"))
    out, _ = jobs.route_layers(places, rules)
    return out.select("p_partkey", "target_layer", F.col("geom_type"), F.size(F.col("rings")[0]).alias("vertices"), F.round(F.col("rings")[0][0][0], 4).alias("first_x"))


@query("""SELECT c_custkey::VARCHAR AS key, c_name AS name, 'Point' AS geom_type, 100 + c_nationkey * 0.5::DOUBLE AS lon, 30 + c_nationkey * 0.25::DOUBLE AS lat FROM customer WHERE c_custkey % 4 <> 0""")
def geojson_roundtrip(spark, sf_dir):
    """Points written as the Features of one collection and read again by splits; rows without coordinates are left out."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    c = table(spark, sf_dir, "customer").select(k.alias("key"), F.col("c_name").alias("name"), F.when(k % 4 != 0, 100 + n * 0.5).alias("lon"), (30 + n * 0.25).alias("lat"))
    one = geojson.points(c, ["key", "name", "lon", "lat"])
    path = f"{shared_dir(spark)}/geojson-{uuid.uuid4().hex}"
    geojson.write_collection(one, path, [F.col("value")])
    f = geojson.read_features(spark, path)
    p = F.col("rings")[0][0]
    return f.select(F.col("properties")["key"].alias("key"), F.col("properties")["name"].alias("name"), "geom_type", p[0].alias("lon"), p[1].alias("lat"))


@query("""WITH c AS (SELECT c_custkey AS k, c_nationkey AS n FROM customer) SELECT k, CASE WHEN k % 3 = 0 THEN n * 1.0::DOUBLE WHEN k % 3 = 1 THEN n * 2.0::DOUBLE WHEN k % 2 = 0 THEN 13375000 + 5 * (n + 5.0::DOUBLE) END AS x, k % 3 = 2 AND k % 2 = 1 AS failed FROM c""")
def candidate_xy(spark, sf_dir):
    """Coordinates of candidates by their ladder of sources."""
    k, n = F.col("c_custkey"), F.col("c_nationkey").cast("double")
    t = F.struct(F.lit(13375000.0).alias("x_origin"), F.lit(5.0).alias("pixel_width"), F.lit(0.0).alias("x_rotation"), F.lit(3539000.0).alias("y_origin"), F.lit(0.0).alias("y_rotation"), F.lit(-5.0).alias("pixel_height"))
    c = table(spark, sf_dir, "customer").select(k.alias("k"), F.when(k % 3 == 0, n).alias("x"), F.when(k % 3 == 0, n).alias("y"), F.when(k % 3 == 1, n * 2).alias("map_x"), F.when(k % 3 == 1, n * 2).alias("map_y"), F.when(k % 2 == 0, F.array(n, n, n + 10, n + 10)).alias("bbox_pixel"))
    return georef.candidate_xy(c, t).select("k", F.col("out_x").alias("x"), F.col("problem").isNotNull().alias("failed"))


@query(f"""WITH c AS {LONLAT_SQL}, r AS (SELECT k, lon, lat, [[lon, lat], [lon + 0.1::DOUBLE, lat], [lon, lat]] AS ring FROM c) SELECT k, list_transform(ring, lambda p: [round(radians(p[1]) * 6378137, 2), round(ln(tan(pi() / 4 + radians(p[2]) / 2)) * 6378137, 2)]) AS ring FROM r""")
def reproject(spark, sf_dir):
    """Rings in EPSG:3857."""
    lon, lat = F.col("lon"), F.col("lat")
    ring = F.array(F.array(lon, lat), F.array(lon + 0.1, lat), F.array(lon, lat))
    out = geo.reproject(F.array(ring))
    return lonlat(spark, sf_dir).select("k", F.transform(out[0], lambda p: F.transform(p, lambda v: F.round(v, 2))).alias("ring"))


