"""OCR payloads, recogniser outputs of two nestings, and map extracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mapmill.functions import geo
from mapmill.functions.text import first_tag, present
from mapmill.schemas import OCR_CANDIDATE, OSM


def candidates_of(texts: DataFrame, text: str = "value", stem: Column | None = None) -> DataFrame:
    """(map_id, seq, candidate columns) of payload texts: an object with candidates, or a bare list.

    The map id is the payload's, or else the file's stem without its suffix.
    """
    is_list = F.startswith(F.ltrim(F.col(text)), F.lit("["))
    payload = F.from_json(text, f"struct<map_id:string, image_file:string, crs:string, candidates:array<{OCR_CANDIDATE}>>")
    parsed = texts.withColumn("_p", payload).withColumn("_l", F.from_json(text, f"array<{OCR_CANDIDATE}>"))
    own = F.regexp_replace(stem, "_text_candidates$", "") if stem is not None else F.lit(None).cast("string")
    rows = parsed.select(F.when(is_list, own).otherwise(F.coalesce("_p.map_id", own)).alias("map_id"), F.posexplode(F.when(is_list, F.col("_l")).otherwise(F.col("_p.candidates"))).alias("seq", "c"))
    return rows.select("map_id", "seq", "c.*")


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    texts = spark.read.text(path, wholetext=True).withColumn("_f", F.col("_metadata.file_name"))
    return candidates_of(texts, "value", F.regexp_replace("_f", r"\.json$", ""))


def normalize_detections(texts: DataFrame, key: str = "map_id", text: str = "value") -> DataFrame:
    """(map_id, seq, style, text, score, box, orientation, confidence) of recogniser outputs.

    One style has parallel arrays (dt_polys, rec_texts, rec_scores), whose missing tails are null;
    the other nests [box, [text, score]]. Blank texts and detections without a box are left out.
    """
    new = F.from_json(text, "struct<dt_polys:array<array<array<double>>>, rec_texts:array<string>, rec_scores:array<double>>")
    v3 = texts.withColumn("_j", new).where(F.col("_j.rec_texts").isNotNull())
    v3 = v3.select(key, F.posexplode(F.arrays_zip(F.col("_j.dt_polys").alias("points"), F.col("_j.rec_texts").alias("text"), F.col("_j.rec_scores").alias("score"))).alias("seq", "z"))
    v3 = v3.select(key, "seq", F.lit("parallel").alias("style"), "z.text", "z.score", "z.points")
    old = F.try_parse_json(text)
    v2 = texts.where(F.startswith(F.ltrim(F.col(text)), F.lit("["))).select(key, F.try_variant_get(old, "$", "array<variant>").alias("_a")).select(key, F.posexplode("_a").alias("seq", "v"))
    v2 = v2.select(key, "seq", F.lit("nested").alias("style"), F.try_variant_get("v", "$[1][0]", "string").alias("text"), F.try_variant_get("v", "$[1][1]", "double").alias("score"), F.try_variant_get("v", "$[0]", "array<array<double>>").alias("points"))
    both = v3.unionByName(v2).where(present(F.col("text")).isNotNull() & (F.size("points") > 0)).withColumn("box", geo.box_of(F.col("points")))
    return both.select(key, "seq", "style", F.trim("text").alias("text"), "score", "box", geo.box_orientation(F.col("box")).alias("orientation"), geo.confidence_band(F.coalesce("score", F.lit(0.0))).alias("confidence"))


def osm_features(extracts: DataFrame, class_keys: list[str]) -> DataFrame:
    """(osm_name, osm_type, osm_id, osm_class, lon, lat) of an extract's elements that have a name and a place."""
    e = extracts.select(F.posexplode("elements").alias("feature_seq", "e"))
    tags = F.col("e.tags")
    tag = lambda k: present(F.try_element_at(tags, F.lit(k)))
    place = lambda c: F.coalesce(F.nullif(F.col(f"e.{c}"), F.lit(0.0)), F.col(f"e.center.{c}"))
    out = e.select("feature_seq", F.coalesce(tag("name"), tag("name:zh")).alias("osm_name"), F.col("e.type").alias("osm_type"), F.col("e.id").alias("osm_id"), first_tag(tags, class_keys).alias("osm_class"), place("lon").alias("lon"), place("lat").alias("lat"))
    return out.na.drop(subset=["osm_name", "lon", "lat"])


def read_osm(spark: SparkSession, path: str, class_keys: list[str]) -> DataFrame:
    return osm_features(spark.read.schema(OSM).option("multiLine", True).json(path), class_keys)
