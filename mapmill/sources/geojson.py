"""GeoJSON: feature tables of points, lines and polygons, in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mapmill.operators.ranking import rank_by_key
from mapmill.schemas import FEATURE, FEATURES

POINT, LINE, POLYGON = "array<double>", "array<array<double>>", "array<array<array<double>>>"


def rings_of(kind: Column, coordinates: Column) -> Column:
    """Coordinates text of a Point, LineString or Polygon as an array of paths; null for other types."""
    one = F.from_json(coordinates, POINT)
    return F.when(kind == "Point", F.array(F.array(one))).when(kind == "LineString", F.array(F.from_json(coordinates, LINE))).when(kind == "Polygon", F.from_json(coordinates, POLYGON))


def coordinates_of(kind: Column, rings: Column) -> Column:
    """The coordinates text of an array of paths."""
    return F.when(kind == "Point", F.to_json(rings[0][0])).when(kind == "LineString", F.to_json(rings[0])).otherwise(F.to_json(rings))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """(seq, properties map, geom_type, rings) of the FeatureCollections in files of any size; ``seq`` counts from 0 in each file.

    A file is read in as many tasks as it has splits: what opens a feature ends a record of the text source, which finds the next one
    in any split by itself. It cannot stand inside a text, as quotes are escaped there. The first one in the files shows how it is
    written; files whose features do not begin with their type, or with mixed spacing, are read whole, one task a file.
    """
    opening = _opening(spark, path)
    if opening is None:
        return _numbered(_whole(spark, path).select("_file", F.posexplode("features").alias("_at", "f")), ["_at"])
    parts = spark.read.option("lineSep", opening).text(path)
    parts = parts.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_no"))
    # The head of a file is the one record that does not go on with the rest of a feature.
    parsed = parts.where(F.col("value").rlike(r"^\s*[,}]")).withColumn("f", F.from_json(F.concat(F.lit(opening), F.regexp_replace("value", r"[\s,]+$", "")), FEATURE))
    return _numbered(parsed.select("_file", "_at", "_no", "f"), ["_at", "_no"])


def _opening(spark: SparkSession, path: str) -> str | None:
    """How the files at ``path`` begin a feature, if they all begin every feature alike."""
    # A record ends where a type is given, so that the last 200 characters of it hold the brace before it.
    types = spark.read.option("lineSep", '"Feature"').text(path).select(F.right(F.col("value"), F.lit(200)).alias("t"))
    # A member of an object is no feature of the list; with such a one the file is read whole.
    brace = F.when(F.col("t").rlike(r":\s*\{\s*\"type\"\s*:\s*$"), "").otherwise(F.regexp_extract("t", r"(\{\s*\"type\"\s*:\s*)$", 1))
    found = types.where(F.col("t").rlike(r"\"type\"\s*:\s*$")).groupBy(brace.alias("b")).agg(F.count(F.lit(1)).alias("n")).limit(2).collect()
    return found[0].b + '"Feature"' if len(found) == 1 and found[0].b else None


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FEATURES).option("multiLine", True).json(path).select("features", F.col("_metadata.file_path").alias("_file"))


def _numbered(features: DataFrame, order: list[str]) -> DataFrame:
    """Features with their number in their file."""
    out = rank_by_key(features, ["_file"], [F.col(c) for c in order], "_rank")
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    return out.select((F.col("_rank") - 1).cast("int").alias("seq"), F.col("f.properties").alias("properties"), kind.alias("geom_type"), rings_of(kind, text).alias("rings"))


def write_collection(features: DataFrame, path: str, order: list[Column], name: str = "features") -> None:
    """Features (value) in ``order`` as one FeatureCollection, in files that are each a part of it: a head, one feature a line, and an end.

    The parts are written by as many tasks as there are ranges; read one after the other, in the order of their names, they are one document.
    """
    ranked = rank_by_key(features, [], order, "_no", "_many")
    line = F.concat("value", F.when(F.col("_no") < F.col("_many"), ",").otherwise("\n]}"))
    head = f'{{"type":"FeatureCollection","name":"{name}","features":[\n'
    lines = ranked.select("_no", F.concat(F.when(F.col("_no") == 1, head).otherwise(""), line).alias("value"))
    lines.repartitionByRange("_no").sortWithinPartitions("_no").select("value").write.mode("overwrite").text(path)


def features_of(collections: DataFrame) -> DataFrame:
    """The features of rows that hold a ``features`` array."""
    f = collections.select(F.posexplode("features").alias("seq", "f"))
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    return f.select("seq", F.col("f.properties").alias("properties"), kind.alias("geom_type"), rings_of(kind, text).alias("rings"))


def parse_features(texts: DataFrame, column: str = "value") -> DataFrame:
    """Features of a column of JSON texts, one FeatureCollection a row."""
    return features_of(texts.select(F.from_json(column, FEATURES).alias("j")).select("j.features"))


def point_feature(properties: list[str], lon: str = "lon", lat: str = "lat") -> Column:
    """JSON of a point Feature; coordinates are not repeated in its properties."""
    keep = [c for c in properties if c not in (lon, lat)]
    return F.concat(F.lit('{"type":"Feature","geometry":{"type":"Point","coordinates":'), F.to_json(F.array(lon, lat)), F.lit('},"properties":'), F.to_json(F.struct(*keep), {"ignoreNullFields": "false"}), F.lit("}"))


def shape_feature(kind: Column, rings: Column, properties: list[str]) -> Column:
    """JSON of a Feature of any type."""
    return F.concat(F.lit('{"type":"Feature","geometry":{"type":"'), kind, F.lit('","coordinates":'), coordinates_of(kind, rings), F.lit('},"properties":'), F.to_json(F.struct(*properties), {"ignoreNullFields": "false"}), F.lit("}"))


def points(df: DataFrame, properties: list[str], lon: str = "lon", lat: str = "lat") -> DataFrame:
    """One point Feature a line of the rows that have coordinates."""
    return df.where(F.col(lon).isNotNull() & F.col(lat).isNotNull()).select(point_feature(properties, lon, lat).alias("value"))


def write_sequence(features: DataFrame, path: str) -> None:
    """Features one a line, as many files as there are tasks."""
    features.select("value").write.mode("overwrite").text(path)


def collection(features: DataFrame, name: str, crs: str | None = None, most: int = 100_000) -> DataFrame:
    """One row with a whole FeatureCollection, for small results only; more than ``most`` features raise an error."""
    n = features.limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} features: write them as a sequence")
    head = f'{{"type":"FeatureCollection","name":"{name}",' + (f'"crs":{{"type":"name","properties":{{"name":"{crs}"}}}},' if crs else "") + '"features":['
    return features.agg(F.concat(F.lit(head), F.array_join(F.array_sort(F.collect_list("value")), ","), F.lit("]}")).alias("value"))
