"""Best matches of names: pairs that can count (``similar``), scored, and reduced by rank."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from mapmill.functions.text import normal_name, simplified
from mapmill.operators.lookup import small
from mapmill.operators.similar import contained_pairs, scored_pairs, similar_pairs
from mapmill.storage import kept, materialize, scratch

REVIEW = 0.72
#: Scores count after rounding to three places.
HALF_UP = 0.0005
#: Similarity down to which names are paired at once, and the least one that is ever asked for.
NEAR, LEAST = 0.8, 0.01
#: Bonuses of a compatible type and of a way, added before the best pair is chosen.
COMPATIBLE_BONUS, WAY_BONUS = 0.08, 0.04
# Categories of structural names; the labels of the ladder below are fixed too.
STRUCTURAL = ("城门", "宫城", "寺观", "山体", "水体", "桥梁", "衙署")


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def sequence_ratio(a: Column, b: Column) -> Column:
    """Twice the matched characters over all characters, by longest common blocks (not symmetric)."""
    return _ratio(a, b)


def edit_similarity(a: Column, b: Column) -> Column:
    """One minus the edit distance over the longer length; native."""
    return 1 - F.try_divide(F.levenshtein(a, b), F.greatest(F.length(a), F.length(b), F.lit(1)))


METRICS = {"ratio": sequence_ratio, "levenshtein": edit_similarity}


def compatible(place_type: Column, tokens: Column, osm_class: Column) -> Column:
    """A type without tokens fits every class; else one of its tokens must stand in the class."""
    return tokens.isNull() | F.exists(F.coalesce(tokens, F.array().cast("array<string>")), lambda t: F.contains(osm_class, t))


def match_places(places: DataFrame, features: DataFrame, compat: DataFrame, metric: str = "ratio", near: float = NEAR) -> DataFrame:
    """Each place with its best reference feature: match_status, match_method, match_score and the feature's columns.

    ``places``: (seq, name, place_type); ``features``: (feature_seq, osm_name, osm_type, osm_class,
    lon, lat); ``compat``: (place_type, token). The rank of a pair is its score and bonuses; ties go
    to the first feature. Exact or contained names of a compatible type are matched, others need a
    score of 0.72 for review, and the rest are unmatched with no feature. A place without a name is unmatched.

    Contained names and those of a similarity of ``near`` or more come first. A place whose best rank so far leaves room for
    less similar names looks for those that can still beat it, and for no others: below 0.72 less the bonuses nothing changes, unless a
    short contained name is all that was found. Each distinct name and type is matched once, and of features that differ in their number alone the first.
    """
    with scratch():
        tokens = compat.groupBy(F.col("place_type").alias("_pt")).agg(F.collect_set("token").alias("tokens"))
        kinds = places.select(normal_name(F.col("name")).alias("pn"), "place_type").where("pn <> ''").distinct()
        p = materialize(kinds.join(small(tokens), F.col("place_type") == F.col("_pt"), "left").drop("_pt"), "match_places")
        first = F.min_by(F.struct("feature_seq", "osm_name", "lon", "lat"), "feature_seq").alias("_f")
        f = features.select("*", normal_name(F.col("osm_name")).alias("fn")).where("fn <> ''").groupBy("fn", "osm_type", "osm_class").agg(first)
        f = materialize(f.select("fn", "osm_type", "osm_class", "_f.*"), "match_features")
        names_p, names_f = p.select("pn").distinct(), f.select("fn").distinct()
        inside = contained_pairs(names_p, "pn", names_f, "fn").unionByName(contained_pairs(names_f, "fn", names_p, "pn"))
        pairs = inside.unionByName(similar_pairs(names_p, "pn", names_f, "fn", metric, near)).distinct()
        scored = scored_pairs(pairs, "pn", "fn", METRICS[metric], "match_pairs")
        best = materialize(_best_features(p, f, scored), "match_best")
        # What a pair must reach to change the result of its place and type; names take the least of their types.
        told = F.col("match_status").isNotNull() | (F.col("rank") >= REVIEW - HALF_UP)
        floor = F.when(told, F.col("rank")).otherwise(F.lit(REVIEW - HALF_UP)) - COMPATIBLE_BONUS - WAY_BONUS - 1e-9
        open_ = p.join(best.select("pn", "place_type", "rank", "match_status"), (p["pn"] == best["pn"]) & p["place_type"].eqNullSafe(best["place_type"]), "left")
        open_ = open_.select(p["pn"], F.greatest(floor, F.lit(LEAST)).alias("_t")).groupBy("pn").agg(F.min("_t").alias("_t")).where(F.col("_t") < near)
        open_ = materialize(open_, "match_open")
        least = open_.agg(F.min("_t")).first()[0]
        if least is not None:
            more = similar_pairs(open_, "pn", names_f, "fn", metric, least, "_t").join(scored, ["pn", "fn"], "left_anti")
            scored = scored.unionByName(scored_pairs(more, "pn", "fn", METRICS[metric], "match_more"))
            best = _best_features(p, f, scored)
        best = kept(materialize(best.where(F.col("match_status").isNotNull()), "matched"))
    best = best.select(F.col("pn").alias("_p"), F.col("place_type").alias("_k"), "match_status", "match_method", F.round("score", 3).alias("match_score"), "osm_name", "osm_type", "osm_class", "lon", "lat")
    out = places.join(small(best), (normal_name(F.col("name")) == F.col("_p")) & F.col("place_type").eqNullSafe(F.col("_k")), "left")
    cols = ["osm_name", "osm_type", "osm_class", "lon", "lat"]
    return out.select(*places.columns, F.coalesce("match_status", F.lit("unmatched")).alias("match_status"), F.coalesce("match_method", F.lit("")).alias("match_method"), F.coalesce("match_score", F.lit(0.0)).alias("match_score"), *cols)


def _best_features(p: DataFrame, f: DataFrame, scored: DataFrame) -> DataFrame:
    """The pair of the largest rank of each (pn, place_type), with rank, score, match_method and match_status (null where it is no match)."""
    met = p.join(scored, "pn").join(f, "fn")
    fits, inside = compatible(F.col("place_type"), F.col("tokens"), F.col("osm_class")), F.contains(F.col("pn"), F.col("fn")) | F.contains(F.col("fn"), F.col("pn"))
    met = met.withColumn("fits", fits)
    exact, contained = F.col("pn") == F.col("fn"), F.col("fits") & inside
    share = F.least(F.length("pn"), F.length("fn")) / F.greatest(F.length("pn"), F.length("fn"))
    met = met.withColumn("score", F.when(exact, 1.0).when(contained, share).otherwise(F.col("sim"))).withColumn("match_method", F.when(exact, "exact").when(contained, "contains").otherwise("fuzzy"))
    met = met.withColumn("rank", F.col("score") + F.when(F.col("fits"), COMPATIBLE_BONUS).otherwise(0.0) + F.when(F.col("osm_type") == "way", WAY_BONUS).otherwise(0.0))
    best = met.withColumn("_rn", F.row_number().over(Window.partitionBy("pn", "place_type").orderBy(F.desc("rank"), "feature_seq"))).where("_rn = 1").drop("_rn")
    status = F.when(F.col("fits") & F.col("match_method").isin("exact", "contains"), "matched").when(F.round("score", 3) >= REVIEW, "review")
    return best.withColumn("match_status", status).drop("tokens", "fits")


def match_labels(labels: DataFrame, master: DataFrame, specials: list[tuple[str, str, str, float]] = (), metric: str = "ratio", floor: float = 0.86) -> DataFrame:
    """Best master place of each map label over all its texts.

    ``labels``: (seq, texts array<string>); ``master``: (master_seq, name, category); ``specials``:
    (cleaned master name, pattern of the cleaned text, match type, score). A pair scores 1 if
    equal, its special rule's score, 0.88 if the text holds a name of three characters or more, or
    its similarity if that reaches 0.72 for structural categories or 0.84 for names of three
    characters. Scores under ``floor`` count only for special rules. The best pair is the one of
    the largest score, then the longest name, then the first text and master row. Only names that contain each other, that are similar enough to reach
    ``floor``, or that a special rule names are paired; blank ones never are.
    """
    t = labels.select("seq", F.posexplode("texts").alias("text_no", "source_text")).withColumn("tn", simplified(F.col("source_text"))).where("tn <> ''")
    m = master.withColumn("mn", simplified(F.col("name"))).where("mn <> ''")
    # Of rows that differ in their number alone the first counts, so copies of a name never meet copies of a label.
    m = m.groupBy("mn", "name", "category").agg(F.min("master_seq").alias("master_seq"))
    with scratch():
        t, m = kept(materialize(t, "labels")), kept(materialize(m, "master"))
        names_t, names_m = t.select("tn").distinct(), m.select("mn").distinct()
        pairs = contained_pairs(names_t, "tn", names_m, "mn").unionByName(contained_pairs(names_m, "mn", names_t.where(F.length("tn") >= 2), "tn"))
        pairs = pairs.unionByName(similar_pairs(names_t, "tn", names_m, "mn", metric, max(floor, REVIEW) - HALF_UP))
        for name, pattern, _, _ in specials:
            pairs = pairs.unionByName(names_t.where(F.col("tn").rlike(pattern)).select("tn", F.lit(name).alias("mn")).join(names_m, "mn", "left_semi").select("tn", "mn"))
        scored = kept(scored_pairs(pairs.distinct(), "tn", "mn", lambda a, b: F.round(METRICS[metric](a, b), 3), "label_pairs"))
    met = t.join(scored, "tn").join(m, "mn")
    kind, score = F.lit(None).cast("string"), F.lit(None).cast("double")
    structural = F.col("category").isin(*STRUCTURAL)
    ladder = [
        (F.length("mn").between(3, 10**6) & (F.col("sim") >= 0.84), F.lit("fuzzy_name"), F.col("sim")),
        (structural & (F.col("sim") >= 0.72), F.lit("fuzzy_structural_name"), F.col("sim")),
        (structural & (F.length("tn") >= 2) & F.contains(F.col("mn"), F.col("tn")), F.lit("partial_structural_name"), F.lit(0.84)),
        ((F.length("mn") >= 3) & F.contains(F.col("tn"), F.col("mn")), F.lit("contains_standard_name"), F.lit(0.88)),
        *[((F.col("mn") == name) & F.col("tn").rlike(pattern), F.lit(label), F.lit(value)) for name, pattern, label, value in reversed(list(specials))],
        (F.col("tn") == F.col("mn"), F.lit("normalized_exact"), F.lit(1.0)),
    ]
    for test, label, value in ladder:
        kind, score = F.when(test, label).otherwise(kind), F.when(test, value).otherwise(score)
    met = met.withColumn("match_type", kind).withColumn("match_score", score)
    met = met.where((F.col("match_score") >= floor) | F.startswith(F.col("match_type"), F.lit("special")))
    order = Window.partitionBy("seq").orderBy(F.desc("match_score"), F.length("mn").desc(), "text_no", "master_seq")
    best = met.withColumn("_rn", F.row_number().over(order)).where("_rn = 1")
    return best.select("seq", "source_text", F.col("name").alias("matched_name"), F.col("category").alias("matched_category"), "match_type", "match_score")
