"""Lookups with defaults, precedence and fallbacks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapmill.functions.text import blank
from mapmill.operators.similar import contained_pairs

#: Rows up to which a counted side is broadcast.
BROADCAST_ROWS = 100_000
#: Parts up to which each name is tested for each of them.
CONTAINED_ROWS = 1_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a configuration table after counting one row more than is allowed; a larger one is left to shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def keep_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order (reverse the order for last-wins)."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def with_fallback(df: DataFrame, key: Column, rules: DataFrame, rule_key: str, fallback: str, columns: list[str]) -> DataFrame:
    """Left lookup by key; a row without a rule takes the columns of the rule whose key is ``fallback``."""
    r = rules.select(F.col(rule_key).alias("_k"), *[F.col(c).alias(f"_r_{c}") for c in columns])
    d = rules.where(F.col(rule_key) == fallback).limit(1).select(*[F.col(c).alias(f"_d_{c}") for c in columns], F.lit(1).alias("_one"))
    out = df.withColumn("_one", F.lit(1)).join(small(r), key == F.col("_k"), "left").join(F.broadcast(d), "_one", "left")
    picked = [F.when(F.col("_k").isNotNull(), F.col(f"_r_{c}")).otherwise(F.col(f"_d_{c}")).alias(c) for c in columns]
    return out.select(*[F.col(c) for c in df.columns if c not in columns], *picked)


def unmatched(df: DataFrame, key: str, rules: DataFrame, rule_key: str) -> DataFrame:
    """Rows whose key has no rule: an error report that callers check before they write."""
    return df.join(rules.select(F.col(rule_key).alias("_k")), F.col(key) == F.col("_k"), "left_anti")


def curated_first(full: DataFrame, curated: DataFrame, key: str, columns: list[str], flag: str = "in_curated") -> DataFrame:
    """Curated columns win wherever the curated row exists, even if they are blank; ``flag`` says whether it does."""
    c = curated.select(F.col(key).alias("_k"), *[F.col(x).alias(f"_c_{x}") for x in columns])
    out = full.join(c, F.col(key) == F.col("_k"), "left")
    pick = [F.when(F.col("_k").isNotNull(), F.col(f"_c_{x}")).otherwise(F.col(x)).alias(x) for x in columns]
    return out.select(*[F.col(x) for x in full.columns if x not in columns], *pick, F.col("_k").isNotNull().alias(flag))


def first_present(df: DataFrame, alternates: DataFrame, key: str, values: DataFrame, value_key: str, columns: list[str]) -> DataFrame:
    """For each key of ``df`` the value row of its first alternate name that has one.

    ``alternates``: (key, name, ordinal). Keys without any value have null columns.
    """
    v = values.select(F.col(value_key).alias("_v"), F.struct(*columns).alias("_row"))
    hits = alternates.join(v, F.col("name") == F.col("_v")).groupBy(F.col(key).alias("_k")).agg(F.min_by("_row", "ordinal").alias("_best"), F.min_by("name", "ordinal").alias("matched_name"))
    out = df.join(hits, F.col(key) == F.col("_k"), "left")
    return out.select(*df.columns, "matched_name", *[F.col("_best")[c].alias(c) for c in columns])


def trigger_alternates(df: DataFrame, key: str, name: Column, triggers: DataFrame) -> DataFrame:
    """(key, name, ordinal): the exact name first, then the alternates of every trigger token that the name contains.

    ``triggers``: (contains_token, alt_name, priority), a small table.
    """
    own = df.select(F.col(key), name.alias("name"), F.lit(0).alias("ordinal"))
    more = containing(df.select(F.col(key), name.alias("_n")), "_n", triggers, "contains_token")
    return own.unionByName(more.select(key, F.col("alt_name").alias("name"), F.col("priority").alias("ordinal")))


def containing(names: DataFrame, name: str, parts: DataFrame, part: str) -> DataFrame:
    """Rows of ``names`` with each row of ``parts`` whose (non-empty) text they contain.

    A few parts are broadcast and tested in turn; more of them are looked up by their rarest run among the distinct names.
    """
    parts = parts.where(F.length(part) > 0)
    if parts.limit(CONTAINED_ROWS + 1).count() <= CONTAINED_ROWS:
        return names.join(F.broadcast(parts), F.contains(F.col(name), F.col(part)))
    texts = names.select(F.col(name).alias("_text")).where(F.col("_text").isNotNull()).distinct()
    hits = contained_pairs(texts, "_text", parts.select(F.col(part).alias("_part")).distinct(), "_part")
    return names.join(hits, F.col(name) == F.col("_text")).join(parts, F.col("_part") == F.col(part)).drop("_text", "_part")


def copy_coordinates(df: DataFrame, key: str, aliases: DataFrame, columns: list[str], overwrite: bool, status: str, status_col: str = "coord_status") -> DataFrame:
    """Targets of ``aliases`` (target, source) take the source row's coordinates: always, or only if they have none."""
    src = keep_one(df.where(F.col(columns[0]).isNotNull()), [key], [F.col(c) for c in columns]).select(F.col(key).alias("_s"), *[F.col(c).alias(f"_s_{c}") for c in columns])
    a = aliases.join(src, F.col("source") == F.col("_s")).select(F.col("target").alias("_t"), *[f"_s_{c}" for c in columns])
    out = df.join(small(keep_one(a, ["_t"], [F.col(f"_s_{c}") for c in columns])), F.col(key) == F.col("_t"), "left")
    use = F.col("_t").isNotNull() & (F.lit(overwrite) | F.col(columns[0]).isNull())
    picked = [F.when(use, F.col(f"_s_{c}")).otherwise(F.col(c)).alias(c) for c in columns]
    return out.select(*[F.col(c) for c in df.columns if c not in [*columns, status_col]], *picked, F.when(use, status).otherwise(F.col(status_col)).alias(status_col))


def fill_centroid(df: DataFrame, key: str, names: list[str], sources: list[str], columns: list[str], status: str, status_col: str = "coord_status") -> DataFrame:
    """Listed names without coordinates take the mean of the source rows' coordinates, rounded to 7."""
    mean = df.where(F.col(key).isin(sources)).agg(*[F.round(F.avg(c), 7).alias(f"_m_{c}") for c in columns]).withColumn("_one", F.lit(1))
    out = df.withColumn("_one", F.lit(1)).join(F.broadcast(mean), "_one")
    use = F.col(key).isin(names) & F.col(columns[0]).isNull() & F.col(f"_m_{columns[0]}").isNotNull()
    picked = [F.when(use, F.col(f"_m_{c}")).otherwise(F.col(c)).alias(c) for c in columns]
    return out.select(*[F.col(c) for c in df.columns if c not in [*columns, status_col]], *picked, F.when(use, status).otherwise(F.col(status_col)).alias(status_col))


def poi_fallback(df: DataFrame, key: str, pois: DataFrame, tokens: list[str], columns: list[str], status: str, status_col: str = "coord_status") -> DataFrame:
    """Rows without coordinates take those of the first point of interest found under their name.

    ``pois``: (query_name, poi_order, district, address, and ``columns``). A point counts if its
    district or address, or the name asked for, contains one of the tokens.
    """
    near = reduce(lambda a, b: a | b, [F.contains(F.coalesce(F.col(c), F.lit("")), F.lit(t)) for t in tokens for c in ("district", "address", "query_name")])
    first = keep_one(pois.where(F.col(columns[0]).isNotNull() & near), ["query_name"], [F.col("poi_order")]).select(F.col("query_name").alias("_q"), *[F.col(c).alias(f"_p_{c}") for c in columns])
    out = df.join(first, F.col(key) == F.col("_q"), "left")
    use = F.col(columns[0]).isNull() & F.col("_q").isNotNull()
    picked = [F.when(use, F.col(f"_p_{c}")).otherwise(F.col(c)).alias(c) for c in columns]
    return out.select(*[F.col(c) for c in df.columns if c not in [*columns, status_col]], *picked, F.when(use, status).otherwise(F.col(status_col)).alias(status_col))


def overlay(base: DataFrame, key: str, layers: list[DataFrame], columns: list[str]) -> DataFrame:
    """Attributes of several layers on one key: for each column the last layer that has a non-blank value wins."""
    out = base
    for i, layer in enumerate(layers):
        present_cols = [c for c in columns if c in layer.columns]
        out = out.join(layer.select(F.col(key).alias(f"_k{i}"), *[F.col(c).alias(f"_{i}_{c}") for c in present_cols]), F.col(key) == F.col(f"_k{i}"), "left")
    pick = lambda c: F.coalesce(*[F.when(~blank(F.col(f"_{i}_{c}").cast("string")), F.col(f"_{i}_{c}")) for i in reversed(range(len(layers))) if c in layers[i].columns], *([F.col(c)] if c in base.columns else []))
    return out.select(*[F.col(c) for c in base.columns if c not in columns], *[pick(c).alias(c) for c in columns])


def seed_reduce(names: DataFrame, name: str, kind: str, seeds: DataFrame, compatible: DataFrame) -> DataFrame:
    """Replace each name by the longest compatible seed that it contains (of equals, the first seed).

    ``seeds``: (seed, seed_type, ordinal); ``compatible``: (seed_type, place_type), besides equal
    types. The containment join runs once on the distinct names.
    """
    distinct = names.select(F.col(name).alias("_n"), F.col(kind).alias("_t")).distinct()
    pairs = containing(distinct, "_n", seeds, "seed").where(F.col("seed") != F.col("_n"))
    ok = compatible.select(F.col("seed_type").alias("_st"), F.col("place_type").alias("_pt"))
    pairs = pairs.join(small(ok), (F.col("seed_type") == F.col("_st")) & (F.col("_t") == F.col("_pt")), "left").where((F.col("seed_type") == F.col("_t")) | F.col("_st").isNotNull())
    best = pairs.groupBy("_n", "_t").agg(F.max_by("seed", F.struct(F.length("seed"), -F.col("ordinal"))).alias("_best"))
    out = names.join(best, (F.col(name) == F.col("_n")) & (F.col(kind) == F.col("_t")), "left")
    return out.select(*[F.coalesce("_best", name).alias(c) if c == name else F.col(c) for c in names.columns])
