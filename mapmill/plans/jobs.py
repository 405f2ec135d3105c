"""User-level jobs: text to ranked places, boxes to a master table, places to layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapmill.functions import geo, years
from mapmill.functions import text as T
from mapmill.operators import georef, lookup, match, mentions, ranking, sample, upsert
from mapmill.sources import geojson
from mapmill.sources.versions import VersionedTable
from mapmill.storage import materialize


def extract_places(corpus: DataFrame, suffix_types: list[tuple[str, str]], seeds: DataFrame, compatible: DataFrame, clean: dict, valid: dict, head: str | None = None, radius: int = 48) -> DataFrame:
    """Place candidates of a corpus with type, frequency and first context.

    ``seeds``: (seed, seed_type, ordinal); ``clean`` and ``valid`` are the keyword arguments of the
    clean-up and of the validity test. Clean-up, typing and reduction run once a distinct raw string.
    """
    raw = mentions.suffix_candidates(corpus, [s for s, _ in suffix_types], *([head] if head else []))
    distinct = raw.groupBy("raw").agg(F.count(F.lit(1)).alias("n")).withColumn("name", T.clean_candidate(F.col("raw"), **clean))
    known = lookup.small(seeds.select(F.col("seed").alias("_s"), F.col("seed_type").alias("_st")))

    def typed(df: DataFrame) -> DataFrame:
        d = df.drop("place_type", "is_seed").join(known, F.col("name") == F.col("_s"), "left")
        return d.withColumn("place_type", F.coalesce("_st", T.type_by_suffix(F.col("name"), suffix_types))).withColumn("is_seed", F.col("_s").isNotNull()).drop("_s", "_st")

    reduced = typed(lookup.seed_reduce(typed(distinct), "name", "place_type", seeds, compatible))
    good = reduced.where(T.valid_name(F.col("name"), F.col("place_type"), seed=F.col("is_seed"), **valid))
    # One more pass over the texts finds the seeds that occur and the first context of every name.
    own = seeds.select(F.col("seed").alias("name"))
    names = materialize(good.select("name", "n", F.lit(False).alias("seed")).unionByName(own.select("name", F.lit(1).cast("long").alias("n"), F.lit(True).alias("seed"))), "names")
    first = mentions.contexts(mentions.mention_excerpts(corpus, names.select("name"), radius, 1), radius)
    first = materialize(first.select(F.col("name").alias("_n"), F.col("context").alias("first_context")), "first")
    held = names.join(first, F.col("name") == F.col("_n"), "left").where(~F.col("seed") | F.col("_n").isNotNull())
    counts = held.groupBy("name").agg(F.sum("n").alias("occurrence_count"), F.first("first_context").alias("first_context"))
    return typed(counts).drop("is_seed")


def curated(places: DataFrame, seed: Column, noise: list[str], local: list[str], caps: dict[str, int], least: int, name: str = "name", kind: str = "place_type", count: str = "occurrence_count") -> DataFrame:
    """The curated subset: seeds stay; noise goes; the rest needs a local word, its type's length, and a count."""
    has = lambda words: F.col(name).rlike("|".join("\\Q" + w + "\\E" for w in words)) if words else F.lit(False)
    fits = F.lit(True)
    for k, most in caps.items():
        fits &= ~((F.col(kind) == k) & (F.length(name) > most))
    return places.where(seed | (~has(noise) & has(local) & fits & (F.col(count) >= least)))


def temporal_places(corpus: DataFrame, places: DataFrame, checklist: DataFrame, checklist_columns: list[str], anchors: DataFrame | None = None, windows=years.TIME_WINDOWS) -> DataFrame:
    """Places with curated columns and the years of their sentences, from one pass over the corpus."""
    full = lookup.curated_first(places, checklist, "name", checklist_columns, "in_curated_checklist")
    time = mentions.temporal_context(mentions.sentences(mentions.mention_excerpts(corpus, places, 260, 80)), anchors, windows=windows)
    out = full.join(time.withColumnRenamed("name", "_n"), F.col("name") == F.col("_n"), "left").drop("_n")
    return out.withColumn("time_type", F.coalesce("time_type", F.lit(years.NO_TIME))).withColumn("year_count", F.coalesce("year_count", F.lit(0)))


def geocode_places(places: DataFrame, matches: DataFrame, aliases: DataFrame, anchors: DataFrame, centroid: tuple[list[str], list[str]], pois: DataFrame | None = None, tokens: list[str] = ()) -> DataFrame:
    """Coordinates of places: best match in GCJ-02, then aliases, anchors and centroid; then points of interest and the rules again.

    ``matches``: (name, match_score, lon, lat, seq); ``aliases`` and ``anchors``: (target, source).
    """
    best = ranking.best_per_key(matches.where(F.col("lon").isNotNull() & F.col("lat").isNotNull()), ["name"], F.col("match_score"), [F.col("seq")])
    g = geo.gcj02(F.col("lon"), F.col("lat"))
    best = materialize(best.select(F.col("name").alias("_n"), F.round(g["lon"], 7).alias("_lon"), F.round(g["lat"], 7).alias("_lat")), "geocode")

    def rules(df: DataFrame) -> DataFrame:
        met = df.join(best, F.col("name") == F.col("_n"), "left")
        use = F.col("_n").isNotNull()
        own = [F.when(use, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in ("lon", "lat")]
        out = met.select(*[F.col(c) for c in df.columns if c not in ("lon", "lat", "coord_status")], *own, F.when(use, "fallback_coord").otherwise(F.col("coord_status")).alias("coord_status"))
        out = lookup.copy_coordinates(out, "name", aliases, ["lon", "lat"], False, "derived_coord")
        out = lookup.copy_coordinates(out, "name", anchors, ["lon", "lat"], True, "local_anchor_coord")
        return lookup.fill_centroid(out, "name", centroid[0], centroid[1], ["lon", "lat"], "derived_coord")

    start = places.withColumn("lon", F.lit(None).cast("double")).withColumn("lat", F.lit(None).cast("double")).withColumn("coord_status", F.lit("missing"))
    out = materialize(rules(start), "geocoded")
    return out if pois is None else rules(lookup.poi_fallback(out, "name", pois, list(tokens), ["lon", "lat"], "poi_coord"))


def milestone_points(events: DataFrame, places: DataFrame, triggers: DataFrame, windows=years.TIME_WINDOWS) -> DataFrame:
    """Timeline events with the coordinates of their place or of a fallback, time window, and short texts."""
    alternates = lookup.trigger_alternates(events, "event_id", F.col("gazetteer_place"), triggers)
    located = places.where(F.col("lon").isNotNull())
    out = lookup.first_present(events, alternates, "event_id", located, "name", ["lon", "lat"])
    return out.withColumn("time_type", years.time_window(F.col("start_year"), windows)).withColumn("short_text", T.ellipsis(F.col("source_text"), 22))


def mention_statistics(corpus: DataFrame, places: DataFrame, keywords: DataFrame, type_labels: DataFrame, custom: DataFrame) -> DataFrame:
    """Ranked mention statistics of places, with raw counts, themes, level, quality label and reason.

    ``places``: (name, place_type, occurrence_count, lon, lat, coord_status, match_status,
    primary_year); ``type_labels``: (place_type, type_label); ``custom``: (name, custom_reason).
    """
    positions = materialize(mentions.mention_excerpts(corpus, places, 64, 12, rest=True), "positions")
    raw = positions.groupBy(F.col("name").alias("_r")).agg(F.sum("n").alias("raw_surface_count"))
    some = mentions.contexts(mentions.first_mentions(positions.where(F.col("excerpt").isNotNull()), 12), 64)
    themes = ranking.top_themes(mentions.theme_counts(some, keywords, "name"), "name", "theme", "n", "ordinal", 3).select(F.col("name").alias("_t"), "themes")
    out = places.join(raw, F.col("name") == F.col("_r"), "left").join(themes, F.col("name") == F.col("_t"), "left").join(lookup.small(type_labels), "place_type", "left").join(lookup.small(custom), "name", "left")
    ranked = ranking.global_rank(out.drop("_r", "_t"), [F.desc("occurrence_count"), F.asc("name")])
    lead = F.slice(F.coalesce("themes", F.array().cast("array<string>")), 1, 2)
    return ranked.withColumns({
        "raw_surface_count": F.coalesce("raw_surface_count", F.lit(0)), "mention_level": T.mention_level(F.col("occurrence_count")), "rank_label": mentions.rank_label(F.col("rank"), F.col("name"), F.col("occurrence_count")),
        "coordinate_quality": T.coordinate_quality(F.col("coord_status"), F.col("match_status"), F.col("lon"), F.col("lat")), "has_coord": F.col("lon").isNotNull() & F.col("lat").isNotNull(),
        "reason": T.reason(F.col("custom_reason"), F.coalesce("type_label", "place_type"), F.col("occurrence_count"), lead, F.col("primary_year")),
    }).drop("custom_reason", "type_label")


def mention_columns(ranked: DataFrame, segments: int = 28) -> DataFrame:
    """Columns of ranked places on the map: ring, height, radius, label point and label, in EPSG:3857."""
    m = geo.mercator(F.col("lon"), F.col("lat"))
    out = ranked.where(F.col("lon").isNotNull() & F.col("lat").isNotNull()).withColumn("x_3857", m["x"]).withColumn("y_3857", m["y"])
    out = out.withColumn("height_m", geo.column_height(F.col("occurrence_count"))).withColumn("radius_m", geo.column_radius(F.col("occurrence_count")))
    ring = geo.ellipse(F.col("x_3857"), F.col("y_3857"), F.col("radius_m"), F.col("radius_m"), F.lit(segments))
    return out.withColumn("ring", ring).withColumn("label_point", geo.label_point(F.col("x_3857"), F.col("y_3857"), F.col("rank"), F.col("height_m"))).withColumn("label", T.ellipsis(F.concat_ws(" ", "name", F.concat("occurrence_count", F.lit("次"))), 30))


def mention_labels(columns: DataFrame) -> DataFrame:
    """Label points beside the columns of ``mention_columns``, with offset, height and popup."""
    ordinal = F.coalesce(F.nullif(F.col("curated_rank"), F.lit(0)), F.col("rank"), F.lit(999)) if "curated_rank" in columns.columns else F.coalesce("rank", F.lit(999))
    detail = T.popup(F.col("rank_label"), [("提及次数", F.concat("occurrence_count", F.lit(" 次"))), ("柱高", F.concat("height_m", F.lit(" m"))), ("原因", T.ellipsis(F.col("reason"), 48))])
    out = columns.withColumn("label_offset_m", F.round(42 + F.least(ordinal, F.lit(20)) * 1.8, 2)).withColumn("label_z_m", F.round(F.col("height_m") + 12, 2))
    return out.withColumn("label_point", geo.label_point(F.col("x_3857"), F.col("y_3857"), ordinal, F.col("height_m"))).withColumn("label_detail", detail)


def camera_path(frames: DataFrame, duration_s: int = 20) -> DataFrame:
    """The line through the targets of the key frames in order, a row a vertex: no, the vertex before as prev_x and prev_y, and at_s, its time in the flight.

    ``frames`` come from ``keyframes``.
    """
    path = ranking.path_rows(frames, [], [F.col("keyframe")], "target_x_3857", "target_y_3857")
    last = F.greatest(F.lit(frames.count() - 1), F.lit(1))
    return path.withColumn("at_s", (F.col("no") - 1) * F.lit(float(duration_s)) / last)


def web_statistics(ranked: DataFrame, top: int = 50, missing: int = 30) -> dict[str, DataFrame]:
    """The statistics behind the map page: leading places, leading ones without coordinates, and totals in one row."""
    mapped = F.col("lon").isNotNull() & F.col("lat").isNotNull()
    first = F.min(F.when(mapped, F.struct("rank", "name", "occurrence_count")))
    total = ranked.agg(F.count_if(mapped).alias("mapped_columns"), F.count(F.lit(1)).alias("curated_places"), F.count_if(~mapped).alias("missing_count"), first.alias("_f"))
    total = total.select("mapped_columns", "curated_places", "missing_count", F.coalesce("_f.name", F.lit("")).alias("top_name"), F.coalesce("_f.occurrence_count", F.lit(0)).alias("top_count"))
    return {"top_stats": ranking.top(ranked, [F.col("rank")], top), "missing_top": ranking.top(ranked.where(~mapped), [F.col("rank")], missing), "summary": total}


def standardize(raw: DataFrame, rules: DataFrame, order: list[Column], prefix: str, constants: dict[str, str], name: str = "Name", category: str = "Category", fallback: str = "其他") -> DataFrame:
    """Raw places in the standard form: trimmed, numbered in source order, with constants and the columns of their category's rule.

    The rule is looked up by the category as it stands; a blank category is shown as the fallback's.
    """
    numbered = ranking.global_rank(raw, order, "_no")
    columns = [c for c in rules.columns if c != "category"]
    out = lookup.with_fallback(numbered, F.col(category), rules, "category", fallback, columns)
    kind = F.coalesce(T.present(F.trim(category)), F.lit(fallback))
    others = [c for c in raw.columns if c not in (name, category, *columns, *constants)]
    return out.select(F.format_string(f"{prefix}%03d", F.col("_no")).alias("place_id"), F.trim(F.coalesce(F.col(name), F.lit(""))).alias("name"), kind.alias("category"), *columns, *others, *[F.lit(v).alias(k) for k, v in constants.items()])


def checklist(places: DataFrame, manual: DataFrame, previous: DataFrame, rules: DataFrame, other: str = "*") -> DataFrame:
    """Places with match_status, visual_priority and check_action, ranked by priority, status, type and name.

    A manual row (name, the three) counts before the row of an earlier checklist, and that before the rule of the place's type; the rule
    ``other`` stands for types without one. Blank values of the earlier checklist are taken as review and medium.
    """
    three = ["match_status", "visual_priority", "check_action"]
    rows = lookup.with_fallback(places, F.col("place_type"), rules, "place_type", other, three)
    earlier = previous.select("name", F.coalesce("match_status", F.lit("review")).alias("match_status"), F.coalesce("visual_priority", F.lit("medium")).alias("visual_priority"), F.coalesce("check_action", F.lit("")).alias("check_action"))
    chosen = upsert.previous_choice(rows, "name", manual, earlier, three)
    return ranking.global_rank(chosen, ranking.checklist_order("visual_priority", "match_status", "place_type", "name"))


def scene_layers(points: DataFrame, styles: DataFrame, default_style: dict, milestones: DataFrame, heights: DataFrame, default_height: float = 78.0) -> dict[str, DataFrame]:
    """Layers of a scene: stage, place blocks and milestone columns, in degrees and in EPSG:3857 (the path through them is ``scene_path``).

    ``points``: (name, place_type, lon, lat); ``styles``: (place_type, scene_class, shape, width_m,
    depth_m, height_m); ``milestones``: (event_id, event_type, start_year, lon, lat, order_no);
    ``heights``: (event_type, base_height).
    """
    extent = points.agg(F.struct(F.min("lon").alias("x0"), F.min("lat").alias("y0"), F.max("lon").alias("x1"), F.max("lat").alias("y1")).alias("e"))
    stage = extent.select(geo.stage_ring(F.col("e")).alias("ring"))
    s = points.join(lookup.small(styles), "place_type", "left")
    for c, v in default_style.items():
        s = s.withColumn(c, F.coalesce(F.col(c), F.lit(v)))
    half = lambda sx, sy: geo.offset(F.col("lon"), F.col("lat"), sx * F.col("width_m") / 2, sy * F.col("depth_m") / 2)
    rect = F.array(half(-1, -1), half(1, -1), half(1, 1), half(-1, 1), half(-1, -1))
    blocks = s.withColumn("ring", F.when(F.col("shape") == "circle", geo.circle_lonlat(F.col("lon"), F.col("lat"), F.col("width_m") / 2, F.lit(36))).otherwise(rect))
    columns = milestones.join(lookup.small(heights), "event_type", "left").withColumn("height_m", F.coalesce("base_height", F.lit(default_height)) + 2 * F.col("order_no")).drop("base_height")
    columns = columns.withColumn("ring", geo.circle_lonlat(F.col("lon"), F.col("lat"), F.lit(24.0), F.lit(28)))
    flat = lambda df: df.withColumn("ring", geo.reproject_geometry(F.lit("Polygon"), F.array("ring"))[0])
    return {"stage": stage, "blocks": blocks, "columns": columns, "stage_3857": flat(stage), "blocks_3857": flat(blocks), "columns_3857": flat(columns)}


def scene_path(milestones: DataFrame) -> DataFrame:
    """The path through the milestones by year (missing last) and event, a row a vertex, in degrees and as x and y in EPSG:3857 with the vertex before."""
    m = geo.mercator(F.col("lon"), F.col("lat"))
    flat = milestones.withColumn("x", m["x"]).withColumn("y", m["y"])
    return ranking.path_rows(flat, [], [F.coalesce(F.col("start_year"), F.lit(ranking.NO_YEAR)), F.col("event_id")], "x", "y")


def keyframes(shots: DataFrame, alternates: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(frames, missing): each shot with its target's coordinates, the mean over its target groups.

    ``shots``: (keyframe, ...); ``alternates``: (keyframe, target_no, name, ordinal), where each
    target takes its first name that is present; frames with a target that has none are reported.
    """
    targets = alternates.select("keyframe", "target_no").distinct().withColumn("t", F.concat_ws("#", "keyframe", "target_no"))
    names = alternates.withColumn("t", F.concat_ws("#", "keyframe", "target_no")).select("t", "name", "ordinal")
    found = lookup.first_present(targets, names, "t", places, "name", ["lon", "lat"])
    mean = found.groupBy("keyframe").agg(F.avg("lon").alias("target_lon"), F.avg("lat").alias("target_lat"))
    m = geo.mercator(F.col("target_lon"), F.col("target_lat"))
    frames = shots.join(mean, "keyframe").withColumn("target_x_3857", m["x"]).withColumn("target_y_3857", m["y"])
    return frames, found.where(F.col("matched_name").isNull()).select("keyframe", "target_no")


def web_views(ranked: DataFrame, milestones: DataFrame, colours: DataFrame, points_top: int = 50, ranks_top: int = 30) -> dict[str, DataFrame]:
    """Tables behind the map page: points, columns, milestones and rankings."""
    coloured = ranked.join(lookup.small(colours), "mention_level", "left").withColumn("colour", F.coalesce("colour", F.lit("#888888")))
    top = ranking.top(coloured.where(F.col("lon").isNotNull()), [F.col("rank")], points_top)
    ring = geo.circle_lonlat(F.col("lon"), F.col("lat"), geo.column_radius(F.col("occurrence_count")), F.lit(48))
    order = T.safe_double(F.col("order"), 0.0)
    return {"points": top, "columns": top.withColumn("ring", ring).withColumn("height_m", geo.column_height(F.col("occurrence_count"))), "milestones": milestones.orderBy(order), "rankings": ranking.top(coloured, [F.col("rank")], ranks_top)}


def web_milestones(milestones: DataFrame) -> DataFrame:
    """The milestones of the map page numbered by their order, those without a number first."""
    order = T.safe_double(F.col("order"), 0.0)
    return ranking.global_rank(milestones.withColumn("_order", order), [F.col("_order"), F.col("event_id")], "no").drop("_order")


def fit_maps(points: DataFrame, weight: str | None = "weight") -> DataFrame:
    """Accepted or refused transforms of maps from their enabled control points."""
    return georef.fit_transforms(georef.enabled_points(points), ["map_id"], F.col(weight).try_cast("double") if weight else None)


def control_point_table(labels: DataFrame, master: DataFrame, specials=(), manual: DataFrame | None = None, metric: str = "ratio") -> DataFrame:
    """Control-point rows of matched labels, one a (label, master name), by falling score, with manual rows after them.

    ``labels``: (seq, ocr_id, texts, pixel_x, pixel_y); the flag is off until someone has checked a row.
    """
    best = match.match_labels(labels.select("seq", "texts"), master, specials, metric)
    rows = labels.join(best, "seq").withColumn("weight", F.when(F.col("match_score") >= 0.94, 1.0).otherwise(0.7)).withColumn("enabled", F.lit("false"))
    rows = ranking.first_n(rows, ["ocr_id", "matched_name"], [F.desc("match_score"), F.col("seq")], 1)
    ranked = ranking.global_rank(rows, [F.desc("match_score"), F.asc("matched_name"), F.asc("ocr_id")], "no")
    out = ranked.select(F.format_string("cp_%03d", F.col("no")).alias("control_id"), "enabled", "matched_name", "match_type", "match_score", "ocr_id", "source_text", "pixel_x", "pixel_y", "weight")
    return out if manual is None else upsert.append_in_order([out, manual.select(*out.columns)])


def priority_control_points(candidates: DataFrame, names: list[str], master: DataFrame, least: float = 0.76, quota: int = 35, manual: DataFrame | None = None) -> DataFrame:
    """Control-point rows of a quota selection: named candidates always, others of enough quality up to a quota, with the master's coordinates.

    ``candidates``: (seq, text, quality, bbox_pixel, ocr_id); ``master``: (name, x, y), of which the last row of a name (by x, y) counts.
    """
    chosen = ranking.quota_top(candidates, F.col("text").isin(names), F.coalesce("quality", F.lit(0.0)), least, quota, [F.col("seq")], [])
    m = lookup.keep_one(master.select(F.col("name").alias("_n"), F.col("x").alias("map_x"), F.col("y").alias("map_y")), ["_n"], [F.desc("map_x"), F.desc("map_y")])
    mid = geo.centre(F.col("bbox_pixel"))
    rows = chosen.join(m, F.col("text") == F.col("_n"), "left")
    ranked = ranking.global_rank(rows, [F.coalesce("quality", F.lit(0.0)).desc(), F.asc("seq")], "no")
    out = ranked.select(
        F.format_string("cp_%03d", F.col("no")).alias("control_id"), F.lit("false").alias("enabled"), F.col("text").alias("name"), F.format_string("%.3f", mid["x"]).alias("pixel_x"), F.format_string("%.3f", mid["y"]).alias("pixel_y"),
        "map_x", "map_y", F.when(F.col("_n").isNotNull(), "standard_place_exact_match").otherwise("").alias("osm_reference"),
    )
    return out if manual is None else upsert.append_in_order([out, manual.select(*out.columns)])


def standard_places(candidates: DataFrame, rules: DataFrame, transforms: DataFrame, version: str, limits: tuple[float, float] = (georef.RMSE_LIMIT, georef.POINT_LIMIT)) -> tuple[DataFrame, DataFrame]:
    """(places, problems): OCR candidates in the standard form.

    Ids are numbered before unnamed candidates are dropped, so they keep gaps. Candidates of a map
    whose transform fails the gate, or without coordinates, are problems.
    """
    gate = georef.import_gate(transforms, *limits).select(F.col("map_id").alias("_m"), F.col("coefficients").alias("_t"), "gate")
    c = candidates.join(gate, F.col("map_id") == F.col("_m"), "left").drop("_m")
    c = georef.candidate_xy(ranking.rank_by_key(c, ["map_id"], [F.col("seq")], "_no"), F.col("_t"))
    name = F.trim(F.coalesce(T.present(F.col("text")), T.present(F.col("name")), F.lit("")))
    c = c.withColumn("name", name).where("name <> ''").withColumn("problem", F.coalesce("gate", "problem"))
    kind = F.coalesce(T.present(F.col("category")), F.lit("其他"))
    columns = ["target_layer", "display_layer", "qgis_geometry", "semantic_geometry", "geometry_level"]
    r = lookup.with_fallback(c, kind, rules.withColumnRenamed("display_name", "display_layer"), "category", "其他", columns)
    own_id = F.coalesce(T.present(F.col("place_id")), F.concat(T.slug(F.col("map_id")), F.format_string("_%03d", F.col("_no"))))
    notes = T.compact_json(["bbox_pixel", "orientation", "notes"])
    out = r.select(
        own_id.alias("place_id"), "name", kind.alias("category"), *columns, F.col("out_x").alias("x"), F.col("out_y").alias("y"), F.coalesce(T.present(F.col("confidence")), F.lit("medium")).alias("confidence"), F.lit(version).alias("version"),
        F.coalesce(T.present(F.col("source_map")), F.col("map_id")).alias("source_map"), F.coalesce(T.present(F.col("source_stage")), F.lit("ocr")).alias("source_stage"), F.coalesce("reference_logic", F.lit("")).alias("reference_logic"), notes.alias("notes"), "problem",
    )
    return out.where(F.col("problem").isNull()).drop("problem"), out.where(F.col("problem").isNotNull()).select("place_id", "name", "problem")


def import_into(master: VersionedTable, places: DataFrame, map_id: str) -> int:
    """Put the master after an import in force as a new version, and return its number; StaleBase if someone else did so meanwhile."""
    base = master.current()
    return master.commit(import_map(master.read(base), places, map_id), base)


def import_map(master: DataFrame, places: DataFrame, map_id: str) -> DataFrame:
    """The master after an import: earlier rows of the map are replaced."""
    return upsert.merge_master(master, places, "place_id", map_id)


def route_layers(places: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(features, unmatched): places with the geometry of their layer's rule, and those whose layer has none."""
    r = rules.select(F.col("target_layer").alias("_l"), *[F.col(c).alias(f"_{c}") for c in ("qgis_geometry", "shape", "width_m", "height_m", "radius_m", "segments")])
    met = places.join(lookup.small(r), F.col("target_layer") == F.col("_l"))
    shape = geo.shape_geometry(F.col("_qgis_geometry"), F.col("_shape"), F.col("x"), F.col("y"), F.col("_width_m"), F.col("_height_m"), F.col("_radius_m"), F.col("_segments"))
    out = met.withColumn("_g", shape).select(*places.columns, "_g.geom_type", "_g.rings")
    return out, lookup.unmatched(places, "target_layer", rules, "target_layer")


def split_by_coordinates(places: DataFrame, curated_flag: str = "in_curated_checklist") -> dict[str, DataFrame]:
    """Mapped and missing places, in full and curated; the four filters share one scan if the caller keeps the frame."""
    there = F.col("lon").isNotNull() & F.col("lat").isNotNull()
    chosen = F.coalesce(F.col(curated_flag), F.lit(False))
    return {"mapped": places.where(there), "missing": places.where(~there), "mapped_curated": places.where(there & chosen), "missing_curated": places.where(~there & chosen)}


def time_filter(rows: DataFrame, time_type: str, every: str = "全部", column: str = "time_type") -> DataFrame:
    """Rows of one time window; the label for all means no filter."""
    return rows if time_type == every else rows.where(F.col(column) == time_type)


def layer_subset(rows: DataFrame, statuses: list[str] | None = None, most: int | None = None, time_type: str | None = None) -> DataFrame:
    """Rows of a map layer: of given match statuses, up to a rank, of a time window."""
    out = rows if statuses is None else rows.where(F.col("match_status").isin(statuses))
    out = out if most is None else out.where(F.col("rank") <= most)
    return out if time_type is None else out.where(F.col("time_type") == time_type)


def linked_selection(selected: DataFrame, points: DataFrame, columns: DataFrame, key: str = "name") -> DataFrame:
    """What a selection of names shows: its point and its column, each null where there is none."""
    p = points.select(F.col(key).alias("_p"), F.struct("lon", "lat").alias("point"))
    c = columns.select(F.col(key).alias("_c"), F.struct("height_m", "ring").alias("column"))
    return selected.join(p, F.col(key) == F.col("_p"), "left").join(c, F.col(key) == F.col("_c"), "left").drop("_p", "_c")


def review_payload(candidates: DataFrame, size: int, categories: list[str], forced: list[str], cols: int, rows: int, strategy: str) -> DataFrame:
    """(map_id, value): the sampled candidates of each map as one payload with the strategy that chose them."""
    chosen = sample.review_sample(candidates, size, categories, forced, cols, rows)
    entry = F.struct("sample_no", F.struct("place_id", "name", "category", "confidence", "x", "y").alias("c"))
    by = chosen.groupBy("map_id").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["c"]).alias("candidates"))
    return by.select("map_id", F.to_json(F.struct("map_id", F.lit(strategy).alias("sample_strategy"), F.size("candidates").alias("sample_size"), "candidates")).alias("value"))


def control_features(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(image, map) feature layers of control points; image features have y upwards, unplaced points are left out."""
    on = T.flag(F.col("enabled"), georef.ENABLED_WORDS)
    base = points.withColumn("enabled_bool", on)
    image = base.withColumn("lon", F.col("pixel_x").try_cast("double")).withColumn("lat", -F.col("pixel_y").try_cast("double")).withColumn("control_space", F.lit("image"))
    ground = base.withColumn("lon", F.col("map_x").try_cast("double")).withColumn("lat", F.col("map_y").try_cast("double")).withColumn("control_space", F.lit("map"))
    keep = [*points.columns, "enabled_bool", "control_space"]
    return geojson.points(image, keep), geojson.points(ground, keep)


def control_points_back(points: DataFrame, image: DataFrame, ground: DataFrame) -> DataFrame:
    """Control points with the coordinates and attributes that edited feature layers give them.

    ``image`` and ``ground`` are feature tables (see ``geojson``). Attributes of the map layer come
    before those of the image layer and of the table; image y is turned back.
    """
    at = F.col("rings")[0][0]
    own = lambda f, cols: f.select(F.col("properties")["control_id"].alias("control_id"), *[F.col("properties")[c].alias(c) for c in ("name", "enabled", "notes")], *cols)
    i = own(image, [at[0].cast("string").alias("pixel_x"), (-at[1]).cast("string").alias("pixel_y")])
    g = own(ground, [at[0].cast("string").alias("map_x"), at[1].cast("string").alias("map_y")])
    return lookup.overlay(points, "control_id", [i, g], ["name", "enabled", "notes", "pixel_x", "pixel_y", "map_x", "map_y"])


def image_space_boxes(candidates: DataFrame) -> DataFrame:
    """Candidates with ring, centre and size in image space (y upwards), and their quad as JSON."""
    b = F.col("bbox_pixel")
    mid = geo.centre(b)
    ok = candidates.where(F.size("bbox_pixel") == 4)
    return ok.withColumns({"ring": geo.image_ring(b), "center_x": mid["x"], "center_y": -mid["y"], "width_px": b[2] - b[0], "height_px": b[3] - b[1], "quad_json": F.to_json("quad_pixel")})


def register_maps(catalog: DataFrame, maps: DataFrame) -> DataFrame:
    """The catalogue after maps were registered: rows of the same id are replaced."""
    return upsert.upsert(catalog, maps, ["map_id"])


