"""Affine georeferencing: control points, weighted fit, residuals, acceptance and projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapmill.functions import geo
from mapmill.functions.text import blank

# Words that enable a control point.
ENABLED_WORDS = ("1", "true", "yes", "y", "enabled", "是", "启用")
RMSE_LIMIT, POINT_LIMIT = 60.0, 120.0
#: Share of the product of the variances below which points count as lying on a line.
SINGULAR = 1e-12


def enabled_points(points: DataFrame, columns=("pixel_x", "pixel_y", "map_x", "map_y"), flag: str = "enabled") -> DataFrame:
    """Control points that are enabled (a blank flag is) and whose four numbers parse, as doubles."""
    on = blank(F.col(flag)) | F.lower(F.trim(flag)).isin(*ENABLED_WORDS)
    nums = {c: F.col(c).try_cast("double") for c in columns}
    ok = on
    for n in nums.values():
        ok &= n.isNotNull()
    return points.where(ok).withColumns(nums)


def usable_pairs(points: DataFrame, pixel: str = "pixel", target: str = "map") -> DataFrame:
    """Control points given as two-number arrays, with pixel_x, pixel_y, map_x and map_y."""
    num = lambda c, i: F.get(F.col(c), F.lit(i)).try_cast("double")
    out = points.where((F.size(pixel) == 2) & (F.size(target) == 2)).withColumns({"pixel_x": num(pixel, 0), "pixel_y": num(pixel, 1), "map_x": num(target, 0), "map_y": num(target, 1)})
    return out.where("pixel_x is not null and pixel_y is not null and map_x is not null and map_y is not null")


def fit_affine(points: DataFrame, keys: list[str], weight: Column | None = None) -> DataFrame:
    """(keys, n, coefficients, problem): weighted least squares of each key, by two rounds of sums.

    The first round gives the weighted means and the second the centred sums, so large map
    coordinates lose no digits; both are map-side combined. A weight of 0 or null counts as 1.
    Fewer than three points, or points on a line, give a problem and no coefficients.
    """
    w = F.lit(1.0) if weight is None else F.when(F.coalesce(weight, F.lit(0.0)) == 0, 1.0).otherwise(weight)
    p = points.withColumn("_w", w)
    mean = lambda c: (F.sum(F.col("_w") * F.col(c)) / F.sum("_w"))
    means = p.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[mean(c).alias(f"_m_{c}") for c in ("pixel_x", "pixel_y", "map_x", "map_y")])
    d = p.join(means.withColumnsRenamed({k: f"_k_{k}" for k in keys}), [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    dev = {c: F.col(c) - F.col(f"_m_{c}") for c in ("pixel_x", "pixel_y", "map_x", "map_y")}
    s = lambda a, b: F.sum(F.col("_w") * dev[a] * dev[b])
    sums = d.groupBy(*keys).agg(
        F.first("n").alias("n"), *[F.first(f"_m_{c}").alias(f"_m_{c}") for c in dev], s("pixel_x", "pixel_x").alias("xx"), s("pixel_x", "pixel_y").alias("xy"), s("pixel_y", "pixel_y").alias("yy"),
        s("pixel_x", "map_x").alias("xu"), s("pixel_y", "map_x").alias("yu"), s("pixel_x", "map_y").alias("xv"), s("pixel_y", "map_y").alias("yv"),
    )
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    slope = lambda a, b, c, e: F.try_divide(F.col(a) * F.col(b) - F.col(c) * F.col(e), det)
    b1, c1 = slope("xu", "yy", "yu", "xy"), slope("yu", "xx", "xu", "xy")
    b2, c2 = slope("xv", "yy", "yv", "xy"), slope("yv", "xx", "xv", "xy")
    origin = lambda m, b, c: F.col(m) - b * F.col("_m_pixel_x") - c * F.col("_m_pixel_y")
    coefficients = F.struct(origin("_m_map_x", b1, c1).alias("x_origin"), b1.alias("pixel_width"), c1.alias("x_rotation"), origin("_m_map_y", b2, c2).alias("y_origin"), b2.alias("y_rotation"), c2.alias("pixel_height"))
    problem = F.when(F.col("n") < 3, "at least 3 enabled control points are required").when(F.coalesce(det, F.lit(0.0)) <= SINGULAR * F.col("xx") * F.col("yy"), "control points lie on a line")
    return sums.select(*keys, "n", problem.alias("problem"), F.when(problem.isNull(), coefficients).alias("coefficients"))


def residuals(points: DataFrame, fits: DataFrame, keys: list[str]) -> DataFrame:
    """Control points with dx_m, dy_m and error_m under their key's fit, rounded to 3."""
    f = fits.where(F.col("coefficients").isNotNull()).select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("coefficients").alias("_t"))
    met = points.join(f, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]).withColumn("_p", geo.affine(F.col("pixel_x"), F.col("pixel_y"), F.col("_t")))
    dx, dy = F.col("_p.x") - F.col("map_x"), F.col("_p.y") - F.col("map_y")
    return met.select(*points.columns, F.round(dx, 3).alias("dx_m"), F.round(dy, 3).alias("dy_m"), F.round(F.hypot(dx, dy), 3).alias("error_m"))


def accuracy(rows: DataFrame, keys: list[str], detail: list[str] | None = None) -> DataFrame:
    """Root mean square, mean and largest of the rounded errors of each key; ``detail`` columns as an array."""
    e = F.col("error_m")
    more = [F.array_sort(F.collect_list(F.struct(*detail))).alias("residuals")] if detail else []
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("control_point_count"), F.round(F.sqrt(F.avg(e * e)), 3).alias("rmse_m"), F.round(F.avg(e), 3).alias("mean_error_m"), F.max(e).alias("max_error_m"), *more)


def fit_transforms(points: DataFrame, keys: list[str], weight: Column | None = None, rmse: float = RMSE_LIMIT, point: float = POINT_LIMIT) -> DataFrame:
    """Fit, residual figures and acceptance of each key; a key that could not be fitted is not accepted."""
    fits = fit_affine(points, keys, weight)
    acc = accuracy(residuals(points, fits, keys), keys).withColumnsRenamed({k: f"_a_{k}" for k in keys})
    out = fits.join(acc, [F.col(k).eqNullSafe(F.col(f"_a_{k}")) for k in keys], "left").drop(*[f"_a_{k}" for k in keys])
    return out.withColumn("accepted", F.coalesce((F.col("rmse_m") <= rmse) & (F.col("max_error_m") <= point), F.lit(False)))


def import_gate(transforms: DataFrame, rmse: float = RMSE_LIMIT, point: float = POINT_LIMIT, allow_unsafe: bool = False) -> DataFrame:
    """Transforms with ``gate`` (null to pass): a missing one passes, one without accuracy fails, then count, rmse and largest error.

    Columns: status, control_point_count, rmse_m, max_error_m.
    """
    why = (
        F.when(F.lit(allow_unsafe) | (F.col("status") == "missing"), F.lit(None)).when(F.col("status") == "loaded_without_accuracy", "no accuracy report")
        .when((F.col("control_point_count") > 0) & (F.col("control_point_count") < 3), "fewer than 3 control points").when(F.col("rmse_m") > rmse, "rmse above limit").when(F.col("max_error_m") > point, "point error above limit")
    )
    return transforms.withColumn("gate", why)


def projection_gate(transforms: DataFrame) -> DataFrame:
    """Transforms that may project: all but those marked as not accepted."""
    return transforms.where(F.coalesce(F.col("accepted"), F.lit(True)))


def enough_points(points: DataFrame, keys: list[str], least: int = 3, words=("1", "true", "yes", "y", "enabled")) -> DataFrame:
    """(keys, enabled_count, ready): whether a key has enough points whose flag says so (a blank one does not)."""
    on = F.lower(F.trim(F.coalesce(F.col("enabled"), F.lit("")))).isin(*words)
    return points.groupBy(*keys).agg(F.count_if(on).alias("enabled_count")).withColumn("ready", F.col("enabled_count") >= least)


def candidate_xy(candidates: DataFrame, t: Column) -> DataFrame:
    """Candidates with map coordinates: x/y, else map_x/map_y, else the box centre through the transform; ``problem`` if none."""
    ok = F.size("bbox_pixel") == 4
    mid = geo.centre(F.col("bbox_pixel"))
    through = F.when(ok & t.isNotNull(), geo.affine(mid["x"], mid["y"], t))
    own, mapped = F.col("x").isNotNull() & F.col("y").isNotNull(), F.col("map_x").isNotNull() & F.col("map_y").isNotNull()
    pick = lambda a, b, c: F.when(own, F.col(a)).when(mapped, F.col(b)).otherwise(through[c])
    out = candidates.withColumn("out_x", pick("x", "map_x", "x")).withColumn("out_y", pick("y", "map_y", "y"))
    return out.withColumn("problem", F.when(F.col("out_x").isNull() | F.col("out_y").isNull(), "needs x/y, map_x/map_y, or a box and a transform"))


def project_boxes(candidates: DataFrame, transforms: DataFrame, key: str) -> DataFrame:
    """Candidates with the closed ring of their quad (or box) on the map and its centre point, rounded to 3."""
    t = projection_gate(transforms).where(F.col("coefficients").isNotNull()).select(F.col(key).alias("_k"), F.col("coefficients").alias("_t"))
    met = candidates.join(t, F.col(key) == F.col("_k"))
    b = F.col("bbox_pixel")
    quad = F.when(F.size("quad_pixel") >= 3, F.col("quad_pixel")).otherwise(F.array(F.array(b[0], b[1]), F.array(b[2], b[1]), F.array(b[2], b[3]), F.array(b[0], b[3])))
    mid = geo.centre(b)
    xy = geo.affine(mid["x"], mid["y"], F.col("_t"))
    return met.select(*candidates.columns, geo.projected_ring(quad, F.col("_t")).alias("ring"), F.round(xy["x"], 3).alias("center_x"), F.round(xy["y"], 3).alias("center_y"))
