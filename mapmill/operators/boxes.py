"""Overlapping boxes: candidates from detections, exact greedy de-duplication, and snapping."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapmill.functions import geo, text
from mapmill.operators.components import components
from mapmill.operators.ranking import first_n, global_rank, rank_by_key, top
from mapmill.storage import materialize, release

IOU = 0.48
MIN_CONFIDENCE = 0.48
#: Alternative texts of a kept box that are listed.
SHOWN = 8
#: Rounds of the greedy set before components are looked at, and edges of a component that one task decides at most.
ROUNDS, ONE_TASK = 3, 50_000
#: Boxes of the first batch of the greedy set.
BATCH = 20_000


def ocr_candidates(detections: DataFrame, least: float = MIN_CONFIDENCE) -> DataFrame:
    """Kept detections with cleaned text, quad and box in image pixels, quality, orientation and category.

    ``detections``: (map_id, seq, raw_text, raw_confidence, points, tile_x, tile_y, scale, width,
    height, pass_name). Kept are texts with a CJK character that have two of them or a place term,
    of enough confidence, with a box of 3 pixels a side and an area between 20 and 8 % of the image.
    """
    d = detections.withColumn("clean", text.without_punctuation(F.coalesce(F.col("raw_text"), F.lit("")))).withColumn("_r", text.reading_order(F.col("clean")))
    d = d.withColumn("text", F.col("_r.text")).withColumn("reading_rule", F.col("_r.rule")).withColumn("confidence", F.coalesce(F.col("raw_confidence").try_cast("double"), F.lit(0.0)))
    d = d.withColumn("cjk", text.cjk_count(F.col("text"))).where((F.col("clean") != "") & (F.col("confidence") >= least) & (F.col("cjk") >= 1) & ((F.col("cjk") >= 2) | text.has_term(F.col("text"))))
    quad = geo.tile_to_image(F.col("points"), F.col("tile_x"), F.col("tile_y"), F.col("scale"), F.col("width"), F.col("height"))
    d = d.withColumn("quad_pixel", quad).withColumn("bbox_pixel", geo.box_of(F.col("quad_pixel")))
    b, size = F.col("bbox_pixel"), geo.area(F.col("bbox_pixel"))
    d = d.where((size >= 20) & (size <= F.col("width") * F.col("height") * 0.08) & (b[2] - b[0] >= 3) & (b[3] - b[1] >= 3))
    return d.withColumns({
        "quality": geo.ocr_quality(F.col("confidence"), text.has_term(F.col("text")) | text.has_term(F.col("clean")), F.col("cjk"), F.col("pass_name") == "tile"),
        "orientation": geo.quad_orientation(F.col("quad_pixel")), "category": text.ocr_category(F.col("text")),
    }).drop("_r")


def same_place(a: Column, b: Column, alike: Column, threshold: float = IOU) -> Column:
    """Whether two boxes stand for one label: overlap, overlap of alike texts, or near centres of like sizes."""
    over = geo.iou(a, b)
    reach = F.greatest(F.lit(8.0), F.sqrt(F.greatest(geo.area(a), geo.area(b))) * 0.18)
    close = lambda i, j: F.abs((a[j] - a[i]) - (b[j] - b[i])) <= F.greatest(F.lit(12.0), F.greatest(a[j] - a[i], b[j] - b[i]) * 0.45)
    near = (F.greatest(geo.area(a), geo.area(b)) > 0) & (geo.centre_distance(a, b) < reach) & close(0, 2) & close(1, 3)
    return (over >= threshold) | ((over > 0.25) & alike) | near


def _placed(boxes: DataFrame, unit: float) -> DataFrame:
    """The boxes with their edges as columns and the grid cell of their centre (size, cx, cy); a coordinate that is missing or not finite has no place.

    ``size`` n holds the boxes of a longer side below ``unit`` * 2 ** (n + 2), and its cells have sides of ``unit`` * 2 ** n.
    """
    b = F.col("bbox")
    finite = lambda v: F.when(F.abs(v) < float("inf"), v)
    out = boxes.select("map_id", "seq", "quality", text.has_term(F.col("text")).alias("term"), *[finite(b[i].cast("double")).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))])
    out = out.withColumn("side", F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(2.0 * unit)))
    out = out.withColumn("size", _size(F.col("side"), unit))
    edge = unit * F.pow(F.lit(2.0), F.col("size"))
    return out.withColumns({"cx": F.floor((F.col("x0") + F.col("x1")) / 2 / edge), "cy": F.floor((F.col("y0") + F.col("y1")) / 2 / edge)})


def _size(side: Column, unit: float) -> Column:
    return F.greatest(F.floor(F.log2(side / (2 * unit))), F.lit(0)).cast("int")


def _pairs(probing: DataFrame, met: DataFrame, threshold: float, unit: float, within: bool) -> DataFrame:
    """(map_id, a, b, qa): pairs at one place of a box of ``probing`` and one of ``met`` (both ``_placed``), a being the better one.

    ``within``: both tables are the same one, and every pair is found once, from its box of the larger size. Else only pairs are given whose
    better box is of ``probing``. A box looks where centres of boxes of each size can lie that overlap it enough, or are near it.
    """
    # What overlaps by a share of t has sides of t to 1 / t times the own ones, and centres at most (w + v) / 2 - t * max(w, v) apart; what is near is of like sides.
    t, wider = min(threshold, 0.25), 1 + 1e-9
    sizes = F.sequence(_size(F.col("side") * t / wider, unit), F.col("size") if within else _size(F.col("side") / t * wider, unit))
    l = probing.withColumn("at", F.explode(sizes)).withColumn("edge", unit * F.pow(F.lit(2.0), F.col("at")))
    other = 4 * F.col("edge")
    reach = F.greatest(F.lit(8.0), 0.18 * F.greatest(F.col("side"), other))

    def cells(lo: str, hi: str) -> Column:
        own = F.greatest(F.col(hi) - F.col(lo), F.lit(0.0))
        most = F.least(other, own / t)
        away = F.greatest((own + most) / 2 - t * F.greatest(own, most), reach) * wider + 1e-6
        mid = (F.col(lo) + F.col(hi)) / 2
        return F.sequence(F.floor((mid - away) / F.col("edge")), F.floor((mid + away) / F.col("edge")))

    l = l.withColumn("px", F.explode(cells("x0", "x1"))).withColumn("py", F.explode(cells("y0", "y1"))).alias("l")
    r = met.alias("r")
    better = lambda i, j: (F.col(f"{i}.quality") > F.col(f"{j}.quality")) | ((F.col(f"{i}.quality") == F.col(f"{j}.quality")) & (F.col(f"{i}.seq") < F.col(f"{j}.seq")))
    box = lambda i: [F.col(f"{i}.{c}") for c in ("x0", "y0", "x1", "y1")]
    first = better("l", "r")
    ordered = first | ((F.col("l.size") > F.col("r.size")) & better("r", "l")) if within else first
    # Alike are equal texts, or texts that both have a term or both have none: the second holds wherever the first does.
    on = [F.col("l.map_id") == F.col("r.map_id"), F.col("l.at") == F.col("r.size"), F.col("l.px") == F.col("r.cx"), F.col("l.py") == F.col("r.cy"), ordered, same_place(box("l"), box("r"), F.col("l.term") == F.col("r.term"), threshold)]
    one = lambda c, other: F.when(first, F.col(f"l.{c}")).otherwise(F.col(f"r.{c}")) if other else F.when(first, F.col(f"r.{c}")).otherwise(F.col(f"l.{c}"))
    return l.join(r, on).select(F.col("l.map_id").alias("map_id"), one("seq", True).alias("a"), one("seq", False).alias("b"), one("quality", True).alias("qa"))


def _unit(cell: float, threshold: float) -> float:
    if threshold <= 0:
        raise ValueError("the overlap that makes one place must be above 0")
    return max(cell / 4, 8.0)


def box_edges(boxes: DataFrame, cell: float = 64.0, threshold: float = IOU) -> DataFrame:
    """(map_id, a, b): pairs of sequence numbers of boxes at one place, a being the better one.

    Each box lies in one grid cell, that of its centre, on the grid of its size, and the larger box of a pair
    looks into the cells where the other's centre can be: cells of a quarter of ``cell`` for sides up to ``cell``, twice as
    large for each doubling. The better of two boxes is the one of higher quality, then the lower number.
    """
    unit = _unit(cell, threshold)
    placed = _placed(boxes, unit)
    return _pairs(placed, placed, threshold, unit, True)


def _greedy(links: pd.DataFrame) -> pd.DataFrame:
    """The kept nodes of whole components of ``links`` (map_id, a, b), each from a better node to a worse one."""
    worse: dict = {}
    waits: dict = {}
    for m, x, y in zip(links["map_id"], links["a"], links["b"], strict=True):
        worse.setdefault((m, x), []).append((m, y))
        waits[m, y] = waits.get((m, y), 0) + 1
    ready, lost, kept = [n for n in worse if n not in waits], set(), []
    while ready:
        node = ready.pop()
        if node not in lost:
            kept.append(node)
        for other in worse.get(node, ()):
            if node not in lost:
                lost.add(other)
            waits[other] -= 1
            if not waits[other]:
                ready.append(other)
    return pd.DataFrame(kept, columns=["map_id", "seq"])


def independent_set(nodes: DataFrame, edges: DataFrame, report: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, attached) of the greedy set: a node is kept unless a better kept neighbour was found before it.

    ``nodes``: (map_id, seq); ``edges``: (map_id, a, b, qa) from better to worse. In each round
    every open node without an open better neighbour is kept, and its open neighbours are dropped;
    that gives the sequential result. After a few rounds the edges that are left fall into connected components: each one of at most
    ONE_TASK edges is decided by itself in a task, however long its chains are, and only larger ones go on in
    rounds. A dropped node attaches to its best kept better neighbour. ``report`` takes the number of rounds and of components decided in tasks.
    """
    edges = materialize(edges, "edges")
    key = ["map_id", "seq"]
    kept, open_edges, open_nodes = None, edges, materialize(nodes.select(*key), "open")
    rounds, alone = 0, 0
    while True:  # each round decides the best open node at least
        beaten = open_edges.select("map_id", F.col("b").alias("seq")).distinct()
        now = materialize(open_nodes.join(beaten, key, "left_anti"), "now")
        if now.isEmpty():
            break
        rounds += 1
        kept = now if kept is None else kept.unionByName(now)
        lost = open_edges.join(now.withColumnRenamed("seq", "a"), ["map_id", "a"]).select("map_id", F.col("b").alias("seq")).distinct()
        rest = materialize(open_nodes.join(now, key, "left_anti").join(lost, key, "left_anti"), "open")
        open_edges = materialize(open_edges.join(rest.withColumnRenamed("seq", "a"), ["map_id", "a"], "left_semi").join(rest.withColumnRenamed("seq", "b"), ["map_id", "b"], "left_semi").select("map_id", "a", "b", "qa"), "open_edges")
        release(open_nodes)
        open_nodes = rest
        if rounds == ROUNDS and not open_edges.isEmpty():
            whole, large, alone = _component_edges(open_edges)
            types = dict(nodes.select(*key).dtypes)
            done = materialize(whole.groupBy("component").applyInPandas(lambda g: _greedy(g), f"map_id {types['map_id']}, seq {types['seq']}"), "greedy")
            kept = kept.unionByName(done)
            decided = whole.select("map_id", F.col("a").alias("seq")).union(whole.select("map_id", "b")).distinct()
            open_nodes, open_edges = materialize(open_nodes.join(decided, key, "left_anti"), "open"), materialize(large, "open_edges")
    if report is not None:
        report |= {"rounds": rounds, "components": alone}
    kept = nodes.select(*key).limit(0) if kept is None else kept
    to = edges.join(kept.withColumnRenamed("seq", "a"), ["map_id", "a"]).groupBy("map_id", F.col("b").alias("seq")).agg(F.max_by("a", F.struct("qa", -F.col("a"))).alias("kept_seq"))
    return kept, to


def _component_edges(edges: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """The edges of small components with their ``component``, those of large ones, and how many small components there are."""
    node = lambda c: F.struct("map_id", F.col(c).alias("seq"))
    of = components(edges.select(node("a").alias("a"), node("b").alias("b"))).select(F.col("node").alias("_n"), "component")
    placed = materialize(edges.join(of, node("a") == F.col("_n")).drop("_n"), "component_edges")
    sizes = materialize(placed.groupBy(F.col("component").alias("_c")).agg(F.count(F.lit(1)).alias("_size")), "component_sizes")
    met = placed.join(sizes, F.col("component") == F.col("_c"))
    small = met.where(F.col("_size") <= ONE_TASK).drop("_c", "_size")
    return small, met.where(F.col("_size") > ONE_TASK).select(*edges.columns), sizes.where(F.col("_size") <= ONE_TASK).count()


def _greedy_batches(boxes: DataFrame, threshold: float, cell: float, report: dict | None) -> tuple[DataFrame, DataFrame]:
    """(kept, to) as of ``independent_set`` over all pairs of ``boxes`` at one place, of which only few are ever made.

    Boxes are taken in their order, BATCH of the best ones first and then twice as many each time. In each batch, pairs are made only of boxes that no
    kept box has dropped yet, and what is kept there then meets all boxes that are left. The best kept box that drops a box is in the first batch
    that drops it, since later ones are worse.
    """
    unit = _unit(cell, threshold)
    order = [F.desc("quality"), F.col("seq")]
    left = materialize(global_rank(boxes.select("map_id", "seq", "text", "quality", "bbox"), order, "_rank"), "ranked")
    rest, key = left.count(), ["map_id", "seq"]
    some: list[DataFrame] = []
    to: list[DataFrame] = []
    totals: dict = {"rounds": 0, "components": 0}
    low, high = 0, BATCH
    while True:
        last = high - low >= rest
        batch = left if last else left.where(F.col("_rank") <= high)
        one: dict = {}
        kept, _ = independent_set(batch, box_edges(batch, cell, threshold), one)
        totals = {k: v + one[k] for k, v in totals.items()}
        kept = materialize(kept, "kept")
        some.append(kept)
        best = _placed(batch.join(kept, key, "left_semi"), unit)
        pairs = _pairs(best, _placed(left, unit), threshold, unit, False)
        to.append(materialize(pairs.groupBy("map_id", F.col("b").alias("seq")).agg(F.max_by("a", F.struct("qa", -F.col("a"))).alias("kept_seq")), "to"))
        if last:
            break
        after = materialize(left.where(F.col("_rank") > high).join(to[-1], key, "left_anti"), "ranked")
        release(left)
        left, rest = after, after.count()
        low, high = high, 3 * high
        if not rest:
            break
    release(left)
    if report is not None:
        report |= totals
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    return union(some), union(to)


def dedupe_boxes(boxes: DataFrame, threshold: float = IOU, cell: float = 64.0, report: dict | None = None) -> DataFrame:
    """Kept boxes of each map in reading order, numbered by quality, with their alternatives.

    ``boxes``: (map_id, seq, text, quality, bbox). Adds ocr_no, alternative_texts (up to eight other
    texts by quality) and alternative_count. ``report``: see ``independent_set``.
    """
    kept, to = _greedy_batches(boxes, threshold, cell, report)
    lost = to.join(boxes.select("map_id", "seq", "text", "quality"), ["map_id", "seq"])
    count = lost.groupBy("map_id", F.col("kept_seq").alias("seq")).agg(F.count(F.lit(1)).alias("alternative_count"))
    # Of each text the best box, and of those as many as are shown (and one that may be the kept box's own text).
    some = lost.groupBy("map_id", F.col("kept_seq").alias("seq"), F.col("text").alias("t")).agg(F.min(F.struct((-F.col("quality")).alias("q"), F.col("seq").alias("s"))).alias("o"))
    some = first_n(some, ["map_id", "seq"], [F.col("o")], SHOWN + 1).groupBy("map_id", "seq").agg(F.array_sort(F.collect_list(F.struct("o", "t"))).alias("alts"))
    out = boxes.join(kept, ["map_id", "seq"]).join(count, ["map_id", "seq"], "left").join(some, ["map_id", "seq"], "left")
    texts = F.filter(F.transform("alts", lambda x: x["t"]), lambda t: t != F.col("text"))
    out = rank_by_key(out, ["map_id"], [F.desc("quality"), F.col("seq")], "ocr_no").withColumn("ocr_no", F.col("ocr_no").cast("int"))
    out = out.withColumn("alternative_texts", F.coalesce(F.array_join(F.slice(texts, 1, SHOWN), " | "), F.lit("")))
    return out.withColumn("alternative_count", F.coalesce("alternative_count", F.lit(0)).cast("long")).drop("alts").orderBy("map_id", F.col("bbox")[1], F.col("bbox")[0], "seq")


def reading_rank(boxes: DataFrame, name: str = "reading_no") -> DataFrame:
    """Boxes numbered in reading order: by map, upper edge, left edge and sequence number."""
    return global_rank(boxes, [F.col("map_id"), F.col("bbox")[1], F.col("bbox")[0], F.col("seq")], name)


def to_label(boxes: DataFrame, n: int = 180) -> DataFrame:
    """The ``n`` boxes of the largest quality, or confidence where that is missing or 0."""
    return top(boxes, [F.coalesce(F.nullif(F.col("quality"), F.lit(0.0)), F.col("confidence"), F.lit(0.0)).desc(), F.col("map_id"), F.col("seq")], n)


def snap_dedupe(boxes: DataFrame, x: Column, y: Column, step: int = 12, label: str = "text", order: str = "seq") -> DataFrame:
    """The first box of each (text, centre on a grid of ``step`` pixels, rounded half to even)."""
    snap = lambda v: (F.bround(v / step) * step).cast("long")
    return first_n(boxes.withColumn("snap_x", snap(x)).withColumn("snap_y", snap(y)), [label, "snap_x", "snap_y"], [F.col(order)], 1)


def tile_plan(images: DataFrame, tile: int = 1600, overlap: int = 240, width: str = "width", height: str = "height") -> DataFrame:
    """One row a tile (x0, y0, x1, y1) of each image; the last tile of a side is flush with its end."""
    out = images.withColumn("y0", F.explode(geo.tile_starts(F.col(height), tile, overlap))).withColumn("x0", F.explode(geo.tile_starts(F.col(width), tile, overlap)))
    return out.withColumn("x1", F.least(F.col(width), F.col("x0") + tile)).withColumn("y1", F.least(F.col(height), F.col("y0") + tile))
