"""Boxes and detections: masks, anchors, overlaps and what covers what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cells import box_axes, meeting

DILATION, THRESHOLD, MAX_IOU, SCREEN_MARGIN = 3, 0.5, 0.3, 100


def mask_boxes(regions: DataFrame, images: DataFrame, dilation: int = DILATION) -> DataFrame:
    """``image_id, x0, y0, x1, y1`` in whole pixels: scaled, grown, cut to the image, empty ones dropped."""
    met = regions.join(images.select("image_id", "factor", "width", "height"), "image_id")
    low = lambda p: F.greatest(F.lit(0), F.floor(F.col(p) * F.col("factor") - dilation)).cast("long")
    high = lambda p, size, most: F.least(F.col(most), F.ceil((F.col(p) + F.col(size)) * F.col("factor") + dilation)).cast("long")
    out = met.select("image_id", low("x").alias("x0"), low("y").alias("y0"), high("x", "w", "width").alias("x1"), high("y", "h", "height").alias("y1"))
    return out.where((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))


def capture_scale(images: DataFrame, most_width: int = 1280) -> DataFrame:
    """Adds ``scale`` (1 unless the capture is wider than allowed) and ``factor`` from page to capture pixels."""
    scale = F.when(F.col("width") > most_width, F.lit(most_width) / F.col("width")).otherwise(F.lit(1.0))
    return images.withColumns({"scale": scale, "factor": F.col("dpr") * scale})


def decode_anchors(det: DataFrame, images: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``image_id, stride, i, x, y, w, h, score`` of anchors above the threshold, in image pixels.

    ``det(image_id, stride, i, cls, obj, bbox)`` holds cell-relative centre offsets and log
    sizes; ``images(image_id, columns, ratio)`` the input's side in pixels and its shrinking.
    """
    unit = lambda c: F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(1.0))
    rows = det.withColumn("score", F.sqrt(unit("cls") * unit("obj"))).where(F.col("score") >= threshold)
    rows = rows.join(images.select("image_id", "columns", "ratio"), "image_id")
    across = F.ceil(F.col("columns") / F.col("stride"))
    cell = {"_cx": F.col("i") % across, "_cy": F.floor(F.col("i") / across)}
    side = lambda k: F.exp(F.get("bbox", k)) * F.col("stride")
    centre = lambda k, c: (F.get("bbox", k) + F.col(c)) * F.col("stride")
    back = lambda v: v / F.col("ratio")
    return rows.withColumns(cell).select("image_id", "stride", "i", back(centre(0, "_cx") - side(2) / 2).alias("x"), back(centre(1, "_cy") - side(3) / 2).alias("y"), back(side(2)).alias("w"), back(side(3)).alias("h"), "score")


def nms(boxes: DataFrame, iou: float = MAX_IOU) -> DataFrame:
    """Per image the boxes of best score, without those that overlap a kept one by more than ``iou``.

    Boxes of equal score go in the order of ``x, y`` and, if there, ``box_id``. One walk over
    each image's boxes, best first, against those kept so far.
    """
    order = [(-F.col("score")).alias("_best"), *[F.col(c).alias(f"_{c}") for c in ("x", "y", "box_id") if c in boxes.columns]]
    own = F.struct(*[c for c in boxes.columns if c != "image_id"])
    best = boxes.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct(*order, own.alias("box")))).alias("_all"))
    kept_type = boxes.drop("image_id").schema.simpleString()

    def overlaps(a: Column, b: Column) -> Column:
        side = lambda p, size: F.greatest(F.lit(0.0), F.least(a[p] + a[size], b[p] + b[size]) - F.greatest(a[p], b[p]))
        both = side("x", "w") * side("y", "h")
        union = a["w"] * a["h"] + b["w"] * b["h"] - both
        return (union > 0) & (both > iou * union)

    step = lambda kept, x: F.when(F.exists(kept, lambda k: overlaps(k, x["box"])), kept).otherwise(F.concat(kept, F.array(x["box"])))
    left = best.select("image_id", F.explode(F.aggregate("_all", F.array().cast(f"array<{kept_type}>"), step)).alias("_b"))
    return left.select(*[F.col(c) if c == "image_id" else F.col(f"_b.{c}").alias(c) for c in boxes.columns])


def overlap_area(a: str = "", b: str = "b_") -> Column:
    span = lambda p, size: F.greatest(F.lit(0.0), F.least(F.col(f"{a}{p}") + F.col(f"{a}{size}"), F.col(f"{b}{p}") + F.col(f"{b}{size}")) - F.greatest(F.col(f"{a}{p}"), F.col(f"{b}{p}")))
    return span("x", "w") * span("y", "h")


def box_iou(a: DataFrame, b: DataFrame, on: list[str], below: str | None = None, apart: bool = True) -> DataFrame:
    """Pairs of boxes of one image with ``iou``; columns of ``b`` get the prefix ``b_``.

    ``below`` names a column by which only pairs in ascending order are made, each once;
    ``apart=False`` makes overlapping pairs only, by cells; the pairs of a large image are then as many as
    its overlaps, else the square of its boxes.
    """
    if apart:
        other = b.select(*on, *[F.col(c).alias(f"b_{c}") for c in b.columns if c not in on])
        pairs = a.join(other.hint("merge"), on)
    else:
        crossing = lambda p, size: (F.col(p) < F.col(f"b_{p}") + F.col(f"b_{size}")) & (F.col(f"b_{p}") < F.col(p) + F.col(size))
        pairs = meeting(a, b, on, box_axes(), box_axes()).where(crossing("x", "w") & crossing("y", "h"))
    if below is not None:
        pairs = pairs.where(F.col(below) < F.col(f"b_{below}"))
    union = F.col("w") * F.col("h") + F.col("b_w") * F.col("b_h") - overlap_area()
    return pairs.withColumn("iou", F.when(union > 0, overlap_area() / union).otherwise(F.lit(0.0)))


def box_contained_fraction(pairs: DataFrame) -> DataFrame:
    """Pairs with ``fraction``: how much of the ``b_`` box lies in the other."""
    area = F.col("b_w") * F.col("b_h")
    return pairs.withColumn("fraction", F.when(area > 0, overlap_area() / area).otherwise(F.lit(0.0)))


def onscreen_regions(regions: DataFrame, width: float, height: float, margin: float = SCREEN_MARGIN) -> DataFrame:
    """Non-empty boxes within ``margin`` of the viewport."""
    near = lambda p, size, most: (F.col(p) + F.col(size) >= -margin) & (F.col(p) <= most + margin)
    return regions.where((F.col("w") > 0) & (F.col("h") > 0) & near("x", "w", width) & near("y", "h", height))


def occlusion(candidates: DataFrame, bounds: DataFrame, width: float, height: float) -> DataFrame:
    """Keeps a candidate whose centre is covered topmost by itself or a descendant; off-screen centres are kept.

    ``candidates(page_id, node_id, last, x, y, w, h)``, ``last`` being the last node of its subtree;
    ``bounds(page_id, node_id, x, y, w, h, paint_order)``. A centre meets the boxes of the cells
    that it lies in, not all of its page.
    """
    at = candidates.select("page_id", "node_id", "last", (F.col("x") + F.col("w") / 2).alias("_cx"), (F.col("y") + F.col("h") / 2).alias("_cy"))
    on_screen = at.where(F.col("_cx").between(0, width) & F.col("_cy").between(0, height))
    point = [(F.col("_cx"), F.col("_cx")), (F.col("_cy"), F.col("_cy"))]
    hit = meeting(on_screen, bounds.select("page_id", "node_id", "x", "y", "w", "h", "paint_order"), ["page_id"], point, box_axes())
    top = hit.groupBy("page_id", "node_id", "last").agg(F.max_by("b_node_id", F.struct("b_paint_order", "b_node_id")).alias("top"))
    hidden = top.where(~F.col("top").between(F.col("node_id"), F.col("last")))
    return candidates.join(hidden.select("page_id", "node_id").hint("merge"), ["page_id", "node_id"], "left_anti")


def union_regions(**regions: DataFrame) -> DataFrame:
    """All regions as one bag, with ``source`` named by the argument (dom, regex, vision)."""
    out = None
    for source, df in regions.items():
        part = df.withColumn("source", F.lit(source))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def redaction_manifest(regions: DataFrame, by: str = "page_id", order: tuple[str, ...] = ("y", "x", "source", "kind")) -> DataFrame:
    """``regions`` numbered ``r1, r2, ...`` per page; a value column would not be carried."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return regions.drop("value", "text").withColumn("id", F.concat(F.lit("r"), n.cast("string")))


def masked_receipt(regions: DataFrame, pages: DataFrame) -> DataFrame:
    """``page_id, masked, summary`` for every page."""
    counts = regions.groupBy("page_id").agg(F.count("*").alias("masked"))
    out = pages.select("page_id").join(counts, "page_id", "left").withColumn("masked", F.coalesce("masked", F.lit(0)))
    words = F.when(F.col("masked") == 0, F.lit("nothing to withhold")).when(F.col("masked") == 1, F.lit("1 region withheld")).otherwise(F.concat(F.col("masked").cast("string"), F.lit(" regions withheld")))
    return out.withColumn("summary", words)

