"""Suppression of duplicate and nested regions, on one row per page with an array of its detections.

The array form is made by one shuffle on the page and then serves suppression and ordering without
another. Pages hold tens of regions; suppression is quadratic in them by nature and linear in pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Box

#: An earlier region that holds so much of a later one of its type makes it nested.
CONTAINED = 0.9


def as_float(value: float) -> Column:
    """A threshold as the 32-bit float that it is compared as, widened."""
    return F.lit(value).cast("float").cast("double")


def page_arrays(detections: DataFrame, page: list[str], position: list[str], carry: list[str]) -> DataFrame:
    """One row per page: ``dets``, sorted by score downwards, ties by position.

    The position columns must tell a page's detections apart, so that the order is the same every time.
    """
    item = F.struct((-F.col("score")).alias("neg"), F.struct(*position).alias("pos"), "score", "x1", "y1", "x2", "y2", *carry)
    return detections.groupBy(*page).agg(F.sort_array(F.collect_list(item)).alias("dets"))


def _fold(items: Column, drops) -> Column:
    """Items that no earlier kept item drops, in order."""
    none = F.filter(items, lambda x: F.lit(False))
    return F.aggregate(items, none, lambda kept, x: F.when(F.exists(kept, lambda k: drops(k, x)), kept).otherwise(F.concat(kept, F.array(x))))


def deduplicated(dets: Column, iou: float) -> Column:
    """Without regions that overlap a kept one of higher score by more than ``iou``, whatever their types."""
    return _fold(dets, lambda k, x: Box.of(k).iou(Box.of(x)) > as_float(iou))


def cleaned(dets: Column, width: Column, height: Column, figure_fraction: float, nested: bool = True) -> Column:
    """Without tiny figures and, if ``nested``, without regions mostly inside an earlier kept one of their type."""
    least = F.lit(float(figure_fraction)) * width * height
    big = F.filter(dets, lambda x: (x["type"] != "Figure") | (Box.of(x).area >= least))
    if not nested:
        return big
    return _fold(big, lambda k, x: (k["type"] == x["type"]) & (Box.of(x).area > 0) & (Box.of(x).intersection(Box.of(k)) / Box.of(x).area >= F.lit(CONTAINED)))


def overlapping_pairs(detections: DataFrame, page: list[str], key: list[str], carry: list[str] = ()) -> DataFrame:
    """Pairs of regions of a page that intersect: keys with suffix _a and _b, ``shared`` area, ``iou``, ``area_a``, ``area_b``.

    An equi-join on the page with the overlap as residual: the work is per page, not over all pairs.
    """
    columns = [*key, "x1", "y1", "x2", "y2", *carry]
    a = detections.select(*page, *(F.col(c).alias(f"{c}_a") for c in columns))
    b = detections.select(*page, *(F.col(c).alias(f"{c}_b") for c in columns))
    box = lambda s: Box(*(F.col(f"{c}_{s}") for c in ("x1", "y1", "x2", "y2")))
    before = F.struct(*(F.col(f"{c}_a") for c in key)) < F.struct(*(F.col(f"{c}_b") for c in key))
    pairs = a.join(b, page).filter(before & (box("a").intersection(box("b")) > 0))
    return pairs.withColumns({"shared": box("a").intersection(box("b")), "iou": box("a").iou(box("b")), "area_a": box("a").area, "area_b": box("b").area})
