"""Reading order: recursive XY-cut, the model's own order, and page furniture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType


def _gaps(spans: list[tuple[float, float, int]], tolerance: float) -> tuple[list[list[int]], float]:
    """Groups of indices between gaps along one axis, and the widest gap; a gap may be an overlap under ``tolerance``."""
    spans = sorted(spans)
    groups, reach, widest = [[spans[0][2]]], spans[0][1], float("-inf")
    for start, end, index in spans[1:]:
        gap = start - reach
        if gap > -tolerance:
            widest = max(widest, gap)
            groups.append([index])
        else:
            groups[-1].append(index)
        reach = max(reach, end)
    return groups, widest


def xy_cut(boxes: list[tuple[float, float, float, float]], tolerance: float = 0.0) -> list[int]:
    """Indices of the boxes (x1, y1, x2, y2) in reading order.

    A region is cut into columns if its widest vertical gap is at least as wide as its widest horizontal
    one. Else its topmost band is read, and the rest is looked at afresh, so that columns below a heading
    come together. What has no gap is read from top to bottom, then left to right. Work is kept on a
    stack: a tall column needs as many steps as it has bands.
    """
    out: list[int] = []
    todo = [list(range(len(boxes)))]
    while todo:
        part = todo.pop()
        if len(part) < 2:
            out += part
            continue
        columns, across = _gaps([(boxes[i][0], boxes[i][2], i) for i in part], tolerance)
        bands, down = _gaps([(boxes[i][1], boxes[i][3], i) for i in part], tolerance)
        if len(columns) > 1 and (len(bands) == 1 or across >= down):
            todo += [sorted(c) for c in reversed(columns)]
        elif len(bands) > 1:
            top = set(bands[0])
            todo += [[i for i in part if i not in top], sorted(top)]
        else:
            out += sorted(part, key=lambda i: (boxes[i][1], boxes[i][0], i))
    return out


def banded_ranks(boxes: list[list[float]], bands: list[int], hints: list[int] | None, tolerance: float) -> list[int]:
    """Reading rank of each box: bands one after the other, within a band by hint if there are hints, else by XY-cut."""
    order: list[int] = []
    for band in sorted(set(bands)):
        own = [i for i, b in enumerate(bands) if b == band]
        if hints is None:
            order += [own[k] for k in xy_cut([tuple(boxes[i]) for i in own], tolerance)]
        else:
            order += sorted(own, key=lambda i: hints[i])
    ranks = [0] * len(order)
    for rank, i in enumerate(order):
        ranks[i] = rank
    return ranks


def _ranks(boxes, bands, hints, tolerance):
    return banded_ranks(boxes, bands, hints, tolerance)


def reading_ranks(dets: Column, strategy: Column, tolerance: Column, pin: bool = True) -> Column:
    """Rank of each detection of a page array; one call per page, as cutting is recursive."""
    ranks = F.udf(_ranks, ArrayType(IntegerType()), useArrow=True).asNondeterministic()
    boxes = F.transform(dets, lambda x: F.array(x["x1"], x["y1"], x["x2"], x["y2"]))
    bands = F.transform(dets, lambda x: band_of(x["type"]) if pin else F.lit(0))
    hints = F.when(strategy == "model", F.transform(dets, lambda x: x["order_hint"]))
    return ranks(boxes, bands, hints, tolerance)


def band_of(kind: Column) -> Column:
    """0 for headers, 1 for the body, 2 for footers and page numbers."""
    return F.when(kind == "PageHeader", 0).when(kind.isin("PageFooter", "PageNumber"), 2).otherwise(1)


def order_strategy(dets: Column, source: str = "auto") -> Column:
    """model if every kept detection of the page (and there is one) has a hint and the source allows it, else xycut."""
    if source == "xycut":
        return F.lit("xycut")
    hinted = (F.size(dets) > 0) & F.forall(dets, lambda x: x["order_hint"] >= 0)
    return F.when(hinted, "model").otherwise("xycut")


def axis_cuts(boxes: DataFrame, page: list[str], key: list[str], start: str, end: str, tolerance: float) -> DataFrame:
    """Adds ``gap`` (to what stands before on the axis), ``is_cut`` and ``segment`` to each box, by window functions alone."""
    along = Window.partitionBy(*page).orderBy(start, end, *key)
    reach = F.max(end).over(along.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.col(start) - reach
    cut = F.coalesce(gap > -tolerance, F.lit(False))
    return boxes.withColumn("gap", gap).withColumn("is_cut", cut).withColumn("segment", F.sum(F.col("is_cut").cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0)))


def ranked_by_hint(blocks: DataFrame, page: list[str], key: list[str]) -> DataFrame:
    """Adds ``reading_order`` by band, hint and key, by a window alone."""
    return blocks.withColumn("reading_order", F.row_number().over(Window.partitionBy(*page).orderBy(band_of(F.col("type")), "order_hint", *key)) - 1)
