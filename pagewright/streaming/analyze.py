"""The analysis on streams of pages: a row per page with an array of its detections, so that no state is kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.taxonomy import type_of
from ..operators import dedupe, order
from ..schema import AnalysisOptions


def analyze_pages(pages: DataFrame, labels: list[str], width: Column, height: Column, options: AnalysisOptions | None = None) -> DataFrame:
    """Adds ``strategy``, ``dets`` (kept ones, by score) and ``ranks`` (their reading order) to each page.

    ``dets`` is an array of structs pos, class_id, score, order_hint, x1, y1, x2, y2; ``pos`` breaks ties. All
    work is within the row, so the frame may be a stream in any output mode that takes plain rows.
    """
    options = options or AnalysisOptions()
    names = F.array(*(F.lit(x) for x in labels))
    name = lambda k: F.coalesce(F.when(k < len(labels), F.try_element_at(names, k + 1)), F.concat(F.lit("class_"), k.cast("string")))
    strong = F.filter("dets", lambda x: ~F.isnan(x["score"]) & (x["score"] >= F.lit(options.confidence_threshold).cast("float")) & (x["class_id"] >= 0))
    typed = F.transform(strong, lambda x: F.struct((-x["score"]).alias("neg"), x["pos"].alias("pos"), x["score"].alias("score"), *(x[c].alias(c) for c in ("x1", "y1", "x2", "y2", "class_id")), name(x["class_id"]).alias("raw_name"), type_of(name(x["class_id"])).alias("type"), x["order_hint"].alias("order_hint")))
    out = pages.withColumn("dets", F.sort_array(typed))
    out = out.withColumn("dets", dedupe.deduplicated(F.col("dets"), options.duplicate_iou_threshold))
    out = out.withColumn("dets", dedupe.cleaned(F.col("dets"), width, height, options.min_figure_area_fraction, options.suppress_nested_duplicates))
    out = out.withColumn("strategy", order.order_strategy(F.col("dets"), options.reading_order_source))
    tolerance = F.lit(float(options.reading_order_overlap_tolerance)) * F.greatest(width, height)
    return out.withColumn("ranks", order.reading_ranks(F.col("dets"), F.col("strategy"), tolerance, options.pin_page_furniture))
