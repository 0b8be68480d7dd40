"""The analysis pipeline: detections in, typed blocks in reading order out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.taxonomy import with_types
from ..operators import dedupe, order
from ..schema import AnalysisOptions


def kept_pages(detections: DataFrame, classes: DataFrame, options: AnalysisOptions, *, page: list[str], position: list[str], width: Column, height: Column) -> DataFrame:
    """One row per page: ``dets`` above the threshold, typed, without duplicates and nested regions, by score.

    The score filter and the broadcast lookup come before the only shuffle, which is on the page.
    """
    strong = detections.filter(~F.isnan("score") & (F.col("score") >= F.lit(options.confidence_threshold).cast("float")) & (F.col("class_id") >= 0))
    typed = with_types(strong, classes)
    pages = dedupe.page_arrays(typed, page, position, ["class_id", "raw_name", "type", "order_hint"])
    pages = pages.withColumn("dets", dedupe.deduplicated(F.col("dets"), options.duplicate_iou_threshold))
    return pages.withColumn("dets", dedupe.cleaned(F.col("dets"), width, height, options.min_figure_area_fraction, options.suppress_nested_duplicates))


def analyze(detections: DataFrame, classes: DataFrame, options: AnalysisOptions | None = None, *, page: list[str], position: list[str], width: Column, height: Column) -> DataFrame:
    """Blocks of all pages: page columns, ``strategy``, position columns, type, names, score, box and ``reading_order``.

    ``width`` and ``height`` are literals or page columns. Whether the model's order is used is decided on a
    page's kept regions; bands of page furniture are then ordered each on its own.
    """
    options = options or AnalysisOptions()
    pages = kept_pages(detections, classes, options, page=page, position=position, width=width, height=height)
    pages = pages.withColumn("strategy", order.order_strategy(F.col("dets"), options.reading_order_source))
    tolerance = F.lit(float(options.reading_order_overlap_tolerance)) * F.greatest(width, height)
    pages = pages.withColumn("ranks", order.reading_ranks(F.col("dets"), F.col("strategy"), tolerance, options.pin_page_furniture))
    rows = pages.select(*page, "strategy", F.explode(F.arrays_zip("dets", "ranks")).alias("_b"))
    return rows.select(*page, "strategy", *(F.col(f"_b.dets.pos.{c}").alias(c) for c in position), *(F.col(f"_b.dets.{c}").alias(c) for c in ("class_id", "raw_name", "type", "score", "x1", "y1", "x2", "y2")), F.col("_b.ranks").alias("reading_order"))


def blocks_of(blocks: DataFrame) -> Column:
    """A block struct (``schema.BLOCK``) from the columns of ``analyze``; text, LaTeX and table are taken if there."""
    have = set(blocks.columns)
    text = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    from ..schema import TABLE

    table = F.col("table") if "table" in have else F.lit(None).cast(TABLE)
    box = F.struct(F.col("x1").alias("min_x"), F.col("y1").alias("min_y"), F.col("x2").alias("max_x"), F.col("y2").alias("max_y"))
    return F.struct(
        "type", box.alias("box"), F.col("score").alias("confidence"), "reading_order", F.col("class_id").alias("raw_class_id"), F.col("raw_name").alias("raw_class_name"), text("text").alias("text"), text("latex").alias("latex"), table.alias("table")
    )


def documents(blocks: DataFrame, pages: DataFrame, document: str, page: str) -> DataFrame:
    """``document``, ``pages``: the page structs (``schema.PAGE``) of each document in order; pages without blocks stay.

    ``pages`` has the document and page columns, width, height, rotation, skew_angle, source_width and
    source_height; ``page`` holds the page number.
    """
    own = blocks.withColumn("_block", F.struct(F.col("reading_order"), blocks_of(blocks).alias("block"))).groupBy(document, page).agg(F.sort_array(F.collect_list("_block")).alias("_blocks"))
    joined = pages.join(own, [document, page], "left")
    blocks_column = F.transform(F.coalesce("_blocks", F.array().cast(own.schema["_blocks"].dataType)), lambda x: x["block"])
    item = F.struct(F.col(page).cast("int").alias("page_number"), "width", "height", "rotation", "skew_angle", "source_width", "source_height", blocks_column.alias("blocks"))
    return joined.groupBy(document).agg(F.array_sort(F.collect_list(item)).alias("pages"))
