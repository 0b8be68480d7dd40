"""All registered queries of the layout engine and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import taxonomy
from ..functions.text import normalize_latex
from ..operators import correction, decode, dedupe, export, guards, inference, order, recognize, tables, tensors
from ..schema import AnalysisOptions
from ..sources import derived, images
from ..sources.derived import DET_KEY, PAGE_HEIGHT, PAGE_WIDTH, view
from . import analyze as plan
from . import oracles, service

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = oracles.ORACLE_SQL
_PAGE = {"page": ["page_id"], "position": DET_KEY}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def _size() -> dict:
    return {"width": G.d(PAGE_WIDTH), "height": G.d(PAGE_HEIGHT)}


def _heron(spark: SparkSession) -> DataFrame:
    return taxonomy.vocabulary(spark, taxonomy.VOCABULARIES["heron"])


def _strong(spark: SparkSession, sf_dir: str) -> DataFrame:
    dets = derived.detections(spark, sf_dir)
    return taxonomy.with_types(dets.filter(~F.isnan("score") & (F.col("score") >= F.lit(0.5).cast("float"))), _heron(spark))


def _kept(spark: SparkSession, sf_dir: str, options: AnalysisOptions | None = None) -> DataFrame:
    return plan.kept_pages(derived.detections(spark, sf_dir), _heron(spark), options or AnalysisOptions(), **_PAGE, **_size())


def _flat(pages: DataFrame, *extra: str) -> DataFrame:
    rows = pages.select("page_id", *extra, F.posexplode("dets").alias("rank", "_d"))
    return rows.select("page_id", *extra, "rank", *(F.col(f"_d.pos.{c}").alias(c) for c in DET_KEY), *(F.col(f"_d.{c}").alias(c) for c in ("class_id", "raw_name", "type", "score", "order_hint", "x1", "y1", "x2", "y2")))


@query
def dets_filtered(spark, sf_dir):
    return _strong(spark, sf_dir).select("page_id", *DET_KEY, "class_id", "raw_name", "type", "score", "order_hint", "x1", "y1", "x2", "y2")


@query
def type_counts(spark, sf_dir):
    """Kept blocks by type (no clean-up), most frequent first."""
    strong = dedupe.page_arrays(_strong(spark, sf_dir), ["page_id"], DET_KEY, ["type"])
    kept = strong.select(F.explode(dedupe.deduplicated(F.col("dets"), 0.6)).alias("d"))
    return kept.groupBy(F.col("d.type").alias("type")).agg(F.count("*").alias("n_blocks")).orderBy(F.desc("n_blocks"), "type")


@query
def box_geometry(spark, sf_dir):
    b = G.Box.named()
    return derived.detections(spark, sf_dir).select("page_id", *DET_KEY, b.width.alias("width"), b.height.alias("height"), b.area.alias("area"), b.center_x.alias("center_x"), b.center_y.alias("center_y"), b.is_empty.alias("is_empty"))


@query
def pixel_rect(spark, sf_dir):
    """Boxes on a page of half the size, so that half pixels occur."""
    half = G.Box(*(F.col(c) / G.d(2) for c in ("x1", "y1", "x2", "y2")))
    rect = half.pixel_rect(F.lit(380), F.lit(498))
    return derived.detections(spark, sf_dir).select("page_id", *DET_KEY, *(c.alias(n) for c, n in zip(rect, ("px", "py", "pw", "ph"), strict=True)))


@query
def box_iou_pairs(spark, sf_dir):
    pairs = dedupe.overlapping_pairs(_strong(spark, sf_dir), ["page_id"], DET_KEY)
    return pairs.filter(F.col("iou") > dedupe.as_float(0.6)).select("page_id", *(f"{k}_{s}" for s in "ab" for k in DET_KEY), "shared", F.round("iou", 9).alias("iou"))


@query
def containment_pairs(spark, sf_dir):
    pairs = dedupe.overlapping_pairs(_strong(spark, sf_dir), ["page_id"], DET_KEY, ["type"])
    inside = (F.col("type_a") == F.col("type_b")) & (F.col("area_b") > 0) & (F.col("shared") / F.col("area_b") >= F.lit(dedupe.CONTAINED))
    return pairs.filter(inside).select("page_id", *(f"{k}_{s}" for s in "ab" for k in DET_KEY), F.col("type_a").alias("type"))


@query
def dedupe_blocks(spark, sf_dir):
    strong = dedupe.page_arrays(_strong(spark, sf_dir), ["page_id"], DET_KEY, ["class_id", "raw_name", "type", "order_hint"])
    return _flat(strong.withColumn("dets", dedupe.deduplicated(F.col("dets"), 0.6))).select("page_id", *DET_KEY, "rank", "type", "score")


@query
def dedupe_cleanup(spark, sf_dir):
    return _flat(_kept(spark, sf_dir, AnalysisOptions(min_figure_area_fraction=0.005))).select("page_id", *DET_KEY, "rank", "type", "score")


@query
def order_choice(spark, sf_dir):
    return _kept(spark, sf_dir).select("page_id", order.order_strategy(F.col("dets")).alias("strategy"), F.size("dets").alias("n_blocks"))


@query
def model_order(spark, sf_dir):
    """Pages whose blocks all have hints, ordered by band and hint by a window."""
    pages = _kept(spark, sf_dir).filter(order.order_strategy(F.col("dets")) == "model")
    return order.ranked_by_hint(_flat(pages), ["page_id"], ["rank"]).select("page_id", *DET_KEY, "type", "order_hint", "reading_order")


@query
def furniture_pin(spark, sf_dir):
    """First and last place of each band of furniture in the final order."""
    blocks = plan.analyze(derived.detections(spark, sf_dir), _heron(spark), **_PAGE, **_size())
    return blocks.withColumn("band", order.band_of(F.col("type"))).groupBy("page_id", "band").agg(F.min("reading_order").alias("first"), F.max("reading_order").alias("last"), F.count("*").alias("n"))


@query
def xycut_splits(spark, sf_dir):
    """Cuts of each page's kept blocks along the vertical axis."""
    rows = order.axis_cuts(_flat(_kept(spark, sf_dir)), ["page_id"], ["rank"], "y1", "y2", 5.0)
    return rows.select("page_id", *DET_KEY, "gap", "is_cut", F.col("segment").cast("int").alias("segment"))


@query
def xycut_order(spark, sf_dir):
    """XY-cut of whole pages, furniture not pinned."""
    blocks = plan.analyze(derived.detections(spark, sf_dir), _heron(spark), AnalysisOptions(reading_order_source="xycut", pin_page_furniture=False), **_PAGE, **_size())
    return blocks.select("page_id", *DET_KEY, "reading_order")


@query
def analyze_blocks(spark, sf_dir):
    return plan.analyze(derived.detections(spark, sf_dir), _heron(spark), **_PAGE, **_size())


@query
def type_map_builtin(spark, sf_dir):
    labels = [(m, x) for m, xs in taxonomy.VOCABULARIES.items() for x in xs] + [("none", x) for x in ("Title", "stamp", "table_title", "chart_title", "nothing", "")]
    frame = spark.createDataFrame(labels, "model string, label string")
    kind = taxonomy.type_of(F.col("label"))
    view(spark, sf_dir, "documents")
    n = spark.table("documents").groupBy("lang").agg(F.count("*").alias("n_docs"))
    return frame.select("model", "label", kind.alias("type"), taxonomy.is_text_bearing(kind).alias("text_bearing"), taxonomy.is_furniture(kind).alias("furniture")).join(n, F.lit(True))


@query
def type_map_custom(spark, sf_dir):
    frame = spark.createDataFrame([(x,) for x in oracles.CUSTOM_LABELS], "label string")
    view(spark, sf_dir, "documents")
    langs = spark.table("documents").select("lang").distinct()
    typed = frame.select("label", taxonomy.custom_type_of(F.col("label")).alias("type"), taxonomy.custom_type_of(F.col("label"), oracles.CUSTOM_MAP).alias("mapped_type"))
    return langs.join(F.broadcast(typed), F.lit(True)).select("lang", "label", "type", "mapped_type")


def _raw_rows(spark, sf_dir, values: str, scale: float) -> DataFrame:
    """Detector rows packed per page, in key order, with the page's size."""
    dets = derived.detections(spark, sf_dir)
    f = lambda c: c.cast("float")
    columns = {
        "paddle": [f(F.col("class_id")), F.col("score"), *(f(F.col(c) * scale) for c in ("x1", "y1", "x2", "y2")), f(F.col("order_hint"))],
        "yolo": [*(f(F.col(c) * scale) for c in ("x1", "y1", "x2", "y2")), F.col("score"), f(F.col("class_id"))],
    }[values]
    packed = dets.groupBy("page_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(*DET_KEY, F.array(*columns).alias("v")))), lambda x: x["v"])).alias("rows"))
    return packed.join(derived.page_sizes(spark, sf_dir).select("page_id", "width", "height"), "page_id")


def _boxes(frame: DataFrame, *first: str) -> DataFrame:
    return frame.select(*first, "det_pos", "class_id", "score", "order_hint", *(F.round(c, 3).alias(c) for c in ("x1", "y1", "x2", "y2")))


@query
def decode_paddle(spark, sf_dir):
    return _boxes(decode.decode_paddle(_raw_rows(spark, sf_dir, "paddle", 0.75), 0.5, 800, stride=7), "page_id")


@query
def decode_counted(spark, sf_dir):
    """Rows of which a count says how many hold (0: all), some with a NaN score, class, corner or order key."""
    dets = derived.detections(spark, sf_dir)
    f = lambda c: c.cast("float")
    nan = F.lit(float("nan")).cast("float")
    odd = lambda k, c: F.when(F.col("pk") % 11 == k, nan).otherwise(f(c))
    values = [odd(0, F.col("class_id")), odd(1, F.col("score")), odd(2, F.col("x1") * 0.75), *(f(F.col(c) * 0.75) for c in ("y1", "x2", "y2")), odd(3, F.col("order_hint"))]
    packed = dets.groupBy("page_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(*DET_KEY, F.array(*values).alias("v")))), lambda x: x["v"])).alias("rows"))
    sized = packed.join(derived.page_sizes(spark, sf_dir).select("page_id", "width", "height"), "page_id").withColumn("n", (F.col("page_id") % 8).cast("int"))
    return decode.decode_paddle(sized, 0.5, 800, stride=7, count="n").select("page_id", "det_pos", "class_id", "score", "order_hint", F.round("x1", 3).alias("x1"), F.round("y2", 3).alias("y2"))


@query
def decode_yolo(spark, sf_dir):
    return _boxes(decode.decode_yolo(_raw_rows(spark, sf_dir, "yolo", 0.625), 0.5, 640), "page_id")


@query
def decode_detr(spark, sf_dir):
    view(spark, sf_dir, "embeddings")
    e = F.col("embedding")
    logits = F.slice(e, 1, 51)
    boxes = F.transform(F.slice(e, 52, 12), F.abs)
    frame = spark.table("embeddings").select("vec_id", logits.alias("logits"), boxes.alias("boxes"), F.lit(762).alias("width"), F.lit(1000).alias("height"))
    rows = decode.decode_detr(frame, 0.55, 17)
    return rows.select("vec_id", "det_pos", "class_id", F.round(F.col("score").cast("double"), 4).alias("score"), *(F.round(c, 2).alias(c) for c in ("x1", "y1", "x2", "y2")))


@query
def letterbox(spark, sf_dir):
    box = G.letterbox(F.col("width"), F.col("height"), 640)
    return derived.page_sizes(spark, sf_dir).select("page_id", *((F.round(c, 9) if n == "scale" else c).alias(n) for n, c in box.items()))


@query
def orientation_decode(spark, sf_dir):
    """Every four values of every vector as an answer of the classifier; every third answer scaled to probabilities.

    Hundredths are rounded as products, as in DuckDB: 0.285 * 100 is less than 28.5.
    """
    view(spark, sf_dir, "embeddings")
    last = F.floor(F.size("embedding") / 4).cast("int") - 1
    at = F.when(last >= 0, F.sequence(F.lit(0), last))
    four = spark.table("embeddings").select("vec_id", F.explode(at).alias("k"), "embedding").withColumn("v", F.transform(F.slice("embedding", F.col("k") * 4 + 1, F.lit(4)), lambda x: x.cast("double")))
    size = F.transform("v", F.abs)
    total = F.aggregate(size, G.d(0), lambda acc, x: acc + x)
    scaled = F.transform(size, lambda x: F.when(total == 0, F.lit(float("nan"))).otherwise(x / total))
    given = F.when((F.col("vec_id") + F.col("k")) % 3 == 0, scaled).otherwise(F.col("v"))
    rows = four.select("vec_id", "k", decode.decode_orientation(given).alias("p"))
    gate = (F.col("p.rotation") != 0) & (F.col("p.confidence") >= F.lit(0.6).cast("float"))
    return rows.select("vec_id", "k", "p.rotation", *((F.round(F.col(f"p.{c}") * 100) / 100).alias(c) for c in ("confidence", "p0", "p90", "p180", "p270")), gate.alias("applied"))


def _corrected(spark, sf_dir) -> DataFrame:
    pages = derived.page_sizes(spark, sf_dir)
    # Every fifth page does not know its source size.
    known = F.col("page_id") % 5 != 0
    return pages.withColumn("source_w", F.when(known, F.col("width")).otherwise(0)).withColumn("source_h", F.when(known, F.col("height")).otherwise(0))


def _page_columns() -> list:
    return [F.col(c) for c in ("rotation", "skew", "source_w", "source_h", "width", "height")]


@query
def map_to_source_points(spark, sf_dir):
    x, y = G.to_source(G.d(10), G.d(20), *_page_columns())
    uw, uh = G.upright_size(F.col("width"), F.col("height"), F.col("rotation"))
    return _corrected(spark, sf_dir).select("page_id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), uw.alias("upright_w"), uh.alias("upright_h"), G.is_corrected(F.col("rotation"), F.col("skew")).alias("is_corrected"))


@query
def map_to_source_boxes(spark, sf_dir):
    rows = derived.detections(spark, sf_dir).join(_corrected(spark, sf_dir), "page_id")
    box = G.box_to_source(G.Box.named(), *_page_columns())
    return rows.select("page_id", *DET_KEY, *(F.round(c, 5).alias(n) for c, n in zip((box.x1, box.y1, box.x2, box.y2), ("sx1", "sy1", "sx2", "sy2"), strict=True)))


def _gray(spark, sf_dir) -> DataFrame:
    """Pixels derived from events: an image per event type."""
    view(spark, sf_dir, "events")
    e = spark.table("events").select("event_type", F.col("event_id").alias("at"), F.pmod(F.floor(F.col("value") * 100), F.lit(256)).cast("int").alias("r"), F.pmod(F.col("user_id"), F.lit(256)).cast("int").alias("g"), F.pmod(F.col("event_id"), F.lit(256)).cast("int").alias("b"))
    return e.withColumn("luma", G.luma(F.col("r"), F.col("g"), F.col("b")))


@query
def luma_histogram(spark, sf_dir):
    return _gray(spark, sf_dir).groupBy("event_type", "luma").agg(F.count("*").alias("n"))


@query
def otsu_histogram(spark, sf_dir):
    return correction.otsu(_gray(spark, sf_dir), ["event_type"], "luma")


@query
def projection_sharpness(spark, sf_dir):
    rows = _gray(spark, sf_dir).filter("luma < 128").withColumn("bin", F.pmod(F.col("at"), F.lit(97)).cast("int"))
    return correction.sharpness(rows, ["event_type"], "bin", 97)


def _tables(spark, sf_dir) -> DataFrame:
    cells = derived.table_cells(spark, sf_dir)
    cell = F.struct(F.col("r").cast("int").alias("row"), F.col("c").cast("int").alias("column"), F.col("rowspan").cast("int").alias("row_span"), F.col("colspan").cast("int").alias("column_span"), "is_header", F.col("txt").alias("text"), F.struct(*((F.col("c") * 10 + k).cast("double").alias(n) for k, n in enumerate(("min_x", "min_y", "max_x", "max_y")))).alias("box"))
    return cells.groupBy("ok").agg(F.sort_array(F.collect_list(cell)).alias("cells")).select("ok", tables.build(F.col("cells")).alias("table"))


@query
def table_html(spark, sf_dir):
    return _tables(spark, sf_dir).select("ok", tables.to_html(F.col("table")).alias("html"), tables.has_spans(F.col("table")).alias("has_spans"))


@query
def table_parse(spark, sf_dir):
    """Cells read back from rendered HTML."""
    back = tables.parse_tables(_tables(spark, sf_dir).select("ok", tables.to_html(F.col("table")).alias("html")), "html", "t")
    return back.select("ok", "t.row_count", "t.column_count", F.explode("t.cells").alias("c")).select("ok", "row_count", "column_count", *(F.col(f"c.{n}").alias(n) for n in ("row", "column", "row_span", "column_span", "is_header", "text")))


@query
def table_grid(spark, sf_dir):
    return tables.grid_cells(_tables(spark, sf_dir), ["ok"])


@query
def table_csv(spark, sf_dir):
    return _tables(spark, sf_dir).select("ok", tables.to_csv(F.col("table")).alias("csv"), tables.to_csv(F.col("table"), "\t").alias("tsv"))


@query
def table_markdown(spark, sf_dir):
    """Tables with merged cells as HTML, the others as pipes; every second table loses its first column."""
    keep = F.transform(F.filter(F.col("table.cells"), lambda c: c["column"] > 0), lambda c: c.withField("column", c["column"] - 1))
    narrow = _tables(spark, sf_dir).withColumn("table", F.when(F.col("ok") % 2 == 0, tables.build(keep)).otherwise(F.col("table")))
    return narrow.select("ok", tables.to_markdown(F.col("table")).alias("markdown"))


@query
def table_empty(spark, sf_dir):
    """Tables that lose their first columns, some all of them."""
    kept = F.filter(F.col("table.cells"), lambda c: c["column"] >= F.col("ok") % 6)
    cut = _tables(spark, sf_dir).withColumn("table", tables.build(kept))
    return cut.select("ok", tables.is_empty(F.col("table")).alias("is_empty"), F.col("table.row_count").alias("row_count"), F.col("table.column_count").alias("column_count"))


@query
def markdown_blocks(spark, sf_dir):
    """Blocks of recognized tables and formulas as Markdown; every fifth table has no cells and falls back on its text, or its mark."""
    base = _tables(spark, sf_dir).withColumn("table", tables.build(F.filter(F.col("table.cells"), lambda c: F.col("ok") % 5 != 0)))
    text = F.when(F.col("ok") % 2 == 0, F.concat(F.lit(" said "), F.col("ok").cast("string"), F.lit("\n")))
    latex = F.when(F.col("ok") % 3 != 0, F.concat(F.lit(" x^{"), F.col("ok").cast("string"), F.lit("} ")))
    rows = base.select("ok", F.explode(F.array(F.lit("Table"), F.lit("Formula"), F.lit("Text"))).alias("type"), "table", text.alias("text"), latex.alias("latex"))
    shown = export.block_markdown(F.col("type"), F.col("text"), F.col("table"), F.col("latex"))
    return rows.select("ok", "type", shown.alias("markdown"), F.when(F.col("type") != "Table", export.plain_payload(F.col("text"), None, F.col("latex"))).alias("plain"))


@query
def table_bridge(spark, sf_dir):
    """The largest of the tables of four neighbouring orders, and the longest of their header texts."""
    near = _tables(spark, sf_dir).withColumn("near", F.floor(F.col("ok") / 4)).groupBy("near").agg(F.sort_array(F.collect_list(F.struct("ok", "table"))).alias("all"))
    best = service.largest_table(F.transform("all", lambda x: x["table"]))
    said = service.longest(F.transform("all", lambda x: F.array_max(F.transform(x["table"]["cells"], lambda c: F.when(c["column"] == 3, c["text"])))))
    return near.select("near", F.size(best["cells"]).alias("n_cells"), best["row_count"].alias("row_count"), said.alias("longest"))


@query
def table_offset(spark, sf_dir):
    moved = _tables(spark, sf_dir).select("ok", F.explode(tables.offset(F.col("table"), F.col("ok").cast("double"), G.d(0.5))["cells"]).alias("c"))
    return moved.select("ok", F.col("c.row").alias("row"), F.col("c.column").alias("column"), *(F.col(f"c.box.{n}").alias(n) for n in ("min_x", "min_y", "max_x", "max_y")))


def _text_blocks(spark, sf_dir) -> DataFrame:
    """Lines of documents as blocks: 25 a page, types in turn."""
    view(spark, sf_dir, "documents")
    lines = spark.table("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "text"))
    label = F.element_at(F.array(*(F.lit(x) for x in taxonomy.VOCABULARIES["heron"])), F.col("at") % 17 + 1)
    return lines.select("doc_id", (F.floor(F.col("at") / 25) + 1).cast("int").alias("page_number"), (F.col("at") % 25).alias("reading_order"), taxonomy.type_of(label).alias("type"), "text")


@query
def plain_text(spark, sf_dir):
    return export.document_text(_text_blocks(spark, sf_dir), export.plain_payload(F.col("text")))


@query
def markdown(spark, sf_dir):
    return export.document_markdown(_text_blocks(spark, sf_dir), export.block_markdown(F.col("type"), F.col("text")))


def _documents(spark, sf_dir) -> DataFrame:
    """Four pages a document."""
    blocks = analyze_blocks(spark, sf_dir).withColumn("doc", F.floor(F.col("page_id") / 4)).withColumn("page_number", (F.col("page_id") % 4 + 1).cast("int"))
    pages = derived.page_sizes(spark, sf_dir).select(F.floor(F.col("page_id") / 4).alias("doc"), (F.col("page_id") % 4 + 1).cast("int").alias("page_number"), F.lit(PAGE_WIDTH).alias("width"), F.lit(PAGE_HEIGHT).alias("height"), "rotation", F.col("skew").alias("skew_angle"), F.col("width").alias("source_width"), F.col("height").alias("source_height"))
    return plan.documents(blocks, pages, "doc", "page_number")


@query
def doc_json(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc", export.document_json(F.col("pages"), pretty=False).alias("json"))


@query
def json_roundtrip(spark, sf_dir):
    """Blocks read back from exported JSON."""
    back = doc_json(spark, sf_dir).select("doc", F.explode(export.parse_document(F.col("json"))).alias("p"))
    rows = back.select("doc", "p.page_number", "p.rotation", "p.skew_angle", F.explode("p.blocks").alias("b"))
    return rows.select("doc", "page_number", "rotation", "skew_angle", "b.type", "b.confidence", "b.reading_order", "b.raw_class_id", "b.raw_class_name", *(F.col(f"b.box.{c}").alias(c) for c in ("min_x", "min_y", "max_x", "max_y")))


@query
def latex_normalize(spark, sf_dir):
    view(spark, sf_dir, "documents")
    # Whole texts, four of seven in a pair of delimiters.
    text, kind = F.col("text"), F.col("doc_id") % 7
    pairs = [("$$ ", " $$"), ("  $", "$ "), ("\\[", "\\]"), ("\\(", "\\)")]
    wrapped = F.coalesce(*(F.when(kind == k, F.concat(F.lit(before), text, F.lit(after))) for k, (before, after) in enumerate(pairs)), text)
    return spark.table("documents").select("doc_id", normalize_latex(wrapped).alias("latex"))


@query
def page_numbering(spark, sf_dir):
    view(spark, sf_dir, "conversations")
    return guards.number_pages(spark.table("conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn"]).select("conv_id", "turn", "role", "page_number")


@query
def guard_pages(spark, sf_dir):
    numbered = page_numbering(spark, sf_dir)
    counted = guards.first_pages(numbered, ["conv_id"], 4).groupBy("conv_id").agg(F.count("*").alias("n_pages"))
    return counted.withColumn("error", guards.too_many(F.col("n_pages"), 4))


@query
def guard_pixels(spark, sf_dir):
    pages = derived.page_sizes(spark, sf_dir)
    return pages.select("page_id", guards.too_large(F.col("width") * 1000, F.col("height") * 1000, 900_000_000_000).alias("error"))


def _scripted(spark, sf_dir) -> DataFrame:
    """Blocks recognized by scripted recognizers that see the crop's size."""
    blocks = analyze_blocks(spark, sf_dir)
    rect = G.Box.named().pixel_rect(F.lit(PAGE_WIDTH), F.lit(PAGE_HEIGHT))
    crop = F.concat(rect[2].cast("string"), F.lit("x"), rect[3].cast("string"))
    return recognize.recognize(
        blocks,
        crop,
        rect,
        text=recognize.text_recognizer(lambda s: " " + s + "\n"),
        formula=recognize.formula_recognizer(lambda s: "$" + s + "$"),
        table=recognize.html_table_recognizer(lambda s: "<table><tr><td>" + s + "</td><td colspan=2>b</td></tr></table>"),
    )


@query
def recognize_text(spark, sf_dir):
    rows = _scripted(spark, sf_dir)
    return rows.select("page_id", *DET_KEY, "type", "text", "latex", F.col("table.column_count").alias("table_columns"))


@query
def recognize_routing(spark, sf_dir):
    rows = _scripted(spark, sf_dir)
    return rows.groupBy("type").agg(F.count("*").alias("n"), F.count("text").alias("with_text"), F.count("latex").alias("with_latex"), F.count("table").alias("with_table"))


def _page_files(spark, sf_dir) -> DataFrame:
    """Image files made of the bytes of whole texts: a frame 32 pixels wide, then one of the bytes that are left."""
    view(spark, sf_dir, "documents")
    data = F.col("text").cast("binary")
    n = F.octet_length(data)
    wide, left = F.floor(n / 32).cast("int"), n % 32
    frame = lambda w, h, body: F.when((w > 0) & (h > 0), F.concat(F.concat(F.lit("P5 "), w.cast("string"), F.lit(" "), h.cast("string"), F.lit(" 255\n")).cast("binary"), body)).otherwise(F.lit(b""))
    body = F.concat(frame(F.lit(32), wide, F.substring(data, F.lit(1), wide * 32)), frame(left, F.lit(1), F.substring(data, wide * 32 + 1, left)))
    return spark.table("documents").select("doc_id", body.alias("content"))


def _page_images(spark, sf_dir) -> DataFrame:
    return images.frames_of(_page_files(spark, sf_dir))


@query
def image_frames(spark, sf_dir):
    """Frames of image files, decoded."""
    return _page_images(spark, sf_dir).select("doc_id", "page_number", "width", "height", F.sha2("pixels", 256).alias("pixels_sha256"), F.col("error").isNotNull().alias("failed"))


@query
def image_upright(spark, sf_dir):
    """Pages turned by what a classifier says of them (here: upside down, with a confidence by the document)."""
    told = F.struct(F.lit(180).alias("rotation"), ((F.col("doc_id") % 10) / 10).cast("float").alias("confidence"))
    pages = _page_images(spark, sf_dir).filter("pixels is not null").withColumn("turn", told)
    fixed = inference.correct_pages(pages, orientation_column="turn")
    return fixed.select("doc_id", "page_number", "rotation", "skew_angle", "width", "height", F.sha2("pixels", 256).alias("pixels_sha256"))


@query
def image_crops(spark, sf_dir):
    """A region of each page for a recognizer: the middle third of its rows."""
    third = F.floor(F.col("height") / 3).cast("int")
    pages = _page_images(spark, sf_dir).filter("pixels is not null")
    cut = tensors.crop(F.col("pixels"), F.col("width"), F.col("height"), [F.lit(0), third, F.col("width"), third])
    return pages.select("doc_id", "page_number", cut.alias("c")).filter("c is not null").select("doc_id", "page_number", F.col("c.width").alias("width"), F.col("c.height").alias("height"), F.sha2("c.pixels", 256).alias("pixels_sha256"))


class _Scripted:
    """A model session with fixed rows that depend on nothing but the contract; stands for a detector's weights."""

    ROWS = {"paddle": [[1, 0.9, 8, 8, 40, 24, 2], [0, 0.75, 0, 32, 64, 64, 0], [5, 0.3, 0, 0, 9, 9, 1]], "yolo": [[8, 8, 40, 24, 0.9, 1], [16, 32, 60, 60, 0.625, 0], [0, 0, 0, 0, 0, 0]]}

    def __init__(self, path: str, threads: int) -> None:
        self.contract = path

    def get_inputs(self) -> list:
        return [type("Input", (), {"name": "image", "shape": [1, 3, 64, 64]})()]

    def get_outputs(self) -> list:
        n = len(self.ROWS[self.contract][0])
        return [type("Output", (), {"name": "rows", "shape": [3, n], "type": "tensor(float)"})()]

    def run(self, names: list[str] | None, feed: dict) -> list:
        import numpy as np

        (image,) = feed.values()
        if image.shape != (1, 3, 64, 64) or image.dtype != np.float32:
            raise ValueError("the model takes 64 x 64 pixels")
        return [np.array(self.ROWS[self.contract], np.float32)]


def _detected(spark, sf_dir, contract: str) -> DataFrame:
    detector = inference.Detector(contract, contract, 64, ("text", "title"))
    found = inference.detect(_page_images(spark, sf_dir), detector, page=["doc_id", "page_number"], factory=_Scripted)
    return found.select("doc_id", "page_number", "det_pos", "class_id", "score", "order_hint", *(F.round(c, 4).alias(c) for c in ("x1", "y1", "x2", "y2")))


@query
def detect_paddle(spark, sf_dir):
    """Detections of all pages by a session in each worker: paddle contract."""
    return _detected(spark, sf_dir, "paddle")


@query
def detect_yolo(spark, sf_dir):
    """The same by the letterboxed contract."""
    return _detected(spark, sf_dir, "yolo")


@query
def json_fields(spark, sf_dir):
    """Computed fields of exported JSON: sizes of boxes and whether a page was corrected."""
    box = "struct<MinX:double,MaxY:double,Width:double,Height:double,Area:double,CenterX:double,CenterY:double,IsEmpty:boolean>"
    kind = f"struct<Pages:array<struct<PageNumber:int,Width:int,SourceHeight:int,IsCorrected:boolean,Blocks:array<struct<Type:string,ReadingOrder:int,BoundingBox:{box}>>>>>"
    pages = doc_json(spark, sf_dir).select("doc", F.explode(F.from_json("json", kind)["Pages"]).alias("p"))
    rows = pages.select("doc", F.col("p.PageNumber").alias("page_number"), F.col("p.Width").alias("page_width"), F.col("p.SourceHeight").alias("source_height"), F.col("p.IsCorrected").alias("is_corrected"), F.explode("p.Blocks").alias("b"))
    told = {"min_x": "MinX", "max_y": "MaxY", "width": "Width", "height": "Height", "area": "Area", "center_x": "CenterX", "center_y": "CenterY", "is_empty": "IsEmpty"}
    return rows.select("doc", "page_number", "page_width", "source_height", "is_corrected", F.col("b.Type").alias("type"), F.col("b.ReadingOrder").alias("reading_order"), *(F.col(f"b.BoundingBox.{c}").alias(n) for n, c in told.items()))


@query
def page_skew(spark, sf_dir):
    """Skew of one synthetic page per page id, drawn with a known skew from the id; pixel work, so dealt out over all cores.

    ``nearest``: the estimate to the next of the drawn angles, which are three degrees apart.
    """
    ids = derived.page_sizes(spark, sf_dir).select("page_id", ((F.col("page_id") % 5 - 2) * 3).cast("double").alias("drawn"))
    found = correction.estimate_drawn(ids.repartition(4 * spark.sparkContext.defaultParallelism, "page_id"))
    return found.select("page_id", "drawn", (F.round(F.col("angle") / 3) * 3).cast("int").alias("nearest"), "reliable", "within")
