"""The engine as one object: images in, typed blocks and documents out, with counts, and one warning where the order cannot be had."""

from __future__ import annotations

import time
import warnings
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import Box
from ..operators import guards, inference, recognize, tables, tensors
from ..schema import AnalysisOptions, LayoutError, ServiceOptions
from ..sources import images
from . import analyze as plan


class LayoutService:
    """A detector, and optionally an orientation classifier and recognizers, under fixed options.

    Recognizers map a column of crops (structs of width, height, pixels) to text, LaTeX or table structs; see
    ``operators.recognize``. ``factory`` opens a model in a worker; tests give their own.
    """

    def __init__(self, spark: SparkSession, options: ServiceOptions, *, model_path: str | None = None, orientation_path: str | None = None, text: Callable | None = None, table: Callable | None = None, formula: Callable | None = None, factory: Callable[[str, int], Any] = inference.open_session) -> None:
        threads = options.intra_op_threads or 1
        if options.custom_model:
            self.detector = inference.Detector.custom(options.custom_model, options.model_cache_path, threads)
        elif model_path:
            self.detector = inference.Detector.built_in(options.model, inference.model_file(model_path, options.model_cache_path), threads)
        else:
            raise LayoutError("a built-in model needs the path of its file")
        if options.correct_orientation and not orientation_path:
            raise LayoutError("correcting orientation needs the classifier's file")
        self.spark, self.options, self.factory = spark, options, factory
        self.orientation_path, self.text, self.table, self.formula = orientation_path, text, table, formula
        self._warned = False

    # ---- pages

    def frames(self, path: str, *, streaming: bool = False) -> DataFrame:
        """All frames of the files under a path, under the service's limits."""
        return images.read_frames(self.spark, path, max_pixels=self.options.max_image_pixels, max_pages=self.options.max_pages, streaming=streaming)

    def first_frames(self, path: str) -> DataFrame:
        return images.read_images(self.spark, path, max_pixels=self.options.max_image_pixels)

    def frames_of_bytes(self, contents: list[bytes]) -> DataFrame:
        """Frames of image files given as bytes; ``path`` is their place in the list."""
        rows = self.spark.createDataFrame([(str(k), bytes(c)) for k, c in enumerate(contents)], "path string, content binary")
        return images.frames_of(rows, max_pixels=self.options.max_image_pixels, max_pages=self.options.max_pages)

    def decoded(self, pages: DataFrame, document: str = "path", sequence: str = "sequence") -> DataFrame:
        """Pages that are decoded already, numbered by ``sequence``; a null page, a wrong size and one page too many are errors in their rows."""
        numbered = guards.number_pages(pages, [document], [sequence])
        size = F.col("width").cast("bigint") * F.col("height")
        wrong = F.when(F.col("pixels").isNull(), F.concat(F.lit("page "), F.col("page_number").cast("string"), F.lit(" is null"))).when(F.octet_length("pixels") != 3 * size, "the pixels do not fit the page's size")
        many = guards.too_many(F.when(F.col("page_number") > self.options.max_pages, F.col("page_number")), self.options.max_pages)
        error = F.coalesce(wrong, guards.too_large(F.col("width"), F.col("height"), self.options.max_image_pixels), many)
        return numbered.withColumn("error", error).withColumn("pixels", F.when(error.isNull(), F.col("pixels")))

    # ---- analysis

    def classify_orientation(self, pages: DataFrame) -> DataFrame:
        if not self.orientation_path:
            raise LayoutError("the service has no orientation classifier")
        return inference.orientation(pages, self.orientation_path, factory=self.factory)

    def corrected(self, pages: DataFrame, options: AnalysisOptions) -> DataFrame:
        told = self.classify_orientation(pages) if self.options.correct_orientation else pages
        column = "orientation" if self.options.correct_orientation else None
        return inference.correct_pages(told, orientation_column=column, threshold=self.options.orientation_confidence_threshold, deskew=options.deskew, max_angle=options.deskew_max_angle)

    def analyze(self, pages: DataFrame, options: AnalysisOptions | None = None, *, document: str = "path", strict: bool = True) -> tuple[DataFrame, DataFrame]:
        """The corrected pages and their blocks. With ``strict`` a page with an error fails the job; else it has no blocks.

        Blocks are keyed by document and ``page_number``; what recognizers say is in ``text``, ``latex`` and ``table``.
        """
        options = options or AnalysisOptions()
        pages = guards.enforce(pages, F.col("error")) if strict and "error" in pages.columns else pages
        pages = self.corrected(pages, options)
        key = [document, "page_number"]
        found = inference.detect(pages, self.detector, options, page=key, factory=self.factory)
        blocks = plan.analyze(found, inference.classes_of(self.spark, self.detector), options, page=[*key, "width", "height"], position=["det_pos"], width=F.col("width"), height=F.col("height"))
        if self.text or self.table or self.formula:
            joined = blocks.join(pages.select(*key, "pixels"), key)
            rect = Box.named().pixel_rect(F.col("width"), F.col("height"))
            blocks = recognize.recognize(joined, tensors.crop(F.col("pixels"), F.col("width"), F.col("height"), rect), rect, text=self.text if options.recognize_text else None, table=self.table if options.recognize_tables else None, formula=self.formula if options.recognize_formulas else None).drop("pixels")
        return pages, blocks

    def documents(self, pages: DataFrame, blocks: DataFrame, document: str = "path") -> DataFrame:
        """Documents with their pages and blocks, for the exports."""
        return plan.documents(blocks.drop("width", "height"), pages.select(document, "page_number", "width", "height", "rotation", "skew_angle", "source_width", "source_height"), document, "page_number")

    # ---- counts

    def observed(self, blocks: DataFrame, options: AnalysisOptions | None = None) -> tuple[DataFrame, Callable[[], dict]]:
        """The blocks, and a function that tells, after they were written: blocks, those with text, table and LaTeX, pages that XY-cut ordered, and milliseconds.

        Rows are counted as they pass, so write or collect these blocks once, and sort before, not after (a sort reads
        its input twice). If the model's order was demanded and some page had none, it warns, once per service.
        """
        counts, began = Observation(), time.perf_counter()
        filled = [F.count(F.col(c) if c in blocks.columns else F.lit(None)).alias(f"n_{c}") for c in ("text", "table", "latex")]
        cut = F.sum(((F.col("strategy") == "xycut") & (F.col("reading_order") == 0)).cast("bigint")).alias("n_xycut_pages")
        watched = blocks.observe(counts, F.count(F.lit(1)).alias("n_blocks"), *filled, cut)

        def report() -> dict:
            told = dict(counts.get)
            told["milliseconds"] = round((time.perf_counter() - began) * 1000)
            if options and options.reading_order_source == "model" and told["n_xycut_pages"] and not self._warned:
                self._warned = True
                warnings.warn(f"{told['n_xycut_pages']} pages were ordered by XY-cut: the model gives no reading order for them", stacklevel=2)
            return told

        return watched, report


def largest_table(candidates: Column) -> Column:
    """Of an array of table structs the one with the most cells, the first of equals; null if all are empty."""
    ranked = F.transform(F.filter(candidates, lambda t: ~tables.is_empty(t)), lambda t, i: F.struct((-F.size(t["cells"])).alias("less"), i.alias("at"), t.alias("table")))
    return F.get(F.array_sort(ranked), F.lit(0))["table"]


def longest(candidates: Column) -> Column:
    """Of an array of texts the longest one, the first of equals; null if there is none."""
    ranked = F.transform(F.filter(candidates, lambda t: t.isNotNull()), lambda t, i: F.struct((-F.length(t)).alias("less"), i.alias("at"), t.alias("text")))
    return F.get(F.array_sort(ranked), F.lit(0))["text"]
