"""Limits on pages and pixels, and the numbering of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_pages(pages: DataFrame, document: list[str], sequence: list[str]) -> DataFrame:
    """Adds ``page_number`` from 1 in the order of the sequence columns."""
    return pages.withColumn("page_number", F.row_number().over(Window.partitionBy(*document).orderBy(*sequence)))


def too_large(width: Column, height: Column, max_pixels: int) -> Column:
    """An error text for pages with more pixels than allowed, else null; the product is taken in 64 bits."""
    pixels = width.cast("bigint") * height.cast("bigint")
    return F.when(pixels > F.lit(max_pixels).cast("bigint"), F.concat(F.lit("image has "), pixels.cast("string"), F.lit(f" pixels; at most {max_pixels} are allowed")))


def too_many(pages: Column, max_pages: int) -> Column:
    return F.when(pages > max_pages, F.concat(F.lit("document has "), pages.cast("string"), F.lit(f" pages; at most {max_pages} are allowed")))


def enforce(frame: DataFrame, error: Column) -> DataFrame:
    """Fails the job at the first row with an error; without it the error column serves as a quarantine."""
    return frame.filter(F.when(error.isNotNull(), F.raise_error(error).cast("boolean")).otherwise(F.lit(True)))


def first_pages(pages: DataFrame, document: list[str], max_pages: int) -> DataFrame:
    """At most ``max_pages`` + 1 pages of each document: enough to see that there are too many."""
    return pages.filter(F.col("page_number") <= max_pages + 1)
