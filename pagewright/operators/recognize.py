"""Recognizers as user functions on region crops, routed by block type.

A recognizer maps a batch of inputs to a batch of answers (a pandas function); a failure fails the task, as
results must be whole. Parallelism is that of Spark's tasks.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.taxonomy import is_text_bearing
from ..functions.text import normalize_latex, recognized_text
from ..schema import TABLE
from .tables import offset, parse_html


def route(kind: Column) -> Column:
    """Which recognizer a block goes to: text, table or formula; null for none."""
    return F.when(is_text_bearing(kind), "text").when(kind == "Table", "table").when(kind == "Formula", "formula")


def text_recognizer(function: Callable[[pd.Series], pd.Series]) -> Callable[[Column], Column]:
    """From a batch function crop -> text."""
    udf = F.pandas_udf(function, "string", F.PandasUDFType.SCALAR).asNondeterministic()
    return lambda crop: recognized_text(udf(crop))


def formula_recognizer(function: Callable[[pd.Series], pd.Series]) -> Callable[[Column], Column]:
    """From a batch function crop -> LaTeX."""
    udf = F.pandas_udf(function, "string", F.PandasUDFType.SCALAR).asNondeterministic()
    return lambda crop: normalize_latex(udf(crop))


def html_table_recognizer(function: Callable[[pd.Series], pd.Series]) -> Callable[[Column], Column]:
    """From a batch function crop -> HTML of a table."""
    udf = F.pandas_udf(function, "string", F.PandasUDFType.SCALAR).asNondeterministic()
    return lambda crop: parse_html(udf(crop))


def table_recognizer(function: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[Column], Column]:
    """From a batch function crop -> table structure."""
    return F.pandas_udf(function, TABLE, F.PandasUDFType.SCALAR).asNondeterministic()


def recognize(blocks: DataFrame, crop: Column, rect: list[Column], *, text=None, table=None, formula=None) -> DataFrame:
    """Fills ``text``, ``table`` and ``latex`` of the blocks whose type and crop (2 pixels at least each way) call for it.

    Each recognizer sees only its own blocks: inputs of the others are null and answers to them are dropped.
    Tables are moved from the crop to the page; an empty one becomes null.
    """
    x, y, w, h = rect
    asked = F.when((w >= 2) & (h >= 2), route(F.col("type")))
    out = blocks.withColumn("_route", asked).withColumn("_crop", crop)
    none = F.lit(None)
    pick = lambda name, f, kind: F.when(F.col("_route") == name, f(F.when(F.col("_route") == name, F.col("_crop")))) if f else none.cast(kind)
    out = out.withColumn("text", pick("text", text, "string")).withColumn("latex", pick("formula", formula, "string"))
    moved = out.withColumn("table", pick("table", table, TABLE))
    shifted = F.when(F.size(F.col("table.cells")) > 0, offset(F.col("table"), x.cast("double"), y.cast("double")))
    return moved.withColumn("table", shifted).drop("_route", "_crop")
