"""Detector labels and the block types that they mean."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import utrim

# The label order of the two built-in detectors is their wire contract.
VOCABULARIES = {
    "heron": "caption footnote formula list_item page_footer page_header picture section_header table text title document_index code checkbox_selected checkbox_unselected form key_value_region".split(),
    "v3": "abstract algorithm aside_text chart content display_formula doc_title figure_title footer footer_image footnote formula_number header header_image image inline_formula number paragraph_title reference reference_content seal table text vertical_text vision_footnote".split(),
}

# Block types and the detector labels that mean them.
LABELS = {
    "Title": "title doc_title",
    "SectionHeader": "section_header paragraph_title",
    "Text": "text document_index code abstract content reference reference_content algorithm aside_text vertical_text",
    "List": "list_item",
    "Table": "table",
    "Figure": "picture image chart",
    "Caption": "caption figure_title table_title chart_title vision_footnote",
    "Formula": "formula formula_number display_formula inline_formula",
    "Footnote": "footnote",
    "PageHeader": "page_header header header_image",
    "PageFooter": "page_footer footer footer_image",
    "PageNumber": "number",
    "Seal": "seal stamp",
    "Checkbox": "checkbox_selected checkbox_unselected",
    "Form": "form",
    "KeyValueRegion": "key_value_region",
}

# Further spellings that labels of custom models are taken for.
CUSTOM_LABELS = {
    "Title": "document_title",
    "SectionHeader": "section_title heading subtitle sub_title",
    "Text": "plain_text paragraph body body_text index",
    "List": "list list_items",
    "Figure": "figure figure_image photo graphic",
    "Caption": "figure_caption table_caption chart_caption image_caption",
    "Footnote": "table_footnote figure_footnote",
    "Formula": "equation isolate_formula isolated_formula formula_caption math",
    "PageHeader": "running_head",
    "PageNumber": "page_number page_num",
    "Checkbox": "checkbox check_box",
    "Form": "form_region",
    "KeyValueRegion": "key_value kv_region",
}

TYPES = [*LABELS, "Other"]
TEXT_BEARING = ["Title", "SectionHeader", "Text", "List", "Caption", "Footnote", "PageHeader", "PageFooter", "PageNumber", "KeyValueRegion"]
FURNITURE = ["PageHeader", "PageFooter", "PageNumber"]

_BUILT_IN = {label: kind for kind, labels in LABELS.items() for label in labels.split()}
_CUSTOM = {label: kind for kind, labels in CUSTOM_LABELS.items() for label in labels.split()}


def _lookup(table: Mapping[str, str], key: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[key] if table else F.lit(None).cast("string")


def type_of(label: Column) -> Column:
    """Type of a built-in label, by exact spelling; Other for the rest."""
    return F.coalesce(_lookup(_BUILT_IN, label), F.lit("Other"))


def custom_type_of(label: Column, type_map: Mapping[str, str] | None = None) -> Column:
    """Type of a custom model's label: the user's map, the exact spelling, then the spelling in lower case with underscores."""
    spelled = F.lower(F.translate(utrim(label), "- ", "__"))
    return F.coalesce(_lookup(type_map or {}, label), _lookup(_BUILT_IN, label), _lookup(_BUILT_IN, spelled), _lookup(_CUSTOM, spelled), F.lit("Other"))


def is_text_bearing(kind: Column) -> Column:
    return kind.isin(TEXT_BEARING)


def is_furniture(kind: Column) -> Column:
    return kind.isin(FURNITURE)


def vocabulary(spark: SparkSession, labels: list[str], type_map: Mapping[str, str] | None = None, *, custom: bool = False) -> DataFrame:
    """``class_id``, ``raw_name``, ``type``: a dimension of as many rows as the detector has classes."""
    rows = spark.createDataFrame(list(enumerate(labels)), "class_id int, raw_name string")
    return rows.withColumn("type", custom_type_of(F.col("raw_name"), type_map) if custom else type_of(F.col("raw_name")))


def with_types(detections: DataFrame, classes: DataFrame) -> DataFrame:
    """Adds ``raw_name`` and ``type``; classes that the vocabulary lacks are ``class_{id}`` of type Other.

    The vocabulary has one row per class of a detector (at most a few hundred), so it is broadcast.
    """
    joined = detections.join(F.broadcast(classes), "class_id", "left")
    name = F.coalesce(F.col("raw_name"), F.concat(F.lit("class_"), F.col("class_id").cast("string")))
    return joined.withColumn("raw_name", name).withColumn("type", F.coalesce("type", F.lit("Other")))
