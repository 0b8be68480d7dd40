"""Documents as text, Markdown and JSON.

Blocks are rendered row by row, gathered per page and then per document: two partial aggregations, of
which only the strings of one document come together in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bullets, inline, utrim, utrim_end
from . import tables


def _blank(text: Column) -> Column:
    return text.isNull() | (utrim(text) == "")


def plain_payload(text: Column, table: Column | None = None, latex: Column | None = None) -> Column:
    """What stands for a block in plain text: its table as tab-separated lines, else its LaTeX, else its text."""
    out = text
    if latex is not None:
        out = F.when(~_blank(latex), utrim(latex)).otherwise(out)
    if table is not None:
        rows = F.array_join(F.transform(tables.grid(table), lambda r: F.array_join(r, "\t")), "\n")
        out = F.when(~tables.is_empty(table), rows).otherwise(out)
    return out


def block_markdown(kind: Column, text: Column, table: Column | None = None, latex: Column | None = None) -> Column:
    """The Markdown of a block; null if the type has none or there is no text for it."""
    said = F.when(~_blank(text), utrim(text))
    of_table = F.when(~tables.is_empty(table), F.when(tables.to_markdown(table) != "", tables.to_markdown(table))) if table is not None else F.lit(None).cast("string")
    of_formula = F.when(~_blank(latex), F.concat(F.lit("$$\n"), utrim(latex), F.lit("\n$$"))) if latex is not None else F.lit(None).cast("string")
    return (
        F.when(kind == "Title", F.concat(F.lit("# "), inline(said)))
        .when(kind == "SectionHeader", F.concat(F.lit("## "), inline(said)))
        .when(kind == "Caption", F.concat(F.lit("*"), inline(said), F.lit("*")))
        .when(kind == "List", bullets(said))
        .when(kind.isin("Text", "Footnote", "KeyValueRegion", "Other"), said)
        .when(kind == "Figure", "*[Figure]*")
        .when(kind == "Table", F.coalesce(of_table, said, F.lit("*[Table]*")))
        .when(kind == "Formula", F.coalesce(of_formula, said, F.lit("*[Formula]*")))
    )


def _joined(rows: DataFrame, keys: list[str], order: list[str], value: str, between: str) -> DataFrame:
    """The values of each group in order, nulls left out; a group without values stays, as an empty text."""
    item = F.struct(*order, value)
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x[value]), between).alias(value))


def document_text(blocks: DataFrame, payload: Column, document: str = "doc_id", page: str = "page_number", order: str = "reading_order") -> DataFrame:
    """``document``, ``text``: a line per block, an empty line between pages; blank payloads are skipped, the end is trimmed."""
    rows = blocks.select(document, page, order, F.when(~_blank(payload), payload).alias("_v"))
    pages = _joined(rows, [document, page], [order], "_v", "\n")
    return _joined(pages, [document], [page], "_v", "\n\n").select(document, utrim_end(F.col("_v")).alias("text"))


def document_markdown(blocks: DataFrame, markdown: Column, document: str = "doc_id", page: str = "page_number", order: str = "reading_order") -> DataFrame:
    """``document``, ``markdown``: an empty line between blocks, a rule between pages, the end trimmed."""
    rows = blocks.select(document, page, order, markdown.alias("_v"))
    pages = _joined(rows, [document, page], [order], "_v", "\n\n")
    return _joined(pages, [document], [page], "_v", "\n\n---\n\n").select(document, utrim_end(F.col("_v")).alias("markdown"))


def _box_json(box: Column) -> Column:
    w, h = F.greatest(F.lit(0.0), box["max_x"] - box["min_x"]), F.greatest(F.lit(0.0), box["max_y"] - box["min_y"])
    return F.when(
        box.isNotNull(),
        F.struct(
            box["min_x"].alias("MinX"), box["min_y"].alias("MinY"), box["max_x"].alias("MaxX"), box["max_y"].alias("MaxY"), w.alias("Width"), h.alias("Height"), (w * h).alias("Area"),
            (box["min_x"] + w / 2).alias("CenterX"), (box["min_y"] + h / 2).alias("CenterY"), ((w <= 0) & (h <= 0)).alias("IsEmpty"),
        ),
    )


def _cell_json(c: Column) -> Column:
    return F.struct(c["row"].alias("Row"), c["column"].alias("Column"), c["row_span"].alias("RowSpan"), c["column_span"].alias("ColumnSpan"), c["is_header"].alias("IsHeader"), c["text"].alias("Text"), _box_json(c["box"]).alias("BoundingBox"))


def _block_json(b: Column) -> Column:
    t = b["table"]
    table = F.when(t.isNotNull(), F.struct(t["row_count"].alias("RowCount"), t["column_count"].alias("ColumnCount"), F.transform(t["cells"], _cell_json).alias("Cells"), t["html"].alias("Html")))
    return F.struct(
        b["type"].alias("Type"), _box_json(b["box"]).alias("BoundingBox"), b["confidence"].alias("Confidence"), b["reading_order"].alias("ReadingOrder"), b["raw_class_id"].alias("RawClassId"),
        F.coalesce(b["raw_class_name"], F.lit("")).alias("RawClassName"), b["text"].alias("Text"), table.alias("Table"), b["latex"].alias("Latex"),
    )


def document_json(pages: Column, pretty: bool = True) -> Column:
    """JSON of an array of page structs (``schema.PAGE``): type names as strings, nulls left out, computed sizes included."""
    page = lambda p: F.struct(
        p["page_number"].alias("PageNumber"), p["width"].alias("Width"), p["height"].alias("Height"), F.transform(p["blocks"], _block_json).alias("Blocks"), p["rotation"].alias("Rotation"),
        p["skew_angle"].alias("SkewAngle"), p["source_width"].alias("SourceWidth"), p["source_height"].alias("SourceHeight"), ((p["rotation"] != 0) | (p["skew_angle"] != 0)).alias("IsCorrected"),
    )
    return F.to_json(F.struct(F.transform(pages, page).alias("Pages")), {"pretty": str(pretty).lower()})


_BOX_JSON = "struct<MinX:double,MinY:double,MaxX:double,MaxY:double>"
_TABLE_JSON = f"struct<RowCount:int,ColumnCount:int,Cells:array<struct<Row:int,Column:int,RowSpan:int,ColumnSpan:int,IsHeader:boolean,Text:string,BoundingBox:{_BOX_JSON}>>,Html:string>"
DOCUMENT_JSON = (
    f"struct<Pages:array<struct<PageNumber:int,Width:int,Height:int,Blocks:array<struct<Type:string,BoundingBox:{_BOX_JSON},Confidence:float,ReadingOrder:int,RawClassId:int,RawClassName:string,"
    f"Text:string,`Table`:{_TABLE_JSON},Latex:string>>,Rotation:int,SkewAngle:double,SourceWidth:int,SourceHeight:int>>>"
)


def parse_document(json: Column) -> Column:
    """Array of page structs (``schema.PAGE``) from exported JSON; null for text that is not."""
    box = lambda b: F.when(b.isNotNull(), F.struct(b["MinX"].alias("min_x"), b["MinY"].alias("min_y"), b["MaxX"].alias("max_x"), b["MaxY"].alias("max_y")))
    cell = lambda c: F.struct(c["Row"].alias("row"), c["Column"].alias("column"), F.coalesce(c["RowSpan"], F.lit(1)).alias("row_span"), F.coalesce(c["ColumnSpan"], F.lit(1)).alias("column_span"), F.coalesce(c["IsHeader"], F.lit(False)).alias("is_header"), c["Text"].alias("text"), box(c["BoundingBox"]).alias("box"))
    table = lambda t: F.when(t.isNotNull(), F.struct(t["RowCount"].alias("row_count"), t["ColumnCount"].alias("column_count"), F.transform(t["Cells"], cell).alias("cells"), t["Html"].alias("html")))
    block = lambda b: F.struct(b["Type"].alias("type"), box(b["BoundingBox"]).alias("box"), b["Confidence"].alias("confidence"), b["ReadingOrder"].alias("reading_order"), b["RawClassId"].alias("raw_class_id"), F.coalesce(b["RawClassName"], F.lit("")).alias("raw_class_name"), b["Text"].alias("text"), b["Latex"].alias("latex"), table(b["Table"]).alias("table"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    page = lambda p: F.struct(p["PageNumber"].alias("page_number"), p["Width"].alias("width"), p["Height"].alias("height"), zero(p["Rotation"]).alias("rotation"), F.coalesce(p["SkewAngle"], F.lit(0.0)).alias("skew_angle"), zero(p["SourceWidth"]).alias("source_width"), zero(p["SourceHeight"]).alias("source_height"), F.transform(p["Blocks"], block).alias("blocks"))
    return F.transform(F.from_json(json, DOCUMENT_JSON)["Pages"], page)
