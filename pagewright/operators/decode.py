"""Raw detector outputs to detections, as column expressions over packed float rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Box, d, letterbox, logit, sigmoid, unletterboxed
from ..schema import ModelOutputError


def _rows(frame: DataFrame, values: str, stride: int, count: Column | None) -> DataFrame:
    """One row per stretch of ``stride`` floats, ``det_pos`` first to last; a count of 0 or less, or none, means all."""
    held = F.floor(F.size(values) / F.lit(stride)).cast("int")
    n = held if count is None else F.when(count <= 0, held).otherwise(F.least(held, count.cast("int")))
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    row = F.transform(at, lambda k: F.struct(k.alias("pos"), F.slice(F.col(values), k * stride + 1, F.lit(stride)).alias("v")))
    return frame.withColumn("_row", F.explode(row)).withColumn("det_pos", F.col("_row.pos")).withColumn("_v", F.col("_row.v")).drop("_row", values)


def _value(k: int) -> Column:
    return F.col("_v")[k]


def _finite(*columns: Column) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & ~F.isnan(c)
    return out


def _kept(frame: DataFrame, box: Box, class_id: Column, score: Column, hint: Column) -> DataFrame:
    """The detections without their raw row; boxes under a pixel wide or high go."""
    score = F.greatest(F.lit(0.0).cast("float"), F.least(F.lit(1.0).cast("float"), score))
    out = frame.select("*", class_id.alias("class_id"), score.alias("score"), hint.alias("order_hint"), box.x1.alias("x1"), box.y1.alias("y1"), box.x2.alias("x2"), box.y2.alias("y2"))
    return out.drop("_v").filter((Box.named().width >= 1) & (Box.named().height >= 1))


def decode_paddle(frame: DataFrame, threshold: float, input_size: int, *, values: str = "rows", stride: int = 6, count: str | None = None) -> DataFrame:
    """Rows ``class, score, x1, y1, x2, y2 (, order)`` in input pixels; needs ``width`` and ``height`` of the page.

    Rows with a negative or NaN class, a NaN score or a NaN corner, or a score under the threshold, go. The
    order key, if there is one, is the hint unless it is NaN or negative (-1: none).
    """
    if stride < 6:
        raise ModelOutputError(f"rows have {stride} values; 6 or 7 are needed")
    rows = _rows(frame, values, stride, F.col(count) if count else None)
    rows = rows.filter(_finite(*(_value(k) for k in range(6))) & (_value(0) >= 0) & (_value(1) >= F.lit(threshold).cast("float")))
    sx, sy = F.col("width") / d(input_size), F.col("height") / d(input_size)
    x, y = (lambda k: _value(k).cast("double") * sx), (lambda k: _value(k).cast("double") * sy)
    box = Box(x(2), y(3), x(4), y(5)).clamped(F.col("width"), F.col("height"))
    hint = F.when(~F.isnan(_value(6)) & (_value(6) >= 0), _value(6).cast("int")).otherwise(-1) if stride >= 7 else F.lit(-1)
    return _kept(rows, box, _value(0).cast("int"), _value(1), hint)


def decode_yolo(frame: DataFrame, threshold: float, input_size: int, *, values: str = "rows", count: str | None = None) -> DataFrame:
    """Rows ``x1, y1, x2, y2, score, class`` of a letterboxed page; padding rows of zeros fall under a pixel."""
    rows = _rows(frame, values, 6, F.col(count) if count else None)
    rows = rows.filter(_finite(*(_value(k) for k in range(6))) & (_value(5) >= 0) & (_value(4) >= F.lit(threshold).cast("float")))
    raw = Box(*(_value(k).cast("double") for k in range(4)))
    box = unletterboxed(raw, letterbox(F.col("width"), F.col("height"), input_size), F.col("width"), F.col("height"))
    return _kept(rows, box, _value(5).cast("int"), _value(4), F.lit(-1))


def decode_detr(frame: DataFrame, threshold: float, classes: int, *, logits: str = "logits", boxes: str = "boxes") -> DataFrame:
    """Class logits and centre boxes per query; needs ``width`` and ``height`` of the page.

    The first class with the largest logit wins; it is compared with the threshold's log odds, and only
    survivors get a score. A NaN in the first class drops the query, a later NaN loses. Corners are computed
    in 32-bit floats.
    """
    f = lambda c: c.cast("float")
    queries = F.least(F.floor(F.size(logits) / F.lit(classes)), F.floor(F.size(boxes) / F.lit(4))).cast("int")
    at = F.when(queries > 0, F.sequence(F.lit(0), queries - 1)).otherwise(F.array().cast("array<int>"))
    pair = F.transform(at, lambda q: F.struct(q.alias("pos"), F.slice(F.col(logits), q * classes + 1, F.lit(classes)).alias("l"), F.slice(F.col(boxes), q * 4 + 1, F.lit(4)).alias("v")))
    rows = frame.withColumn("_row", F.explode(pair)).withColumn("det_pos", F.col("_row.pos")).withColumn("_l", F.col("_row.l")).withColumn("_v", F.col("_row.v")).drop("_row", logits, boxes)
    best = F.array_max(F.filter("_l", lambda x: ~F.isnan(x)))
    rows = rows.withColumn("_best", best).filter(~F.isnan(F.col("_l")[0]) & F.col("_best").isNotNull() & _finite(*(_value(k) for k in range(4))))
    least = logit(threshold)
    rows = rows.filter(F.col("_best") >= F.lit(least).cast("float")) if least > float("-inf") else rows
    rows = rows.withColumn("_class", (F.array_position("_l", F.col("_best")) - 1).cast("int")).withColumn("_score", sigmoid(F.col("_best")))
    w, h = f(F.col("width")), f(F.col("height"))
    half = F.lit(0.5).cast("float")
    mul = lambda a, b: f(f(a) * f(b))  # noqa: E731  products of floats are kept in 32 bits
    left, top = f(_value(0) - mul(_value(2), half)), f(_value(1) - mul(_value(3), half))
    right, bottom = f(_value(0) + mul(_value(2), half)), f(_value(1) + mul(_value(3), half))
    box = Box(*(mul(c, s).cast("double") for c, s in ((left, w), (top, h), (right, w), (bottom, h)))).clamped(F.col("width"), F.col("height"))
    return _kept(rows, box, F.col("_class"), F.col("_score"), F.lit(-1)).drop("_l", "_best", "_class", "_score")


def decode_orientation(values: Column) -> Column:
    """struct(rotation, confidence, p0, p90, p180, p270) from four probabilities or logits, in 64-bit floats.

    Values that lie from 0 to 1 and sum to 1 within 0.01 are probabilities; others go through softmax.
    """
    v = [F.get(values, F.lit(k)).cast("double") for k in range(4)]
    total = v[0] + v[1] + v[2] + v[3]
    probabilities = F.abs(total - d(1)) <= d(0.01)
    for x in v:
        probabilities = probabilities & (x >= 0) & (x <= 1) & ~F.isnan(x)
    most = F.greatest(*v)
    e = [F.exp(x - most) for x in v]
    denominator = e[0] + e[1] + e[2] + e[3]
    p = F.array(*(F.when(probabilities, x).otherwise(y / denominator) for x, y in zip(v, e, strict=True)))
    best = F.array_position(p, F.array_max(p)).cast("int") - 1
    short = F.raise_error(F.lit("an orientation model must give 4 values")).cast("int")
    rotation = F.when(F.size(values) < 4, short).otherwise(best * 90)
    return F.struct(rotation.alias("rotation"), F.array_max(p).alias("confidence"), *(p[k].alias(f"p{90 * k}") for k in range(4)))
