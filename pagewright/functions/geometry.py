"""Boxes, letterboxes, page corrections and scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def d(value: float) -> Column:
    return F.lit(float(value))


class Box:
    """Four double columns; a struct column works through ``Box.of``."""

    def __init__(self, x1: Column, y1: Column, x2: Column, y2: Column) -> None:
        self.x1, self.y1, self.x2, self.y2 = x1, y1, x2, y2

    @classmethod
    def of(cls, box: Column) -> Box:
        return cls(box["x1"], box["y1"], box["x2"], box["y2"])

    @classmethod
    def named(cls, prefix: str = "") -> Box:
        return cls(*(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2")))

    @property
    def width(self) -> Column:
        return F.greatest(d(0), self.x2 - self.x1)

    @property
    def height(self) -> Column:
        return F.greatest(d(0), self.y2 - self.y1)

    @property
    def area(self) -> Column:
        return self.width * self.height

    @property
    def center_x(self) -> Column:
        return self.x1 + self.width / d(2)

    @property
    def center_y(self) -> Column:
        return self.y1 + self.height / d(2)

    @property
    def is_empty(self) -> Column:
        """Both sides are zero; one zero side is not enough."""
        return (self.width <= 0) & (self.height <= 0)

    def intersection(self, other: Box) -> Column:
        w = F.greatest(d(0), F.least(self.x2, other.x2) - F.greatest(self.x1, other.x1))
        h = F.greatest(d(0), F.least(self.y2, other.y2) - F.greatest(self.y1, other.y1))
        return w * h

    def iou(self, other: Box) -> Column:
        shared = self.intersection(other)
        union = self.area + other.area - shared
        return F.when(union <= 0, d(0)).otherwise(shared / union)

    def pixel_rect(self, width: Column, height: Column) -> list[Column]:
        """x, y, w, h in pixels: corners clamped to the page and rounded half to even."""
        corner = lambda v, most: F.rint(F.greatest(d(0), F.least(v, most.cast("double")))).cast("int")
        x, y, right, bottom = corner(self.x1, width), corner(self.y1, height), corner(self.x2, width), corner(self.y2, height)
        return [x, y, F.greatest(F.lit(0), right - x), F.greatest(F.lit(0), bottom - y)]

    def clamped(self, width: Column, height: Column) -> Box:
        into = lambda v, most: F.greatest(d(0), F.least(v, most.cast("double")))
        return Box(into(self.x1, width), into(self.y1, height), into(self.x2, width), into(self.y2, height))


def letterbox(width: Column, height: Column, size: int) -> dict[str, Column]:
    """Scale, content size, padding and placement of a page in a square input."""
    scale = F.least(d(size) / width, d(size) / height)
    content = lambda v: F.greatest(F.lit(1), F.least(F.lit(size), F.rint(v * scale).cast("int")))
    cw, ch = content(width), content(height)
    px, py = (d(size) - cw) / d(2), (d(size) - ch) / d(2)
    place = lambda pad: F.greatest(F.lit(0), F.round(pad - d(0.1)).cast("int"))
    return {"scale": scale, "content_width": cw, "content_height": ch, "pad_x": px, "pad_y": py, "left": place(px), "top": place(py)}


def unletterboxed(box: Box, lb: dict[str, Column], width: Column, height: Column) -> Box:
    """A box of the square input in page coordinates, clamped."""
    x, y = (lambda v: (v - lb["pad_x"]) / lb["scale"]), (lambda v: (v - lb["pad_y"]) / lb["scale"])
    return Box(x(box.x1), y(box.y1), x(box.x2), y(box.y2)).clamped(width, height)


def sigmoid(x: Column) -> Column:
    """Logistic function in 32-bit floats, from the side that cannot overflow."""
    x = x.cast("double")
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, d(1) / (d(1) + e)).otherwise(e / (d(1) + e)).cast("float")


def logit(p: float) -> float:
    """Log odds of a probability; -inf at or below 0, inf at or above 1."""
    import math

    return -math.inf if p <= 0 else math.inf if p >= 1 else math.log(p / (1 - p))


def upright_size(width: Column, height: Column, rotation: Column) -> tuple[Column, Column]:
    turned = rotation.isin(90, 270)
    return F.when(turned, height).otherwise(width), F.when(turned, width).otherwise(height)


def source_size(source: Column, corrected: Column) -> Column:
    """The source size; pages that do not know it (0) have the corrected one."""
    return F.when(source > 0, source).otherwise(corrected)


def is_corrected(rotation: Column, skew: Column) -> Column:
    return (rotation != 0) | (skew != 0)


def to_source(x: Column, y: Column, rotation: Column, skew: Column, source_w: Column, source_h: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """A point of the corrected page on the source page: the skew is undone about the centres, then the quarter turn."""
    sw, sh = source_size(source_w, width).cast("double"), source_size(source_h, height).cast("double")
    uw, uh = upright_size(sw, sh, rotation)
    angle = F.radians(skew)
    dx, dy = x - width / d(2), y - height / d(2)
    straight = skew == 0
    ux = F.when(straight, x).otherwise(F.cos(angle) * dx - F.sin(angle) * dy + uw / d(2))
    uy = F.when(straight, y).otherwise(F.sin(angle) * dx + F.cos(angle) * dy + uh / d(2))
    px = F.when(rotation == 90, sw - uy).when(rotation == 180, sw - ux).when(rotation == 270, uy).otherwise(ux)
    py = F.when(rotation == 90, ux).when(rotation == 180, sh - uy).when(rotation == 270, sh - ux).otherwise(uy)
    return px, py


def box_to_source(box: Box, *page: Column) -> Box:
    """The upright box around the four mapped corners."""
    corners = [to_source(x, y, *page) for x in (box.x1, box.x2) for y in (box.y1, box.y2)]
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    return Box(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))


def luma(r: Column, g: Column, b: Column) -> Column:
    """8-bit brightness in integer arithmetic."""
    return F.floor((299 * r + 587 * g + 114 * b + 500) / F.lit(1000)).cast("int")
