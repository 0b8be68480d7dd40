"""Model inputs from page images: stretched, letterboxed or centre-cropped, as float32 NCHW tensors; and crops for recognizers."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.images import pack, unpack
from .correction import resize

# ImageNet's mean and deviation per channel, the gray of letterbox borders, the classifier's sizes.
MEAN, DEVIATION = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
BORDER, SHORT_SIDE, CROP = 114, 256, 224


def interpolation(contract: str) -> str:
    """The kernel a model was trained with: bicubic for the paddle contract, else bilinear."""
    return "bicubic" if contract == "paddle" else "triangle"


def packed(image: np.ndarray, imagenet: bool = False) -> np.ndarray:
    """(1, 3, height, width): pixels from 0 to 1, normalized if asked for."""
    mean, deviation = (np.array(x, np.float32) for x in ((MEAN, DEVIATION) if imagenet else ((0, 0, 0), (1, 1, 1))))
    scaled = image.astype(np.float32) * (np.float32(1) / (np.float32(255) * deviation)) - mean / deviation
    return np.ascontiguousarray(scaled.transpose(2, 0, 1)[None], np.float32)


def stretched(image: np.ndarray, size: int, imagenet: bool = False, kernel: str = "triangle") -> np.ndarray:
    """The whole page on a square, its sides scaled each on its own."""
    same = image.shape[:2] == (size, size)
    return packed(image if same else resize(image, size, size, kernel), imagenet)


def letterbox_place(width: int, height: int, size: int) -> tuple[int, int, int, int]:
    """Content width and height, left and top on a square canvas (``geometry.letterbox`` for one page)."""
    scale = min(size / width, size / height)
    w, h = (max(1, min(size, round(x * scale))) for x in (width, height))
    left, top = (max(0, math.floor((size - x) / 2 - 0.1 + 0.5)) for x in (w, h))
    return w, h, left, top


def letterboxed(image: np.ndarray, size: int, imagenet: bool = False, kernel: str = "triangle") -> np.ndarray:
    """The page scaled by one factor in the middle of a gray square."""
    w, h, left, top = letterbox_place(image.shape[1], image.shape[0], size)
    canvas = np.full((size, size, 3), BORDER, np.uint8)
    canvas[top : top + h, left : left + w] = resize(image, w, h, kernel)[: size - top, : size - left]
    return packed(canvas, imagenet)


def centre_cropped(image: np.ndarray, short_side: int = SHORT_SIDE, crop: int = CROP) -> np.ndarray:
    """The middle square of the page scaled to a short side, normalized as classifiers need it."""
    if short_side < crop:
        raise ValueError("the short side must be at least the crop")
    height, width = image.shape[:2]
    scaled = [max(short_side, round(x * short_side / min(width, height))) for x in (width, height)]
    left, top = ((x - crop) // 2 for x in scaled)
    return packed(resize(image, *scaled)[top : top + crop, left : left + crop], imagenet=True)


def model_input(image: np.ndarray, contract: str, size: int, imagenet: bool = False) -> np.ndarray:
    """The tensor that a detector of the contract takes."""
    make = letterboxed if contract == "yolo" else stretched
    return make(image, size, imagenet, interpolation(contract))


def page_tensors(pages: DataFrame, contract: str, size: int, imagenet: bool = False) -> DataFrame:
    """All columns but ``pixels``, and ``tensor`` (float32, packed); null where a page has no pixels."""
    kept = [f for f in pages.schema.fields if f.name != "pixels"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                width, height, pixels = (row.column(c)[0].as_py() for c in range(3))
                tensor = None if pixels is None else model_input(unpack(width, height, pixels), contract, size, imagenet).tobytes()
                yield pa.RecordBatch.from_arrays([*row.columns[3:], pa.array([tensor], pa.binary())], [*(f.name for f in kept), "tensor"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return pages.select("width", "height", "pixels", *(F.col(f.name).alias(f"_{i}") for i, f in enumerate(kept))).mapInArrow(run, f"{schema}, tensor binary")


def crop(pixels: Column, width: Column, height: Column, rect: list[Column]) -> Column:
    """struct(width, height, pixels) of a region of a page (x, y, width, height; see ``Box.pixel_rect``); null for an empty region.

    For recognizers; the page's pixels meet its blocks by a join on the page.
    """

    def run(p: pa.Array, w: pa.Array, h: pa.Array, *r: pa.Array) -> pa.Array:
        out = []
        for data, width_, height_, *rect_ in zip(p, w, h, *r, strict=True):
            x, y, rw, rh = (v.as_py() for v in rect_)
            if data.as_py() is None or not rw or not rh:
                out.append(None)
                continue
            cut = unpack(width_.as_py(), height_.as_py(), data.as_py())[y : y + rh, x : x + rw]
            out.append(dict(zip(("width", "height", "pixels"), pack(cut), strict=True)))
        return pa.array(out, pa.struct([("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.binary())]))

    return F.arrow_udf(run, "width int, height int, pixels binary")(pixels, width, height, *rect)
