"""Types, options and errors of the layout engine."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

BOX = "struct<min_x:double,min_y:double,max_x:double,max_y:double>"
CELL = f"struct<row:int,column:int,row_span:int,column_span:int,is_header:boolean,text:string,box:{BOX}>"
TABLE = f"struct<row_count:int,column_count:int,cells:array<{CELL}>,html:string>"
#: One region of a page in reading order; confidence is a 32-bit float, as detectors give it.
BLOCK = f"struct<type:string,box:{BOX},confidence:float,reading_order:int,raw_class_id:int,raw_class_name:string,text:string,latex:string,`table`:{TABLE}>"
PAGE = f"struct<page_number:int,width:int,height:int,rotation:int,skew_angle:double,source_width:int,source_height:int,blocks:array<{BLOCK}>>"


class LayoutError(Exception):
    """Base of the engine's errors."""


class InvalidOptionError(LayoutError, ValueError):
    """An option is out of its range."""


class ImageTooLargeError(LayoutError):
    """A page has more pixels than allowed."""


class ImageFormatError(LayoutError, ValueError):
    """An image is empty, broken or of an unknown format."""


class TooManyPagesError(LayoutError):
    """A document has more pages than allowed."""


class ModelFileError(LayoutError):
    """A model file is missing or is not the expected one."""


class ModelOutputError(LayoutError):
    """A model's outputs do not follow its contract."""


def _check(ok: bool, name: str, value: object, rule: str) -> None:
    if not ok:
        raise InvalidOptionError(f"{name} is {value!r}; {rule}")


def _fraction(value: float) -> bool:
    return not math.isnan(value) and 0 <= value <= 1


ORDER_SOURCES = ("auto", "xycut", "model")


@dataclass(frozen=True)
class AnalysisOptions:
    """Options of one analysis; thresholds of scores and overlap are compared as 32-bit floats."""

    confidence_threshold: float = 0.5
    recognize_text: bool = True
    recognition_parallelism: int = 1
    duplicate_iou_threshold: float = 0.6
    suppress_nested_duplicates: bool = True
    min_figure_area_fraction: float = 0.001
    reading_order_overlap_tolerance: float = 0.005
    pin_page_furniture: bool = True
    deskew: bool = False
    deskew_max_angle: float = 15.0
    reading_order_source: str = "auto"
    recognize_tables: bool = True
    recognize_formulas: bool = True
    page_parallelism: int = 1

    def __post_init__(self) -> None:
        for name in ("confidence_threshold", "duplicate_iou_threshold", "min_figure_area_fraction"):
            _check(_fraction(getattr(self, name)), name, getattr(self, name), "it must be from 0 to 1")
        tolerance = self.reading_order_overlap_tolerance
        _check(not math.isnan(tolerance) and tolerance >= 0, "reading_order_overlap_tolerance", tolerance, "it must be 0 or more")
        _check(0 < self.deskew_max_angle <= 45, "deskew_max_angle", self.deskew_max_angle, "it must be over 0 and at most 45")
        _check(self.reading_order_source in ORDER_SOURCES, "reading_order_source", self.reading_order_source, f"it must be one of {ORDER_SOURCES}")
        for name in ("recognition_parallelism", "page_parallelism"):
            _check(getattr(self, name) >= 1, name, getattr(self, name), "it must be 1 or more")


CONTRACTS = ("paddle", "detr", "yolo")


@dataclass(frozen=True)
class CustomModel:
    """A detector of the user's own: file, input size, labels in class order and output contract."""

    path: str
    input_size: int
    labels: Sequence[str]
    contract: str
    imagenet_normalize: bool = False
    type_map: Mapping[str, str] = field(default_factory=dict)
    sha256: str | None = None
    display_name: str | None = None

    def __post_init__(self) -> None:
        _check(bool(self.path and self.path.strip()), "path", self.path, "it must not be blank")
        _check(64 <= self.input_size <= 4096 and self.input_size % 32 == 0, "input_size", self.input_size, "it must be a multiple of 32 from 64 to 4096")
        _check(len(self.labels) > 0, "labels", self.labels, "there must be one at least")
        _check(all(isinstance(x, str) and x.strip() for x in self.labels), "labels", self.labels, "none may be blank")
        _check(len(set(self.labels)) == len(self.labels), "labels", self.labels, "they must differ")
        _check(self.contract in CONTRACTS, "contract", self.contract, f"it must be one of {CONTRACTS}")
        digits = set("0123456789abcdefABCDEF")
        _check(self.sha256 is None or (len(self.sha256) == 64 and set(self.sha256) <= digits), "sha256", self.sha256, "it must be 64 hexadecimal digits")


MODELS = ("v3", "heron", "custom")


@dataclass(frozen=True)
class ServiceOptions:
    """Options of a service; naming a custom model alone chooses it."""

    model: str | None = None
    use_gpu: bool = False
    offline: bool = False
    model_cache_path: str | None = None
    max_image_pixels: int = 100_000_000
    correct_orientation: bool = False
    orientation_confidence_threshold: float = 0.6
    max_pages: int = 500
    intra_op_threads: int | None = None
    custom_model: CustomModel | None = None

    def __post_init__(self) -> None:
        model = self.model or ("custom" if self.custom_model else "v3")
        _check(model in MODELS, "model", model, f"it must be one of {MODELS}")
        _check((model == "custom") == (self.custom_model is not None), "model", model, "a custom model goes with custom, and only with it")
        object.__setattr__(self, "model", model)
        _check(self.max_image_pixels > 0, "max_image_pixels", self.max_image_pixels, "it must be over 0")
        _check(self.max_pages > 0, "max_pages", self.max_pages, "it must be over 0")
        _check(self.intra_op_threads is None or self.intra_op_threads > 0, "intra_op_threads", self.intra_op_threads, "it must be over 0")
        _check(_fraction(self.orientation_confidence_threshold), "orientation_confidence_threshold", self.orientation_confidence_threshold, "it must be from 0 to 1")
