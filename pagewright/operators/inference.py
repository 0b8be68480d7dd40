"""Detectors and the orientation classifier over page images, one ONNX session per Python worker.

A worker opens a model once and keeps it; pages come to it as Arrow rows, and what leaves is the model's raw
rows, which ``decode`` turns into detections by column expressions. Parallelism is that of Spark's tasks, so a
session computes with ``threads`` of its own (one unless told otherwise). The model file must be where every executor
can read it; ``model_file`` finds and checks it on the driver.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import taxonomy
from ..schema import AnalysisOptions, CustomModel, ModelFileError, ModelOutputError
from ..sources.images import pack, unpack
from . import correction, decode, tensors

#: Where model files are looked for if a service names no folder.
CACHE_VARIABLE = "PAGEWRIGHT_MODELS"
_IMAGE_NAMES = {"paddle": "image", "detr": "pixel_values", "yolo": "images"}
_INPUT_SIZES = {"v3": 800, "heron": 640}


@dataclass(frozen=True)
class FileProgress:
    """How far a model file has been read; ``total`` is null while it is not known."""

    name: str
    done: int
    total: int | None = None
    resumed_from: int = 0
    attempt: int = 1

    @property
    def percent(self) -> float | None:
        return min(100.0, 100.0 * self.done / self.total) if self.total else None

    @property
    def is_resumed(self) -> bool:
        return self.resumed_from > 0

    @property
    def is_complete(self) -> bool:
        return bool(self.total) and self.done >= self.total


def _digest(path: Path, progress: Callable[[FileProgress], None] | None) -> str:
    total, done, found = path.stat().st_size, 0, hashlib.sha256()
    with path.open("rb") as f:
        while part := f.read(1 << 22):
            found.update(part)
            done += len(part)
            if progress:
                progress(FileProgress(path.name, done, total))
    return found.hexdigest()


def model_file(name: str, cache: str | None = None, sha256: str | None = None, progress: Callable[[FileProgress], None] | None = None) -> str:
    """The path of a model file: as given if it names a file, else in the cache folder (option, environment, user's cache).

    With a checksum the file is read once, telling ``progress`` about it, and must have it. Nothing is downloaded.
    """
    folder = cache or os.environ.get(CACHE_VARIABLE) or str(Path.home() / ".cache" / "pagewright")
    path = next((p for p in (Path(name), Path(folder) / name) if p.is_file()), None)
    if path is None:
        raise ModelFileError(f"model file {name!r} is neither a path nor in {folder}")
    if sha256 is not None:
        found = _digest(path, progress)
        if found != sha256.lower():
            raise ModelFileError(f"model file {path} has SHA-256 {found}, not {sha256.lower()}")
    return str(path)


@dataclass(frozen=True)
class Detector:
    """What is needed to run a detector: its file, contract, input size, class labels and normalization."""

    path: str
    contract: str
    input_size: int
    labels: tuple[str, ...]
    imagenet: bool = False
    type_map: tuple[tuple[str, str], ...] | None = None
    threads: int = 1

    @classmethod
    def custom(cls, model: CustomModel, cache: str | None = None, threads: int = 1) -> Detector:
        return cls(model_file(model.path, cache, model.sha256), model.contract, model.input_size, tuple(model.labels), model.imagenet_normalize, tuple(model.type_map.items()), threads)

    @classmethod
    def built_in(cls, name: str, path: str, threads: int = 1) -> Detector:
        return cls(model_file(path), "paddle" if name == "v3" else "detr", _INPUT_SIZES[name], tuple(taxonomy.VOCABULARIES[name]), threads=threads)


def open_session(path: str, threads: int = 1) -> Any:
    import onnxruntime

    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = threads
    options.log_severity_level = 3
    try:
        return onnxruntime.InferenceSession(path, options, providers=["CPUExecutionProvider"])
    except Exception as e:
        raise ModelFileError(f"model {path} cannot be opened: {e}") from e


_sessions: dict[tuple, Any] = {}


def _session(path: str, threads: int, factory: Callable[[str, int], Any]) -> Any:
    """The worker's session of a model; opened at first use."""
    key = (path, threads, getattr(factory, "__qualname__", repr(factory)))
    if key not in _sessions:
        _sessions[key] = factory(path, threads)
    return _sessions[key]


def image_input(session: Any, contract: str | None = None) -> str:
    """The input that takes the image: the one with the contract's name, else the first of four dimensions."""
    inputs = session.get_inputs()
    named = [i.name for i in inputs if i.name == _IMAGE_NAMES.get(contract)]
    found = named or [i.name for i in inputs if len(i.shape) == 4]
    if not found:
        raise ModelOutputError(f"the model has no image input of four dimensions; inputs: {', '.join(i.name for i in inputs)}")
    return found[0]


def _is_float(kind: str) -> bool:
    return kind == "tensor(float)"


def wanted_outputs(session: Any, contract: str, classes: int) -> list[str] | None:
    """The outputs worth computing, from the model's declared shapes; null for all. A raw YOLO head is refused here."""
    outputs = session.get_outputs()
    if contract == "paddle":
        rows = [o.name for o in outputs if _is_float(o.type) and len(o.shape) == 2 and o.shape[1] in (6, 7)][:1]
        counts = [o.name for o in outputs if o.type == "tensor(int32)" and len(o.shape) == 1][:1]
        return rows + counts if rows else None
    if contract == "yolo":
        shapes = {o.name: o.shape for o in outputs if _is_float(o.type) and len(o.shape) in (2, 3)}
        open_ended = any(not isinstance(x, int) or x < 0 for s in shapes.values() for x in s)
        if not open_ended and not any(s[-1] == 6 for s in shapes.values()):
            raw = next((n for n, s in shapes.items() if len(s) == 3 and 4 + classes in s[1:]), None)
            said = f"output {raw!r} is a raw head without suppression; export the model with it in the graph" if raw else "no output has rows of 6 values"
            raise ModelOutputError(f"{said}; outputs: {', '.join(f'{o.name} {o.shape}' for o in outputs)}")
    return None


def raw_rows(named: dict[str, np.ndarray], contract: str, classes: int) -> dict[str, Any]:
    """What ``decode`` needs from a model's outputs, found by name, rank and type.

    paddle: ``rows``, ``count``, ``stride``; yolo: ``rows``; detr: ``logits``, ``boxes``, ``classes``, which must be as
    many as the labels, or one more ("nothing").
    """
    floats = {n: v for n, v in named.items() if v.dtype == np.float32}
    if contract == "paddle":
        rows = [v for v in floats.values() if v.ndim == 2 and v.shape[1] in (6, 7)]
        counts = [int(v[0]) for v in named.values() if v.dtype == np.int32 and v.ndim == 1 and len(v)]
        if not rows:
            raise ModelOutputError("the model gave no rows of 6 or 7 values (class, score, box, order)")
        return {"rows": rows[-1].ravel(), "count": counts[-1] if counts else 0, "stride": rows[-1].shape[1]}
    if contract == "yolo":
        rows = [v for v in floats.values() if v.ndim in (2, 3) and v.shape[-1] == 6]
        if not rows:
            raise ModelOutputError("the model gave no rows of 6 values (box, score, class)")
        return {"rows": rows[0].ravel()}
    three = {n: v for n, v in floats.items() if v.ndim == 3}
    boxes = three.get("pred_boxes", next((v for n, v in three.items() if v.shape[2] == 4 and n != "logits"), None))
    logits = three.get("logits", next((v for v in three.values() if v is not boxes and (v.shape[2] == classes or v.shape[2] > 4)), None))
    if boxes is None or logits is None:
        raise ModelOutputError("the model gave no logits and boxes of queries")
    if logits.shape[2] not in (classes, classes + 1):
        raise ModelOutputError(f"the model's logits have {logits.shape[2]} classes, but {classes} labels are given")
    n = min(logits.shape[1], boxes.shape[1])
    return {"logits": logits[0, :n].ravel(), "boxes": boxes[0, :n].ravel(), "classes": logits.shape[2]}


def infer(session: Any, detector: Detector, image: np.ndarray) -> dict[str, Any]:
    """Raw rows of one page."""
    size, contract = detector.input_size, detector.contract
    feed = {image_input(session, contract): tensors.model_input(image, contract, size, detector.imagenet)}
    names = {i.name for i in session.get_inputs()}
    if contract == "paddle":
        feed |= {n: np.array([v], np.float32) for n, v in (("scale_factor", (1, 1)), ("im_shape", (size, size))) if n in names}
    wanted = wanted_outputs(session, contract, len(detector.labels))
    found = session.run(wanted, feed)
    return raw_rows(dict(zip(wanted or [o.name for o in session.get_outputs()], found, strict=True)), contract, len(detector.labels))


_RAW = {"rows": "array<float>", "count": "int", "stride": "int", "logits": "array<float>", "boxes": "array<float>", "classes": "int"}


def run_detector(pages: DataFrame, detector: Detector, page: list[str], factory: Callable[[str, int], Any] = open_session) -> DataFrame:
    """The page columns, ``width``, ``height`` and the model's raw rows; pages without pixels (errors) are left out."""
    kinds = {"array<float>": pa.list_(pa.float32()), "int": pa.int32()}
    names = [*page, "width", "height", *_RAW]
    schema = ", ".join([*(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in page), "width int, height int", *(f"{c} {t}" for c, t in _RAW.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                width, height, pixels = (batch.column(len(page) + c)[k].as_py() for c in range(3))
                found = infer(_session(detector.path, detector.threads, factory), detector, unpack(width, height, pixels))
                raw = [pa.array([found.get(c)], kinds[t]) for c, t in _RAW.items()]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(k, 1) for c in range(len(page) + 2)), *raw], names)

    return pages.filter("pixels is not null").select(*page, F.col("width").cast("int"), F.col("height").cast("int"), "pixels").mapInArrow(run, schema)


def detect(pages: DataFrame, detector: Detector, options: AnalysisOptions | None = None, *, page: list[str], factory: Callable[[str, int], Any] = open_session) -> DataFrame:
    """Detections of all pages, ready for ``plans.analyze``: page columns, ``width``, ``height``, ``det_pos``, class, score, hint, box."""
    threshold = (options or AnalysisOptions()).confidence_threshold
    raw = run_detector(pages, detector, page, factory)
    if detector.contract == "yolo":
        return decode.decode_yolo(raw.drop("count", "stride", "logits", "boxes", "classes"), threshold, detector.input_size)
    if detector.contract == "detr":
        # The model says how many classes there are, one more than the labels if the last is "nothing".
        n = len(detector.labels)
        parts = [decode.decode_detr(raw.filter(F.col("classes") == k).drop("rows", "count", "stride", "classes"), threshold, k) for k in (n, n + 1)]
        return parts[0].unionByName(parts[1])
    parts = [decode.decode_paddle(raw.filter(F.col("stride") == k).drop("stride", "logits", "boxes", "classes"), threshold, detector.input_size, stride=k, count="count").drop("count") for k in (6, 7)]
    return parts[0].unionByName(parts[1])


def classes_of(spark: SparkSession, detector: Detector) -> DataFrame:
    """The classes of a detector for ``plans.analyze``: a built-in vocabulary, or a user's labels with their map."""
    custom = detector.type_map is not None
    return taxonomy.vocabulary(spark, list(detector.labels), dict(detector.type_map or ()), custom=custom)


def orientation(pages: DataFrame, path: str, *, threads: int = 1, factory: Callable[[str, int], Any] = open_session) -> DataFrame:
    """All columns and ``orientation``: struct(rotation, confidence, p0, p90, p180, p270); null for pages without pixels."""
    kept = pages.columns

    def run(pixels: pa.Array, width: pa.Array, height: pa.Array) -> pa.Array:
        out = []
        for p, w, h in zip(pixels, width, height, strict=True):
            if p.as_py() is None:
                out.append(None)
                continue
            session = _session(path, threads, factory)
            (values, *_) = session.run(None, {image_input(session): tensors.centre_cropped(unpack(w.as_py(), h.as_py(), p.as_py()))})
            out.append(values.ravel().astype(np.float32).tolist())
        return pa.array(out, pa.list_(pa.float32()))

    values = F.arrow_udf(run, "array<float>").asNondeterministic()(F.col("pixels"), F.col("width"), F.col("height"))
    told = pages.withColumn("_values", values)
    return told.select(*kept, F.when(F.col("_values").isNotNull(), decode.decode_orientation(F.col("_values"))).alias("orientation"))


def correct_pages(pages: DataFrame, *, orientation_column: str | None = None, threshold: float = 0.6, deskew: bool = False, max_angle: float = 15.0) -> DataFrame:
    """The pages upright and straight: ``width``, ``height`` and ``pixels`` anew, and ``rotation``, ``skew_angle``, ``source_width``, ``source_height``.

    A page is turned if the orientation's confidence reaches the threshold, then straightened if its skew is
    reliable. Pages without pixels and pages to which nothing applies pass as they are. Other columns stay.
    """
    added = ["rotation", "skew_angle", "source_width", "source_height"]
    same = [f for f in pages.schema.fields if f.name not in ("width", "height", "pixels", *added)]
    names = [*(f.name for f in same), "width", "height", "pixels", *added]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in same), "width int, height int, pixels binary, rotation int, skew_angle double, source_width int, source_height int"])
    types = [pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.float64(), pa.int32(), pa.int32()]
    none = F.lit(None)
    turned = (F.col(orientation_column)["rotation"], F.col(orientation_column)["confidence"]) if orientation_column else (none.cast("int"), none.cast("float"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                width, height, pixels, rotation, confidence = (batch.column(c)[k].as_py() for c in range(5))
                row = (width, height, pixels, 0, 0.0, width, height)
                if pixels is not None:
                    image, rotation, skew = correction.correct_page(unpack(width, height, pixels), rotation=rotation or 0, rotation_confidence=confidence or 0.0, orientation_threshold=threshold, deskew=deskew, max_angle=max_angle)
                    row = (*pack(image), rotation, skew, width, height)
                yield pa.RecordBatch.from_arrays([*(c.slice(k, 1) for c in batch.columns[5:]), *(pa.array([v], t) for v, t in zip(row, types, strict=True))], names)

    first = [F.col("width").cast("int"), F.col("height").cast("int"), F.col("pixels"), turned[0].alias("_turned"), turned[1].alias("_sure")]
    return pages.select(*first, *(F.col(f.name).alias(f"_{i}") for i, f in enumerate(same))).mapInArrow(run, schema)
