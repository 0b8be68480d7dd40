"""Images in, detections out: decoders, tensors, sessions with small hand-made models, page correction, the service."""

import hashlib
import struct
import warnings
import zlib

import numpy as np
import pytest
from pagewright.operators import correction, guards, inference, tensors
from pagewright.plans import service
from pagewright.plans.service import LayoutService
from pagewright.schema import TABLE, AnalysisOptions, CustomModel, ImageFormatError, LayoutError, ModelFileError, ModelOutputError, ServiceOptions
from pagewright.sources import images
from pyspark.sql import functions as F

RNG = np.random.default_rng(4)
PICTURE = RNG.integers(0, 256, (7, 11, 3)).astype(np.uint8)


def png(image, kinds=(0, 1, 2, 3, 4), color=2, depth=8, palette=b""):
    """A PNG whose rows use the filters in turn."""
    rows = image.reshape(len(image), -1).astype(int)
    step = 3 if color == 2 else 1
    raw, above = b"", np.zeros(rows.shape[1], int)
    for y, row in enumerate(rows):
        kind = kinds[y % len(kinds)]
        left, corner = np.r_[np.zeros(step, int), row[:-step]], np.r_[np.zeros(step, int), above[:-step]]
        p = left + above - corner
        pa, pb, pc = abs(p - left), abs(p - above), abs(p - corner)
        paeth = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, above, corner))
        guess = [0 * row, left, above, (left + above) // 2, paeth][kind]
        raw += bytes([kind]) + ((row - guess) % 256).astype(np.uint8).tobytes()
        above = row
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    width = image.shape[1] * 8 // depth if color == 0 else image.shape[1]
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(image), depth, color, 0, 0, 0)) + palette + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def bmp(image):
    height, width = image.shape[:2]
    stride = -(-width * 3 // 4) * 4
    rows = b"".join(r[:, ::-1].tobytes().ljust(stride, b"\0") for r in image[::-1])
    return b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows


def tiff(pictures, packing=1, order="<"):
    """Pages of RGB strips, one strip each."""
    pack = {1: bytes, 8: zlib.compress, 32773: lambda b: b"".join(bytes([len(b[k : k + 100]) - 1]) + b[k : k + 100] for k in range(0, len(b), 100))}[packing]
    out = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8)
    for k, image in enumerate(pictures):
        body = pack(image.tobytes())
        tags = [(256, 4, image.shape[1]), (257, 4, image.shape[0]), (258, 3, 8), (259, 3, packing), (262, 3, 2), (273, 4, 0), (277, 3, 3), (278, 4, image.shape[0]), (279, 4, len(body))]
        at = len(out)
        place = at + 2 + 12 * len(tags) + 4
        out += struct.pack(order + "H", len(tags))
        for tag, kind, value in tags:
            value = place if tag == 273 else value
            out += struct.pack(order + "HHI", tag, kind, 1) + (struct.pack(order + "I", value) if kind == 4 else struct.pack(order + "HH", value, 0))
        out += struct.pack(order + "I", place + len(body) if k + 1 < len(pictures) else 0) + body
    return out


def gif_codes(indices, bits):
    """GIF codes without compression: a clear code before the table can grow."""
    codes, clear = [], 1 << bits
    for k, value in enumerate(indices):
        if k % (clear - 2) == 0:
            codes.append(clear)
        codes.append(value)
    codes.append(clear + 1)
    held = sum(c << (k * (bits + 1)) for k, c in enumerate(codes))
    data = held.to_bytes(-(-len(codes) * (bits + 1) // 8), "little")
    return b"".join(bytes([len(data[k : k + 255])]) + data[k : k + 255] for k in range(0, len(data), 255)) + b"\0"


def gif(frames, palette):
    """Frames of palette indices; from the second on index 0 is transparent."""
    height, width = frames[0].shape
    out = b"GIF89a" + struct.pack("<HHBBB", width, height, 0x80 | 2, 0, 0) + palette.tobytes()
    for k, f in enumerate(frames):
        out += b"\x21\xf9\x04" + bytes([k > 0]) + b"\0\0\0\0" + b"\x2c" + struct.pack("<HHHHB", 0, 0, width, height, 0) + b"\x03" + gif_codes(f.ravel().tolist(), 3)
    return out + b"\x3b"


def test_decoders():
    same = lambda data, image=PICTURE, k=0: np.array_equal(images.opened(data).frame(k), image)
    assert same(png(PICTURE)) and same(bmp(PICTURE))
    gray = PICTURE[..., :1]
    assert same(png(gray, color=0), gray.repeat(3, axis=2))
    bits = RNG.integers(0, 2, (5, 16)).astype(np.uint8)
    assert same(png(np.packbits(bits, axis=1)[..., None], kinds=(0,), color=0, depth=1), (bits * 255)[..., None].repeat(3, axis=2))
    assert same(b"P6 # note\n11 7\n255\n" + PICTURE.tobytes()) and same(b"P5 11 7 255\n" + gray.tobytes(), gray.repeat(3, axis=2))
    other = RNG.integers(0, 256, (3, 4, 3)).astype(np.uint8)
    for packing in (1, 8, 32773):
        for order in "<>":
            pages = images.opened(tiff([PICTURE, other], packing, order))
            assert pages.sizes == [(11, 7), (4, 3)] and np.array_equal(pages.frame(0), PICTURE) and np.array_equal(pages.frame(1), other)
    palette = RNG.integers(0, 256, (8, 3)).astype(np.uint8)
    first, second = (RNG.integers(0, 8, (6, 9)).astype(np.uint8) for _ in range(2))
    film = images.opened(gif([first, second], palette))
    assert len(film.sizes) == 2 and np.array_equal(film.frame(0), palette[first])
    assert np.array_equal(film.frame(1), palette[np.where(second == 0, first, second)])
    # LZW of TIFF: codes of 9 bits, high bits first
    codes = "".join(f"{c:09b}" for c in (256, 65, 66, 258, 257))
    assert images._lzw(int(codes.ljust(48, "0"), 2).to_bytes(6, "big"), 8, True) == b"ABAB"
    for broken in (b"", b"hello", png(PICTURE)[:30], b"GIF89a", b"II*\0"):
        (row,) = images.pages_of(broken)
        assert row[3] is None and row[4]
    with pytest.raises(ImageFormatError):
        images.unpack(3, 3, b"x")


def test_frames_of_files_and_streams(spark, tmp_path):
    (tmp_path / "a.tiff").write_bytes(tiff([PICTURE, PICTURE[::-1].copy(), PICTURE]))
    (tmp_path / "b.png").write_bytes(png(PICTURE))
    (tmp_path / "c.txt").write_bytes(b"no image")
    rows = images.read_frames(spark, str(tmp_path)).collect()
    told = sorted((r.path.rsplit("/", 1)[1], r.page_number, r.width, r.error is None) for r in rows)
    assert told == [("a.tiff", 1, 11, True), ("a.tiff", 2, 11, True), ("a.tiff", 3, 11, True), ("b.png", 1, 11, True), ("c.txt", 1, None, False)]
    limited = images.read_frames(spark, str(tmp_path), max_pages=2, max_pixels=70).collect()
    errors = {r.path.rsplit("/", 1)[1]: r.error for r in limited}
    assert "3 pages" in errors["a.tiff"] and "77 pixels" in errors["b.png"]
    by_jvm = {r.path.rsplit("/", 1)[1]: bytes(r.pixels) for r in images.read_images(spark, str(tmp_path)).collect() if r.error is None}
    assert by_jvm["b.png"] == PICTURE.tobytes()
    with pytest.raises(Exception, match="cannot be read"):
        guards.enforce(images.read_frames(spark, str(tmp_path)), F.col("error")).collect()
    stream = images.read_frames(spark, str(tmp_path), streaming=True)
    query = stream.writeStream.format("memory").queryName("frames").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("frames").count() == len(rows)


def test_tensors():
    flat = np.full((10, 20, 3), (10, 20, 30), np.uint8)
    t = tensors.stretched(flat, 32)
    assert t.shape == (1, 3, 32, 32) and t.dtype == np.float32 and np.allclose(t[0, :, 5, 5], np.array([10, 20, 30]) / 255)
    n = tensors.stretched(flat, 32, imagenet=True, kernel="bicubic")
    assert np.allclose(n[0, :, 0, 0], (np.array([10, 20, 30]) / 255 - tensors.MEAN) / tensors.DEVIATION, atol=1e-6)
    box = tensors.letterboxed(flat, 64)
    assert tensors.letterbox_place(20, 10, 64) == (64, 32, 0, 16) and np.allclose(box[0, :, 0, 0], 114 / 255) and np.allclose(box[0, :, 32, 32], np.array([10, 20, 30]) / 255)
    assert tensors.letterbox_place(2816, 1536, 640) == (640, 349, 0, 145)
    wide = np.zeros((256, 512, 3), np.uint8)
    wide[:, 144:368] = 200
    c = tensors.centre_cropped(wide)
    assert c.shape == (1, 3, 224, 224) and np.allclose(c[0, 0], c[0, 0, 0, 0]) and c[0, 0, 0, 0] > 0
    with pytest.raises(ValueError):
        tensors.centre_cropped(wide, 100, 224)
    assert (tensors.interpolation("paddle"), tensors.interpolation("yolo")) == ("bicubic", "triangle")
    assert np.array_equal(tensors.stretched(PICTURE[:7, :7], 7), tensors.packed(PICTURE[:7, :7]))


def test_tensors_and_crops_of_pages(spark):
    page = (1, 11, 7, PICTURE.tobytes())
    pages = spark.createDataFrame([page, (2, None, None, None)], "page int, width int, height int, pixels binary")
    rows = {r.page: r.tensor for r in tensors.page_tensors(pages, "yolo", 64).collect()}
    assert rows[2] is None and np.array_equal(np.frombuffer(rows[1], np.float32), tensors.letterboxed(PICTURE, 64).ravel())
    rect = [F.lit(v) for v in (2, 1, 5, 4)]
    cut = pages.select("page", tensors.crop(F.col("pixels"), F.col("width"), F.col("height"), rect).alias("c")).orderBy("page").collect()
    assert bytes(cut[0].c.pixels) == PICTURE[1:5, 2:7].tobytes() and (cut[0].c.width, cut[0].c.height) == (5, 4) and cut[1].c is None


# ---- models: protocol buffers written by hand


def _varint(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def _field(k, value):
    if isinstance(value, int):
        return _varint(k << 3) + _varint(value)
    value = value.encode() if isinstance(value, str) else value
    return _varint(k << 3 | 2) + _varint(len(value)) + value


def _value(name, shape, kind=1):
    dims = b"".join(_field(1, _field(1, d)) for d in shape)
    return _field(1, name) + _field(2, _field(1, _field(1, kind) + _field(2, dims)))


def onnx_model(inputs, outputs):
    """A model that takes images and gives constants: ``inputs`` name -> shape, ``outputs`` name -> array."""
    image = next(iter(inputs))
    tensor = lambda name, a: b"".join(_field(1, d) for d in a.shape) + _field(2, 1 if a.dtype == np.float32 else 6) + _field(8, name) + _field(9, a.tobytes())
    node = lambda op, ins, outs, extra=b"": _field(1, b"".join(_field(1, i) for i in ins) + b"".join(_field(2, o) for o in outs) + _field(4, op) + extra)
    graph = node("ReduceMean", [image], ["mean"], _field(5, _field(1, "keepdims") + _field(3, 0) + _field(20, 2)))
    graph += node("Mul", ["mean", "zero"], ["nothing"])
    for name, a in outputs.items():
        graph += node("Add", [f"{name}_c", "nothing"], [name]) if a.dtype == np.float32 else node("Identity", [f"{name}_c"], [name])
    graph += _field(2, "made")
    for name, a in {"zero": np.zeros((), np.float32), **{f"{n}_c": a for n, a in outputs.items()}}.items():
        graph += _field(5, tensor(name, a))
    graph += b"".join(_field(11, _value(n, s)) for n, s in inputs.items())
    graph += b"".join(_field(12, _value(n, a.shape, 1 if a.dtype == np.float32 else 6)) for n, a in outputs.items())
    return _field(1, 8) + _field(7, graph) + _field(8, _field(2, 17))


f32 = lambda x: np.array(x, np.float32)
IMAGE = [1, 3, 64, 64]
MODELS = {
    "paddle": onnx_model({"image": IMAGE, "im_shape": [1, 2], "scale_factor": [1, 2]}, {"fetch_0": f32([[1, 0.9, 32, 0, 64, 16, 2], [0, 0.8, 0, 0, 32, 16, 5], [0, 0.7, 0, 32, 64, 64, 9]]), "fetch_1": np.array([2], np.int32), "masks": np.zeros((3, 8, 8), np.int32)}),
    "yolo": onnx_model({"images": IMAGE}, {"output0": f32([[[8, 8, 40, 24, 0.9, 0], [16, 32, 60, 60, 0.6, 1], [0, 0, 0, 0, 0, 0]]])}),
    "raw": onnx_model({"images": IMAGE}, {"output0": np.zeros((1, 6, 10), np.float32)}),
    "detr": onnx_model({"pixel_values": IMAGE}, {"logits": f32([[[4, 0, -2], [-3, -1, 3], [-5, -5, -5]]]), "pred_boxes": f32([[[0.25, 0.25, 0.5, 0.5], [0.75, 0.75, 0.5, 0.5], [0.5, 0.5, 0.2, 0.2]]])}),
    "turn": onnx_model({"x": [1, 3, 224, 224]}, {"softmax": f32([[0.02, 0.03, 0.92, 0.03]])}),
}


@pytest.fixture(scope="module")
def models(tmp_path_factory):
    folder = tmp_path_factory.mktemp("models")
    for name, data in MODELS.items():
        (folder / f"{name}.onnx").write_bytes(data)
    return folder


def page_rows(spark, *pages):
    rows = [("doc", k + 1, p.shape[1], p.shape[0], p.tobytes(), None) if p is not None else ("doc", k + 1, None, None, None, "broken") for k, p in enumerate(pages)]
    return spark.createDataFrame(rows, "path string, page_number int, width int, height int, pixels binary, error string")


def test_detectors_of_three_contracts(spark, models):
    pages = page_rows(spark, np.zeros((64, 128, 3), np.uint8), None)
    run = lambda name, labels=("text", "title"), **k: inference.detect(pages, inference.Detector(str(models / f"{name}.onnx"), k.pop("contract", name), 64, labels, **k), page=["page_number"]).orderBy("det_pos").collect()
    box = lambda r: tuple(round(x, 3) for x in (r.x1, r.y1, r.x2, r.y2))
    paddle = run("paddle")
    assert [(r.class_id, r.order_hint, box(r)) for r in paddle] == [(1, 2, (64, 0, 128, 16)), (0, 5, (0, 0, 64, 16))]  # the count leaves the third row out
    yolo = run("yolo")
    assert [(r.class_id, box(r)) for r in yolo] == [(0, (16, 0, 80, 16)), (1, (32, 32, 120, 64))]
    detr = run("detr", ("a", "b", "c"))
    assert [(r.class_id, box(r)) for r in detr] == [(0, (0, 0, 64, 32)), (2, (64, 32, 128, 64))]
    assert len(run("detr")) == 2  # one class more than labels: the last is "nothing"
    for name, contract, labels in (("raw", "yolo", ("a", "b")), ("yolo", "paddle", ("a", "b")), ("detr", "yolo", ("a", "b", "c")), ("yolo", "detr", ("a", "b")), ("detr", "detr", ("a",))):
        with pytest.raises(Exception, match="ModelOutputError"):
            run(name, labels, contract=contract)
    session = inference.open_session(str(models / "paddle.onnx"))
    assert inference.wanted_outputs(session, "paddle", 2) == ["fetch_0", "fetch_1"] and inference.image_input(session, "paddle") == "image"
    with pytest.raises(ModelOutputError, match="raw head"):
        inference.wanted_outputs(inference.open_session(str(models / "raw.onnx")), "yolo", 2)


def test_model_files(models, monkeypatch):
    path = models / "yolo.onnx"
    digest = hashlib.sha256(path.read_bytes()).hexdigest()
    assert inference.model_file(str(path), sha256=digest.upper()) == str(path)
    assert inference.model_file("yolo.onnx", cache=str(models)) == str(path)
    told = []
    inference.model_file(str(path), sha256=digest, progress=told.append)
    assert told[-1].is_complete and told[-1].percent == 100 and not told[-1].is_resumed
    assert inference.FileProgress("x", 5).percent is None and inference.FileProgress("x", 5, 20, 3).percent == 25 and inference.FileProgress("x", 5, 20, 3).is_resumed
    monkeypatch.setenv(inference.CACHE_VARIABLE, str(models))
    assert inference.model_file("yolo.onnx") == str(path)
    with pytest.raises(ModelFileError, match="SHA-256"):
        inference.model_file(str(path), sha256="0" * 64)
    with pytest.raises(ModelFileError, match="neither"):
        inference.model_file("missing.onnx", cache=str(models))
    with pytest.raises(ModelFileError, match="opened"):
        inference.open_session(str(models))


def test_page_correction(spark, models):
    straight = correction.draw_page(3, 0.0, 300, 400)
    skewed = correction.draw_page(3, 6.0, 300, 400)
    pages = page_rows(spark, straight[::-1, ::-1].copy(), skewed, None)
    told = inference.orientation(pages, str(models / "turn.onnx"))
    rows = {r.page_number: r for r in told.collect()}
    assert rows[1].orientation.rotation == 180 and rows[1].orientation.confidence == pytest.approx(0.92) and rows[3].orientation is None
    fixed = {r.page_number: r for r in inference.correct_pages(told.filter("page_number <> 2"), orientation_column="orientation").collect()}
    assert fixed[1].rotation == 180 and bytes(fixed[1].pixels) == straight.tobytes() and fixed[3].pixels is None and fixed[3].rotation == 0
    level = {r.page_number: r for r in inference.correct_pages(pages, deskew=True).collect()}
    assert abs(level[2].skew_angle - 6) <= 0.5 and level[2].width > 300 and level[2].source_width == skewed.shape[1] and level[1].skew_angle == 0
    unsure = inference.correct_pages(told.filter("page_number = 1"), orientation_column="orientation", threshold=0.95).first()
    assert unsure.rotation == 0 and bytes(unsure.pixels) == straight[::-1, ::-1].tobytes()


def test_service(spark, models, tmp_path):
    model = CustomModel(str(models / "paddle.onnx"), 64, ["Text", "Title"], "paddle")
    (tmp_path / "p.png").write_bytes(png(np.zeros((64, 64, 3), np.uint8)))
    made = LayoutService(spark, ServiceOptions(custom_model=model), text=lambda crop: F.concat(F.lit(" "), crop["width"].cast("string"), F.lit("x"), crop["height"].cast("string")))
    pages, blocks = made.analyze(made.frames(str(tmp_path / "p.png")))
    watched, report = made.observed(blocks, AnalysisOptions(reading_order_source="model"))
    rows = sorted(watched.collect(), key=lambda r: r.reading_order)
    assert [(r.type, r.text.strip()) for r in rows] == [("Title", "32x16"), ("Text", "32x16")] and {r.strategy for r in rows} == {"model"}
    told = report()
    assert (told["n_blocks"], told["n_text"], told["n_xycut_pages"]) == (2, 2, 0) and told["milliseconds"] > 0
    (document,) = made.documents(pages, blocks).collect()
    assert [b.raw_class_name for b in document.pages[0].blocks] == ["Title", "Text"]
    yolo = LayoutService(spark, ServiceOptions(custom_model=CustomModel(str(models / "yolo.onnx"), 64, ["Text", "Title"], "yolo")))
    options = AnalysisOptions(reading_order_source="model")
    watched, report = yolo.observed(yolo.analyze(yolo.frames_of_bytes([png(np.zeros((64, 64, 3), np.uint8))]), options)[1], options)
    watched.collect()
    with pytest.warns(UserWarning, match="XY-cut"):
        report()
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        report()  # once per service
    rows = [("d", 1, 2, 1, b"123456"), ("d", 2, None, None, None), ("d", 3, 2, 2, b"1")]
    errors = {r.page_number: r.error for r in made.decoded(spark.createDataFrame(rows, "path string, sequence int, width int, height int, pixels binary")).collect()}
    assert errors[1] is None and errors[2] == "page 2 is null" and "fit" in errors[3]
    with pytest.raises(LayoutError):
        LayoutService(spark, ServiceOptions())
    with pytest.raises(LayoutError):
        made.classify_orientation(pages)


def test_bridge(spark):
    cell = (0, 0, 1, 1, False, "x", None)
    rows = [([(1, 1, [cell], None), (1, 2, [cell, cell], None), (2, 1, [cell, cell], None)], ["ab", None, "cd", "a"]), ([(0, 0, [], None)], [None]), ([], [])]
    frame = spark.createDataFrame(rows, f"t array<{TABLE}>, s array<string>")
    out = frame.select(service.largest_table(F.col("t")).alias("t"), service.longest(F.col("s")).alias("s")).collect()
    assert out[0].t.column_count == 2 and out[0].s == "ab" and out[1].t is None and out[1].s is None and out[2].t is None
