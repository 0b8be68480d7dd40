"""Page images: files, bytes and streams of them, as rows of decoded RGB pixels.

``read_images`` takes the first frame of whatever the JVM's image reader knows (JPEG, PNG, GIF, BMP, TIFF).
``read_frames`` and ``frames_of`` give a row per frame; their decoders are plain numpy: PNG, BMP, PNM, GIF and
TIFF. A page is ``width``, ``height`` and ``pixels`` (RGB bytes, row by row), so pages travel through
``mapInArrow`` as they are. Sizes are read from the headers first: a page over the limit is an error in its
row (``error``), and its pixels are never decoded.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType, _parse_datatype_string

from ..schema import ImageFormatError

MAX_PIXELS, MAX_PAGES = 100_000_000, 500
PAGE_IMAGE = "page_number int, width int, height int, pixels binary, error string"


def pack(image: np.ndarray) -> tuple[int, int, bytes]:
    """Width, height and bytes of an image array (height, width, 3)."""
    return image.shape[1], image.shape[0], np.ascontiguousarray(image, np.uint8).tobytes()


def unpack(width: int, height: int, pixels: bytes) -> np.ndarray:
    if len(pixels) != 3 * width * height:
        raise ImageFormatError(f"{len(pixels)} bytes of pixels for {width} x {height}")
    return np.frombuffer(pixels, np.uint8).reshape(height, width, 3)


def _rgb(samples: np.ndarray, palette: np.ndarray | None = None) -> np.ndarray:
    """An RGB image of samples (height, width, channels); gray is repeated, alpha dropped, a palette looked up."""
    if palette is not None:
        return palette[np.minimum(samples[..., 0], len(palette) - 1)]
    return samples[..., :3] if samples.shape[2] >= 3 else samples[..., :1].repeat(3, axis=2)


def _bits(rows: np.ndarray, width: int, depth: int) -> np.ndarray:
    """Samples of ``depth`` bits (1, 2, 4, 8 or 16, the high byte of these) from rows of bytes."""
    if depth == 16:
        return rows[:, ::2][:, :width]
    if depth == 8:
        return rows[:, :width]
    spread = np.unpackbits(rows, axis=1).reshape(len(rows), -1, depth)
    return (spread * (1 << np.arange(depth - 1, -1, -1, dtype=np.uint8))).sum(axis=2, dtype=np.uint8)[:, :width]


# ---- formats: each gives the sizes of its frames, and a frame's image


class Png:
    MAGIC = (b"\x89PNG\r\n\x1a\n",)

    def __init__(self, data: bytes) -> None:
        self.chunks: dict[bytes, bytes] = {}
        at = 8
        while at + 8 <= len(data):
            size, kind = struct.unpack(">I4s", data[at : at + 8])
            self.chunks[kind] = self.chunks.get(kind, b"") + data[at + 8 : at + 8 + size]
            at += 12 + size
        width, height, self.depth, self.color, _, _, self.interlaced = struct.unpack(">IIBBBBB", self.chunks[b"IHDR"][:13])
        self.sizes = [(width, height)]

    def frame(self, _: int) -> np.ndarray:
        if self.interlaced:
            raise ImageFormatError("interlaced PNG is not decoded here; read it with read_images")
        (width, height) = self.sizes[0]
        channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[self.color]
        step = max(1, channels * self.depth // 8)
        stride = -(-width * channels * self.depth // 8)
        raw = np.frombuffer(zlib.decompress(self.chunks[b"IDAT"]), np.uint8)[: height * (stride + 1)].reshape(height, stride + 1)
        above = np.zeros(stride, np.uint8)
        out = np.empty((height, stride), np.uint8)
        for y in range(height):
            out[y] = above = self._unfiltered(int(raw[y, 0]), raw[y, 1:], above, step)
        samples = _bits(out, width * channels, self.depth).reshape(height, width, channels)
        if self.color == 3:
            return _rgb(samples, np.frombuffer(self.chunks[b"PLTE"], np.uint8).reshape(-1, 3))
        return _rgb(samples * np.uint8(255 // ((1 << self.depth) - 1)) if self.depth < 8 else samples)

    @staticmethod
    def _unfiltered(kind: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
        if kind == 0:
            return row.copy()
        if kind == 2:
            return row + above
        if kind == 1:  # running sums of each channel
            padded = np.zeros(-(-len(row) // step) * step, np.uint8)
            padded[: len(row)] = row
            return np.cumsum(padded.reshape(-1, step), axis=0, dtype=np.uint8).ravel()[: len(row)]
        out, up, before = [0] * len(row), above.tolist(), row.tolist()
        for k, value in enumerate(before):
            left, corner = (out[k - step], up[k - step]) if k >= step else (0, 0)
            if kind == 3:
                guess = (left + up[k]) >> 1
            else:
                guess = min((abs(up[k] - corner), 0, left), (abs(left - corner), 1, up[k]), (abs(left + up[k] - 2 * corner), 2, corner))[2]
            out[k] = (value + guess) & 255
        return np.array(out, np.uint8)


class Bmp:
    MAGIC = (b"BM",)

    def __init__(self, data: bytes) -> None:
        self.data = data
        self.offset, self.header = struct.unpack("<I", data[10:14])[0], struct.unpack("<I", data[14:18])[0]
        width, height, _, self.depth, self.packing = struct.unpack("<iiHHI", data[18:34])
        self.upward, self.sizes = height > 0, [(width, abs(height))]

    def frame(self, _: int) -> np.ndarray:
        if self.packing not in (0, 3) or self.depth not in (1, 4, 8, 24, 32):
            raise ImageFormatError("packed BMP is not decoded here; read it with read_images")
        (width, height) = self.sizes[0]
        stride = -(-width * self.depth // 32) * 4
        rows = np.frombuffer(self.data, np.uint8, stride * height, self.offset).reshape(height, stride)
        if self.depth >= 24:
            image = rows[:, : width * self.depth // 8].reshape(height, width, -1)[..., 2::-1]
        else:
            n = struct.unpack("<I", self.data[46:50])[0] or 1 << self.depth
            palette = np.frombuffer(self.data, np.uint8, 4 * n, 14 + self.header).reshape(n, 4)[:, 2::-1]
            image = _rgb(_bits(rows, width, self.depth)[..., None], palette)
        return image[::-1] if self.upward else image


class Pnm:
    """Binary PGM and PPM, 8 bits; several images one after the other are frames."""

    MAGIC = (b"P5", b"P6")

    def __init__(self, data: bytes) -> None:
        self.data, self.sizes, self.places = data, [], []
        at = 0
        while data[at : at + 2] in self.MAGIC:
            channels, fields, k = (1 if data[at + 1 : at + 2] == b"5" else 3), [], at + 2
            while len(fields) < 3:
                while data[k : k + 1].isspace():
                    k += 1
                if data[k : k + 1] == b"#":
                    k = data.index(b"\n", k)
                    continue
                end = k
                while data[end : end + 1].isdigit():
                    end += 1
                fields.append(int(data[k:end]))
                k = end
            width, height, most = fields
            if most > 255:
                raise ImageFormatError("PNM of more than 8 bits is not decoded here")
            self.sizes.append((width, height))
            self.places.append((k + 1, channels))
            at = k + 1 + width * height * channels

    def frame(self, k: int) -> np.ndarray:
        (width, height), (at, channels) = self.sizes[k], self.places[k]
        return _rgb(np.frombuffer(self.data, np.uint8, width * height * channels, at).reshape(height, width, channels))


def _lzw(data: bytes, first: int, most_significant_first: bool) -> bytes:
    """Variable-width codes of GIF (low bits first) or TIFF (high bits first, growing one code early)."""
    clear, early = 1 << first, int(most_significant_first)
    table: list[bytes] = []
    out, held, n, width, last, at = [], 0, 0, first + 1, b"", 0
    while True:
        while n < width:
            if at >= len(data):
                return b"".join(out)
            held = held << 8 | data[at] if most_significant_first else held | data[at] << n
            n, at = n + 8, at + 1
        if most_significant_first:
            code, held = held >> (n - width), held & ((1 << (n - width)) - 1)
        else:
            code, held = held & ((1 << width) - 1), held >> width
        n -= width
        if code == clear:
            table, width, last = [bytes([k]) for k in range(clear)] + [b"", b""], first + 1, b""
            continue
        if code == clear + 1:
            return b"".join(out)
        said = table[code] if code < len(table) else last + last[:1]
        out.append(said)
        if last and len(table) < 4096:
            table.append(last + said[:1])
        last = said
        if len(table) + early >= 1 << width and width < 12:
            width += 1


class Gif:
    """Frames as they show: each is drawn over what the frames before it leave."""

    MAGIC = (b"GIF87a", b"GIF89a")

    def __init__(self, data: bytes) -> None:
        self.data, self.parts = data, []
        self.width, self.height, flags = struct.unpack("<HHB", data[6:11])
        at = 13
        self.palette, at = self._colors(flags, at)
        clear, disposal = None, 0
        while at < len(data) and data[at] != 0x3B:
            if data[at] == 0x21:
                if data[at + 1] == 0xF9:
                    packed, clear_at = data[at + 3], data[at + 6]
                    disposal, clear = packed >> 2 & 7, clear_at if packed & 1 else None
                at = self._blocks(at + 2)[1]
            else:
                x, y, w, h, packed = struct.unpack("<HHHHB", data[at + 1 : at + 10])
                palette, at = self._colors(packed, at + 10)
                body, end = self._blocks(at + 1)
                self.parts.append((x, y, w, h, packed >> 6 & 1, self.palette if palette is None else palette, data[at], body, clear, disposal))
                at, clear, disposal = end, None, 0
        self.sizes = [(self.width, self.height)] * len(self.parts)

    def _colors(self, flags: int, at: int) -> tuple[np.ndarray | None, int]:
        if not flags & 0x80:
            return None, at
        n = 2 << (flags & 7)
        return np.frombuffer(self.data, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n

    def _blocks(self, at: int) -> tuple[bytes, int]:
        parts = []
        while self.data[at]:
            parts.append(self.data[at + 1 : at + 1 + self.data[at]])
            at += 1 + self.data[at]
        return b"".join(parts), at + 1

    def frame(self, last: int) -> np.ndarray:
        canvas = np.full((self.height, self.width, 3), 255, np.uint8)
        for k, (x, y, w, h, interlaced, palette, first, body, clear, disposal) in enumerate(self.parts[: last + 1]):
            index = np.frombuffer(_lzw(body, first, False).ljust(w * h, b"\0")[: w * h], np.uint8).reshape(h, w)
            if interlaced:
                order = [r for start, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(start, h, step)]
                index = index[np.argsort(order)]
            before, area = canvas.copy(), canvas[y : y + h, x : x + w]
            drawn = _rgb(index[..., None], palette)[: area.shape[0], : area.shape[1]]
            seen = np.ones(area.shape[:2], bool) if clear is None else index[: area.shape[0], : area.shape[1]] != clear
            area[seen] = drawn[seen]
            if k == last:
                return canvas
            if disposal == 2:
                area[:] = 255
            elif disposal == 3:
                canvas = before
        raise IndexError(last)


class Tiff:
    """Strips of gray, palette and RGB samples: plain, PackBits, LZW and Deflate."""

    MAGIC = (b"II*\0", b"MM\0*")
    _SIZES = {1: (1, "B"), 3: (2, "H"), 4: (4, "I")}

    def __init__(self, data: bytes) -> None:
        self.data, self.order, self.pages = data, "<" if data[:2] == b"II" else ">", []
        (at,) = struct.unpack(self.order + "I", data[4:8])
        seen = set()
        while at and at not in seen and at + 2 <= len(data):
            seen.add(at)
            (n,) = struct.unpack(self.order + "H", data[at : at + 2])
            tags = {}
            for k in range(n):
                entry = at + 2 + 12 * k
                tag, kind, count = struct.unpack(self.order + "HHI", data[entry : entry + 8])
                if kind in self._SIZES:
                    size, code = self._SIZES[kind]
                    place = entry + 8 if size * count <= 4 else struct.unpack(self.order + "I", data[entry + 8 : entry + 12])[0]
                    tags[tag] = struct.unpack(f"{self.order}{count}{code}", data[place : place + size * count])
            self.pages.append(tags)
            (at,) = struct.unpack(self.order + "I", data[at + 2 + 12 * n : at + 6 + 12 * n])
        self.sizes = [(t[256][0], t[257][0]) for t in self.pages]

    def frame(self, k: int) -> np.ndarray:
        tags = self.pages[k]
        (width, height), one = self.sizes[k], lambda tag, default: tags.get(tag, (default,))[0]
        depth, packing, meaning, channels, predictor = one(258, 1), one(259, 1), one(262, 1), one(277, 1), one(317, 1)
        readers = {1: lambda b: b, 5: lambda b: _lzw(b, 8, True), 8: zlib.decompress, 32946: zlib.decompress, 32773: _packbits}
        if packing not in readers or one(284, 1) != 1 or meaning > 3 or 273 not in tags:
            raise ImageFormatError("this kind of TIFF is not decoded here; read it with read_images")
        raw = b"".join(readers[packing](self.data[a : a + n]) for a, n in zip(tags[273], tags[279], strict=True))
        stride = -(-width * channels * depth // 8)
        rows = np.frombuffer(raw.ljust(stride * height, b"\0"), np.uint8, stride * height).reshape(height, stride)
        if depth == 16 and self.order == "<":
            rows = rows.reshape(height, -1, 2)[..., ::-1].reshape(height, stride)
        samples = _bits(rows, width * channels, depth).reshape(height, width, channels)
        if predictor == 2:
            samples = np.cumsum(samples, axis=1, dtype=np.uint8)
        if meaning == 3:
            return _rgb(samples, (np.array(tags[320]).reshape(3, -1).T >> 8).astype(np.uint8))
        if depth < 8:
            samples = samples * np.uint8(255 // ((1 << depth) - 1))
        return _rgb(255 - samples if meaning == 0 else samples)


def _packbits(data: bytes) -> bytes:
    out, at = [], 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out.append(data[at + 1 : at + 2 + n])
            at += 2 + n
        else:
            out.append(data[at + 1 : at + 2] * (257 - n) if n > 128 else b"")
            at += 2 if n > 128 else 1
    return b"".join(out)


FORMATS = (Png, Bmp, Pnm, Gif, Tiff)


def opened(content: bytes):
    """The file as one of the formats: ``sizes`` of its frames, from the headers alone, and ``frame(k)``."""
    if not content:
        raise ImageFormatError("the image is empty")
    for kind in FORMATS:
        if content.startswith(kind.MAGIC):
            try:
                return kind(content)
            except (IndexError, KeyError, ValueError, struct.error) as e:
                raise ImageFormatError(f"broken {kind.__name__} image: {e}") from e
    raise ImageFormatError("no known image format")


def pages_of(content: bytes | None, max_pixels: int = MAX_PIXELS, max_pages: int = MAX_PAGES, first_only: bool = False) -> list[tuple]:
    """Rows (page_number, width, height, pixels, error) of the frames; a document with too many pages is one error row."""
    try:
        source = opened(content or b"")
        sizes = source.sizes[:1] if first_only else source.sizes
        if not sizes:
            raise ImageFormatError("the image has no frame")
        if len(sizes) > max_pages:
            return [(1, *sizes[0], None, f"document has {len(sizes)} pages; at most {max_pages} are allowed")]
        out = []
        for k, (width, height) in enumerate(sizes):
            if width * height > max_pixels:
                out.append((k + 1, width, height, None, f"image has {width * height} pixels; at most {max_pixels} are allowed"))
            else:
                out.append((k + 1, width, height, pack(source.frame(k))[2], None))
        return out
    except (ImageFormatError, IndexError, KeyError, ValueError, struct.error, zlib.error) as e:
        return [(1, None, None, None, f"the image cannot be read: {e}")]


def frames_of(files: DataFrame, content: str = "content", *, max_pixels: int = MAX_PIXELS, max_pages: int = MAX_PAGES, first_only: bool = False) -> DataFrame:
    """A row per frame of each image file: all columns but the content, then ``page_number`` (from 1), ``width``, ``height``, ``pixels``, ``error``.

    Works on batches and on streams (it keeps no state). What cannot be read, an empty or null content, a page of
    too many pixels and a document of too many pages give a row with an error and without pixels; ``guards.enforce``
    makes such a row fail the job.
    """
    other = [f for f in files.schema.fields if f.name != content and f.name not in ("page_number", "width", "height", "pixels", "error")]
    extra = _parse_datatype_string(PAGE_IMAGE).fields
    schema = StructType([*other, *extra])
    kinds = [to_arrow_type(f.dataType) for f in extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                for page in pages_of(batch.column(0)[k].as_py(), max_pixels, max_pages, first_only):
                    row = batch.slice(k, 1)
                    yield pa.RecordBatch.from_arrays([*row.columns[1:], *(pa.array([v], t) for v, t in zip(page, kinds, strict=True))], schema.names)

    return files.select(content, *(f.name for f in other)).mapInArrow(run, schema)


def read_frames(spark: SparkSession, path: str, *, max_pixels: int = MAX_PIXELS, max_pages: int = MAX_PAGES, streaming: bool = False) -> DataFrame:
    """All frames of the image files under a path (a folder, a file or a pattern): ``path`` and the columns of ``frames_of``."""
    reader = spark.readStream if streaming else spark.read
    if streaming:
        reader = reader.schema("path string, modificationTime timestamp, length bigint, content binary")
    return frames_of(reader.format("binaryFile").load(path).select("path", "content"), max_pixels=max_pixels, max_pages=max_pages)


def read_images(spark: SparkSession, path: str, *, max_pixels: int = MAX_PIXELS) -> DataFrame:
    """The first frame of the image files under a path, decoded by the JVM: ``path``, ``page_number`` 1, ``width``, ``height``, ``pixels``, ``error``."""
    images = spark.read.format("image").load(path).select("image.*")
    schema = f"path string, {PAGE_IMAGE}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path_, height, width, channels, data in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                pixels = error = None
                if width < 0:
                    error, width, height = "the image cannot be read", None, None
                elif width * height > max_pixels:
                    error = f"image has {width * height} pixels; at most {max_pixels} are allowed"
                else:  # the JVM gives blue, green, red (, alpha)
                    samples = np.frombuffer(data, np.uint8).reshape(height, width, channels)
                    pixels = pack(_rgb(samples[..., 2::-1] if channels >= 3 else samples))[2]
                yield pa.RecordBatch.from_pylist([{"path": path_, "page_number": 1, "width": width, "height": height, "pixels": pixels, "error": error}], pa.schema([("path", pa.string()), ("page_number", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.binary()), ("error", pa.string())]))

    return images.select(F.col("origin"), "height", "width", "nChannels", "data").mapInArrow(run, schema)
