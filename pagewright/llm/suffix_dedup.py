"""Removal of repeated 200-byte strings by a hash-compared suffix sort, dealt out by content.

A string of 200 bytes repeats only if its anchor does: the leftmost of its 64-byte strings with the least
hash, which depends on the content alone. So:

1. Each text is cut into runs of consecutive 200-byte windows that share an anchor (about one per 70
   bytes). A run travels as the hash of its anchor and a 128-bit cryptographic digest of all its bytes,
   dealt by the former. Of runs that are equal within a part of a task one travels, and the others are known to repeat.
2. Runs whose anchor is unique repeat nothing. Runs that occur whole in two places or more, by the digest, are repeated
   whole. Only where runs share an anchor but differ (at the ends of repeated passages) are bytes needed:
   one run of each kind is fetched from its text.
3. There the suffixes that begin at the anchors are sorted by mergesort. Two suffixes are compared by
   binary search for their common length on prefix polynomial hashes, then by one byte. Neighbours'
   common lengths, checked against the bytes, split the sorted suffixes into classes for every length;
   windows that agree to the right of the anchor (same class) and to its left (same prefix hash, checked
   against the bytes) are repeated.
4. Anchors in very many different runs (a line that a third of all texts has, each in its own
   surroundings) would make one large sort. A bounded sample names them; their windows travel one by one as
   digests, dealt by the digest, so no task gets them all. The sample decides how windows travel, never what repeats.
5. The repeated runs of windows meet their texts again, and the bytes that they cover are removed.

Texts without a repeated run are never shuffled and never leave the JVM: a bitmap of fixed size tells them apart.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PolyHash, free_names, maybe_in, mix64, release, sliced, stash, tidy, unstash, with_key

#: Bytes of a string that counts as repeated, and of its anchor.
WINDOW, ANCHOR = 200, 64
_GRAMS = WINDOW - ANCHOR + 1
#: Window starts that are looked at together; positions within fit ``_AT`` bits.
STEP, _AT = 1 << 17, 24
#: Runs that a bucket should hold about.
BUCKET = 1 << 19
#: Bytes of text whose runs are made together.
PART = 4 << 20
#: Hot anchors are those of so many different runs in a sample of texts: one in so many, and of so many bytes about at most.
HOT_RUNS, HOT_ONE_IN, HOT_SAMPLE = 32, 16, 1 << 30
_REMOVAL = np.dtype([("at", "<u4"), ("n", "<u4")])
_REQUEST = np.dtype([("key", "<u8"), ("at", "<u4"), ("n", "u1"), ("rel", "u1")])


def anchor_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each 64-byte string: hashes of 8 bytes are mixed pairwise into those of 16, 32 and 64."""
    out = mix64(np.ndarray(len(data) - 7, "<u8", np.ascontiguousarray(data).data, strides=(1,)).copy())
    for step in (8, 16, 32):
        out = mix64(out[:-step] * np.uint64(0x9E3779B97F4A7C15) + out[step:])
    return out


def runs(data: np.ndarray, ends: np.ndarray, step: int = STEP) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: start, number of windows, anchor's offset, anchor hash.

    ``data``: the bytes of all texts, one after the other; ``ends``: where each text ends.
    """
    parts = []
    for begin in range(0, max(0, len(data) - WINDOW + 1), step):
        sub = data[begin : begin + step + WINDOW - 1]
        n = len(sub) - WINDOW + 1
        grams = len(sub) - ANCHOR + 1
        value = anchor_hashes(sub)
        ranked = value >> np.uint64(_AT) << np.uint64(_AT) | np.arange(grams, dtype=np.uint64)
        padded = np.full(-(-grams // _GRAMS) * _GRAMS, (1 << 64) - 1, np.uint64)
        padded[:grams] = ranked
        blocks = padded.reshape(-1, _GRAMS)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        anchor = (np.minimum(behind[:n], ahead[_GRAMS - 1 : _GRAMS - 1 + n]) & np.uint64((1 << _AT) - 1)).astype(np.int64)
        inside = ends[np.searchsorted(ends, begin, "right") : np.searchsorted(ends, begin + n, "left") + 1]
        end_of = np.repeat(inside, np.diff(np.r_[begin, np.minimum(inside, begin + n)]))
        start = np.flatnonzero(np.arange(begin + WINDOW, begin + WINDOW + n) <= end_of)
        if not len(start):
            continue
        anchor = anchor[start]
        fresh = np.r_[True, (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)]
        lo, at = start[fresh], anchor[fresh]
        windows = start[np.r_[np.flatnonzero(fresh)[1:] - 1, len(start) - 1]] - lo + 1
        parts.append((lo + begin, windows, at - lo, value[at]))
    if not parts:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    return tuple(map(np.concatenate, zip(*parts, strict=True)))


def digests(data: bytes, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """128-bit digests of stretches of bytes, as two columns."""
    raw = b"".join([hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), (start + length).tolist(), strict=True)])
    return np.frombuffer(raw, np.uint64).reshape(-1, 2)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and the ends of its values; nulls are empty."""
    column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.empty(0, np.uint8)
    return data, offsets[1:] - offsets[0]


def _slices(order_by: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Value, begin and end of each stretch of equal values."""
    if not len(order_by):
        return
    starts = np.flatnonzero(np.r_[True, order_by[1:] != order_by[:-1]])
    for a, b in zip(starts, np.r_[starts[1:], len(order_by)], strict=True):
        yield order_by[a], a, b


_RUNS = "bucket int, key binary, d1 binary, d2 binary, doc_a binary, doc_b binary, at binary, n binary, rel binary"
_TYPES = {"key": np.uint64, "d1": np.uint64, "d2": np.uint64, "doc_a": np.int64, "doc_b": np.int64, "at": np.uint32, "n": np.uint8, "rel": np.uint8}


def _packed(bucket: np.ndarray, x: dict[str, np.ndarray]) -> pa.RecordBatch:
    order = np.argsort(bucket, kind="stable")
    cuts = list(_slices(bucket[order]))
    columns = {c: x[c][order].astype(t) for c, t in _TYPES.items()}
    return pa.RecordBatch.from_arrays([pa.array([int(k) for k, _, _ in cuts], pa.int32()), *(pa.array([v[a:b].tobytes() for _, a, b in cuts], pa.binary()) for v in columns.values())], [c.split()[0] for c in _RUNS.split(", ")])


def _first_of_kind(x: dict[str, np.ndarray], columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Masks: the first row of each kind (equal in ``columns``), and rows whose kind is found twice or more."""
    order = np.lexsort([x[c] for c in columns])
    new = np.r_[True, np.logical_or.reduce([x[c][order][1:] != x[c][order][:-1] for c in columns])] if len(order) else np.empty(0, bool)
    kind = np.cumsum(new) - 1
    first, twice = np.zeros(len(order), bool), np.zeros(len(order), bool)
    first[order[new]] = True
    if len(order):
        twice[order] = np.bincount(kind)[kind] > 1
    return first, twice


def _cut(batches: Iterator[pa.RecordBatch], buckets: int, hot: np.ndarray, part: int, step: int) -> Iterator[pa.RecordBatch]:
    """Packed runs, by bucket: runs by their anchor, then (after ``buckets``) what is known to repeat, then windows of hot anchors."""
    for batch in sliced(batches, part):
        data, ends = _bytes_of(batch.column(2))
        lo, windows, rel, key = runs(data, ends, step)
        if not len(lo):
            continue
        raw = data.tobytes()
        is_hot = np.isin(key, hot)
        cold = ~is_hot
        parts = [(lo[cold], windows[cold], rel[cold], key[cold], windows[cold] + WINDOW - 1)]
        if is_hot.any():
            n = windows[is_hot]
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            ones = np.ones(len(inside), np.int64)
            parts.append((np.repeat(lo[is_hot], n) + inside, ones, 0 * ones, np.repeat(key[is_hot], n), WINDOW * ones))
        for place, (start, n, offset, anchor, length) in enumerate(parts):
            if not len(start):
                continue
            which = np.searchsorted(ends, start, "right")
            d = digests(raw, start, length)
            x = {"key": anchor, "d1": d[:, 0], "d2": d[:, 1], "doc_a": batch.column(0).to_numpy()[which], "doc_b": batch.column(1).to_numpy()[which], "at": start - np.r_[0, ends[:-1]][which], "n": n, "rel": offset}
            first, twice = _first_of_kind(x, ["d1", "d2", "rel", "n"])
            goes = {c: v[first] for c, v in x.items()}
            yield _packed(((goes["key"] if place == 0 else goes["d1"]) & np.uint64(buckets - 1)).astype(np.int32) + 2 * buckets * place, goes)
            if twice.any():
                known = {c: v[twice] for c, v in x.items()}
                yield _packed((known["doc_a"].view(np.uint64) & np.uint64(buckets - 1)).astype(np.int32) + buckets, known)


def _by_doc(x: dict[str, np.ndarray], records: np.ndarray, kind: int) -> pd.DataFrame:
    order = np.lexsort((x["doc_b"], x["doc_a"]))
    a, b, records = x["doc_a"][order], x["doc_b"][order], records[order]
    starts = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.empty(0, np.int64)
    return pd.DataFrame({"doc_a": a[starts], "doc_b": b[starts], "kind": np.full(len(starts), kind, np.int32), "body": [records[i:j].tobytes() for i, j in itertools.pairwise([*starts.tolist(), len(a)])]})


def _removals(x: dict[str, np.ndarray], rows: np.ndarray) -> pd.DataFrame:
    out = np.zeros(int(rows.sum()), _REMOVAL)
    out["at"], out["n"] = x["at"][rows], x["n"][rows]
    return _by_doc({c: x[c][rows] for c in ("doc_a", "doc_b")}, out, 0)


def _sift(pdf: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """Of a bucket: runs that repeat whole (kind 0), and one run of each kind that shares its anchor with others (kind 1)."""
    x = {c: np.concatenate([np.frombuffer(b, t) for b in pdf[c]]) for c, t in _TYPES.items()}
    place = int(pdf["bucket"].iloc[0]) // buckets
    if place == 1:
        return _removals(x, np.ones(len(x["at"]), bool))
    if place == 2:
        return _removals(x, _first_of_kind(x, ["d1", "d2"])[1])
    ranked = np.sort(x["key"])
    shared = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
    if not len(shared):
        return _removals(x, np.zeros(len(x["at"]), bool))
    found = np.minimum(np.searchsorted(shared, x["key"]), len(shared) - 1)
    x = {c: v[shared[found] == x["key"]] for c, v in x.items()}
    first, twice = _first_of_kind(x, ["d1", "d2", "rel", "n", "key"])
    keys, key = np.unique(x["key"], return_inverse=True)
    ask = first & (np.bincount(key[first], minlength=len(keys))[key] > 1)
    request = np.zeros(int(ask.sum()), _REQUEST)
    for c in ("key", "at", "n", "rel"):
        request[c] = x[c][ask]
    out = pd.concat([_removals(x, twice), _by_doc({c: x[c][ask] for c in ("doc_a", "doc_b")}, request, 1)])
    del x, ranked, shared, found, first, twice, keys, key, ask, request
    release()
    return out


class SuffixSorter:
    """Sorts suffixes of one buffer, each up to its own end, by hash-compared mergesort."""

    def __init__(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, group: np.ndarray) -> None:
        self.data, self.start, self.length, self.group = data, start, length, group
        self.hashes = PolyHash(data, 3)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common length of suffixes i and j: binary search on prefix hashes."""
        a, b = self.start[i], self.start[j]
        low, high = np.zeros(len(i), np.int64), np.minimum(self.length[i], self.length[j])
        while True:
            open_ = low < high
            if not open_.any():
                return low
            middle = (low + high + 1) >> 1
            same = self.hashes.span(a, middle) == self.hashes.span(b, middle)
            low = np.where(open_ & same, middle, low)
            high = np.where(open_ & ~same, middle - 1, high)

    def less(self, i: np.ndarray, j: np.ndarray, or_equal: bool) -> np.ndarray:
        """Whether suffix i stands before j: by group, then by the first byte that differs; an end stands first."""
        gi, gj = self.group[i], self.group[j]
        out = gi < gj
        same = np.flatnonzero(gi == gj)
        if len(same):
            i, j = i[same], j[same]
            common = self.common(i, j)
            ends_i, ends_j = common == self.length[i], common == self.length[j]
            x = self.data[np.minimum(self.start[i] + common, len(self.data) - 1)]
            y = self.data[np.minimum(self.start[j] + common, len(self.data) - 1)]
            out[same] = np.where(ends_i & ends_j, or_equal, np.where(ends_i | ends_j, ends_i, x < y))
        return out

    def sort(self) -> np.ndarray:
        """Bottom-up mergesort: all pairs of runs of a round are merged at once, each element by its rank in the other run."""
        n = len(self.start)
        order = np.argsort(self.group, kind="stable")  # runs of different groups need no merging by bytes
        width = 1
        while width < n:
            place = np.arange(n)
            run = place // width
            left = run % 2 == 0
            lo = np.minimum((run + np.where(left, 1, -1)) * width, n)
            hi = np.minimum(lo + width, n)
            begin, end = lo.copy(), hi.copy()
            while True:
                open_ = np.flatnonzero(begin < end)
                if not len(open_):
                    break
                middle = (begin[open_] + end[open_]) >> 1
                # Of equal suffixes those of the left run come first, so the sort is stable.
                before = np.empty(len(open_), bool)
                for side in (True, False):
                    at = left[open_] == side
                    before[at] = self.less(order[middle[at]], order[place[open_[at]]], not side)
                begin[open_] = np.where(before, middle + 1, begin[open_])
                end[open_] = np.where(before, end[open_], middle)
            target = (run - ~left) * width + (place - run * width) + (begin - lo)
            merged = np.empty_like(order)
            merged[target] = order
            order = merged
            width *= 2
        return order


def _common_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """Common length in bytes from positions a and b on (``step`` 1) or backwards before them (-1), at most ``most``."""
    out = np.zeros(len(a), np.int64)
    alive = np.flatnonzero(most > 0)
    k = 0
    while len(alive):
        x, y = (a[alive] + k, b[alive] + k) if step > 0 else (a[alive] - k - 1, b[alive] - k - 1)
        alive = alive[data[x] == data[y]]
        k += 1
        out[alive] = k
        alive = alive[most[alive] > k]
    return out


def repeated_windows(spans: list[bytes], key: np.ndarray, n: np.ndarray, rel: np.ndarray) -> np.ndarray:
    """For runs of windows (bytes, anchor hash, number of windows, anchor's offset): which windows repeat, as a matrix."""
    sizes = np.array([len(s) for s in spans], np.int64)
    data = np.frombuffer(b"".join(spans), np.uint8)
    begin = np.r_[0, np.cumsum(sizes)[:-1]]
    anchor = begin + rel
    sorter = SuffixSorter(data, anchor, sizes - rel, key)
    order = sorter.sort()
    out = np.zeros((len(spans), _GRAMS), bool)
    i, j = order[:-1], order[1:]
    common = np.zeros(len(order), np.int64)
    same = np.flatnonzero(key[i] == key[j])
    common[1:][same] = sorter.common(i[same], j[same])
    # Collision check: what the hashes call common is compared byte by byte.
    common[1:][same] = np.minimum(common[1:][same], _common_bytes(data, anchor[i[same]], anchor[j[same]], common[1:][same], 1))
    key_o, rel_o, n_o, anchor_o = key[order], rel[order], n[order], anchor[order]
    for left in range(_GRAMS):  # windows with so many bytes before the anchor
        part = (rel_o >= left) & (rel_o - n_o + 1 <= left)
        if part.sum() < 2:
            continue
        cls = np.cumsum((common < WINDOW - left) | np.r_[True, key_o[1:] != key_o[:-1]])[part]
        rows = np.flatnonzero(part)
        before = sorter.hashes.span(anchor_o[rows] - left, left)
        at = np.lexsort((before, cls))
        cls, before, rows = cls[at], before[at], rows[at]
        equal = np.flatnonzero((cls[1:] == cls[:-1]) & (before[1:] == before[:-1]))
        if not len(equal):
            continue
        x, y = rows[equal], rows[equal + 1]
        sure = _common_bytes(data, anchor_o[x], anchor_o[y], np.full(len(x), left), -1) == left
        column = order[np.r_[x[sure], y[sure]]]
        out[column, rel[column] - left] = True
    return out


def _sort_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    flags = repeated_windows(list(pdf["bytes"]), pdf["key"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), pdf["rel"].to_numpy(np.int64))
    edge = np.diff(np.pad(flags.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edge == 1)
    _, last = np.nonzero(edge == -1)
    removal = np.zeros(len(row), _REMOVAL)
    removal["at"], removal["n"] = pdf["at"].to_numpy(np.int64)[row] + first, last - first
    return _by_doc({c: pdf[c].to_numpy(np.int64)[row] for c in ("doc_a", "doc_b")}, removal, 0)[["doc_a", "doc_b", "body"]]


def _fetch(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the runs that are asked for."""
    for batch in sliced(batches):
        out: list[tuple] = []
        for a, b, text, bodies in zip(*batch.columns, strict=True):
            text, a, b = text.as_py().encode(), a.as_py(), b.as_py()
            for body in bodies.as_py():
                for key, at, n, rel in np.frombuffer(body, _REQUEST).tolist():
                    out.append(((key >> 32) & (buckets - 1), key - (key >> 63 << 64), a, b, at, n, rel, text[at : at + n + WINDOW - 1]))
        columns = list(zip(*out, strict=True)) or [()] * 8
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["bucket", "key", "doc_a", "doc_b", "at", "n", "rel", "bytes"])


def hot_anchors(texts: DataFrame, n_bytes: int) -> np.ndarray:
    """Anchor hashes that ``HOT_RUNS`` different runs of the sample have; ascending. The sample is drawn by the texts' hashes."""
    share = min(1 / HOT_ONE_IN, HOT_SAMPLE / max(n_bytes, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, PART):
            data, ends = _bytes_of(batch.column(2))
            lo, windows, _, key = runs(data, ends)
            if not len(lo):
                continue
            d = digests(data.tobytes(), lo, windows + WINDOW - 1)
            pairs = np.unique(np.stack((key, d[:, 0])), axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["key", "run"])

    drawn = texts.filter(F.pmod(F.col("doc_b"), F.lit(1 << 30)) < int(share * (1 << 30)))
    kinds = drawn.mapInArrow(tidy(run), "key bigint, run bigint").distinct().groupBy("key").agg(F.count("*").alias("n"))
    found = kinds.filter(F.col("n") >= HOT_RUNS).select("key").toPandas()["key"].to_numpy(np.int64)
    return np.sort(found.view(np.uint64))


def repeated_runs(keyed: DataFrame, key: str, text_col: str) -> DataFrame:
    """Stored rows ``doc_a``, ``doc_b``, ``body``: runs of repeated windows (start and number, packed) of the texts.

    ``keyed`` has a key (see ``with_key``) of id and text, and the text.
    """
    doc = [F.col(key)[c].alias(f"doc_{c}") for c in "ab"]
    texts = keyed.select(*doc, F.col(text_col).alias("body"))
    n_bytes = texts.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    buckets = 1 << max(5, (n_bytes // 70 // BUCKET).bit_length())
    hot = texts.sparkSession.sparkContext.broadcast(hot_anchors(texts, n_bytes))
    out = "doc_a bigint, doc_b bigint, kind int, body binary"
    found = stash(texts.mapInArrow(tidy(lambda it: _cut(it, buckets, hot.value, PART, STEP)), _RUNS).groupBy("bucket").applyInPandas(lambda pdf: _sift(pdf, buckets), out), "runs")
    asked = found.filter("kind = 1").groupBy("doc_a", "doc_b").agg(F.collect_list("body").alias("bodies"))
    maybe = maybe_in(found.filter("kind = 1").select("doc_a"))
    fetched = texts.filter(maybe("doc_a")).join(asked, ["doc_a", "doc_b"]).select("doc_a", "doc_b", F.col("body").alias("text"), "bodies").mapInArrow(tidy(lambda it: _fetch(it, 4 * buckets)), "bucket int, key bigint, doc_a bigint, doc_b bigint, at bigint, n int, rel int, bytes binary")
    ends = fetched.groupBy("bucket").applyInPandas(_sort_bucket, "doc_a bigint, doc_b bigint, body binary")
    repeats = stash(found.filter("kind = 0").select("doc_a", "doc_b", "body").unionByName(ends), "repeats")
    unstash(found)
    return repeats


def removed_intervals(bodies: list[bytes]) -> list[tuple[int, int]]:
    """Maximal stretches of removed bytes from packed runs of windows."""
    runs_ = np.frombuffer(b"".join(bodies), _REMOVAL)
    start = runs_["at"].astype(np.int64)
    end = start + runs_["n"] + WINDOW - 1
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order]) if len(end) else end
    fresh = np.r_[True, start[1:] > reach[:-1]] if len(start) else np.empty(0, bool)
    return list(zip(start[fresh].tolist(), reach[np.r_[np.flatnonzero(fresh)[1:] - 1, len(start) - 1]].tolist() if len(start) else [], strict=True))


def _kept(data: bytes, intervals: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in intervals:
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


def _parted(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, str]:
    """The rows that surely hold no repeat; the others, with the packed runs of each; and the name of that column."""
    keyed, key = with_key(docs, id_col, text_col)
    repeats = repeated_runs(keyed, key, text_col)
    maybe = maybe_in(repeats.select("doc_a"))
    bodies, a, b = free_names(keyed, "_pw_bodies", "_pw_a", "_pw_b")
    packed = repeats.groupBy(F.col("doc_a").alias(a), F.col("doc_b").alias(b)).agg(F.collect_list("body").alias(bodies))
    rows = keyed.filter(maybe(F.col(key)["a"]))
    near = rows.join(packed, (F.col(key)["a"] == F.col(a)) & (F.col(key)["b"] == F.col(b)), "left").select(*(F.col(c) for c in docs.columns), bodies)
    return keyed.filter(~maybe(F.col(key)["a"])).drop(key), near, bodies


def _intervals(bodies: pa.Scalar) -> list[tuple[int, int]]:
    return removed_intervals(bodies.as_py()) if bodies.is_valid else []


def removal_digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256`` per input row.

    A null text counts as empty; texts under 200 bytes lose nothing. Repeated rows are documents of their
    own, so their texts repeat one another. A null id is an id like any other. Other columns are ignored;
    an empty table gives no rows. Documents are told apart by 128 bits of hashes of id and text.
    """
    names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    plain, near, bodies = _parted(docs.select(F.col(id_col), F.col(text_col)), id_col, text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            size, removed, spans, digest = [], [], [], []
            for text, packed in zip(batch.column(1), batch.column(2), strict=True):
                data, cuts = (text.as_py() or "").encode(), _intervals(packed)
                kept = _kept(data, cuts)
                size.append(len(data))
                removed.append(len(data) - len(kept))
                spans.append(len(cuts))
                digest.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in (size, removed, spans)), pa.array(digest, pa.string())], names)

    kind = docs.schema[id_col].dataType.simpleString()
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    whole = plain.select(F.col(id_col), F.octet_length(data).cast("bigint").alias("n_bytes"), *(F.lit(0).cast("bigint").alias(c) for c in names[2:4]), F.sha2(data, 256).alias("kept_sha256"))
    return whole.unionByName(near.select(F.col(id_col), F.col(text_col), bodies).mapInArrow(tidy(cut), f"`{id_col}` {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"))


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns with the repeated bytes taken out of the texts.

    A character that is cut in two goes altogether; a null text stays null. Other cases as in
    ``removal_digests``.
    """
    place = docs.columns.index(text_col)
    plain, near, _ = _parted(docs, id_col, text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            cuts = [_intervals(b) for b in batch.column(batch.num_columns - 1)]
            new = [_kept(t.as_py().encode(), c).decode("utf-8", "ignore") if c else t.as_py() for t, c in zip(batch.column(place), cuts, strict=True)]
            columns = list(batch.columns[:-1])
            columns[place] = pa.array(new, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    return plain.unionByName(near.mapInArrow(tidy(cut), docs.schema))
