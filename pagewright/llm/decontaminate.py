"""Benchmark decontamination with a distributed positional inverted index.

The index is a table of segments. Terms are 64-bit hashes of words, so a false match needs words whose
hashes collide at every place where the phrases differ. A segment holds whole documents: for every term its postings (ascending
word positions, documents one after the other), so a phrase never leaves its segment and building the
index shuffles nothing. Searching sends the test windows (a stated query set, in blocks of bounded size)
to all segments. In a segment, a window with an absent term is done with at once; for the others the
postings of its rarest term, shifted by the term's offset, are the first candidates for the window's
begin, and are intersected with the shifted lists of the next rarest terms until none is left or all
terms agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import alnum_words, scope, stash, tidy, unstash, with_key, without

WINDOW = 13
#: A document is contaminated if its hit words are at least one in so many.
HIT_SHARE = 20
#: Text bytes of a segment (a longer document is a segment of its own), and test words of a block.
SEGMENT, BLOCK_WORDS = 4 << 20, 1 << 21


def term_keys(text: str | None) -> np.ndarray:
    words = alnum_words((text or "").encode())
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


class Segment:
    """Postings of some documents: ``terms`` ascending, ``offsets`` into ``positions``, ``ends`` of the documents in words."""

    FIELDS = {"ends": np.int64, "terms": np.uint64, "offsets": np.int64, "positions": np.uint32}

    def __init__(self, ends: np.ndarray, terms: np.ndarray, offsets: np.ndarray, positions: np.ndarray) -> None:
        self.ends, self.terms, self.offsets, self.positions = ends, terms, offsets, positions
        self.n_words = int(ends[-1]) if len(ends) else 0
        self.starts = np.r_[0, ends[:-1]].astype(np.int64)

    @classmethod
    def of(cls, texts: list[str | None]) -> Segment:
        keys = [term_keys(t) for t in texts]
        ends = np.cumsum([len(k) for k in keys], dtype=np.int64)
        key = np.concatenate(keys) if keys else np.empty(0, np.uint64)
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        starts = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(ranked) else np.empty(0, np.int64)
        return cls(ends, ranked[starts], np.r_[starts, len(ranked)].astype(np.int64), order.astype(np.uint32))

    def rank(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key among the terms, -1 if absent."""
        if not len(self.terms):
            return np.full(keys.shape, -1, np.int64)
        at = np.minimum(np.searchsorted(self.terms, keys), len(self.terms) - 1)
        return np.where(self.terms[at] == keys, at, -1)

    def has(self, rank: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Whether the posting list of each term holds each position: binary search within the list."""
        low, high = self.offsets[rank], self.offsets[rank + 1]
        end = high.copy()
        while True:
            open_ = low < high
            if not open_.any():
                break
            middle = (low + high) >> 1
            below = self.positions[np.minimum(middle, len(self.positions) - 1)] < position
            low = np.where(open_ & below, middle + 1, low)
            high = np.where(open_ & ~below, middle, high)
        return (low < end) & (self.positions[np.minimum(low, len(self.positions) - 1)] == position)

    def candidates(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each given term all its postings: index of the term, position."""
        n = self.offsets[rank + 1] - self.offsets[rank]
        who = np.repeat(np.arange(len(rank)), n)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return who, self.positions[self.offsets[rank][who] + inside].astype(np.int64)


class Windows:
    """The distinct windows of a block of test items, grouped by length."""

    def __init__(self, items: list[tuple[str, str | None]], width: int = WINDOW) -> None:
        self.width = width
        by_text: dict[bytes, set[str]] = {}
        lengths: dict[bytes, int] = {}
        for name, text in items:
            keys = term_keys(text)
            n = min(width, len(keys))
            for at in range(len(keys) - n + 1 if n else 0):
                raw = keys[at : at + n].tobytes()
                by_text.setdefault(raw, set()).add(name)
                lengths[raw] = n
        self.groups = []
        for n in sorted(set(lengths.values())):
            raws = [r for r in by_text if lengths[r] == n]
            self.groups.append((np.frombuffer(b"".join(raws), np.uint64).reshape(-1, n), [sorted(by_text[r]) for r in raws]))

    def phrases(self, segment: Segment) -> Iterator[tuple[int, list[list[str]], np.ndarray, np.ndarray]]:
        """Exact occurrences, by window length: length, item names by window, window, begin position."""
        for keys, names in self.groups:
            rank = segment.rank(keys)
            alive = np.flatnonzero((rank >= 0).all(axis=1))
            if not len(alive):
                continue
            rank = rank[alive]
            n = rank.shape[1]
            count = segment.offsets[rank + 1] - segment.offsets[rank]
            rarest = np.argsort(count, axis=1, kind="stable")
            first = rarest[:, 0]
            who, at = segment.candidates(rank[np.arange(len(rank)), first])
            begin = at - first[who]
            doc = np.searchsorted(segment.ends, at, "right")
            fits = (begin >= segment.starts[doc]) & (begin + n <= segment.ends[doc])
            who, begin = who[fits], begin[fits]
            for step in range(1, n):
                if not len(who):
                    break
                offset = rarest[who, step]
                agree = segment.has(rank[who, offset], begin + offset)
                who, begin = who[agree], begin[agree]
            if len(who):
                yield n, names, alive[who], begin

    def near(self, segment: Segment, slop: int) -> Iterator[tuple[int, list[str], int, int]]:
        """Proximity matches: all terms of a window, in any order, within its length plus ``slop`` words of one document.

        Yields window length, item names, begin and end of the stretch around each posting of the rarest term
        (the leftmost shortest one); overlapping stretches of a window are reported each.
        """
        for keys, names in self.groups:
            rank = segment.rank(keys)
            for w in np.flatnonzero((rank >= 0).all(axis=1)):
                terms = np.unique(rank[w])
                reach = keys.shape[1] + slop
                lists = sorted((segment.positions[segment.offsets[t] : segment.offsets[t + 1]].astype(np.int64) for t in terms), key=len)
                for p in lists[0]:
                    doc = int(np.searchsorted(segment.ends, p, "right"))
                    lo, hi = max(int(segment.starts[doc]), p - reach + 1), min(int(segment.ends[doc]), p + reach)
                    spots = [x[np.searchsorted(x, lo) : np.searchsorted(x, hi)] for x in lists]
                    if all(len(s) for s in spots):
                        where = sorted((int(q), k) for k, s in enumerate(spots) for q in s)
                        best = _least_stretch(where, len(spots), int(p))
                        if best and best[1] - best[0] <= reach:
                            yield keys.shape[1], names[w], *best


def _least_stretch(where: list[tuple[int, int]], kinds: int, through: int) -> tuple[int, int] | None:
    """The leftmost shortest stretch (begin, end) that holds every kind and the position ``through``."""
    best, have, left = None, [0] * kinds, 0
    for q, k in where:
        have[k] += 1
        while all(have):
            a = where[left][0]
            if a <= through:
                stretch = (a, max(q, through) + 1)
                if best is None or stretch[1] - stretch[0] < best[1] - best[0]:
                    best = stretch
            have[where[left][1]] -= 1
            left += 1
    return best


_SEGMENT = "ends binary, terms binary, offsets binary, positions binary, hit binary, found_doc array<int>, found_item array<string>"


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index: a row per segment with the ids and packed postings of its documents. Can be stored as a table."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["ids", *(c.split()[0] for c in _SEGMENT.split(", "))]

    def segment(ids: list, texts: list[str | None], id_type: pa.DataType) -> pa.RecordBatch:
        s = Segment.of(texts)
        packed = [pa.array([getattr(s, f).astype(t).tobytes()], pa.binary()) for f, t in Segment.FIELDS.items()]
        hit = pa.array([np.zeros(-(-s.n_words // 8), np.uint8).tobytes()], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(id_type)), *packed, hit, pa.array([[]], pa.list_(pa.int32())), pa.array([[]], pa.list_(pa.string()))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, size = [], [], 0
            for i, t in zip(batch.column(0), batch.column(1), strict=True):
                t = t.as_py()
                ids.append(i.as_py())
                texts.append(t)
                size += len(t or "")
                if size >= SEGMENT:
                    yield segment(ids, texts, batch.column(0).type)
                    ids, texts, size = [], [], 0
            if ids:
                yield segment(ids, texts, batch.column(0).type)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(tidy(run), f"ids array<{kind}>, {_SEGMENT}")


def _loaded(batch: pa.RecordBatch, row: int) -> Segment:
    return Segment(*(np.frombuffer(batch.column(1 + k)[row].as_buffer(), t) for k, t in enumerate(Segment.FIELDS.values())))


def _marking(spark: SparkSession, items: list[tuple[str, str | None]], width: int = WINDOW) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of index rows that marks the words in occurrences of the items' windows, and adds the items found."""
    windows = spark.sparkContext.broadcast(items)
    made: dict[int, Windows] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = made[0] = made.get(0) or Windows(windows.value, width)
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                s = _loaded(one, 0)
                bits = np.unpackbits(np.frombuffer(one.column(5)[0].as_buffer(), np.uint8), count=s.n_words, bitorder="little").astype(bool)
                found = set(zip(one.column(6)[0].as_py(), one.column(7)[0].as_py(), strict=True))
                for n, names, who, begin in test.phrases(s):
                    edge = np.zeros(s.n_words + 1, np.int64)
                    np.add.at(edge, begin, 1)
                    np.add.at(edge, begin + n, -1)
                    bits |= np.cumsum(edge[:-1]) > 0
                    doc = np.searchsorted(s.ends, begin, "right")
                    for d, w in set(zip(doc.tolist(), who.tolist(), strict=True)):
                        found.update((d, name) for name in names[w])
                pairs = sorted(found)
                new = [pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary()), pa.array([[d for d, _ in pairs]], pa.list_(pa.int32())), pa.array([[i for _, i in pairs]], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*one.columns[:5], *new], one.schema.names)

    return run


def _blocks(items: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[str, str | None]]]:
    """The test items, as blocks of at most ``BLOCK_WORDS`` words (or one item)."""
    block, size = [], 0
    rows = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")), F.col(text_col)).distinct()
    for name, text in rows.toLocalIterator():
        n = len(alnum_words((text or "").encode()))
        if block and size + n > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((name, text))
        size += n
    if block:
        yield block


def contamination(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per input row: ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated``.

    A word is hit if it lies in an occurrence of a window (13 consecutive words of an item; all words of a
    shorter one). Contaminated: at least one word in 20 is hit. A null or empty text has no words and is
    clean; an item without words matches nothing; an item without an id is named by the empty string.
    Repeated rows and items are fine: rows are judged each, an item id counts once. Other columns are
    ignored; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    index = stash(build_index(docs, id_col=id_col, text_col=text_col), "index")
    blocks = _blocks(items, item_col, item_text_col)
    block, search = next(blocks, []), None
    while search is None:
        following = next(blocks, None)
        found = _marking(docs.sparkSession, block)
        if following is None:
            search = found
        else:  # blocks take turns: one broadcast and one marked index at a time
            marked = stash(index.mapInArrow(tidy(found), index.schema), "index")
            unstash(index)
            index, block = marked, following
    names = [id_col, "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in search(batches):
            batch = batch.select(["ids", "ends", "hit", "found_doc", "found_item"])
            for row in range(batch.num_rows):
                ends = np.frombuffer(batch.column(1)[row].as_buffer(), np.int64)
                starts = np.r_[0, ends[:-1]]
                total = np.r_[0, np.cumsum(np.unpackbits(np.frombuffer(batch.column(2)[row].as_buffer(), np.uint8), count=int(ends[-1]), bitorder="little"), dtype=np.int64)]
                found: list[list[str]] = [[] for _ in ends]
                for d, item in zip(batch.column(3)[row].as_py(), batch.column(4)[row].as_py(), strict=True):
                    found[d].append(item)
                words, hit = ends - starts, total[ends] - total[starts]
                digest = [hashlib.sha256(",".join(sorted(f)).encode()).hexdigest() for f in found]
                yield pa.RecordBatch.from_arrays([batch.column(0)[row].values, pa.array(words, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(f) for f in found], pa.int64()), pa.array(digest, pa.string()), pa.array((hit > 0) & (HIT_SHARE * hit >= words), pa.bool_())], names)

    return index.mapInArrow(tidy(run), f"`{id_col}` {kind}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean")


def matches(index: DataFrame, items: DataFrame, *, slop: int = 0, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Every match: ``doc_id``, ``item_id``, ``begin`` and ``end`` (words of the document), ``kind`` phrase or proximity.

    Proximity matches (``slop`` over 0) are stretches of at most the window's length plus ``slop`` words that
    hold all its words in any order; one is reported per posting of the window's rarest word, and stretches
    that a phrase of the same length already covers are left out.
    """
    element = index.schema["ids"].dataType.elementType.simpleString()
    out = None
    for block in _blocks(items, item_col, item_text_col):
        shared = index.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            test = Windows(shared.value)
            for batch in batches:
                for row in range(batch.num_rows):
                    s = _loaded(batch, row)
                    ids = batch.column(0)[row].as_py()
                    rows = {(name, int(b), int(b) + n, "phrase") for n, names, who, begin in test.phrases(s) for w, b in zip(who, begin, strict=True) for name in names[w]}
                    if slop:
                        rows |= {(name, a, b, "proximity") for _, names, a, b in test.near(s, slop) for name in names if (name, a, b, "phrase") not in rows}
                    rows = sorted(rows)
                    doc = np.searchsorted(s.ends, [r[1] for r in rows], "right") if rows else []
                    yield pa.RecordBatch.from_arrays([pa.array([ids[d] for d in doc], batch.column(0).type.value_type), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] - int(s.starts[d]) for r, d in zip(rows, doc, strict=True)], pa.int64()), pa.array([r[2] - int(s.starts[d]) for r, d in zip(rows, doc, strict=True)], pa.int64()), pa.array([r[3] for r in rows], pa.string())], ["doc_id", "item_id", "begin", "end", "kind"])

        part = index.mapInArrow(run, f"doc_id {element}, item_id string, begin bigint, `end` bigint, kind string")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return index.sparkSession.createDataFrame([], f"doc_id {element}, item_id string, begin bigint, `end` bigint, kind string")
    return out.distinct()


def drop_contaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns but those of contaminated documents; cases as in ``contamination``."""
    keyed, key = with_key(docs, id_col, text_col)
    kept: list[DataFrame] = []
    with scope(kept):  # the index goes as soon as the verdicts are there
        found = stash(contamination(keyed, items, id_col=key, text_col=text_col).filter("contaminated").select(key).distinct(), "contaminated")
        kept.append(found)
    return without(keyed, key, found).drop(key)
