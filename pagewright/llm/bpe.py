"""Byte-level BPE by per-prefix dynamic programming.

For every prefix of a piece there is exactly one token that can end its encoding. It is found among
the vocabulary entries that are suffixes of the prefix (a suffix automaton reports them, longest
first): a candidate is right when its encoding is compatible with the last token of what stands before
it. Two tokens are compatible when no merge would join them across their border at the time at which
both stand there. Following the stored last tokens backwards emits the exact ids; counting along the
way gives the token count of every prefix. Work is linear in the piece for any input, also for runs of
one character on which repeated merging is quadratic.
"""

from __future__ import annotations

import hashlib
import json
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, tidy

#: Fixed value: the published split pattern of byte-level BPE.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct pieces whose encoding a worker remembers in each of two generations, unless told otherwise.
REMEMBERED = 1 << 15
#: Longer pieces are encoded again each time, so that memory stays bounded.
LONGEST_REMEMBERED = 64
NEVER = 1 << 60
#: Pieces whose prefixes are not pieces: the quote and the letters of a cut one part.
CONTRACTIONS = frozenset("'s 't 're 've 'm 'll 'd".split())


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable bytes stand for themselves, the rest follow from U+0100."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Tokens, ranks and halves of each token, read from a tokenizer file; one per process and path."""

    _loaded: dict[str, Vocabulary] = {}

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = _byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        model = spec["model"]
        ids = {raw(s): i for s, i in model["vocab"].items()}
        self.ids = ids
        top = max(ids.values()) + 1
        self.rank = [-1] * top
        self.left, self.right = list(range(top)), list(range(top))
        self.joined: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = map(raw, merge.split(" ") if isinstance(merge, str) else merge)
            whole = ids[a + b]
            self.joined[ids[a], ids[b]] = rank
            if self.rank[whole] < 0:
                self.rank[whole], self.left[whole], self.right[whole] = rank, ids[a], ids[b]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes = {i: b for b, i in ids.items()} | {i: s.encode() for s, i in self.special.items()}
        self.size = {i: len(b) for i, b in self.bytes.items()}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.split = regex.compile(SPLIT)
        self.matches = ahocorasick.Automaton()
        for b, i in ids.items():
            self.matches.add_word(b.decode("latin-1"), (len(b), i))
        self.matches.make_automaton()
        self._compatible: dict[int, dict[int, bool]] = {}
        self._known = 0

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the encoding of both tokens' text is just these two tokens.

        On the left of the border stand, over time, the right halves of ``a`` from the innermost to ``a``
        itself; on the right likewise the left halves of ``b``. Each lives from its own merge to the merge
        that takes it in. A merge across the border happens if its two tokens still stand when its rank
        comes; among equal ranks the leftmost place goes first.
        """
        left, right = [(a, NEVER)], [(b, NEVER)]
        while self.rank[left[-1][0]] >= 0:
            left.append((self.right[left[-1][0]], self.rank[left[-1][0]]))
        while self.rank[right[-1][0]] >= 0:
            right.append((self.left[right[-1][0]], self.rank[right[-1][0]]))
        i, j = len(left) - 1, len(right) - 1
        while True:
            (x, x_ends), (y, y_ends) = left[i], right[j]
            rank = self.joined.get((x, y), NEVER)
            if rank < x_ends and rank <= y_ends and rank < NEVER:
                return False
            if i == 0 and j == 0:
                return True
            if x_ends <= y_ends:
                i -= 1
                j -= x_ends == y_ends
            else:
                j -= 1

    def prefixes(self, piece: bytes) -> list[int]:
        """The last token of the encoding of every prefix of ``piece`` (-1 for the empty one)."""
        last = [-1]
        push, known, done = last.append, self._compatible, 0
        for end, (length, token) in self.matches.iter(piece.decode("latin-1")):
            if end < done:
                continue
            start = end + 1 - length
            if start:
                left = last[start]
                row = known.get(left)
                if row is None:
                    row = known[left] = {}
                fits = row.get(token)
                if fits is None:
                    fits = row[token] = self.compatible(left, token)
                    self._known += 1
                if not fits:
                    continue
            push(token)
            done = end + 1
        if done != len(piece):
            raise ValueError("the vocabulary has no token for some byte")
        if self._known >= 8 * REMEMBERED:
            self.forget()
        return last

    def forget(self) -> None:
        """Empties what is remembered of pairs."""
        self._compatible.clear()
        self._known = 0

    def prefix_counts(self, piece: bytes) -> list[int]:
        """The token count of every prefix of ``piece``, exact: one more than that of what stands before its last token."""
        count = [0]
        size = self.size
        for end, token in enumerate(self.prefixes(piece)):
            if end:
                count.append(count[end - size[token]] + 1)
        return count

    def encode_piece(self, piece: bytes) -> list[int]:
        last, size = self.prefixes(piece), self.size
        out, end = [], len(piece)
        while end:
            out.append(last[end])
            end -= size[last[end]]
        out.reverse()
        return out

    def pieces(self, text: str) -> list[str | int]:
        """The pieces that are encoded on their own; ids for special strings."""
        if self.special_split is None or not any(s in text for s in self.special):
            return self.split.findall(text)
        parts = self.special_split.split(text)
        return [x for part in parts for x in ([self.special[part]] if part in self.special else self.split.findall(part))]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


class Remembering(dict):
    """Calls ``make`` on a miss. When full, it becomes the older generation, of which only what is asked for again stays. Long keys are not kept."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make, self.older, self.size = make, {}, REMEMBERED

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
            if not isinstance(key, int) and len(key) > LONGEST_REMEMBERED:
                return value
        if len(self) >= self.size:
            self.older = dict(self)
            super().clear()
        self[key] = value
        return value

    def clear(self) -> None:
        super().clear()
        self.older = {}


class Encoder:
    """Encodes texts as the tokenizers library does without added begin or end tokens."""

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str) -> None:
        self.vocabulary = v = Vocabulary.load(path)
        self.ids = Remembering(lambda p: (p,) if isinstance(p, int) else tuple(v.encode_piece(p.encode())))

    @classmethod
    def load(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def forget(self) -> None:
        """Empties what is remembered: a worker that is used again by another operator must not hold it."""
        self.ids.clear()
        self.vocabulary.forget()

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.ids.__getitem__, self.vocabulary.pieces(text))))

    def decode(self, ids: list[int]) -> str:
        return self.vocabulary.decode(ids)


class PrefixCounts:
    """Exact token counts of the code-point prefixes of one text, from the stored prefix counts of its pieces.

    ``total`` is the whole text's count. ``count(p)`` is the count of ``text[:p]``: what stands before the
    piece that the cut meets keeps its encoding, so the stored sums answer for it; the counts of the cut
    piece's prefixes are made once and kept. Only cut special strings and contractions, and a run of blanks
    that ends at the cut after its first piece (it splits differently at the end of a text), are encoded again.
    ``fit(budget)`` is the longest prefix of at most so many tokens, found backwards over the stored counts.
    """

    def __init__(self, counter: Counter, text: str) -> None:
        self.counter, self.text = counter, text
        v = counter.vocabulary
        pieces = v.pieces(text)
        names = {i: s for s, i in v.special.items()}
        self.pieces = [names[p] if isinstance(p, int) else p for p in pieces]
        self.fixed = [isinstance(p, int) for p in pieces]
        self.starts = list(accumulate(map(len, self.pieces), initial=0))
        self.sums = list(accumulate((counter.counts[p] for p in pieces), initial=0))
        self.total = self.sums[-1]
        self.blanks = [len(p) - len(p.lstrip()) for p in self.pieces]
        self.stored: dict[int, list[int]] = {}

    def _blank(self, k: int) -> bool:
        return self.blanks[k] == len(self.pieces[k])

    def _within(self, k: int) -> list[int]:
        """The counts of all code-point prefixes of piece ``k``."""
        if k not in self.stored:
            piece = self.pieces[k]
            counts = self.counter.vocabulary.prefix_counts(piece.encode())
            self.stored[k] = [counts[at] for at in accumulate((len(c.encode()) for c in piece), initial=0)]
        return self.stored[k]

    def count(self, p: int) -> int:
        p = max(0, min(p, len(self.text)))
        if p == len(self.text):
            return self.total
        k = bisect_right(self.starts, p) - 1
        if self.starts[k] == p and not (k and self._blank(k - 1)):
            return self.sums[k]
        blank = p - self.starts[k] <= self.blanks[k]
        if self.fixed[k] and self.starts[k] < p:
            # A cut special string is ordinary text, which blanks and marks before it may join.
            for _ in range(3):
                k -= k > 0 and not self.fixed[k - 1]
            blank = self.text[self.starts[k] : p].strip() == ""
        while k > 0 and blank and not self.fixed[k - 1] and self._blank(k - 1):
            k -= 1
        if p <= self.starts[k + 1] and not self.fixed[k] and self.pieces[k] not in CONTRACTIONS:
            return self.sums[k] + self._within(k)[p - self.starts[k]]
        return self.sums[k] + sum(self.counter.counts[x] for x in self.counter.vocabulary.pieces(self.text[self.starts[k] : p]))

    def fit(self, budget: int) -> int:
        if self.total <= budget:
            return len(self.text)
        k = min(bisect_right(self.sums, budget) + 2, len(self.pieces))
        p = self.starts[k]
        while p > 0 and self.count(p) > budget:
            p -= 1
        return p


class Counter:
    """Counts tokens without building ids."""

    _made: dict[str, Counter] = {}

    def __init__(self, path: str) -> None:
        self.vocabulary = v = Vocabulary.load(path)
        self.counts = Remembering(lambda p: 1 if isinstance(p, int) else v.prefix_counts(p.encode())[-1])

    @classmethod
    def load(cls, path: str) -> Counter:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def forget(self) -> None:
        self.counts.clear()
        self.vocabulary.forget()

    def count(self, text: str) -> int:
        return sum(map(self.counts.__getitem__, self.vocabulary.pieces(text)))

    def prefixes(self, text: str) -> PrefixCounts:
        return PrefixCounts(self, text)


def encode_documents(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True, remembered: int = REMEMBERED) -> DataFrame:
    """Encode and decode every whole text.

    Returns ``id_col``, ``ids`` (array of int, absent unless ``keep_ids``), ``n_tokens``, ``ids_sha256``,
    ``decoded_sha256`` and ``round_trip`` (decoding gives the text back). One row per input row: a null
    text counts as empty, repeated rows are encoded each, other columns are ignored, an empty table gives
    no rows. Texts of any length are encoded whole; special strings inside a text become their ids.
    ``path`` must exist on every executor. A worker remembers twice ``remembered`` pieces at most (some 250 bytes
    each), up to the end of its partition.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, " + "ids array<int>, " * keep_ids + "n_tokens bigint, ids_sha256 string, decoded_sha256 string, round_trip boolean"
    names = [id_col, *(["ids"] if keep_ids else []), "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.load(path)
        encoder.ids.size = remembered
        decimal = Remembering(str)
        for batch in sliced(batches, 1 << 18):
            out: dict[str, list] = {n: [] for n in names[1:]}
            for text in batch.column(1):
                text = text.as_py() or ""
                ids = encoder.encode(text)
                back = encoder.decode(ids)
                if keep_ids:
                    out["ids"].append(np.array(ids, np.int32))
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(back.encode()).hexdigest())
                out["round_trip"].append(back == text)
            types = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64(), "round_trip": pa.bool_()}
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[n], types.get(n, pa.string())) for n in names[1:])], names)
        encoder.forget()

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(tidy(run), schema)


def count_tokens(docs: DataFrame, path: str, *, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """Exact token counts of every whole text, and the longest prefix that fits ``limit``.

    Returns ``id_col``, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` (more than ``limit`` tokens) and
    ``fit_chars`` (code points of the longest prefix of at most ``limit`` tokens, encoded on its own). One
    row per input row: a null text counts as empty, repeated rows are counted each, other columns are
    ignored, an empty table gives no rows. ``remembered`` as in ``encode_documents``.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_bytes", "n_tokens", "over_limit", "fit_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.load(path)
        counter.counts.size = remembered
        for batch in sliced(batches):
            size, tokens, fits = [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                n = counter.count(text)
                size.append(len(text.encode()))
                tokens.append(n)
                fits.append(counter.prefixes(text).fit(limit) if n > limit else len(text))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_()), pa.array(fits, pa.int64())], names)
        counter.forget()

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(tidy(run), f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean, fit_chars bigint")
