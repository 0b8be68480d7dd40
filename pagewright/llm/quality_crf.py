"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad from features of itself and of its neighbours (shares of upper case,
digits, punctuation, symbols and separators, word lengths, repeated words and lines) and from learned transitions
between lines. Forward-backward gives each line's probability of being good; a document's score is their
mean, weighted by the lines' lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PolyHash, held_out, sliced, tidy
from .crf import Adam, Chains, observed_transitions

#: Expected number of labelled documents that the model is fitted to; their ids are chosen by hash.
SAMPLE = 3000
#: Lines of one of them that fitting looks at, at most: those in its middle.
SAMPLE_LINES = 400
#: A document counts as good from this score on.
THRESHOLD = 0.3
_ROUNDS, _RATE, _RIDGE = 300, 0.1, 0.1
_CLASSES = 11
_CLASS = np.full(256, 0, np.uint8)  # lower case and bytes of other scripts
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[9, 11, 12, 13, 32]] = 3
for _k, _group in enumerate((b".", b",;:", b"!?", b"|", b"#*$%&<>", b"\"'()-_/\\[]{}=+~^`@"), 4):
    _CLASS[list(_group)] = _k
_CLASS[[*range(0, 9), *range(14, 32), 127]] = 10
_OWN = 19


def line_features(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, lines per text and bytes per line.

    ``data`` is the bytes of all texts one after the other and ``ends`` where each text ends; an empty text
    has one empty line.
    """
    n = len(data)
    begins = np.r_[0, ends[:-1]]
    breaks = np.flatnonzero(data == 10)
    text_of_break = np.searchsorted(ends, breaks, "right")
    lines = np.bincount(text_of_break, minlength=len(ends)) + 1
    which = np.repeat(np.arange(len(ends)), lines)
    first = np.r_[True, which[1:] != which[:-1]]
    last = np.r_[first[1:], True]
    start, stop = np.empty(len(which), np.int64), np.empty(len(which), np.int64)
    start[first], stop[last] = begins, ends
    start[~first], stop[~last] = breaks + 1, breaks
    size = stop - start
    cls = _CLASS[data]
    cls[breaks] = 3
    owner = np.repeat(np.arange(len(which)), np.diff(np.r_[start, n])) if n else np.empty(0, np.int64)
    counts = np.bincount(owner * _CLASSES + cls, minlength=len(which) * _CLASSES).reshape(-1, _CLASSES).astype(float)
    counts[:, 3] -= ~last
    word_at = np.flatnonzero((cls != 3) & np.r_[True, cls[:-1] == 3]) if n else np.empty(0, np.int64)
    # A text's first byte begins a word whatever stands before it in the buffer.
    heads = begins[(ends > begins)]
    heads = heads[cls[heads] != 3]
    word_at = np.union1d(word_at, heads)
    words = np.bincount(owner[word_at], minlength=len(which)).astype(float)
    key, echoes = np.zeros(len(which), np.uint64), np.zeros((len(which), 2))
    if n:
        hashes = PolyHash(data, 5)
        key = hashes.span(start, size)
        word_end = np.r_[np.flatnonzero(cls == 3), n]
        word_end = np.minimum(word_end[np.searchsorted(word_end, word_at)], stop[owner[word_at]])
        word, line_of = hashes.span(word_at, word_end - word_at), owner[word_at]
        for back in (1, 2):
            echo = (word[back:] == word[:-back]) & (line_of[back:] == line_of[:-back])
            echoes[:, back - 1] = np.bincount(line_of[back:][echo], minlength=len(which))
    order = np.lexsort((np.arange(len(which)), key, which))
    repeated = np.zeros(len(which))
    repeated[order[1:]] = (which[order[1:]] == which[order[:-1]]) & (key[order[1:]] == key[order[:-1]]) & (size[order[1:]] > 0)
    length, some = np.maximum(size, 1), np.maximum(words, 1)
    own = np.empty((len(which), _OWN))
    own[:, 0] = 1
    own[:, 1] = counts[:, 1] / length
    own[:, 2] = counts[:, 2] / length
    own[:, 3] = counts[:, 3] / length
    own[:, 4:10] = np.minimum(counts[:, 4:10] / some[:, None], 2)
    own[:, 10] = counts[:, 10] / length
    own[:, 11] = np.log1p(size) / 5
    own[:, 12] = np.minimum((size - counts[:, 3]) / some / 10, 2)
    own[:, 13] = repeated
    own[:, 14] = size == 0
    own[:, 15] = words < 4
    own[:, 16] = np.minimum(counts[:, 8] / length * 4, 2)
    own[:, 17:19] = echoes / some[:, None]
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:][~first[1:]] = own[:-1][~first[1:]]
    after[:-1][~last[:-1]] = own[1:][~last[:-1]]
    return np.hstack([own, before, after]), lines, size


def fit(features: np.ndarray, lines: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    """Weights and transitions that maximise the likelihood of the lines' labels, with a ridge penalty."""
    weights = {"emission": np.zeros((features.shape[1], 2)), "transition": np.zeros((2, 2))}
    if not len(labels):
        return weights
    y = np.repeat(labels, lines)
    chains, adam = Chains(lines), Adam(_RATE)
    target = np.eye(2)[y]
    seen = observed_transitions(y, lines, 2)
    for _ in range(_ROUNDS):
        p, expected, _ = chains.marginals(features @ weights["emission"], weights["transition"], pairs=True)
        adam.step(weights, {"emission": (features.T @ (target - p) - _RIDGE * weights["emission"]) / len(lines), "transition": (seen - expected - _RIDGE * weights["transition"]) / len(lines)})
    return weights


def scores(weights: dict[str, np.ndarray], features: np.ndarray, lines: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Per text: mean over its lines, weighted by length, of the probability of being good."""
    good = Chains(lines).marginals(features @ weights["emission"], weights["transition"])[:, 1]
    which = np.repeat(np.arange(len(lines)), lines)
    weight = size + 1.0
    return np.clip(np.bincount(which, good * weight, len(lines)) / np.bincount(which, weight, len(lines)), 0, 1)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    parts = [(t.as_py() or "").encode() for t in texts]
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts], dtype=np.int64)


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, lines_per_document: int = SAMPLE_LINES) -> dict[str, np.ndarray]:
    """Fit to about ``sample`` labelled documents outside the held-out fold.

    Rows of ``labels`` without id or with a label other than 0 and 1 are ignored. Which documents are in the
    sample depends on a hash of their ids; executors turn their texts into features, and only these come
    to the driver, of at most ``lines_per_document`` neighbouring lines of each.
    """
    usable = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).filter(F.col("_id").isNotNull() & F.col("_label").isin(0, 1) & ~held_out(F.col("_id"))).distinct()
    n = usable.count()
    part = F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / max(n, 1)))
    chosen = usable.filter(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            if batch.num_rows:
                features, lines, _ = line_features(*_bytes(batch.column(2)))
                cut = [c[(skip := max(0, len(c) - lines_per_document) // 2) : skip + lines_per_document] for c in np.split(features.astype(np.float32), np.cumsum(lines)[:-1])]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in cut], pa.binary())], ["id", "label", "features"])

    texts = docs.select(F.col(id_col), F.col(text_col)).join(chosen, F.col(id_col) == F.col("_id")).select("_id", "_label", text_col)
    rows = sorted((str(r[0]), r[1], bytes(r[2])) for r in texts.mapInArrow(run, f"id {usable.schema['_id'].dataType.simpleString()}, label int, features binary").collect())
    blocks = [np.frombuffer(r[2], np.float32).reshape(-1, 3 * _OWN) for r in rows]
    features = np.concatenate(blocks).astype(float) if blocks else np.zeros((0, 3 * _OWN))
    return fit(features, np.array([len(b) for b in blocks], np.int64), np.array([r[1] for r in rows], np.int64))


def quality_scores(docs: DataFrame, weights: dict[str, np.ndarray], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``held_out``, ``score`` (0 to 1, higher: better) and ``predicted`` per input row.

    A null or empty text is one empty line and is scored as such. Repeated rows are scored each; a null id
    is never held out; other columns are ignored; an empty table gives no rows. A model fitted to no labels
    scores every text 0.5.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            if batch.num_rows:
                score = scores(shared.value, *line_features(*_bytes(batch.column(2))))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array((score >= THRESHOLD).astype(np.int32), pa.int32())], [id_col, "held_out", "score", "predicted"])

    return docs.select(F.col(id_col), held_out(F.col(id_col)).alias("_held_out"), F.col(text_col)).mapInArrow(tidy(run), f"`{id_col}` {kind}, held_out boolean, score double, predicted int")
