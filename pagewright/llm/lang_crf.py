"""Language identification of code-switched text by a linear-chain conditional random field over words.

Each word of a line is labelled with a language from its affixes, its character 3-grams and its place in
the lexicon (all as hashed features), and from learned transitions between the languages of neighbouring
words. A text's language is the one with the largest sum of the words' forward-backward marginals,
weighted by their lengths; the score is its share.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, sliced, tidy
from .crf import Adam, Chains, observed_transitions

#: Expected number of documents of each language that the model is fitted to, chosen by a hash of their ids.
SAMPLE = 250
#: Words of each language that fitting looks at, at most, unless ``train`` is told otherwise; of one training line; and of one document.
TRAIN_WORDS, LINE_WORDS, DOCUMENT_WORDS = 60_000, 200, 4_000
#: Hashed features, and words whose features' sum a worker remembers.
BUCKETS, REMEMBERED = 1 << 15, 1 << 18
_ROUNDS, _RATE, _RIDGE = 60, 0.1, 0.02
#: Share of the training lines into which a stretch of another language is put.
_SWITCHED = 0.3
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*+")


def line_words(text: str | None) -> list[list[str]]:
    """The words (letters with the marks on them, lower case) of each line that has some."""
    return [w for line in (text or "").lower().split("\n") if (w := _WORD.findall(line))]


def word_features(word: str) -> list[int]:
    """Buckets of the word itself, its affixes of 1 to 3 letters and its 3-grams with borders."""
    framed = f"<{word}>"
    names = ["w" + word, *(f"p{word[:k]}" for k in (1, 2, 3)), *(f"s{word[-k:]}" for k in (1, 2, 3)), *(f"g{framed[k : k + 3]}" for k in range(len(framed) - 2))]
    return [zlib.crc32(n.encode()) & (BUCKETS - 1) for n in names]


class Emissions(dict):
    """Place of each word in a table of emission scores; the table is emptied when it is full."""

    def __init__(self, weights: np.ndarray) -> None:
        super().__init__()
        self.weights = weights
        self.new: list[str] = []
        self.table = np.zeros((0, weights.shape[1]))

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        self.new.append(word)
        return at

    def of(self, words: list[str]) -> np.ndarray:
        if len(self) > REMEMBERED:
            self.clear()
            self.table = self.table[:0]
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            features = [word_features(w) for w in self.new]
            flat = self.weights[np.concatenate([np.array(f) for f in features])]
            sums = np.add.reduceat(flat, np.r_[0, np.cumsum([len(f) for f in features])[:-1]], axis=0)
            self.table = np.concatenate([self.table, sums])
            self.new = []
        return self.table[at]


def fit(lines: list[tuple[int, list[str]]], languages: int, words_per_language: int = TRAIN_WORDS) -> dict[str, np.ndarray]:
    """Weights from lines of known language; some get a stretch of another line put in, so that transitions are learned.

    Lines are cut into parts of ``LINE_WORDS`` words and drawn in an order given by a seed, until each language
    has ``words_per_language`` words or no more lines.
    """
    weights = {"emission": np.zeros((BUCKETS, languages)), "transition": np.zeros((languages, languages))}
    if not lines:
        return weights
    lines = [(label, line[k : k + LINE_WORDS]) for label, line in lines for k in range(0, len(line), LINE_WORDS)]
    rng = np.random.default_rng(7)
    drawn = [0] * languages
    words, labels, lengths = [], [], []
    order = rng.permutation(len(lines))
    for k, at in enumerate(order):
        label, own = lines[at]
        if drawn[label] >= words_per_language:
            continue
        drawn[label] += len(own)
        tags = [label] * len(own)
        if rng.random() < _SWITCHED:
            other, guest = lines[order[rng.integers(len(order))]]
            n, cut = int(rng.integers(2, 11)), int(rng.integers(len(own) + 1))
            own, tags = own[:cut] + guest[:n] + own[cut:], tags[:cut] + [other] * len(guest[:n]) + tags[cut:]
        words += own
        labels += tags
        lengths.append(len(own))
    lexicon = {w: i for i, w in enumerate(dict.fromkeys(words))}
    features = [word_features(w) for w in lexicon]
    starts = np.r_[0, np.cumsum([len(f) for f in features])]
    flat = np.concatenate([np.array(f) for f in features])
    owner = np.repeat(np.arange(len(lexicon)), np.diff(starts))
    at = np.fromiter((lexicon[w] for w in words), np.int64, len(words))
    labels, lengths = np.array(labels), np.array(lengths)
    target, seen = np.eye(languages)[labels], observed_transitions(labels, lengths, languages)
    chains, adam = Chains(lengths), Adam(_RATE)
    for _ in range(_ROUNDS):
        emission = np.add.reduceat(weights["emission"][flat], starts[:-1], axis=0)[at]
        p, expected, _ = chains.marginals(emission, weights["transition"], pairs=True)
        rest = target - p
        by_word = np.stack([np.bincount(at, rest[:, k], len(lexicon)) for k in range(languages)], axis=1)
        by_feature = np.stack([np.bincount(flat, by_word[owner, k], BUCKETS) for k in range(languages)], axis=1)
        adam.step(weights, {"emission": (by_feature - _RIDGE * weights["emission"]) / len(lengths), "transition": (seen - expected - _RIDGE * weights["transition"]) / len(lengths)})
    return weights


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, words_per_language: int = TRAIN_WORDS, words_per_document: int = DOCUMENT_WORDS) -> tuple[list[str], dict[str, np.ndarray]]:
    """The languages and weights, fitted to about ``sample`` documents of each language outside the held-out fold.

    Of these, fitting looks at ``words_per_language`` words of each language at most, drawn line by line. Rows
    without id, text or language are ignored. Two passes: languages are counted, then the rows whose hashed id falls
    under the language's share are cut into lines of words by executors, and at most ``words_per_document`` words of each, in lines spread
    evenly over it, come to the driver.
    """
    usable = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text")).filter(F.col("_id").isNotNull() & F.col("_lang").isNotNull() & ~held_out(F.col("_id")))
    counts = {r["_lang"]: r["n"] for r in usable.groupBy("_lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return [], fit([], 1)
    hashed = F.pmod(F.xxhash64("_id"), F.lit(1 << 30))
    part = F.lit(False)
    for lang, n in counts.items():
        part = part | ((F.col("_lang") == lang) & (hashed < int((1 << 30) * min(1.0, sample / n))))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = []
            for text in batch.column(2):
                lines = [w[k : k + LINE_WORDS] for w in line_words(text.as_py()) for k in range(0, len(w), LINE_WORDS)]
                spread = -(-sum(map(len, lines)) // words_per_document)
                out.append([" ".join(w) for w in lines[:: max(1, spread)]])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.string()))], ["lang", "id", "lines"])

    chosen = usable.filter(part).select(F.col("_lang").cast("string"), F.col("_id").cast("string"), "_text")
    rows = sorted((r["lang"], r["id"], r["lines"]) for r in chosen.mapInArrow(words, "lang string, id string, lines array<string>").collect())
    return languages, fit([(languages.index(lang), line.split(" ")) for lang, _, lines in rows for line in lines], len(languages), words_per_language)


def identify(docs: DataFrame, languages: list[str], weights: dict[str, np.ndarray], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``held_out``, ``lang_pred``, ``score`` and ``n_switches`` per input row.

    ``lang_pred`` is one of ``languages``, or ``und`` (score 0) for a null text, one without a letter, or a
    model without languages; ``n_switches`` counts neighbouring words of a line whose likeliest languages
    differ. Ties go to the language that sorts first. Repeated rows are judged each; a null id is never held
    out; other columns are ignored; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((languages, weights))
    made: dict[int, Emissions] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, model = shared.value
        emissions = made[0] = made.get(0) or Emissions(model["emission"])
        for batch in sliced(batches):
            lines = [line_words(t.as_py()) for t in batch.column(2)]
            words = [w for doc in lines for line in doc for w in line]
            lengths = np.array([len(line) for doc in lines for line in doc], np.int64)
            sums = np.zeros((len(lines), max(1, len(names))))
            switches = np.zeros(len(lines), np.int64)
            if words and names:
                p = Chains(lengths).marginals(emissions.of(words), model["transition"])
                doc = np.repeat(np.arange(len(lines)), [sum(map(len, d)) for d in lines])
                weight = np.fromiter(map(len, words), float, len(words))
                for k in range(len(names)):
                    sums[:, k] = np.bincount(doc, p[:, k] * weight, len(lines))
                line = np.repeat(np.arange(len(lengths)), lengths)
                best = p.argmax(axis=1)
                change = (best[1:] != best[:-1]) & (line[1:] == line[:-1])
                switches = np.bincount(doc[1:][change], minlength=len(lines))
            total = sums.sum(axis=1)
            top = sums.argmax(axis=1)
            score = np.where(total > 0, sums[np.arange(len(lines)), top] / np.maximum(total, 1e-300), 0.0)
            pred = [names[t] if n > 0 else "und" for t, n in zip(top, total, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(np.clip(score, 0, 1), pa.float64()), pa.array(switches, pa.int64())], [id_col, "held_out", "lang_pred", "score", "n_switches"])

    return docs.select(F.col(id_col), held_out(F.col(id_col)).alias("_held_out"), F.col(text_col)).mapInArrow(tidy(run), f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double, n_switches bigint")
