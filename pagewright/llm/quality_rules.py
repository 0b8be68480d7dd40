"""Quality rules per document and per host.

Document rules count words, symbols, repeated lines and repeated 8-word windows. Failures are then
aggregated by host; each host's failure rate is shrunk towards an empirical beta prior that is fitted
to all hosts by moments, so that a host of three documents is not condemned by two of them; the
host's verdict is joined back to its documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, sliced, stash, tidy, with_key, without

WINDOW = 8
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
MAX_REPEAT_PCT = 30
#: A document also counts as a failure of its host with more symbols than this share of its words ...
MAX_SYMBOL_PCT = 50
#: ... or with more than this share of its lines repeated.
MAX_DUP_LINE_PCT = 50
#: Hosts whose shrunk failure rate is above this lose all their documents.
MAX_HOST_RATE = 0.5
_MULTIPLIERS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(WINDOW)], np.uint64)


def repeated_window_words(words: list[bytes]) -> int:
    """Words that lie in a window of 8 words found twice or more in the text, the first one included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.uint64, len(words))
    key = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        key += ids[k : n + k] * _MULTIPLIERS[k]
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    a, b = order[1:][same], order[:-1][same]
    repeated = np.zeros(n, bool)
    if all((ids[a + k] == ids[b + k]).all() for k in range(WINDOW)):
        repeated[a] = repeated[b] = True
    else:  # two different windows share a hash: count the windows themselves
        windows = list(zip(*(words[k : n + k] for k in range(WINDOW)), strict=True))
        counts = Counter(windows)
        repeated[:] = [counts[w] > 1 for w in windows]
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, np.flatnonzero(repeated), 1)
    np.add.at(edges, np.flatnonzero(repeated) + WINDOW, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def rule_counts(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (lines with a word)."""
    text = text or ""
    words = text.encode().split()
    seen: set[str] = set()
    lines = dups = 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            lines += 1
            dups += line in seen
            seen.add(line)
    return len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), dups, repeated_window_words(words), lines


def document_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``id_col``, ``host``, the counts, ``base_failed`` and ``failed`` (any rule) per input row."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = [rule_counts(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(6))], names)

    counted = docs.select(F.col(id_col), F.col(host_col).cast("string").alias("host"), F.col(text_col)).mapInArrow(tidy(run), f"`{id_col}` {kind}, host string, " + ", ".join(f"{n} bigint" for n in names[2:]))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))
    soft = (100 * F.col("n_symbols") > MAX_SYMBOL_PCT * F.col("n_words")) | (100 * F.col("n_dup_lines") > MAX_DUP_LINE_PCT * F.col("n_lines"))
    return counted.withColumn("base_failed", base).withColumn("failed", base | soft)


def host_verdicts(rules: DataFrame) -> DataFrame:
    """``host``, ``n_docs``, ``n_failed``, ``host_rate`` (shrunk), ``host_bad``.

    The prior's two parameters come from one aggregate over the hosts (a single row); with fewer than two
    hosts, or rates that vary too little or too much for a beta prior, the prior weighs as ten documents.
    """
    hosts = rules.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("failed").cast("bigint")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg(F.avg(rate).alias("mean"), F.var_pop(rate).alias("var")).first()
    mean, var = prior["mean"] or 0.0, prior["var"] or 0.0
    weight = mean * (1 - mean) / var - 1 if 0 < var < mean * (1 - mean) else 10.0
    shrunk = (F.col("n_failed") + F.lit(mean * weight)) / (F.col("n_docs") + F.lit(weight))
    return hosts.withColumn("host_rate", shrunk).withColumn("host_bad", F.col("host_rate") > MAX_HOST_RATE)


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Rule counts, ``base_failed``, ``host_rate`` and ``kept`` per input row.

    Texts are read once: the counts (a few numbers a row) are stored, hosts are aggregated from them with
    partial sums, and only the numbers meet the host table, never the texts. A hot host is one row of the
    host table, and its documents are only sums there.

    A null or empty text has no words and fails the base rules. Rows without a host form one host of
    their own. Repeated rows are judged each. Other columns are ignored; an empty table gives no rows.
    """
    rules = stash(document_rules(docs, id_col=id_col, text_col=text_col, host_col=host_col), "rules")
    hosts = host_verdicts(rules).select(F.col("host").alias("_host"), "host_rate", "host_bad")
    joined = rules.join(hosts, F.col("host").eqNullSafe(F.col("_host")), "left")
    return joined.drop("_host").withColumn("kept", ~F.col("base_failed") & ~F.col("host_bad"))


def drop_rejected(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """All rows and columns but those of rejected documents; cases as in ``quality_rules``."""
    # A text that appears under two hosts is judged by host, so the host is part of the key here.
    keyed, key = with_key(docs, id_col, text_col, host_col)
    rejected = stash(quality_rules(keyed, id_col=key, text_col=text_col, host_col=host_col).filter("not kept").select(key).distinct(), "rejected")
    return without(keyed, key, rejected).drop(key)
