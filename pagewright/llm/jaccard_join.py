"""N-gram Jaccard join by token-combination prefixes, and the components that its links make.

A document is the set of hashes of its distinct 5-word shingles. Equal sets are one class from the start.
Between classes:

* Tokens (shingles) have a global order: by frequency class, rare ones first, each class by hash. Of a set of n tokens that
  must share t = ceil(0.8 n) with a partner, a prefix is indexed. With single tokens it holds n - t + 1
  tokens: any partner's prefix shares one of them.
* All tokens of all sets are counted. Those found more often than a limit are frequent, in three classes by
  count, each kept as a bitmap of bounded size; a token that shares a bit is merely treated as more frequent.
  The limit is 1, and more only where the bitmap would fill up: then texts with a fifth of their shingles
  unseen elsewhere, which is most of them, meet nobody. Common passages come last in the order, so they are
  indexed only by sets that hold little else. Frequent tokens are indexed as 2-token combinations:
  they are dealt into parts and the prefix is extended until
  rare + sum over parts of (tokens in the part - 1) >= n - t + 1.
  If a partner shared no rare token and at most one token in each part, then at least n - t + 1 of the
  prefix tokens would be missing from it, so t tokens could not be shared. The number of parts follows
  the size level of the set; levels grow by 1.25, so partners are at most one level apart, and each set
  is indexed at its own level and the next.
* Tokens found once only come first in the order and are not indexed: they meet nobody, and a set with more
  than a fifth of them has no partner at all.
* Sets that share an index entry are candidates. The lists with one least member are one group, its
  neighbourhood; so a pair that many lists hold is met in few groups. Members are compared with the first
  member, then with the one that has the fewest tokens of its own (a text that the others were made from): as
  many pairs as members. Only members that then still lie in different components, and whose tokens found
  elsewhere are enough for a link, are compared with one another, in blocks: the members of the group's
  largest component and all others are cut into blocks of bounded size, and each pair of blocks that can hold
  two components is one task, which counts shared tokens as a matrix product and returns a forest of links,
  never the pairs. Every link is verified on the whole sets.

Sets of three tokens or fewer link with no different set. Index entries travel packed, dealt by hash into
as many buckets as the data needs, so none is large. Sets are known by 64 bits of a salted hash; another 64
tell whether two sets share them, and if so all are made again with the next salt.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, in_bitmap, maybe_in, merged_bitmap, mix64, plain_words, release, sliced, stash, tidy, unstash, with_key, without
from .components import connected_components

SHINGLE = 5
#: Two sets link when 100 * shared >= 80 * united.
SHARE, OF = 80, 100
#: Bits of a bitmap of frequent tokens, at most.
CLASS_BITS = 1 << 27
#: The classes of frequent tokens begin at these multiples of the least frequent count.
CLASSES = (1, 16, 256)
#: Postings that are packed at a time, and how many a bucket should hold about.
CHUNK, BUCKET = 1 << 18, 1 << 19
#: Tokens of a block of members, about, each member counting as ``LEAST`` at least; and from which on a token is counted densely.
BLOCK, LEAST, DENSE = 1 << 18, 256, 24
#: Keys over which a neighbourhood is dealt where its members meet a row about it.
SALTS = 8
_K = np.array([pow(0xA0761D6478BD642F, k + 1, 1 << 64) for k in range(SHINGLE)], np.uint64)
#: Sizes at which the levels begin.
_LEVELS = [1]
while _LEVELS[-1] < 1 << 40:
    _LEVELS.append(max(_LEVELS[-1] + 1, -(-_LEVELS[-1] * OF // SHARE)))
_LEVELS = np.array(_LEVELS, np.int64)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct 5-word shingles; of the whole sequence if shorter; empty without words."""
    words = plain_words((text or "").encode())
    if not words:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(ids) - SHINGLE + 1
    if n < 1:
        return mix64(np.array([(ids * _K[: len(ids)]).sum(dtype=np.uint64) + np.uint64(len(ids))]))
    sums = ids[:n] * _K[0]
    for k in range(1, SHINGLE):
        sums += ids[k : n + k] * _K[k]
    return np.unique(mix64(sums))


def set_id(tokens: np.ndarray, salt: int = 0) -> tuple[int, int]:
    """Identity of a set: 64 bits of a salted cryptographic hash of its tokens, and 64 more to tell whether two sets share them."""
    raw = hashlib.blake2b(tokens.tobytes(), digest_size=16, salt=salt.to_bytes(8, "little")).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def frequent_above(n_tokens: int) -> int:
    """Tokens found more often than this are frequent: the least limit with which they surely set at most an eighth of the bits.

    Of all tokens, at most one in ``limit`` + 1 can be found more than ``limit`` times.
    """
    return max(1, -(-n_tokens * 8 // CLASS_BITS) - 1)


def needed(n: int) -> int:
    """Tokens of a set of n that a prefix must cover: n - ceil(0.8 n) + 1."""
    return n - -(-n * SHARE // OF) + 1


def combination_prefix(tokens: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Index entries of a sorted set, given the frequency class of each token (-1: in no other set, 0: rare)."""
    need = needed(len(tokens)) - int((rank < 0).sum())
    if need <= 0:
        return tokens[:0]
    rare = tokens[rank == 0]
    if len(rare) >= need:
        return rare[:need]
    common = tokens[np.argsort(rank, kind="stable")][int((rank <= 0).sum()) :]
    out = [rare]
    level = int(np.searchsorted(_LEVELS, len(tokens), "right")) - 1
    for at in (level, level + 1):
        parts = max(1, int(_LEVELS[at]) // 40)
        part = ((common * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(40)).astype(np.int64) % parts
        first = np.zeros(len(common), bool)
        first[np.unique(part, return_index=True)[1]] = True
        covered = np.cumsum(~first)
        take = int(np.searchsorted(covered, need - len(rare))) + 1
        chosen, part = common[:take], part[:take]
        order = np.argsort(part, kind="stable")
        chosen, part = chosen[order], part[order]
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        for lo, hi in zip(starts, np.r_[starts[1:], len(part)], strict=True):
            i, j = np.triu_indices(hi - lo, 1)
            out.append(mix64(chosen[lo:hi][i] * _K[0] + chosen[lo:hi][j] * _K[1] + np.uint64(at + 1)))
    return np.unique(np.concatenate(out))


def _distinct_sets(batches: Iterator[pa.RecordBatch], salt: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each set of a task once, whatever the number of its copies there."""
    seen: set[int] = set()
    for batch in sliced(batches):
        for text in batch.column(0):
            tokens = shingle_set(text.as_py())
            if len(tokens) and (k := set_id(tokens, salt)[0]) not in seen:
                seen.add(k)
                yield k, tokens


def _by_bucket(key: np.ndarray, buckets: int, *more: np.ndarray) -> pa.RecordBatch:
    """Rows (bucket, tokens, ...) with the packed tokens of each bucket and what belongs to them."""
    bucket = (key & np.uint64(buckets - 1)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    ends = np.r_[starts[1:], len(bucket)]
    packed = [pa.array([x[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()) for x in (key[order], *(m[order] for m in more))]
    return pa.RecordBatch.from_arrays([pa.array(bucket[starts], pa.int32()), *packed], ["bucket", "tokens", "more"])


def _chunks(entries: Iterator[tuple[int, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tokens and, for each, the set it is of; about ``CHUNK`` at a time."""
    tokens, ids, size = [], [], 0
    for k, own in entries:
        if len(own):
            tokens.append(own)
            ids.append(k)
            size += len(own)
        if size >= CHUNK:
            yield np.concatenate(tokens), np.repeat(np.array(ids, np.int64), [len(t) for t in tokens])
            tokens, ids, size = [], [], 0
    if tokens:
        yield np.concatenate(tokens), np.repeat(np.array(ids, np.int64), [len(t) for t in tokens])


_PACKED = "bucket int, tokens binary, more binary"


def _address(tokens: np.ndarray, buckets: int) -> np.ndarray:
    """What the count of a token goes by: its bucket and its upper 32 bits."""
    return (tokens >> np.uint64(32)) * np.uint64(buckets) | tokens & np.uint64(buckets - 1)


def _counted(texts: DataFrame, buckets: int, salt: int) -> DataFrame:
    """Per bucket, packed upper halves of the tokens: those found once in a chunk, and (half, count) of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, _ in _chunks((k, t) for k, t in _distinct_sets(batches, salt) if len(t) > 3):
            bucket = key & np.uint64(buckets - 1)
            values, counts = np.unique(bucket << np.uint64(32) | key >> np.uint64(32), return_counts=True)
            cuts = np.searchsorted(values, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32))
            halves, once, rows = values.astype(np.uint32), counts == 1, []
            for at, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                if a < b:
                    many = ~once[a:b]
                    rows.append((at, halves[a:b][~many].tobytes(), np.stack((halves[a:b][many], counts[a:b][many].astype(np.uint32))).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2))], ["bucket", "tokens", "more"])

    return texts.mapInArrow(tidy(run), _PACKED)


def _frequent(packed: DataFrame, buckets: int, limits: list[int]) -> DataFrame:
    """``above`` (a limit), ``n`` and ``ids``: packed addresses of tokens found more often; a row per bucket and limit."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = int(pdf["bucket"].iloc[0])
        once = np.concatenate([np.frombuffer(b, np.uint32) for b in pdf["tokens"]])
        many = np.concatenate([np.frombuffer(b, np.uint32).reshape(2, -1) for b in pdf["more"]], axis=1)
        del pdf
        half = np.concatenate((once, many[0]))
        order = np.argsort(half, kind="stable")
        counts = np.concatenate((np.ones(len(once), np.uint32), many[1]))[order]
        half = half[order]
        starts = np.flatnonzero(np.r_[True, half[1:] != half[:-1]])
        sums = np.add.reduceat(counts, starts, dtype=np.int64)
        ids = half[starts].astype(np.uint64) * np.uint64(buckets) | np.uint64(at)
        rows = [(x, int((sums > x).sum()), ids[sums > x].tobytes()) for x in limits]
        out = pd.DataFrame([r for r in rows if r[1]], columns=["above", "n", "ids"]).astype({"above": "int64", "n": "int64"})
        del once, many, half, order, counts, starts, sums, ids, rows
        release()
        return out

    return packed.groupBy("bucket").applyInPandas(run, "above bigint, n bigint, ids binary")


def _ranks(texts: DataFrame, n_tokens: int, buckets: int, salt: int):
    """The broadcast bitmaps: tokens found twice or more, then the classes of frequent tokens from the least limit on."""
    limits = [1, *((frequent_above(n_tokens) + 1) * x - 1 for x in CLASSES)]
    found = stash(_frequent(_counted(texts, buckets, salt), buckets, sorted(set(limits))), "frequent")
    n = {r["above"]: r["n"] for r in found.groupBy("above").agg(F.sum("n").alias("n")).collect()}
    size = lambda x: min(CLASS_BITS, 1 << max(16, (8 * n.get(x, 0)).bit_length()))
    bitmaps = {x: merged_bitmap(found.filter(F.col("above") == x).select("ids"), size(x)) for x in set(limits)}
    unstash(found)
    return texts.sparkSession.sparkContext.broadcast([bitmaps[x] for x in limits])


def _rank(tokens: np.ndarray, buckets: int, bitmaps: list[np.ndarray]) -> np.ndarray:
    """Frequency class of each token: -1 if surely in no other set, else in how many of the bitmaps after the first it is."""
    at = _address(tokens, buckets)
    rank = in_bitmap(at, bitmaps[0]).astype(np.int8) - np.int8(1)
    some = np.flatnonzero(rank == 0)
    for bitmap in bitmaps[1:]:
        some = some[in_bitmap(at[some], bitmap)]
        rank[some] += 1
    return rank


def _neighbourhoods(packed: DataFrame) -> DataFrame:
    """``centre``, ``id``: the members of all lists of two sets or more that have the centre as their least member, itself included."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        key = np.concatenate([np.frombuffer(b, np.uint64) for b in pdf["tokens"]])
        who = np.concatenate([np.frombuffer(b, np.int64) for b in pdf["more"]])
        del pdf
        order = np.lexsort((who, key))
        key, who = key[order], who[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        centre = np.repeat(who[starts], sizes)
        some = np.repeat(sizes > 1, sizes)
        centre, who = centre[some], who[some]
        order = np.lexsort((who, centre))
        centre, who = centre[order], who[order]
        fresh = np.r_[True, (centre[1:] != centre[:-1]) | (who[1:] != who[:-1])] if len(who) else np.empty(0, bool)
        out = pd.DataFrame({"centre": centre[fresh], "id": who[fresh]})
        del key, who, centre, order, some
        release()
        return out

    return packed.groupBy("bucket").applyInPandas(run, "centre bigint, id bigint").distinct()


def _links_of(shared: int, x: int, y: int) -> bool:
    return OF * shared >= SHARE * (x + y - shared)


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """Common values of two sorted arrays without repetition."""
    both = np.sort(np.concatenate((x, y)), kind="stable")
    return int((both[1:] == both[:-1]).sum())


def _numbered(coarse: np.ndarray) -> np.ndarray:
    """Sorted 16-bit values made distinct by the number of their occurrence."""
    wide = coarse.astype(np.int64)
    return wide << 32 | (np.arange(len(wide)) - np.searchsorted(wide, wide))


def _sifted(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """The pairs (a, b) that link as far as ``column`` of their sets can tell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = (lambda v: np.frombuffer(v.as_buffer(), np.uint64)) if column == "tokens" else (lambda v: _numbered(np.frombuffer(v.as_buffer(), np.uint16)))
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = read(x), read(y)
                keep.append(_links_of(min(len(x), len(y)), len(x), len(y)) and _links_of(_shared(x, y), len(x), len(y)))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("set_id").alias("a"), F.col(column).alias("_x"))
    right = sets.select(F.col("set_id").alias("b"), F.col(column).alias("_y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "_x", "_y").mapInArrow(tidy(run), "a bigint, b bigint")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, stored.

    First by the tokens' upper 16 bits: equal tokens have equal ones, so what these have in common is never
    less than what the sets share, and a quarter of the bytes clears most pairs. The rest meet as whole sets.
    """
    likely = stash(_sifted(pairs, sets, "coarse"), "likely")
    links = stash(_sifted(likely, sets, "tokens"), "links")
    unstash(likely)
    return links


def _star_pairs(near: DataFrame) -> DataFrame:
    """One pair (a, b) per member: b with a, the least centre near it."""
    return near.filter("centre <> id").groupBy(F.col("id").alias("b")).agg(F.min("centre").alias("a")).select("a", "b")


def _with_centre(rows: DataFrame, id_: str, centres: DataFrame, how: str = "inner") -> DataFrame:
    """The rows with what ``centres`` (a row per centre) says; a large neighbourhood is dealt over ``SALTS`` keys by its members' ids."""
    salt = F.pmod(F.xxhash64(id_), F.lit(SALTS)).cast("int").alias("salt")
    spread = centres.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return rows.select("*", salt).join(spread, ["centre", "salt"], how).drop("salt")


def _rooted(near: DataFrame, roots: DataFrame) -> DataFrame:
    """The members, with their ``root``, of the neighbourhoods that hold several components and could link all the same."""
    rooted = near.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    able = rooted.filter(OF * (F.col("n") - F.col("own")) >= SHARE * F.col("n"))
    split = able.groupBy("centre").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("centre")
    return _with_centre(able, "id", split, "left_semi")


def _may_link(a: str, b: str):
    """Whether two sets can link, if all their tokens found elsewhere were shared; columns are structs with n and own."""
    na, nb, shared = F.col(a)["n"], F.col(b)["n"], F.least(F.col(a)["n"] - F.col(a)["own"], F.col(b)["n"] - F.col(b)["own"])
    return OF * shared >= SHARE * (na + nb - shared)


def _centre_pairs(apart: DataFrame) -> DataFrame:
    """Per neighbourhood, each member of another component with its centre, and with the member that has the fewest tokens of its own."""
    rows = apart.select("centre", F.struct("id", "root", "n", "own").alias("y"))
    best = apart.groupBy("centre").agg(F.min(F.struct((F.col("own") / F.col("n")).alias("share"), "id", "root", "n", "own")).alias("x"))
    first = rows.filter(F.col("y")["id"] == F.col("centre")).select("centre", F.col("y").alias("x"))
    centres = best.select("centre", F.struct(*(F.col("x")[c].alias(c) for c in ("id", "root", "n", "own"))).alias("x")).unionByName(first)
    pairs = _with_centre(rows, "y.id", centres).filter((F.col("x")["root"] != F.col("y")["root"]) & _may_link("x", "y"))
    ids = F.col("x")["id"], F.col("y")["id"]
    return pairs.select(F.least(*ids).alias("a"), F.greatest(*ids).alias("b")).distinct()


def shared_tokens(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of the numbers of shared tokens of all pairs of sets.

    Tokens of few sets add to their pairs one by one; those of many are columns of 0 and 1, multiplied.
    """
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(t) for t in sets])
    token = np.concatenate(sets) if m else np.empty(0, np.uint64)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.empty(0, np.int64)
    times = np.diff(np.r_[starts, len(token)])
    column = np.repeat(np.arange(len(starts)), times)
    often = np.repeat(times, times)
    out = np.zeros((m, m), np.float32)
    many = often > DENSE
    who, which = owner[many], np.unique(column[many], return_inverse=True)[1]
    for at in range(0, int(which.max()) + 1 if len(which) else 0, 4096):
        inside = (which >= at) & (which < at + 4096)
        marks = np.zeros((m, min(4096, int(which.max()) + 1 - at)), np.float32)
        marks[who[inside], which[inside] - at] = 1
        out += marks @ marks.T
    few, where = owner[~many], column[~many]
    flat = np.zeros(m * m, np.int64)
    for back in range(1, DENSE):
        same = where[back:] == where[:-back]
        if not same.any():
            break
        flat += np.bincount(few[back:][same] * m + few[:-back][same], minlength=m * m)
    rest = flat.reshape(m, m)
    return np.rint(out).astype(np.int64) + rest + rest.T


def forest_of_links(sets: list[np.ndarray], roots: np.ndarray, outside: np.ndarray, inside_too: bool) -> list[tuple[int, int]]:
    """Places of pairs that link and make, with the given components, the same components as all links between them.

    Compared are the sets that are ``outside`` with those that are not and, if ``inside_too``, with one another.
    """
    n = np.array([len(t) for t in sets], np.int64)
    shared = shared_tokens(sets)
    link = (OF * shared >= SHARE * (n[:, None] + n[None, :] - shared)) & (roots[:, None] != roots[None, :])
    link &= outside[:, None] & (~outside[None, :] | inside_too)
    x, y = np.nonzero(link)
    if not len(x):
        return []
    root = np.unique(roots, return_inverse=True)[1]
    lo, hi = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
    _, one = np.unique(lo * (int(root.max()) + 1) + hi, return_index=True)
    up = list(range(int(root.max()) + 1))

    def top(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    out = []
    for k in one.tolist():
        a, b = top(int(lo[k])), top(int(hi[k]))
        if a != b:
            up[b] = a
            out.append((int(x[k]), int(y[k])))
    return out


def _block_links(apart: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that join the components of each neighbourhood as all links between its members would.

    The members of its largest component are cut into blocks by hash, the others too. A block of others meets
    every block of the former and every other block of others, each pair of blocks in a task of its own; pairs within the
    largest component are never looked at, nor are a neighbourhood's members ever together in one task unless they are few.
    """
    weight = F.greatest(F.col("n"), F.lit(LEAST))
    parts = apart.groupBy("centre", "root").agg(F.count("*").alias("m"), F.sum(weight).alias("t"))
    largest = parts.groupBy("centre").agg(F.max(F.struct("m", "root", "t")).alias("top"), F.sum("t").alias("t"))
    blocks = lambda t: F.ceil(t / BLOCK).cast("int")
    plan = largest.select("centre", F.col("top")["root"].alias("top"), blocks(F.col("top")["t"]).alias("ins"), blocks(F.col("t") - F.col("top")["t"]).alias("outs"))
    rows = _with_centre(apart.select("centre", "id", "root"), "id", plan).withColumn("outside", F.col("root") != F.col("top"))
    own = F.when(F.col("outside"), F.col("ins") + F.pmod(F.xxhash64("id"), "outs")).otherwise(F.pmod(F.xxhash64("id"), "ins")).cast("int")
    met = F.when(F.col("outside"), F.sequence(F.lit(0), F.col("ins") + F.col("outs") - 1)).otherwise(F.sequence("ins", F.col("ins") + F.col("outs") - 1))
    dealt = rows.withColumn("block", own).withColumn("other", F.explode(met)).filter((F.col("block") != F.col("other")))
    keyed = dealt.select("id", "centre", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "root", (F.col("block") > F.col("other")).alias("second"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["id"].to_numpy(np.int64)
        found = forest_of_links([np.frombuffer(t, np.uint64) for t in pdf["tokens"]], pdf["root"].to_numpy(np.int64), pdf["second"].to_numpy(bool), bool(pdf["lo"].iloc[0] == 0))
        return pd.DataFrame({"a": [ids[x] for x, _ in found], "b": [ids[y] for _, y in found]}, dtype="int64")

    whole = keyed.join(sets.select(F.col("set_id").alias("id"), "tokens"), "id")
    return whole.groupBy("centre", "lo", "hi").applyInPandas(run, "a bigint, b bigint").distinct()


def document_sets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", salt: int = 0) -> DataFrame:
    """``id_col``, ``n_shingles``, ``set_id`` and ``set_check`` (null for an empty set) per input row."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_shingles", "set_id", "set_check"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = [shingle_set(text.as_py()) for text in batch.column(1)]
            ids = [set_id(t, salt) if len(t) else (None, None) for t in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in sets], pa.int64()), *(pa.array([x[k] for x in ids], pa.int64()) for k in (0, 1))], names)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(tidy(run), f"`{id_col}` {kind}, n_shingles bigint, set_id bigint, set_check bigint")


def _links(texts: DataFrame, n_tokens: int, salt: int) -> DataFrame | None:
    """Component roots of the sets that have links: ``id``, ``root``; stored."""
    buckets = 1 << max(4, (n_tokens // BUCKET).bit_length())

    bitmaps = _ranks(texts, n_tokens, buckets, salt)

    def indexed(batches):
        for key, who in _chunks((k, combination_prefix(t, _rank(t, buckets, bitmaps.value))) for k, t in _distinct_sets(batches, salt) if len(t) > 3):
            yield _by_bucket(key, buckets, who)

    near = stash(_neighbourhoods(texts.mapInArrow(tidy(indexed), _PACKED)), "near")
    pairs = stash(_star_pairs(near), "pairs")
    n_pairs = pairs.count()
    if not n_pairs:
        unstash(pairs, near)
        return None
    bits = 1 << min(27, max(20, (16 * n_pairs).bit_length()))
    candidates = texts.sparkSession.sparkContext.broadcast(merged_bitmap(near.select("id"), bits))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = bits - 1
        ids, sets, size = [], [], 0
        own = lambda t: int((_rank(t, buckets, bitmaps.value) < 0).sum())
        row = lambda: pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([t.tobytes() for t in sets], pa.binary()), pa.array([(t >> np.uint64(48)).astype(np.uint16).tobytes() for t in sets], pa.binary()), pa.array([len(t) for t in sets], pa.int64()), pa.array([own(t) for t in sets], pa.int64())], ["set_id", "tokens", "coarse", "n", "own"])
        for k, tokens in _distinct_sets(batches, salt):
            if candidates.value[(k & mask) >> 3] >> (k & 7) & 1:
                ids.append(k)
                sets.append(tokens)
                size += tokens.nbytes
            if size > 1 << 22:
                yield row()
                ids, sets, size = [], [], 0
        if ids:
            yield row()

    sets = stash(texts.mapInArrow(tidy(whole), "set_id bigint, tokens binary, coarse binary, n bigint, own bigint").dropDuplicates(["set_id"]), "sets")
    edges = _verified(pairs, sets)
    roots = stash(connected_components(edges), "roots")
    unstash(edges)
    members = stash(near.join(sets.select(F.col("set_id").alias("id"), "n", "own"), "id"), "members")
    unstash(near)
    for last in (False, True):
        apart = stash(_rooted(members, roots), "apart")
        if last:
            extra = stash(_block_links(apart, sets), "links")
        else:
            rest = stash(_centre_pairs(apart).join(pairs, ["a", "b"], "left_anti"), "pairs")
            extra = _verified(rest, sets)
            unstash(rest)
        if not extra.isEmpty():
            # Components are kept by their stars, so only these and the new links are contracted again.
            star = roots.select(F.col("id").alias("a"), F.col("root").alias("b"))
            again = stash(connected_components(star.unionByName(extra)), "roots")
            unstash(roots)
            roots = again
        unstash(extra, apart)
    unstash(pairs, sets, members)
    return roots


def _identified(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, int]:
    """``document_sets``, its classes (``set_id``, ``_first``: the least id, ``n``), both stored, and the salt with which no two sets share an id."""
    for salt in range(16):
        own = stash(document_sets(docs, id_col=id_col, text_col=text_col, salt=salt), "own")
        classes = stash(own.filter("set_id is not null").groupBy("set_id").agg(F.min(F.col(id_col)).alias("_first"), F.max("n_shingles").alias("n"), F.min("set_check").alias("lo"), F.max("set_check").alias("hi")), "classes")
        if classes.filter("lo <> hi").isEmpty():
            return own, classes, salt
        unstash(own, classes)
    raise RuntimeError("different sets share an id under every salt")


def _classes(classes: DataFrame, texts: DataFrame, salt: int) -> DataFrame:
    """``set_id``, ``root`` (names the component) and ``least`` (the component's least ``_first``) of each distinct set."""
    n_tokens = classes.agg(F.sum("n")).first()[0] or 0
    roots = _links(texts, n_tokens, salt)
    if roots is None:
        return classes.select("set_id", F.col("set_id").alias("root"), F.col("_first").alias("least"))
    rooted = classes.select("set_id", "_first").join(roots.withColumnRenamed("id", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    return rooted.join(rooted.groupBy("root").agg(F.min("_first").alias("least")), "root").select("set_id", "root", "least")


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_shingles``, ``component_id`` (the least id that links reach) per input row.

    A null or empty text, or one without words, has an empty set, links with nothing and is its own
    component. Rows with equal sets are one class; repeated rows are, too. A row with a null id takes part
    and gets its component's least non-null id. Other columns are ignored; an empty table gives no rows.
    """
    own, classes, salt = _identified(docs, id_col, text_col)
    (least,) = free_names(own, "_least")
    named = stash(_classes(classes, docs.select(F.col(text_col)), salt).select("set_id", F.col("least").alias(least)), "named")
    unstash(classes)
    return own.join(named, "set_id", "left").select(F.col(id_col), "n_shingles", F.coalesce(least, F.col(id_col)).alias("component_id"))


def keep_one_per_component(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of one row of each component: the one with the least id (of several texts with that id, the one with the least hash).

    Rows without words stay all; cases otherwise as in ``jaccard_components``. Texts that stay are not shuffled.
    """
    keyed, key = with_key(docs, id_col, text_col)
    own, classes, salt = _identified(keyed, key, text_col)
    rooted = _classes(classes, docs.select(F.col(text_col)), salt)
    ids = keyed.select(F.col(key), F.col(id_col).alias("_id")).distinct()
    placed = stash(own.select(F.col(key), "set_id").join(rooted.select("set_id", "root"), "set_id").join(ids, key).select(F.col(key).alias("_key"), "_id", "root"), "placed")
    unstash(own, classes)
    best = F.min(F.struct(F.col("_id").isNull().alias("last"), "_id", "_key"))["_key"].alias(key)
    stays = placed.groupBy("root").agg(best).select(key)
    rows = placed.groupBy(F.col("_key").alias(key)).agg(F.count("*").alias("n"))
    marked = stash(rows.join(stays.withColumn("stays", F.lit(True)), key, "left").filter("n > 1 or stays is null").select(key, F.coalesce("stays", F.lit(False)).alias("again")), "dropped")
    unstash(placed)
    twice = marked.filter("again").select(key)
    maybe = maybe_in(twice.select(F.col(key)["a"].alias("a")))
    some = keyed.filter(maybe(F.col(key)["a"])).join(twice, key, "left_semi").dropDuplicates([key])
    return without(keyed, key, marked.select(key)).unionByName(some).drop(key)
