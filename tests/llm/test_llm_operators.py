"""Training-data operators against brute force, the tokenizer library, round trips and held-out accuracy."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pagewright.llm import boosting, bpe, chat, common, components, decontaminate, html_extract, jaccard_join, lang_crf, quality_crf, quality_rules, queries, suffix_dedup
from pagewright.llm.components import connected_components
from pagewright.llm.crf import Chains
from pyspark.sql import functions as F

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def vocabulary(rng, n):
    return ["".join(rng.choice("abcdeéñüfghil") for _ in range(rng.randint(1, 7))) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    """Texts with copies, near copies, shared passages, repeated runs, nulls, blanks, repeated rows."""
    rng = random.Random(3)
    words = vocabulary(rng, 400)
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, rows = text(60), []
    for k in range(60):
        rows.append([k, text(rng.randint(1, 160)), "en", f"src{k % 4}", 1])
    base = text(120).split()
    for k in range(60, 100):  # near copies of one text, some too far
        own = base[:]
        for _ in range(rng.randint(0, 9)):
            own[rng.randrange(len(own))] = rng.choice(words)
        rows.append([k, " ".join(own), "en", "src0", 1])
    for k in range(100, 120):
        rows.append([k, f"{text(rng.randint(5, 60))} {passage} {text(rng.randint(0, 60))}", None, "src1", 1])
    rows += [[120, None, None, None, None], [121, "", "en", "src2", 0], [122, " \n\t ", "en", "src2", 3], [123, "a", "en", None, 1], [124, "a b c", "en", "src3", 5], [125, "a b c", "en", "src3", 5]]
    rows += [[126, "x" * 900, "en", "src3", 900], [127, "ab " * 700, "en", "src3", 2100], [128, rows[5][1], "en", "src0", 1], [128, rows[5][1], "en", "src0", 1], [129, "É" * 300 + passage, "fr", "src0", 1]]
    return [tuple(r) for r in rows]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    return spark.createDataFrame(corpus, DOCS).withColumn("kept", F.lit(1)).withColumn("set_id", F.lit("clash")).withColumn("_text", F.lit(0))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_bpe_equals_the_library_and_counts_every_prefix():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    library, encoder, counter = Tokenizer.from_file(path), bpe.Encoder.load(path), bpe.Counter.load(path)
    rng = random.Random(1)
    alphabet = "ab  \n\n\t'sltdvre 19.,!<|endoftext|>éñü　\x1c\x85 the ing"
    for _ in range(400):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) + rng.choice(["", "<|endoftext|>", "<|endoftext|> x"])
        ids = library.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text) == ids and encoder.decode(ids) == library.decode(ids, skip_special_tokens=False)
        counts = [len(library.encode(text[:p], add_special_tokens=False).ids) for p in range(len(text) + 1)]
        prefixes = counter.prefixes(text)
        assert [prefixes.count(p) for p in range(len(text) + 1)] == counts
        assert all(prefixes.fit(b) == max(p for p, c in enumerate(counts) if c <= b) for b in (0, 1, 4, 9))
    long = "a" * 20_000
    assert counter.count(long) == len(library.encode(long, add_special_tokens=False).ids)


@pytest.mark.parametrize("piece", ["a", "é", " ", "\n", "!", "7"])
def test_a_long_piece_is_not_encoded_for_every_prefix(monkeypatch, piece):
    path, encoded, whole = queries.tokenizer_path(), [], bpe.Vocabulary.prefixes
    counter, text = bpe.Counter(path), "x " + piece * 400 + "b " + piece * 400
    expected = max(p for p in range(len(text)) if counter.count(text[:p]) <= 4)
    monkeypatch.setattr(bpe.Vocabulary, "prefixes", lambda self, b: encoded.append(len(b)) or whole(self, b))
    assert bpe.Counter(path).prefixes(text).fit(4) == expected
    assert sum(encoded) < 10 * len(text.encode())


def test_tokenizer_queries(docs, empty, corpus):
    path = queries.tokenizer_path()
    rows = bpe.encode_documents(docs, path).collect()
    assert len(rows) == len(corpus) and all(r.round_trip for r in rows)
    assert bpe.encode_documents(empty, path, keep_ids=False).count() == 0
    counted = {(r.doc_id, r.n_bytes): r for r in bpe.count_tokens(docs, path, limit=50).collect()}
    assert counted[120, 0].n_tokens == 0 and not counted[120, 0].over_limit
    assert all(r.over_limit == (r.n_tokens > 50) for r in counted.values())
    assert bpe.count_tokens(empty, path).count() == 0


def brute_windows(items, width=13):
    out = collections.defaultdict(set)
    for name, text in items:
        words = decontaminate.alnum_words((text or "").encode())
        n = min(width, len(words))
        for k in range(len(words) - n + 1 if n else 0):
            out[tuple(words[k : k + n])].add(name)
    return out


def test_contamination_equals_brute_force(spark, docs, corpus, empty):
    passage = corpus[101][1].split()
    bench = [(1, " ".join(passage[10:40])), (2, "a b c"), (3, None), (4, "..."), (5, corpus[3][1]), (5, corpus[3][1]), (None, corpus[9][1])]
    items = spark.createDataFrame(bench, "item_id long, text string").withColumn("doc_id", F.lit(9))
    windows = brute_windows([("" if i is None else str(i), t) for i, t in bench])
    lengths = {len(w) for w in windows}
    got = decontaminate.contamination(docs, items).collect()
    assert len(got) == len(corpus)
    expected = collections.Counter()
    for doc_id, text, *_ in corpus:
        words = decontaminate.alnum_words((text or "").encode())
        hit, names = set(), set()
        for n in lengths:
            for k in range(len(words) - n + 1):
                if found := windows.get(tuple(words[k : k + n])):
                    hit.update(range(k, k + n))
                    names |= found
        expected[doc_id, len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)] += 1
    assert collections.Counter(tuple(r) for r in got) == expected
    assert any(r.contaminated for r in got)
    bad = {r.doc_id for r in got if r.contaminated}
    assert {r.doc_id for r in decontaminate.drop_contaminated(docs, items).collect()} == {r[0] for r in corpus} - bad
    assert decontaminate.contamination(empty, items).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(docs, items.limit(0)).collect())


def test_contamination_in_blocks(monkeypatch, docs, spark, corpus):
    items = spark.createDataFrame([(k, corpus[k][1]) for k in range(8)], "item_id long, text string")
    whole = sorted(map(tuple, decontaminate.contamination(docs, items).collect()), key=str)
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 50)
    assert sorted(map(tuple, decontaminate.contamination(docs, items).collect()), key=str) == whole


def test_phrase_and_proximity_matches(spark):
    docs = spark.createDataFrame([(1, "x one two three y"), (2, "three z one two"), (3, "one far far far far far two three")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "one two three")], "item_id long, text string")
    index = decontaminate.build_index(docs)
    exact = decontaminate.matches(index, items).collect()
    assert [(r.doc_id, r.begin, r.end, r.kind) for r in exact] == [(1, 1, 4, "phrase")]
    near = {(r.doc_id, r.begin, r.end, r.kind) for r in decontaminate.matches(index, items, slop=1).collect()}
    assert near == {(1, 1, 4, "phrase"), (2, 0, 4, "proximity")}


def brute_jaccard(rows):
    sets = []
    for doc_id, text, *_ in rows:
        words = (text or "").encode().translate(LOWER).split()
        sets.append((doc_id, frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])))
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for k, (doc_id, _) in enumerate(sets):
        least[find(k)] = min(doc_id, least.get(find(k), doc_id))
    return [(doc_id, len(s), least[find(k)]) for k, (doc_id, s) in enumerate(sets)]


@pytest.mark.parametrize("frequent", [64, 3, 1, 0])
def test_jaccard_join_equals_brute_force(monkeypatch, docs, corpus, empty, frequent):
    monkeypatch.setattr(jaccard_join, "frequent_above", lambda n: frequent)  # low limits push tokens into the combined class
    got = sorted(tuple(r) for r in jaccard_join.jaccard_components(docs).collect())
    assert got == sorted(brute_jaccard(corpus))
    assert len({r[2] for r in got}) < len({r[0] for r in got})
    if frequent == 64:
        assert jaccard_join.jaccard_components(empty).count() == 0
        stays = jaccard_join.keep_one_per_component(docs)
        kept = [r.doc_id for r in stays.collect()]
        wordless = {d for d, n, _ in got if n == 0}
        assert sorted(kept) == sorted({c for _, n, c in got if n} | wordless)
        assert stays.columns == docs.columns


def test_combination_prefixes_share_an_entry():
    """For linked sets, with all classes: found once (-1, never shared), rare (0) and frequent ones (1 to 3)."""
    rng = np.random.default_rng(5)
    linked = 0
    for _ in range(600):
        n = int(rng.integers(4, 300))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = a.copy()
        gone = rng.permutation(len(b))[: rng.integers(0, max(1, len(b) // 9))]
        b = np.unique(np.concatenate([np.delete(b, gone), rng.integers(0, 1 << 63, rng.integers(0, max(1, len(b) // 9))).astype(np.uint64)]))
        shared = np.intersect1d(a, b)
        if 100 * len(shared) >= 80 * (len(a) + len(b) - len(shared)):
            linked += 1
            shares = np.sort(rng.random(3))
            place = lambda x: (x % np.uint64(1000)).astype(float) / 1000
            alone = lambda x, s=shared: ~np.isin(x, s) & (x % np.uint64(7) < 5)  # noqa: E731  of the tokens of one set only, some are found once
            rank = lambda x, s=shares: np.where(alone(x), -1, (place(x)[:, None] < s).sum(axis=1)).astype(np.int8)
            assert len(np.intersect1d(jaccard_join.combination_prefix(a, rank(a)), jaccard_join.combination_prefix(b, rank(b))))
    assert linked > 200


def test_forest_of_links_makes_the_same_components():
    rng = np.random.default_rng(6)
    for trial in range(30):
        base = rng.integers(0, 1 << 63, 60).astype(np.uint64)
        sets = [np.unique(np.concatenate([base[rng.random(60) > rng.random() * 0.3], rng.integers(0, 1 << 63, rng.integers(0, 9)).astype(np.uint64)])) for _ in range(rng.integers(2, 70))]
        shared = np.array([[len(np.intersect1d(x, y)) for y in sets] for x in sets])
        assert np.array_equal(jaccard_join.shared_tokens(sets) * (1 - np.eye(len(sets), dtype=int)), shared * (1 - np.eye(len(sets), dtype=int)))
        roots, outside, inside = rng.integers(0, 9, len(sets)), rng.random(len(sets)) < 0.5, bool(trial % 2)

        def components(pairs, roots=roots):
            up = {int(r): int(r) for r in roots}
            find = lambda k: k if up[k] == k else find(up[k])
            for x, y in pairs:
                up[find(int(roots[x]))] = find(int(roots[y]))
            return [min(q for q in up if find(q) == find(int(r))) for r in roots]

        every = [(x, y) for x in range(len(sets)) for y in range(len(sets)) if outside[x] and (not outside[y] or inside) and x != y and 100 * shared[x, y] >= 80 * (len(sets[x]) + len(sets[y]) - shared[x, y])]
        found = jaccard_join.forest_of_links(sets, roots, outside, inside)
        assert set(found) <= set(every) and len(found) < 9 and components(found) == components(every)


def test_blocks_of_a_neighbourhood(monkeypatch, docs, corpus):
    monkeypatch.setattr(jaccard_join, "BLOCK", 512)  # blocks of two members
    monkeypatch.setattr(jaccard_join, "_centre_pairs", lambda apart: apart.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0))
    monkeypatch.setattr(jaccard_join, "_star_pairs", lambda near, f=jaccard_join._star_pairs: f(near).filter("pmod(xxhash64(b), 3) = 0"))
    assert sorted(tuple(r) for r in jaccard_join.jaccard_components(docs).collect()) == sorted(brute_jaccard(corpus))


def test_sets_that_share_an_id_get_another_salt(monkeypatch, docs, corpus):
    real, salts = jaccard_join.document_sets, []

    def clashing(frame, *, salt=0, **names):
        salts.append(salt)
        out = real(frame, salt=salt, **names)
        return out if salt > 1 else out.withColumn("set_id", F.when(F.col("set_id").isNotNull(), F.col("set_id") % 50))

    monkeypatch.setattr(jaccard_join, "document_sets", clashing)
    assert sorted(tuple(r) for r in jaccard_join.jaccard_components(docs).collect()) == sorted(brute_jaccard(corpus))
    assert salts == [0, 1, 2]


@pytest.mark.parametrize("hub_edges", [1 << 20, 1])
def test_components_of_chains_and_hubs(spark, monkeypatch, hub_edges):
    monkeypatch.setattr(components, "HUB_EDGES", hub_edges)
    monkeypatch.setattr(components, "HUBS", 8)
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(200, 200), (None, 5), (31, 30)]
    got = {r.id: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100 + k: 100 for k in range(30)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_suffix(rows):
    places = collections.Counter()
    data = [(r[0], (r[1] or "").encode()) for r in rows]
    for _, b in data:
        places.update(b[k : k + 200] for k in range(len(b) - 199))
    out = []
    for doc_id, b in data:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if places[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((doc_id, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def test_suffix_dedup_equals_brute_force(monkeypatch, docs, corpus, empty):
    expected = brute_suffix(corpus)
    assert sum(r[2] for r in expected) > 0
    for step, hot, part in ((1 << 19, 32, 4 << 20), (257, 32, 4 << 20), (1 << 19, 2, 4 << 20), (1 << 19, 2, 3000)):
        monkeypatch.setattr(suffix_dedup, "STEP", step)  # a small step cuts runs of windows apart
        monkeypatch.setattr(suffix_dedup, "PART", part)  # a small part leaves copies to be found between parts
        monkeypatch.setattr(suffix_dedup, "HOT_RUNS", hot)  # few runs make an anchor hot, so that windows travel alone
        monkeypatch.setattr(suffix_dedup, "HOT_ONE_IN", 1)
        assert sorted(tuple(r) for r in suffix_dedup.removal_digests(docs).collect()) == sorted(r[:5] for r in expected)
    cut = suffix_dedup.remove_repeats(docs)
    assert cut.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in cut.collect()) == sorted((r[0], r[5].decode("utf-8", "ignore")) for r in expected)
    assert suffix_dedup.removal_digests(empty).count() == 0


def test_suffix_sort_orders_by_bytes():
    rng = random.Random(8)
    data = "".join(rng.choice("ab") for _ in range(600)).encode()
    starts = np.array([rng.randrange(0, 560) for _ in range(90)])
    lengths = np.array([rng.randint(1, 40) for _ in starts])
    order = suffix_dedup.SuffixSorter(np.frombuffer(data, np.uint8), starts, lengths, np.zeros(len(starts), np.int64)).sort()
    pieces = [data[s : s + n] for s, n in zip(starts, lengths, strict=True)]
    assert list(order) == sorted(range(len(pieces)), key=lambda k: (pieces[k], k))


def test_quality_rules_equal_brute_force(docs, corpus, empty):
    got = quality_rules.quality_rules(docs).collect()
    assert len(got) == len(corpus)
    texts = {(r[0], r[3]): r[1] or "" for r in corpus}
    for r in got:
        words = texts[r.doc_id, r.host].encode().split()
        windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
        counts = collections.Counter(windows)
        covered = {k + j for k, w in enumerate(windows) if counts[w] > 1 for j in range(8)}
        assert (r.n_words, r.n_repeat_words) == (len(words), len(covered))
        assert r.base_failed == (len(words) < 20 or 100 * len(covered) > 30 * len(words))
        assert r.kept == (not r.base_failed and not r.host_bad)
    kept = collections.Counter(r.doc_id for r in got if r.kept)
    assert collections.Counter(r.doc_id for r in quality_rules.drop_rejected(docs).collect()) == kept
    assert quality_rules.quality_rules(empty).count() == 0


def test_host_rates_are_shrunk(spark):
    rows = [(f"h{h}", h == 0 or k % 10 == 0) for h in range(8) for k in range(200 if h else 3)]
    verdicts = {r.host: r for r in quality_rules.host_verdicts(spark.createDataFrame(rows, "host string, failed boolean")).collect()}
    assert verdicts["h0"].host_rate < 1 and abs(verdicts["h1"].host_rate - 0.1) < 0.05 and not verdicts["h1"].host_bad


def test_chat_round_trip_of_hostile_texts(spark):
    rng = random.Random(4)
    bits = ["<s>", "</s>", "[INST]", " [/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE 61>>", "<</ROLE>>", "\\", "<\\s>", "[\\\\/INST]", "a", " ", "\n", "é", "<", "["]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice([None, "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))])) for c in range(150) for t in range(rng.randint(1, 4))]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"), (None, None, "user", "x"), (None, None, "user", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("_out", F.lit(1)).withColumn("formatted", F.lit(2))
    out = chat.format_conversations(turns).collect()
    assert all(r.round_trip for r in out)
    want = collections.defaultdict(list)
    for c, t, role, text in rows:
        want[c].append((t, role or "", text or ""))
    for r in out:
        assert [(x.role, x.text) for x in r.turns] == [x[1:] for x in sorted(want[r.conv_id], key=lambda x: (x[0] or 0, x[1], x[2]))]
    digest = {r.conv_id: r for r in chat.conversation_digests(chat.format_conversations(turns)).collect()}
    assert digest[-1].loss_chars == len("</s>[INST] ok [/INST]")
    assert chat.format_conversations(turns.limit(0)).count() == 0


def test_quality_scores_on_held_out_rows(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_crf.quality_scores(docs, quality_crf.train(docs, labels)).join(labels, "doc_id").filter("held_out").select("score", "predicted", "quality").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert bad and sum(g > b for g in good for b in bad) / (len(good) * len(bad)) > 0.97
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.93


def test_quality_of_odd_rows(docs, empty, spark, corpus):
    model = quality_crf.train(docs, spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1), (7, 5)], "doc_id long, quality int"))
    rows = quality_crf.quality_scores(docs, model).collect()
    assert len(rows) == len(corpus) and all(0 <= r.score <= 1 for r in rows)
    assert quality_crf.quality_scores(empty, model).count() == 0
    none = quality_crf.train(empty, spark.createDataFrame([], "doc_id long, quality int"))
    assert all(r.score == 0.5 for r in quality_crf.quality_scores(docs, none).collect())


def test_language_on_held_out_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    languages, weights = lang_crf.train(docs)
    rows = lang_crf.identify(docs, languages, weights).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert rows and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.95
    en, fr = (docs.filter(f"lang = '{x}'").first().text.split("\n")[0] for x in ("en", "fr"))
    mixed = spark.createDataFrame([(1, f"{en[:200]} {fr[:60]}")], "doc_id long, text string")
    assert lang_crf.identify(mixed, languages, weights).first().lang_pred == "en"


def test_a_long_line_does_not_use_up_the_words_of_other_languages():
    rng = random.Random(2)
    a, b = (["".join(rng.choice(x) for _ in range(6)) for _ in range(300)] for x in ("abcde", "vwxyz"))
    lines = [(0, a * 300), *((1, b[k : k + 10]) for k in range(0, 300, 10))]
    for own in (lines, [(1 - k, words) for k, words in lines]):  # the long line in either place
        weights = lang_crf.fit(own, 2)
        scores = lang_crf.Emissions(weights["emission"]).of(a[:50] + b[:50])
        first = own[0][0]
        assert (scores[:50].argmax(axis=1) == first).all() and (scores[50:].argmax(axis=1) == 1 - first).all()
    few = lang_crf.fit([(0, a), (1, b)], 2, words_per_language=10)
    assert not np.array_equal(few["emission"], lang_crf.fit([(0, a), (1, b)], 2)["emission"])


def test_language_of_odd_rows(docs, empty, corpus):
    languages, weights = lang_crf.train(docs)
    rows = lang_crf.identify(docs, languages, weights).collect()
    assert languages == ["en"] or languages == ["en", "fr"]
    assert len(rows) == len(corpus) and {r.lang_pred for r in rows if r.doc_id in (120, 121, 122)} == {"und"}
    assert lang_crf.identify(docs, *lang_crf.train(empty)).filter("lang_pred <> 'und'").count() == 0


PAGE = (
    "<!DOCTYPE html><html><head><title>t</title><script>var a='</p>';</script></head><body><nav><ul><li><a href=/a>Home</a></li></ul></nav><!-- x --><div class='ad'>Buy now</div>"
    "<article><h1>A &amp; B</h1><p>First   para\ngraph with some words, and <b>bold</b> ones.<p>Second &lt;one&gt;, unclosed.<br>more<div class=\"share\"><ul><li><a href=#>Share</a></li></ul></div></article>"
    "<div class='comments'><div class='comment'><p>Nice article, thanks a lot.</p></div></div><footer>&copy; me</footer>"
)


def test_main_text_of_pages(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "v", ""), (None, "w", "just text"), (1, "u", PAGE)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    rows = html_extract.main_text(pages, html_extract.trained()).collect()
    want = "A & B\nFirst para graph with some words, and bold ones.\nSecond <one>, unclosed. more"
    assert [r.text for r in rows if r.page_id == 1] == [want, want]
    assert all(r.n_chars == len(r.text) for r in rows) and [r.text for r in rows if r.page_id in (2, 3)] == ["", ""]


def test_decoding_has_no_contradictions_and_is_accurate():
    rng, model, wrong, total = random.Random(77), html_extract.trained(), 0, 0
    for _ in range(60):
        page = html_extract.Page(html_extract.sample_page(rng))
        kept = html_extract.decode(page, model.log_odds(html_extract.features(page)))
        assert all(kept[page.parent[k]] for k in range(1, len(kept)) if kept[k])
        wrong += int((kept != (html_extract._labels(page) > 0))[1:].sum())
        total += len(kept)
    assert wrong / total < 0.02


def test_pipeline_equals_brute_force(spark, docs, corpus, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path())
    bench = [(1, " ".join(corpus[30][1].split()[:30])), (2, " ".join(corpus[60][1].split()[:20])), (3, None)]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    plain.write.parquet(str(tmp_path / "documents.parquet"))

    def failures(text):
        words = (text or "").encode().split()
        windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
        counts = collections.Counter(windows)
        covered = {k + j for k, w in enumerate(windows) if counts[w] > 1 for j in range(8)}
        lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\r\x0b\x0c")]
        base = len(words) < 20 or 100 * len(covered) > 30 * len(words)
        symbols = sum((text or "").count(c) for c in "#*$%&|<>")
        return base, base or 100 * symbols > 50 * len(words) or 100 * (len(lines) - len(set(lines))) > 50 * len(lines)

    by_host = collections.defaultdict(list)
    for r in corpus:
        by_host[r[3]].append(failures(r[1])[1])
    rates = [sum(v) / len(v) for v in by_host.values()]
    mean = sum(rates) / len(rates)
    var = sum((x - mean) ** 2 for x in rates) / len(rates)
    weight = mean * (1 - mean) / var - 1 if 0 < var < mean * (1 - mean) else 10
    good = {h for h, v in by_host.items() if (sum(v) + mean * weight) / (len(v) + weight) <= 0.5}
    rows = [r for r in corpus if not failures(r[1])[0] and r[3] in good]
    least, seen = {d: c for d, n, c in brute_jaccard(rows)}, set()
    rows = [r for r in rows if least[r[0]] == r[0] and not (r[0] in seen or seen.add(r[0]))]
    cut = [(r[0], x[5].decode("utf-8", "ignore"), *r[2:]) for r, x in zip(rows, brute_suffix(rows), strict=True)]
    windows = brute_windows([(str(i), t) for i, t in bench])

    def contaminated(text):
        words = decontaminate.alnum_words(text.encode())
        hit = {k + j for n in {len(w) for w in windows} for k in range(len(words) - n + 1) if tuple(words[k : k + n]) in windows for j in range(n)}
        return bool(hit) and 20 * len(hit) >= len(words)

    clean = [r for r in cut if not contaminated(r[1])]
    assert len(corpus) > len(rows) > len(clean) > 0 and any(a[1] != b[1] for a, b in zip(rows, cut, strict=True))
    ids = {r[0]: library.encode(r[1], add_special_tokens=False).ids for r in clean}
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == ids
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain = spark.createDataFrame(stage(spark, plain, str(tmp_path)).collect(), plain.schema)
        assert plain.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert sorted(tuple(r) for r in plain.collect()) == sorted(clean)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, plain.limit(0), str(tmp_path)).count() == 0


def test_clashing_columns(spark, corpus):
    names = ["_pw_key", "_pw_text", "_pw_doc", "_pw_bodies", "_PW_A", "set_id", "_first", "doc_a", "body", "place", "kept", "host", "_key", "_id"]
    rows = spark.createDataFrame(corpus[55:80] + corpus[120:], DOCS).select("*", *(F.lit(k).alias(n) for k, n in enumerate(names)))
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string").withColumn("_pw_key", F.lit(0))
    for stage in (quality_rules.drop_rejected, jaccard_join.keep_one_per_component, suffix_dedup.remove_repeats, lambda d: decontaminate.drop_contaminated(d, items)):
        out = stage(rows)
        assert out.columns == rows.columns and all(tuple(r)[-len(names) :] == tuple(range(len(names))) for r in out.collect())


def test_row_keys_tell_nulls_apart(spark):
    rows = spark.createDataFrame([("x", None), (None, "x"), ("x", ""), ("", "x"), ("x", "x"), ("x", "x")], "a string, b string")
    keyed, key = common.with_key(rows, "a", "b")
    assert key == "_pw_key" and keyed.select(key).distinct().count() == 5 and common.with_key(keyed, "a")[1] == "__pw_key"


def test_slices_and_bitmaps(spark):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(["x" * (900 if k == 7 else 10) for k in range(40)])], ["k", "t"])
    parts = list(common.sliced(iter([batch, batch.slice(0, 0)]), 200))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch])) and max(p.num_rows for p in parts) < 20 < sum(p.num_rows for p in parts)
    values = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 500)
    frame = spark.createDataFrame([(int(v),) for v in values], "v long").repartition(5)
    for rows in (frame, spark.createDataFrame([(values[:200].tobytes(),), (values[200:].tobytes(),), (None,)], "v binary")):
        bitmap = common.merged_bitmap(rows, 1 << 20)
        assert common.in_bitmap(values, bitmap).all() and np.unpackbits(bitmap).sum() <= 500


def test_the_shared_folder_is_never_a_machine_of_a_cluster():
    class Fake:
        def __init__(self, master, where):
            self.sparkContext, self.conf, self.where = type("Context", (), {"master": master})(), self, where

        def get(self, name, default):
            return self.where or default

        def set(self, name, value):
            self.where = value

    assert common.shared_dir(Fake("spark://host:7077", "hdfs:///x/")) == "hdfs:///x"
    assert common.shared_dir(Fake("local[4]", None)).startswith("file:")
    for master in ("spark://host:7077", "local-cluster[3,2,1000]", "yarn"):
        with pytest.raises(RuntimeError):
            common.shared_dir(Fake(master, None))


def test_polynomial_hashes_of_structured_strings():
    bits = np.array([bin(k).count("1") & 1 for k in range(4096)], np.uint8)
    for seed in range(4):
        for n in (256, 1024, 4096):
            h = common.PolyHash(np.r_[bits[:n], 1 - bits[:n], bits[:n]], seed)
            assert h.span(0, n) != h.span(n, n) and h.span(0, n) == h.span(2 * n, n)


def test_marginals_equal_enumeration():
    import itertools

    rng = np.random.default_rng(2)
    lengths, labels = [4, 1, 3], 3
    emission, transition = rng.normal(size=(8, labels)), rng.normal(size=(labels, labels))
    got, pairs, partition = Chains(lengths).marginals(emission, transition, pairs=True)
    want, expected, logs, at = np.zeros((8, labels)), np.zeros((labels, labels)), 0.0, 0
    for n in lengths:
        paths = list(itertools.product(range(labels), repeat=n))
        weight = np.exp([sum(emission[at + k, y] for k, y in enumerate(p)) + sum(transition[a, b] for a, b in itertools.pairwise(p)) for p in paths])
        logs += np.log(weight.sum())
        for p, w in zip(paths, weight / weight.sum(), strict=True):
            for k, y in enumerate(p):
                want[at + k, y] += w
            for a, b in itertools.pairwise(p):
                expected[a, b] += w
        at += n
    assert np.allclose(got, want) and np.allclose(pairs, expected) and np.isclose(partition, logs)


def test_decoding_is_the_best_of_all_subsets():
    import itertools

    rng = random.Random(5)
    for _ in range(40):
        page = html_extract.Page("".join(rng.choice(["<div>", "<p>", "</div>", "<ul>", "</ul>"]) for _ in range(9)))
        n = len(page.tag)
        odds = np.array([rng.uniform(-1, 1) for _ in range(n)])
        best = max(sum(odds[k] for k in kept) for size in range(n) for some in itertools.combinations(range(1, n), size) for kept in [(0, *some)] if all(page.parent[k] in kept for k in some))
        assert np.isclose(odds[html_extract.decode(page, odds)].sum(), best)


def test_boosted_trees():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0) != (x[:, 1] > 0.3)).astype(float)
    model = boosting.BoostedTrees().fit(x[:1500], y[:1500])
    odds = model.log_odds(x[1500:])
    assert ((odds > 0) == y[1500:]).mean() > 0.95
    binned = [[int(np.searchsorted(e, v, "right")) for e, v in zip(model.edges, row, strict=True)] for row in x[1500:1510]]
    for row, told in zip(binned, odds, strict=False):
        total = model.base
        for feature, split, leaf in zip(model.feature, model.split, model.leaf, strict=True):
            node = 0
            for _ in range(model.depth):
                node = 2 * node + 1 + (row[feature[node]] > split[node])
            total += leaf[node - (2**model.depth - 1)]
        assert np.isclose(total, told)


@pytest.mark.parametrize("text", ["qwertyuiopasdfghjklzxcvbnm" * 7700, "天地玄黄宇宙洪荒日月盈昃" * 5000, "a" * 200_000, "\n" * 50_000 + "x", "é " * 40_000])
def test_counts_of_very_long_pieces(text):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    library, counter = Tokenizer.from_file(path), bpe.Counter(path)
    size = lambda p: len(library.encode(text[:p], add_special_tokens=False).ids)
    prefixes = counter.prefixes(text)
    assert prefixes.total == size(len(text))
    rng = random.Random(6)
    for p in [0, 1, 5, *(rng.randrange(2000) for _ in range(12)), len(text) - 1]:
        assert prefixes.count(p) == size(p)
    fit = prefixes.fit(1024)
    assert size(fit) <= 1024 and all(size(fit + k) > 1024 for k in (1, 2, 3))


def test_letters_and_marks():
    assert lang_crf.line_words("½ ² ⅷ 12 _\n") == [] and lang_crf.line_words("हिन्दी भाषा x2") == [["हिन्दी", "भाषा", "x"]]


LAYOUTS = {
    "blog": (
        "<html><body><header class='masthead'><h1>My site</h1><p>All about things</p></header><nav><ul><li><a href=/>Home</a></li><li><a href=/b>About</a></li></ul></nav>"
        "<main><div class='post'><h1>How the bridge was built</h1><p>In the spring of that year, the builders came to the river, and they stayed until the winter.</p>"
        "<p>The old road, which had been closed for long, was opened again; people walked over it on <a href=x>market days</a>, talking loudly.</p><blockquote><p>Nobody believed it could stand, he said.</p></blockquote></div></main>"
        "<aside class='sidebar'><h3>Related</h3><ul><li><a href=1>Ten best bridges</a></li><li><a href=2>Road works</a></li></ul></aside>"
        "<section class='comments'><h2>Comments</h2><div class='comment'><p>Great text, thank you so much for it.</p></div><div class='comment'><p>I was there myself in those days, it was cold.</p></div></section>"
        "<footer>&copy; 2020 My site, all rights reserved</footer></body></html>",
        "How the bridge was built\nIn the spring of that year, the builders came to the river, and they stayed until the winter.\nThe old road, which had been closed for long, was opened again; people walked over it on market days, talking loudly.\nNobody believed it could stand, he said.",
    ),
    "divs": (
        "<body><div id=cookie-notice class='notice'><p>We use cookies to make the site better.</p></div><div class='menu'><ul><li><a href=a>Start</a></li><li><a href=b>News</a></li></ul></div>"
        "<div id='content'><h2>A day in the hills</h2><p>We left early, before the sun was up, and took the path along the stream.</p><div class='ad'>Buy boots now, half price</div><p>At noon the fog came in, so we turned back, slowly and carefully.</p></div>"
        "<div class='sidebar widget'><h3>Popular</h3><p>What others read, today and every day, on these pages.</p></div><div class='footer'><p>&copy; Hill club</p></div></body>",
        "A day in the hills\nWe left early, before the sun was up, and took the path along the stream.\nAt noon the fog came in, so we turned back, slowly and carefully.",
    ),
    "formula": (
        "<body><nav><a href=/>Home</a> <a href=/c>Contents</a></nav><article><h1>Lines</h1><p>Let <math><mi>x</mi></math> be a point on the line, and <object>the figure</object> show it, as it was drawn by hand.</p><xmp><b>a &amp; b</b></xmp>"
        "<p>Then, by the rule above, every other point is found in the same way, step by step.</p></article><form class='search'><input name=q><button>Find</button></form></body>",
        "Lines\nLet x be a point on the line, and the figure show it, as it was drawn by hand.\n<b>a &amp; b</b>\nThen, by the rule above, every other point is found in the same way, step by step.",
    ),
}


@pytest.mark.parametrize("name", sorted(LAYOUTS))
def test_layouts_written_by_hand(name):
    source, want = LAYOUTS[name]
    assert html_extract.extract([source], html_extract.trained()) == [want]


@pytest.mark.parametrize("source", ["<div>" * 40_000, "<a x='b " * 40_000, "<b " * 40_000, "</x" * 40_000, "<select>" * 20_000, "<a x='b \" > " * 20_000, "<b>" * 40_000 + "<li>" * 20_000, "<b>" * 30_000 + "</i>" * 30_000, "<!" * 40_000, "<p><i>" * 20_000])
def test_hostile_pages_take_linear_time(source):
    import time

    began = time.process_time()
    html_extract.Page(source)
    assert time.process_time() - began < 4


def test_benchmark_blocks_leave_nothing_behind(monkeypatch, spark, docs):
    made, gone = [], []
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 3)
    monkeypatch.setattr(decontaminate, "stash", lambda df, name: made.append(common.stash(df, name)) or made[-1])
    monkeypatch.setattr(decontaminate, "unstash", lambda *frames: gone.extend(frames) or common.unstash(*frames))
    items = spark.createDataFrame([(k, f"word{k} a b") for k in range(4)], "item_id long, text string")
    assert decontaminate.contamination(docs, items).count() == docs.count()
    assert len(made) == 4 and all(any(m is g for g in gone) for m in made[:-1])
