"""Each operator against brute force on small inputs: NULLs, empty and long texts, ties,
repeated rows, empty tables, clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pa = pytest.importorskip("pyarrow")

VOCABULARY = ["the", "of", "and", "river", "stone", "lamp", "green", "walks", "over", "under", "cold", "north", "paper", "seven", "oak"]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) + str(r.randint(0, 40)) for _ in range(n))


ODD = [(1, None), (2, ""), (3, "  \n "), (4, "one"), (5, "one"), (5, "two words"), (None, "no id here"), (None, "no id here"), (6, "é" * 30)]


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


# 1 and 7


def stats_by_force(text):
    tokens = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = collections.defaultdict(list)
    for k in range(len(tokens) - 7):
        windows[tuple(tokens[k : k + 8])].append(k)
    covered = {i for places in windows.values() if len(places) > 1 for k in places for i in range(k, k + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(tokens), sum(map(len, tokens)), sum(map((text or "").count, "#*$%&|<>")), len(lines) - len(set(lines)), len(covered)


def test_text_stats(documents):
    from concordat.llm.textstats import text_stats

    loop = "a b c d e f g h i " * 3
    texts = [t for _, t in ODD] + [loop, "x " * 20000, loop + "\n\n" + loop + "\n" + loop, "é ü\x0bß # $$ |\x1c<", prose(1, 300)]
    rows = text_stats(documents(list(enumerate(texts)))).collect()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == stats_by_force(texts[r.doc_id])


def labelled_documents(documents, n=400):
    rows, marks = [], []
    for i in range(n):
        bad = i % 4 == 0
        text = prose(i, 40)
        rows.append((i, re.sub(r"(\w+)", r"\1%%", text) if bad else text))
        marks.append((i, 0 if bad else 1))
    return documents(rows), marks, rows


def test_quality_rules_find_the_marked_texts(documents, labels):
    from concordat.llm.quality_rules import quality_rules

    docs, marks, _ = labelled_documents(documents)
    judged = quality_rules(docs.unionByName(documents(ODD)), labels([*marks, (0, None), (None, 0)], "quality")).collect()
    truth = dict(marks)
    assert len(judged) == 400 + len(ODD)
    # Ids below 7 are used by the odd rows too.
    assert all(r.kept == (truth[r.doc_id] == 1) for r in judged if r.doc_id is not None and r.doc_id > 6)
    assert all(r.base_failed and not r.kept for r in judged if r.n_words < 20)


def test_quality_rules_without_labels_or_documents(documents, labels):
    from concordat.llm.quality_rules import quality_rules

    none = labels([], "quality")
    assert [r.kept for r in quality_rules(documents([(1, prose(1, 30))]), none).collect()] == [True]
    assert quality_rules(documents([]), none).count() == 0


def test_pairwise_ranking(documents, labels):
    from concordat.llm.ranking import held_out, quality_scores

    docs, marks, _ = labelled_documents(documents)
    rows = quality_scores(docs.unionByName(documents(ODD)), labels([*marks, (3, None)], "quality"), ~held_out()).collect()
    truth = dict(marks)
    known = [r for r in rows if r.doc_id is not None and r.doc_id > 6]
    assert len(rows) == 400 + len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.predicted == truth[r.doc_id] for r in known]) > 0.97
    assert [r.score for r in quality_scores(documents([(1, "a")]), labels([(1, 1)], "quality")).collect()] == [1.0]
    assert quality_scores(documents([]), labels([], "quality")).count() == 0


def test_ranking_learns_from_every_labelled_row(spark):
    from concordat.llm import ranking
    from concordat.llm.textstats import COUNTS

    n = 21_000
    odd = {"n_words": F.pmod(F.xxhash64("doc_id"), F.lit(900)) + F.col("doc_id") % 7, "n_lines": F.pmod(F.hash("doc_id"), F.lit(9)) + 1}
    stats = spark.range(n).withColumnRenamed("id", "doc_id")
    stats = stats.select("doc_id", *(odd.get(c, F.pmod(F.hash("doc_id", F.lit(c)), F.lit(50))).cast("long").alias(c) for c in COUNTS))
    y = F.when((F.col("n_words") + F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(300)) > 1000), 1).otherwise(0)
    marks = stats.select("doc_id", y.alias("quality"))
    model = ranking.learn_ranking(stats, marks, "doc_id", "quality")
    rows = stats.select("doc_id", model.score(ranking.features()).alias("s")).join(marks, "doc_id").collect()
    scores, bad = np.sort([r.s for r in rows]), sum(r.quality == 0 for r in rows)
    assert 0 < n - bad < bad
    assert np.isclose(model.threshold, (scores[bad - 1] + scores[bad]) / 2, rtol=1e-12)
    given = stats.join(marks, "doc_id").select("doc_id", F.col("quality").alias("y"), F.array("n_words").alias("x"))
    blocks = ranking.pair_blocks(given, n - bad, bad).collect()
    assert {x[0] for b in blocks for x in b.x} == {r.n_words for r in stats.select("n_words").collect()}
    assert sum(v == 0 for b in blocks for v in b.y) == bad and all(0 in b.y and 1 in b.y for b in blocks)


def test_ranking_sums_are_those_of_all_pairs(spark):
    from concordat.llm import ranking

    rng = np.random.default_rng(5)
    x, y, w = rng.normal(size=(60, 3)), rng.integers(0, 2, 60), rng.normal(size=3)
    given = spark.createDataFrame([(i, int(k), v.tolist()) for i, (k, v) in enumerate(zip(y, x))], "doc_id long, y int, x array<double>")
    gradient, hessian = ranking.newton_sums(ranking.pair_blocks(given, int(y.sum()), int((1 - y).sum())), w, np.ones(3))
    d = np.array([a - b for a in x[y == 1] for b in x[y == 0]])
    p = 1 / (1 + np.exp(d @ w))
    assert np.allclose(gradient, d.T @ p / len(d)) and np.allclose(hessian, (d * (p * (1 - p))[:, None]).T @ d / len(d))


# 2


def test_unigram_scores_and_exact_likelihoods(documents):
    from concordat.llm import hmm

    texts = [(i, prose(i, 5 + i)) for i in range(60)] + ODD + [(99, prose(99, 3000))]
    rows = hmm.language_model_scores(documents(texts), ~hmm.held_out()).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = collections.Counter(w for i, t in texts if not held(i) for w in [*words(t), b""])
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        (str(i), len(words(t)) + 1, sum(w in counts for w in [*words(t), b""]), sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in [*words(t), b""]))
        for i, t in texts
    )
    got = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.base_score) for r in rows)
    assert [g[:3] for g in got] == [w[:3] for w in want] and {r.train_tokens for r in rows} == {n}
    assert np.allclose([g[3] for g in got], [w[3] for w in want])
    assert all(r.score < 0 for r in rows)


def test_forward_agrees_with_all_paths():
    from concordat.llm import hmm

    rng = np.random.default_rng(1)
    k, c = hmm.STATES, 6
    model = hmm.Tables(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(c), k).T)
    long = rng.integers(0, c, 3 * hmm.STRETCH + 7)
    for text in (long[:1], long[:2], long):
        p, total = model.first * model.emits[text[0]], 0.0
        for x in text[1:]:
            p = p @ model.moves * model.emits[x]
            total, p = total + np.log10(p.sum()), p / p.sum()
        want = total + np.log10((p if len(text) > 1 else p).sum())
        assert np.isclose(hmm.log10_likelihoods([text], model)[0], want)
    together = hmm.log10_likelihoods([long[:1], long, long[:5]], model)
    assert np.allclose(together, [hmm.log10_likelihoods([t], model)[0] for t in (long[:1], long, long[:5])])


def test_training_raises_the_likelihood():
    from concordat.llm import hmm

    rng = np.random.default_rng(2)
    sample = [np.concatenate([rng.integers(0, 3, 40), rng.integers(3, 6, 40)]) for _ in range(30)]
    shares = np.full(6, 1 / 6)
    model = hmm.start_tables([], shares)
    before = sum(hmm.log10_likelihoods(sample, model))
    for _ in range(5):
        model = hmm.from_counts(hmm.expected_counts(*hmm.cut(sample), model), shares)
        after = sum(hmm.log10_likelihoods(sample, model))
        assert after > before - 0.5
    assert after > before + 1


def test_training_counts_every_token_and_move(spark, monkeypatch):
    from concordat.llm import hmm

    rng = np.random.default_rng(6)
    texts = [rng.integers(0, 6, n) for n in (1, 2, hmm.SEQUENCE, hmm.SEQUENCE + 1, 3 * hmm.SEQUENCE + 5)]
    shares = np.full(6, 1 / 6)
    counts = hmm.expected_counts(*hmm.cut(texts), hmm.start_tables([], shares))
    k, tokens = hmm.STATES, sum(map(len, texts))
    emits = counts[k + k * k :].reshape(-1, k)
    assert np.isclose(counts[:k].sum(), len(texts)) and np.isclose(counts[k : k + k * k].sum(), tokens - len(texts))
    assert np.allclose(emits.sum(1), np.bincount(np.concatenate(texts), minlength=6))
    # Without a pass over all rows nothing has been learned from some of them.
    rows = spark.createDataFrame([(i, True, t.astype("<u2").tobytes()) for i, t in enumerate(texts)], "row long, training boolean, classes binary")
    monkeypatch.setattr(hmm, "ITERATIONS", 0)
    assert np.array_equal(hmm.train(rows, shares).flat(), hmm.start_tables([], shares).flat())


def test_language_model_on_nothing(documents):
    from concordat.llm import hmm

    assert hmm.language_model_scores(documents([]), ~hmm.held_out()).count() == 0


# 3


def test_lcs():
    from concordat.llm import decontaminate as d

    r = random.Random(3)
    for _ in range(200):
        a, b = ([r.choice([b"a", b"b", b"c"]) for _ in range(r.randint(1, 9))] for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        assert d.lcs(d._masks(a), len(a), b) == table[-1, -1]


def test_leaks_against_all_windows(spark, documents):
    from concordat.llm import decontaminate as d

    items = [(i, prose(1000 + i, 20 + i % 25) + ". " + prose(2000 + i, 4)) for i in range(40)]
    rows, planted = list(ODD), set()
    for i in range(120):
        text = prose(i, 150)
        if i % 3 == 0:
            item = items[i % 40]
            own = item[1].split()
            if i % 2:
                own = [w if k % 9 else "changed" for k, w in enumerate(own)]
            text = text + " " + " ".join(own).upper() + " " + prose(5000 + i, 60)
            planted.add((100 + i, item[0]))
        rows.append((100 + i, text))
    benchmark = spark.createDataFrame([*items, (90, None), (91, ""), (92, "  ")], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in d.leaks(documents(rows), benchmark).collect()}
    force = set()
    asked = [d.as_item(*x) for x in items]
    for doc_id, text in rows:
        own = d.words_of(text or "")
        for item in asked:
            width = len(item.words) + 8
            if any(d.check(own[at : at + width], item)[2] for at in range(0, max(1, len(own) - width + 1))):
                force.add((doc_id, item.item_id))
    assert planted <= force
    assert len(found & force) >= 0.9 * len(force) and planted <= found
    assert all(doc_id in {i for i, _ in planted} for doc_id, _ in found)
    kept = d.without_leaks(documents(rows), benchmark)
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - {i for i, _ in planted}
    assert d.leaks(documents([]), benchmark).count() == 0
    assert d.leaks(documents(rows), benchmark.filter("item_id > 80")).count() == 0


def test_leaks_whose_words_are_the_common_ones(spark, documents):
    from concordat.llm import decontaminate as d

    # 0.6 of each item are words of every document, so what is kept of it says little of it by cosine.
    common = [f"c{k}" for k in range(24)]
    r = random.Random(8)
    items = [(i, " ".join([*r.sample(common, 16), *(f"i{i}w{k}" for k in range(12))]) + ". " + " ".join(r.sample(common, 4))) for i in range(30)]
    rows = []
    for i in range(60):
        item = [w for w in items[i % 30][1].split() if w[0] == "c"] if i < 30 else []
        assert not item or d.check(d.words_of(" ".join(item)), d.as_item(*items[i]))[2]
        rows.append((i, " ".join([*item, prose(i, 200), " ".join(sorted(common))])))
    found = {(r.doc_id, r.item_id) for r in d.leaks(documents(rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {(i, i) for i in range(30)} <= found


def test_no_leak_is_lost_among_many_items(spark, documents):
    from concordat.llm import decontaminate as d

    # No two items share a word, and other items' words stand around each planted one.
    own = [[f"i{i}w{k}" for k in range(16 + i % 30)] for i in range(400)]
    items = [(i, " ".join(w) + f". so i{i}x i{i}y") for i, w in enumerate(own)]
    r, rows = random.Random(5), []
    for i in range(80):
        item = items[5 * i][1].split()
        if i % 2:
            item[: int(0.4 * len(item)) - 1] = ["changed"] * (int(0.4 * len(item)) - 1)
        assert d.check(d.words_of(" ".join(item)), d.as_item(*items[5 * i]))[2]
        around = [[r.choice(r.choice(own)) for _ in range(r.randint(40, 90))] for _ in range(2)]
        rows.append((i, " ".join([*around[0], *item, *around[1]])))
    found = {(r.doc_id, r.item_id) for r in d.leaks(documents(rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found == {(i, 5 * i) for i in range(80)}


def test_items_at_the_start_of_documents(spark, documents):
    from concordat.llm import decontaminate as d

    # Without their answers, the items need all their other words, wherever a batch has the documents.
    items = [(i, prose(100 + i, n) + ". " + prose(200 + i, 4)) for i, n in enumerate((45, 70, 109))]
    rows = []
    for i in range(60):
        item = items[i % 3][1].split()
        lost = int(0.18 * len(item))
        item[-lost:] = ["changed"] * lost
        assert d.check(d.words_of(" ".join(item)), d.as_item(*items[i % 3]))[2]
        rows.append((i, " ".join(item) + " " + prose(300 + i, 8 * (i % 7))))
    docs = documents(rows).coalesce(1)
    found = {(r.doc_id, r.item_id) for r in d.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found == {(i, i % 3) for i in range(60)}


# 4 and 8

STRANGE = ["Hello Wörld İΣΑΣ<|endoftext|>  it's 123", "a\x1cb \x1f c\x85d '''s", "日本語 😀 ½Ⅷ", "x" * 3000, "tab\tnew\n\nline ", " lead", "I'LL we've", "<|startoftext|>"]


def tokenizer(name):
    public = pytest.importorskip("public_tokenizers")
    library = pytest.importorskip("tokenizers")
    return public.path(name), library.Tokenizer.from_file(public.path(name))


def test_token_files_round_trip(documents):
    from concordat.llm.tokenfiles import token_files

    path, library = tokenizer("byte_bpe_50k.json")
    rows = [(i, t) for i, t in ODD if i not in (None, 5)] + [(10 + i, t) for i, t in enumerate(STRANGE)] + [(50, prose(1, 9000))]
    start = 0
    want = []
    for i, text in sorted(rows, key=lambda r: r[0]):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = token_files(documents(rows[::-1]), path).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want
    assert token_files(documents([]), path).count() == 0
    repeated = token_files(documents([(1, "a"), (1, "b"), (None, "c")]), path).collect()
    assert sorted(r.start for r in repeated) == [0, 2, 4] and [r.doc_id for r in repeated if r.start == 0] == [None]


def test_packing_every_width_with_escapes():
    from concordat.llm.tokenfiles import BLOCK, pack, read_block, unpack

    rng = np.random.default_rng(0)
    for n in (0, 1, 59, 60, 61, 120, 121, BLOCK, BLOCK + 1, 3 * BLOCK + 5):
        for bits in (0, 1, 5, 16, 33, 60, 61, 64):
            values = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            values = values >> np.uint64(64 - bits) if bits else np.zeros(n, np.uint64)
            packed, blocks = pack(values)
            assert (unpack(packed, n) == values).all()
            for b in range(len(blocks)):
                assert (read_block(packed, blocks, b, n) == values[b * BLOCK : (b + 1) * BLOCK]).all()


def test_bpe_equals_the_library(documents):
    from concordat.llm.bpe import encode_decode

    path, library = tokenizer("word_bpe_49k.json")
    rows = ODD + [(10 + i, t) for i, t in enumerate(STRANGE)] + [(50, prose(1, 3000))]
    got = encode_decode(documents(rows), path).collect()
    assert len(got) == len(rows)
    for r, (i, text) in zip(got, rows):
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        raw = np.array(ids, "<u4").tobytes()
        assert (r.doc_id, r.n_tokens, r.ids_sha256, r.decoded) == (i, len(ids), hashlib.sha256(raw).hexdigest(), decoded)
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert encode_decode(documents([]), path).count() == 0


# 5


def test_nearest_examples_are_exact():
    from concordat.llm.toxicity import NEIGHBOURS, Index

    rng = np.random.default_rng(4)
    terms = {f"t{i}".encode(): i for i in range(60)}
    index = Index(terms, rng.uniform(1, 3, 60), 0.1, rng.integers(0, 2, 500).astype(float), np.arange(500))
    text = lambda: " ".join(f"t{int(i)}" for i in rng.zipf(1.4, rng.integers(1, 12)) if i < 60) or "t1"
    vectors = [index.vector(text()) for _ in range(500)]
    vectors = [v if len(v[0]) else index.vector("t1") for v in vectors]
    index.build(vectors)
    dense = np.zeros((500, 60), np.float32)
    for i, (p, w) in enumerate(vectors):
        dense[i, p] = w
    for _ in range(100):
        p, w = index.vector(text())
        query = np.zeros(60, np.float32)
        query[p] = w
        cosines = dense @ query
        order = [i for i in np.lexsort((np.arange(500), -np.round(cosines, 5))) if cosines[i] > 0][:NEIGHBOURS]
        found, _ = index.nearest(p, w)
        assert np.allclose(cosines[found], cosines[order], atol=1e-4)
    assert index.score("")[0] == pytest.approx(0.1) and not len(index.score("nothing known")[1])


def test_toxicity(documents, labels):
    from concordat.llm.toxicity import held_out, toxicity_scores

    rows, marks = [], []
    for i in range(400):
        bad = i % 5 == 0
        rows.append((i, prose(i, 40) + (" you Rotten, fiend!!" if bad else "")))
        marks.append((i, int(bad)))
    scored = toxicity_scores(documents(rows + ODD), labels([*marks, (8, None)], "toxic"), ~held_out()).collect()
    truth = dict(marks)
    assert len(scored) == 400 + len(ODD) and all(0 <= r.score <= 1 for r in scored)
    assert all(r.predicted == truth[r.doc_id] for r in scored if r.doc_id is not None and r.doc_id > 6)
    assert all(r.predicted == 0 for r in scored if r.doc_id is None)
    assert [r.score for r in toxicity_scores(documents([(1, "x")]), labels([], "toxic")).collect()] == [0.0]
    assert toxicity_scores(documents([]), labels(marks, "toxic")).count() == 0


# 6


def removal_by_force(texts, span):
    data = [(t or "").encode() for t in texts]
    counts = collections.Counter(d[i : i + span] for d in data for i in range(len(d) - span + 1))
    out = []
    for d in data:
        covered = np.zeros(len(d), bool)
        for i in range(len(d) - span + 1):
            if counts[d[i : i + span]] > 1:
                covered[i : i + span] = True
        left = bytes(b for b, c in zip(d, covered) if not c)
        spans = int((np.diff(np.append(0, covered.astype(int))) == 1).sum())
        out.append((len(d), int(covered.sum()), spans, hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [1, 256])
def test_removed_bytes(documents, monkeypatch, hot):
    from concordat.llm import dedup

    monkeypatch.setattr(dedup, "HOT_EXTENTS", hot)
    shared, edge = prose(7, 90), prose(8, 60)[:399]
    texts = [None, "", "short", prose(1, 200), prose(1, 200), shared + prose(2, 90), prose(3, 50) + shared + "é", "ab" * 700]
    texts += [prose(4, 30) + edge + prose(5, 30), prose(6, 30) + edge + prose(9, 30), shared[:450] + "x" + shared[300:], prose(10, 99), prose(11, 99) + prose(11, 99)]
    rows = [(i if i != 3 else None, t) for i, t in enumerate(texts)]
    rows[12] = (11, texts[12])
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in dedup.removed_bytes(documents(rows)).collect())
    assert got == sorted(removal_by_force(texts, dedup.SPAN))
    left = dedup.with_repeats_removed(documents(rows))
    assert left.columns == documents(rows).columns and left.count() == len(rows)
    assert dedup.removed_bytes(documents([])).count() == 0


def test_suffix_order_on_small_alphabets(monkeypatch):
    from concordat.llm import suffixes

    rng = np.random.default_rng(6)
    for _ in range(150):
        k, span = int(rng.integers(1, 5)), int(rng.integers(2, 8))
        monkeypatch.setattr(suffixes, "MEMORY_ENTRIES", int(rng.choice([5, 10**6])))
        monkeypatch.setattr(suffixes, "ALPHABET", int(rng.choice([50, 4096])) if k > 2 else 4096)
        pieces = [bytes(rng.integers(97, 97 + k, int(rng.integers(1, 30))).astype(np.uint8)) for _ in range(int(rng.integers(1, 6)))]
        counts = collections.Counter(p[i : i + span] for p in pieces for i in range(len(p) - span + 1))
        want = [i + span <= len(p) and counts[p[i : i + span]] > 1 for p in pieces for i in range(len(p))]
        assert suffixes.repeated_starts(pieces, span).tolist() == want


# 9


def test_warc(spark):
    from concordat.llm import warc

    same, other = "<p>" + "x" * 1200, "<p>\r\n\r\nWARC/1.1\r\n\r\n" + "y" * 1000
    rows = [(1, "http://b.example/x", same), (2, "http://a.example/x?q#f", same), (3, "http://a.example/x", "small"), (4, "http://a.example/x", "small"), (5, None, None)]
    rows += [(6, "http://a.example/y", other), (7, "http://A.example/y z\r\n", other), (8, "http://a.example/y", other), (8, "http://a.example/y", other), (None, "u", same)]
    pages = spark.createDataFrame([(*r, "w", 3) for r in rows], "page_id long, url string, html string, record string, digest int")
    got = warc.capture_history(pages).collect()
    largest = {same: 2, other: 8}
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        revisit = html in largest and i != largest[html]
        want.append((str(i), len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", largest[html] if revisit else None))
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == sorted(want)
    ordered = sorted(got, key=lambda r: (r.range_no, r.position))
    keys = [((r.url_key is not None, r.url_key or ""), r.captured_at) for r in ordered]
    assert keys == sorted(keys)
    assert warc.capture_history(pages.filter("page_id > 99")).count() == 0


def test_loser_tree():
    from concordat.llm.warc import LoserTree

    r = random.Random(9)
    for k in range(9):
        runs = [sorted((r.randint(0, 9), i) for _ in range(r.randint(0, 6))) for i in range(k)]
        merged = list(LoserTree([iter([(x[0], x) for x in run]) for run in runs]))
        assert [m[1] for m in merged] == sorted(x for run in runs for x in run)


# 10


def classes_by_force(rows):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    n = len(rows)
    near = [[bool(a) and a is not b and 5 * len(a & b) >= 4 * len(a | b) for b in sets] for a in sets]
    group = list(range(n))
    for _ in range(n):
        group = [min([group[i], *(group[j] for j in range(n) if near[i][j])]) for i in range(n)]
    ids = [min((rows[j][0] for j in range(n) if group[j] == group[i] and rows[j][0] is not None), default=None) for i in range(n)]
    return [(str(rows[i][0]), str(ids[i]), sum(near[i])) for i in range(n)]


@pytest.mark.parametrize("parts", [3, 512])
def test_near_duplicates(documents, monkeypatch, parts):
    from concordat.llm import jaccard

    monkeypatch.setattr(jaccard, "PART_NODES", parts)
    monkeypatch.setattr(jaccard, "KEY_ROWS", 2 * parts)
    rows = [(20 + i, prose(i, 60)) for i in range(20)]
    base = prose(77, 120).split()
    for i in range(25):
        own = list(base)
        own[(5 * i) % 110] = f"edit{i}"
        if i % 3 == 0:
            own = own[: 120 - 2 * i]
        rows.append((100 + i, " ".join(own)))
    rows += [(200, " ".join(base)), (201, " ".join(base).upper()), (202, "a b c"), (203, "A  b\nc"), (204, "a b"), *ODD]
    got = sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in jaccard.near_duplicates(documents(rows)).collect())
    assert got == sorted(classes_by_force(rows))
    kept = jaccard.one_of_each(documents([r for r in rows if r[0] is not None and r[0] > 9]))
    assert {r.doc_id for r in kept.collect()} == {int(c) for i, c, _ in classes_by_force(rows) if i != "None" and int(i) > 9}


@pytest.mark.parametrize("size", [20, 40, 70])
def test_links_are_counted_once_where_parts_are_empty(documents, monkeypatch, size):
    from concordat.llm import jaccard

    monkeypatch.setattr(jaccard, "PART_SHINGLES", size)
    base = prose(77, 120).split()
    rows = [(i, " ".join(base[: 120 - 3 * i])) for i in range(3)]
    got = sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in jaccard.near_duplicates(documents(rows)).collect())
    assert got == sorted(classes_by_force(rows)) and {n for *_, n in got} == {2}


def test_near_duplicates_of_nothing(documents):
    from concordat.llm import jaccard

    assert jaccard.near_duplicates(documents([])).count() == 0


def test_posterior_bound():
    from concordat.llm.jaccard import THRESHOLD, TOLERANCE, least_matches

    grid = np.linspace(0, 1, 20001)
    for n in (16, 32, 64):
        m = least_matches(n)
        for k, kept in ((m, True), (m - 1, False)):
            density = grid**k * (1 - grid) ** (n - k)
            assert (density[grid >= THRESHOLD].sum() / density.sum() >= TOLERANCE * (0.9 if kept else 1.1)) == kept
