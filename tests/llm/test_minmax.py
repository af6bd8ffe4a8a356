"""Min-max near duplicates and their components against brute force."""

import random
import re

import numpy as np
import pytest

pytest.importorskip("pyarrow")


def shingle_set(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if len(words) == 1:
        return {(words[0],)}
    return {tuple(words[i : i + 2]) for i in range(len(words) - 1)}


def by_force(rows):
    sets = [shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                up[root(i)] = root(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((doc, len(sets[i]), least, doc == least))
    return sorted(out, key=str)


def judged(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=str)


def mutated(words, r, n):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
    return words


def family(r, first, size, length, changes):
    """Copies of copies, so that chains are longer than links."""
    base = [f"w{r.randrange(3000)}" for _ in range(length)]
    out, rows = [base], [(first, " ".join(base))]
    for k in range(1, size):
        out.append(mutated(r.choice(out[-3:]), r, r.randint(0, changes)))
        rows.append((first + k, " ".join(out[-1])))
    return rows


def corpus():
    r = random.Random(11)
    rows = [row for k in range(25) for row in family(r, 1000 * k, r.randint(1, 9), r.randint(4, 120), 5)]
    r.shuffle(rows)
    words = [f"x{i}" for i in range(10)]
    # Sets of 9 and 8 out of 10 and 9: 8/10 is a link, 7/9 is none.
    rows += [(90_001, " ".join(words)), (90_002, " ".join(words[:9])), (90_003, " ".join(words[:8])), (90_004, " ".join(words[:7]))]
    return rows


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (5, "two words"), (None, "no id here"), (None, "no id here"), (None, "two words"), (6, "é" * 30), (7, "É" * 30)]


@pytest.mark.parametrize("part", [512, 3])
def test_components_equal_brute_force(documents, monkeypatch, part):
    from concordat.llm import minmax

    monkeypatch.setattr(minmax, "PART_NODES", part)
    rows = corpus() + ODD
    got = judged(minmax.minmax_duplicates(documents(rows)))
    assert got == by_force(rows)
    assert sum(not kept for *_, kept in got) > 60


def test_a_large_group_in_parts(documents, monkeypatch):
    from concordat.llm import minmax

    monkeypatch.setattr(minmax, "PART_NODES", 16)
    r = random.Random(5)
    base = [f"b{i}" for i in range(60)]
    # All of one passage: some linked with each other, some only alike.
    rows = [(i, " ".join(mutated(base, r, r.choice([1, 2, 3, 9, 12])))) for i in range(150)]
    assert judged(minmax.minmax_duplicates(documents(rows))) == by_force(rows)


def test_long_texts_and_nothing(documents):
    from concordat.llm.minmax import minmax_duplicates

    r = random.Random(2)
    words = [f"w{r.randrange(10**6)}" for _ in range(60_000)]
    rows = [(2, " ".join(words)), (1, " ".join(words[5:] + ["end"])), (3, " ".join(words[:40_000]))]
    assert judged(minmax_duplicates(documents(rows))) == by_force(rows)
    assert minmax_duplicates(documents([])).count() == 0
    assert judged(minmax_duplicates(documents([(1, None)]))) == [(1, 0, 1, True)]


def test_signature_values_estimate_the_similarity():
    from concordat.llm import minmax

    r = np.random.default_rng(0)
    both = [r.integers(0, 2**64, 400, dtype=np.uint64) for _ in range(40)]
    shares, least_only = [], []
    for own in both:
        a, b = minmax.signature(own[:360]), minmax.signature(own[40:])
        shares.append((a == b).mean())
        least_only.append((a == b)[::4].mean())
    # 320 of 400 in common; as many hash evaluations give a lower variance than minima alone.
    assert abs(np.mean(shares) - 0.8) < 0.015 and np.var(shares) < np.var(least_only)


def test_thinned_edges_keep_components(spark):
    from concordat.llm.components import components, thinned

    r = random.Random(6)
    edges = [(x, y) for c in range(5) for x in range(100 * c, 100 * c + 40) for y in r.sample(range(100 * c, 100 * c + 40), 6)]
    df = spark.createDataFrame([*edges, (1, 1)], "a long, b long")
    assert thinned(df).count() <= 5 * 39
    assert {(x.node, x.component) for x in components(thinned(df)).collect()} == {(x, x // 100 * 100) for e in edges for x in e}
