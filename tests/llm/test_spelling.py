"""Spelling variants against brute force: both tries, long words, lost letters, chains of forms."""

import collections
import random
import re
import zlib

import pytest

pytest.importorskip("pyarrow")


def shortened(word):
    return {word[:i] + word[i + 1 :] for i in range(len(word))}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and a in shortened(b)


def groups_by_force(counts):
    out = {}
    for w, n in counts.items():
        close = [(-m, v) for v, m in counts.items() if v != w and abs(len(v) - len(w)) < 2 and near(v, w)]
        form = min(close)[1] if close and -min(close)[0] >= 10 * n else None
        out[w] = (form, n, len(close), counts[form] if form else None)
    rows = set()
    for w, (form, n, close, form_n) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.add((w, form, root, n, close, form_n))
    return rows


def as_set(df):
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(rows) == len(set(rows))
    return {tuple(r) for r in rows}


def edited(word, r, letters):
    kind, at = r.randrange(3), r.randrange(len(word))
    if kind == 0:
        return word[:at] + word[at + 1 :]
    return word[:at] + r.choice(letters) + word[at + (kind == 1) :]


@pytest.mark.parametrize("lengths", [(7, 10), (7, 24), (47, 50)])
def test_groups_equal_brute_force(spark, lengths):
    from concordat.llm.spelling import variant_groups

    r = random.Random(lengths[1])
    letters = "abéÿ"
    counts = {"a" * 9: 5, "a" * 10: 70, "a" * 11: 900, "a" * 47: 2, "a" * 48: 30, "a" * 49: 400, "a" * 50: 3, "abababa": 3, "bababab": 40}
    while len(counts) < 220:
        word = "".join(r.choice(letters) for _ in range(r.randint(*lengths)))
        for _ in range(r.randrange(5)):
            counts[word] = 10 ** r.randrange(1, 5)
            word = edited(word, r, letters)
            if len(word) < 7:
                break
        else:
            counts.setdefault(word, 2)
    want = groups_by_force(counts)
    assert sum(row[4] for row in want) > 100
    assert as_set(variant_groups(spark.createDataFrame(list(counts.items()), "word string, n long"))) == want


def test_one_crowded_prefix(spark):
    """Every word shares its first half, so all states start at one node."""
    from concordat.llm.spelling import variant_groups

    counts = {f"common{a}{b}{c}{d}": ord(a) * ord(b) % 97 + 2 for a in "abcde" for b in "fghij" for c in "klmno" for d in "pqrs"}
    assert as_set(variant_groups(spark.createDataFrame(list(counts.items()), "word string, n long"))) == groups_by_force(counts)


def test_texts_equal_brute_force(documents):
    from concordat.llm.spelling import spelling_variants

    r = random.Random(8)
    vocabulary = ["election", "elections", "Selection", "señorita", "SEÑORITA", "ÜBERMUT", "übermut", "hyphen-ation", "shortly1word", "niño" * 30, "÷×÷×÷×÷×", "xyzxyzx"]
    rows = [(i, " ".join(r.choice(vocabulary[: r.randint(1, 12)]) for _ in range(r.randint(1, 80)))) for i in range(120)]
    rows += [(1, None), (2, ""), (3, " \n"), (None, "election elections"), (None, "election elections"), *((4 + i, "a" * (30_000 + i % 2)) for i in range(12))]
    counts = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    want = groups_by_force({w: n for w, n in counts.items() if n >= 2})
    assert any(len(row[0]) > 1000 and row[4] for row in want)
    assert as_set(spelling_variants(documents(rows), one_in=31)) == want


def test_chains_and_ties(spark):
    from concordat.llm.spelling import variant_groups

    counts = {"abcdefg": 2, "abcdefgh": 20, "abcdefghi": 200, "abcdefghij": 2000, "zbcdefghij": 2000, "abcdefghix": 200}
    rows = {r.word: r for r in variant_groups(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert rows["abcdefg"].root == "abcdefghij" and rows["abcdefgh"].form == "abcdefghi"
    assert rows["abcdefghij"].form is None and rows["abcdefghij"].root == "abcdefghij"
    assert as_set(variant_groups(spark.createDataFrame(list(counts.items()), "word string, n long"))) == groups_by_force(counts)


def test_nothing(spark, documents):
    from concordat.llm.spelling import spelling_variants, variant_groups

    assert spelling_variants(documents([])).count() == 0
    assert spelling_variants(documents([(1, "seldomword"), (2, None)])).count() == 0
    assert variant_groups(spark.createDataFrame([], "word string, n long")).count() == 0
