"""Fill-in-middle against brute force: boundary sets of every kind, odd texts, restored rows."""

import hashlib
import random
import re

import numpy as np
import pytest

pytest.importorskip("pyarrow")

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def cut_by_force(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(tokens[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(
    ("offsets", "kind"),
    [
        (np.arange(7, 60_000, 6), "BitmapContainer"), (np.arange(3, 9_000), "RunContainer"), (np.array([0, 5, 9, 65_535]), "ArrayContainer"),
        (np.array([0]), "ArrayContainer"), (np.concatenate([np.arange(100), np.arange(500, 4_000), [9_000]]), "RunContainer"),
    ],
)
def test_containers_select_and_rank(offsets, kind):
    from concordat.llm.fim import BoundarySet

    for base in (0, 1 << 16, 5 << 16):
        own = BoundarySet(offsets + base)
        assert type(own.containers[0]).__name__ == kind and len(own) == len(offsets)
        assert [own.select(k) for k in range(len(own))] == (offsets + base).tolist()
        for x in [0, base, base + 1, base + 8_000, base + 65_535, base + 70_000, *(offsets[::97] + base).tolist()]:
            assert own.rank(x) == int((offsets + base <= x).sum())


def test_sets_of_several_chunks():
    from concordat.llm.fim import BoundarySet

    r = np.random.default_rng(4)
    offsets = np.unique(np.concatenate([r.integers(0, 1 << 20, 30_000), np.arange(300_000, 330_000), [1 << 22]]))
    own = BoundarySet(offsets)
    assert len({type(c) for c in own.containers}) > 1 and len(own.containers) == 17
    picked = r.integers(0, len(offsets), 2_000)
    assert [own.select(int(k)) for k in picked] == offsets[picked].tolist()
    assert [own.rank(int(x)) for x in offsets[picked]] == (picked + 1).tolist()
    with pytest.raises(IndexError):
        own.select(len(own))


def odd_rows():
    r = random.Random(3)
    pieces = ["a", "é", "𝒳𝒴", "　", " ", "\n\t", "\x0b", "\x1c", "<", "<S", "P>", ">", "wörter", "日本", "\r\n", "é"]
    rows = [(i, "".join(r.choice(pieces) for _ in range(r.randint(1, 60)))) for i in range(400)]
    rows += [(500, None), (501, ""), (502, "  \n "), (503, "<P> marked"), (504, "x<M>"), (None, "no id at all"), (None, "no id at all"), (7, "one"), (7, "two words")]
    return rows + [(600 + i, ("word " * 90_000) + "é" * i) for i in range(4)] + [(700 + i, "abc\n" * 30 + "<" * i) for i in range(20)]


def test_rows_equal_brute_force(spark, documents):
    from pyspark.sql import functions as F

    from concordat.llm.fim import fill_in_middle, restored

    rows = odd_rows()
    out = fill_in_middle(documents(rows)).withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out), key=str)
    assert got == sorted(((i, *cut_by_force(i, t)) for i, t in rows), key=str)
    assert sorted(r.back for r in out) == sorted(t or "" for _, t in rows)
    assert {r.form for r in out} == {"plain", "psm", "spm"}


def test_no_rows_and_other_shares(documents):
    from concordat.llm.fim import fill_in_middle

    assert fill_in_middle(documents([])).count() == 0
    rows = fill_in_middle(documents([(i, f"some words of {i}") for i in range(50)]), moved=100, suffix_first=0).collect()
    assert {r.form for r in rows} == {"psm"}
    assert {r.form for r in fill_in_middle(documents([(1, "a b")]), moved=0).collect()} == {"plain"}
