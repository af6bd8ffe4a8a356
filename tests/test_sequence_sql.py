"""The oracle's recursive matching blocks against the standard library's."""

import random
from difflib import SequenceMatcher

import duckdb
import pandas as pd


def test_ratios_of_random_pairs():
    from concordat.plans.sequence_sql import ratio_ctes

    r = random.Random(1)
    draw = lambda letters, low, high: "".join(r.choice(letters) for _ in range(r.randint(low, high)))
    rows = [(draw(letters, 1, 25), draw(letters, 1, 40)) for letters in ("ab", "abc ", "abcdéfgh ij") for _ in range(200)]
    # Long second strings, in which frequent characters start no block.
    rows += [(draw("abcde fghij", 5, 25), draw("aaaaabbbbccde fghijklmnopqrstuvwxyz", 190, 420)) for _ in range(60)]
    rows += [("aaab", "a" * 300), ("a" * 5, "b" * 250 + "a" * 5), ("same", "same")]
    con = duckdb.connect()
    con.register("given", pd.DataFrame(rows, columns=["a", "b"]))
    got = con.sql(f"with recursive {ratio_ctes('select a, b from given')} select a, b, ratio from ratios").fetchall()
    assert len(got) == len(set(rows))
    assert [(a, b, x) for a, b, x in got if x != SequenceMatcher(None, a, b).ratio()] == []
