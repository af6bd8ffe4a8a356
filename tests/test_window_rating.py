"""The sequence ratio rates few windows, and the class check is judged once."""

from difflib import SequenceMatcher

import numpy as np
from pyspark.sql import functions as F

from concordat.functions import similarity as sim
from concordat.plans import engine


def test_matched_characters_equal_the_matcher():
    draw = np.random.default_rng(4)
    for _ in range(3000):
        a, b = ("".join(draw.choice(list("abc é"), draw.integers(0, n))) for n in (20, 40))
        assert sim.ratio(a, b) == SequenceMatcher(None, a, b).ratio()


def test_common_subsequence_bounds_the_matcher():
    draw = np.random.default_rng(5)
    for _ in range(1000):
        a, b = ("".join(draw.choice(list("abc é"), draw.integers(1, n))) for n in (20, 40))
        longest = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                longest[i + 1][j + 1] = longest[i][j] + 1 if x == y else max(longest[i][j + 1], longest[i + 1][j])
        assert sim.common(sim.Needle(a).masks, a, b) == longest[-1][-1] >= sim.matched(a, b)


def test_repeated_readings_rate_each_window_once(monkeypatch):
    """Equal windows are bounded once, and the matcher is not built for a text that cannot win."""
    best = SequenceMatcher(None, "old tom", "old tam").ratio()
    seen = []
    bounds = sim.window_bounds
    monkeypatch.setattr(sim, "SequenceMatcher", lambda *a: 1 / 0)
    monkeypatch.setattr(sim, "window_bounds", lambda *a: seen.append(len(a[3])) or bounds(*a))
    assert sim.best_ratio("old tom", " ".join(["old tam gin net 750ml"] * 30)) == best
    assert seen == [5]


def test_class_type_is_judged_once(spark):
    """Verdict, detail and the comparisons' status come from one judgement."""
    from concordat.operators.catalog import class_verdict, keyword_mask

    field = "class_type_designation"
    df = spark.createDataFrame([("Dry Gin", "dry gin 750 ml", "1", "Gin", "2")], f"{field} string, text string, ocr_id string, ai_{field} string, llm_id string")
    df = df.withColumns({"declared_mask": keyword_mask(F.lower(field)), "observed_mask": keyword_mask(F.lower("text"))}).localCheckpoint()
    rule = next(r for r in engine.RULES if r.strategy == "class_type")
    plan = lambda c: df.select(c.alias("r"))._jdf.queryExecution().analyzed().toString()
    alone = plan(class_verdict(F.col("declared_mask"), F.col("observed_mask"), F.col(field)))
    built = engine._evaluate(rule, engine.Evidence())
    found = df.select(built.alias("r")).first().r
    assert found.verdict == "PASS" and [c.match_status for c in found.comparisons] == ["MATCH", "MATCH"]
    assert plan(built).count("declared_mask") == alone.count("declared_mask")
