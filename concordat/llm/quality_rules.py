"""Decision lists of threshold rules, learned by sequential covering from labelled counts.

Everything runs as DataFrame operations.  The labelled rows are reduced to bins of their
features once; growing a rule by one condition is one histogram over them, pruning it one
aggregate, so the driver sees a few hundred counts at a time however many rows there are.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.llm.common import fold, stored
from concordat.llm.textstats import ratios, text_stats

#: Thresholds per feature and class, from quantiles of all labelled rows.
QUANTILES = 12
MAX_RULES = 6
MAX_CONDITIONS = 3
#: One labelled row in so many prunes rules and takes no part in growing them.
PRUNE_FOLD = 3


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float
    bin: int

    def column(self, features: dict[str, Column]) -> Column:
        value = features[self.feature]
        return value >= F.lit(self.threshold) if self.at_least else value < F.lit(self.threshold)

    def binned(self, names: list[str]) -> Column:
        place = F.col("bins")[names.index(self.feature)]
        return place > self.bin if self.at_least else place <= self.bin

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:.6g}"


Rule = list[Condition]


def _all(columns: list[Column]) -> Column:
    return functools.reduce(lambda a, b: a & b, columns, F.lit(True))


def _any(columns: list[Column]) -> Column:
    return functools.reduce(lambda a, b: a | b, columns, F.lit(False))


def _thresholds(rows: DataFrame, features: dict[str, Column]) -> dict[str, list[float]]:
    shares = [(i + 0.5) / QUANTILES for i in range(QUANTILES)]
    found = rows.groupBy("bad").agg(*(F.percentile_approx(c, shares, 2000).alias(f) for f, c in features.items())).collect()
    return {f: sorted({v for row in found for v in (row[f] or [])}) for f in features}


def learn_rules(labelled: DataFrame, features: dict[str, Column]) -> list[Rule]:
    """Rules for the rows with ``bad`` = 1, best first.

    ``labelled`` has ``doc_id``, ``bad`` (0 or 1) and what ``features`` read.  A rule grows by
    the condition with the largest information gain among the rows that no earlier rule takes,
    until it takes no good row of the growing fold; trailing conditions are then dropped as
    the pruning fold says.  Learning ends when a rule is wrong there as often as right.
    Without rows of both classes there are no rules.
    """
    names = list(features)
    rows = labelled.filter("bad is not null").select("doc_id", "bad", *(c.alias(f) for f, c in features.items()))
    rows = stored(rows, "rule-rows")
    thresholds = _thresholds(rows, {f: F.col(f) for f in names})
    bins = F.array(
        *(functools.reduce(lambda a, b: a + b, [(F.col(f) >= F.lit(t)).cast("int") for t in thresholds[f]], F.lit(0)) for f in names)
    )
    prunes = fold("doc_id", PRUNE_FOLD) == 0
    rows = stored(rows.select(F.coalesce(prunes, F.lit(False)).alias("prunes"), "bad", bins.alias("bins")), "rule-bins")
    rules: list[Rule] = []
    while len(rules) < MAX_RULES:
        free = rows.filter(~_any([_all([c.binned(names) for c in r]) for r in rules]))
        rule: Rule = []
        while len(rule) < MAX_CONDITIONS:
            best = _best_condition(free.filter(_all([~F.col("prunes"), *(c.binned(names) for c in rule)])), names, thresholds)
            if best is None:
                break
            rule.append(best[0])
            if best[1] == 0:
                break
        rule = _pruned(free.filter("prunes"), rule, names) if rule else []
        if not rule:
            break
        rules.append(rule)
    return rules


def _best_condition(rows: DataFrame, names: list[str], thresholds: dict[str, list[float]]) -> tuple[Condition, int] | None:
    """The condition with the largest gain and the good rows that it still takes."""
    counts = rows.select("bad", F.posexplode("bins").alias("feature", "bin")).groupBy("feature", "bin", "bad").count().collect()
    tally: dict[int, dict[int, list[int]]] = {}
    for row in counts:
        tally.setdefault(row["feature"], {}).setdefault(row["bin"], [0, 0])[row["bad"]] += row["count"]
    best = None
    for i, by_bin in sorted(tally.items()):
        good, bad = (sum(n[c] for n in by_bin.values()) for c in (0, 1))
        if not bad:
            continue
        low = [0, 0]
        for k in range(len(thresholds[names[i]])):
            low = [a + b for a, b in zip(low, by_bin.get(k, (0, 0)))]
            for at_least, g, b in ((True, good - low[0], bad - low[1]), (False, *low)):
                if not b or (g, b) == (good, bad):
                    continue
                gain = b * (math.log2(b / (b + g)) - math.log2(bad / (bad + good)))
                if gain > 1e-9 and (best is None or gain > best[0]):
                    best = gain, Condition(names[i], at_least, thresholds[names[i]][k], k), g
    return best and (best[1], best[2])


def _pruned(rows: DataFrame, rule: Rule, names: list[str]) -> Rule:
    """The leading conditions that do best on the pruning fold; none if it errs as often as not."""
    prefixes = [_all([c.binned(names) for c in rule[: n + 1]]) for n in range(len(rule))]
    sums = rows.agg(
        *(F.count_if(p & (F.col("bad") == 1)).alias(f"b{n}") for n, p in enumerate(prefixes)),
        *(F.count_if(p & (F.col("bad") == 0)).alias(f"g{n}") for n, p in enumerate(prefixes)),
    ).first()
    worth = [(sums[f"b{n}"] - sums[f"g{n}"]) / max(1, sums[f"b{n}"] + sums[f"g{n}"]) for n in range(len(rule))]
    n = max(range(len(rule)), key=lambda i: (worth[i], -i))
    return rule[: n + 1] if worth[n] > 0 else []


def decision_list(rules: list[Rule], features: dict[str, Column]) -> Column:
    """Number of the first rule that takes a row, from 1; 0 if none does."""
    out = F.lit(0)
    for n in range(len(rules), 0, -1):
        out = F.when(_all([c.column(features) for c in rules[n - 1]]), n).otherwise(out)
    return out


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def quality_rules(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> DataFrame:
    """Counts, base verdict and learned verdict for every document.

    The texts are read once: their counts are stored, and rules are learned from and applied
    to these.  A NULL text counts as empty and so fails the base rules; a document labelled
    several times is as many examples; NULL labels are no examples; rows that share an id
    each get a verdict.  ``rule`` is the number of the rule that rejected a row, 0 if none did.
    """
    stats = stored(text_stats(docs, id_col, text_col), "text-stats")
    given = labels.select(F.col(id_col).alias("doc_id"), (F.col(label_col) == 0).cast("int").alias("bad"))
    # What fails the base rules is settled; the list learns from the rest.
    rules = learn_rules(stats.filter(~base_failed()).join(given, "doc_id"), ratios())
    judged = stats.withColumns({"base_failed": base_failed(), "rule": decision_list(rules, ratios())})
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
