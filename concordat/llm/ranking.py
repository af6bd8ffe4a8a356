"""Quality scores learned from preference pairs by a Bradley-Terry model.

Counts over whole texts are JVM expressions; the model is a linear score of their ratios,
fitted on all labelled rows and applied as a Column expression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.llm.common import fold, stored
from concordat.llm.textstats import ratios, text_stats

#: Rows of the more frequent class in a block, all of whose pairs across the classes are preferences.
BLOCK = 512
#: Rows of the rarer class that a block should have at least; they go to several blocks for that.
LEAST = 32
PENALTY = 1e-3
STEPS = 30
#: Bins that a pass of the threshold's search counts.
BINS = 1024


def features() -> dict[str, Column]:
    """Ratios on scales on which differences are comparable."""
    scaled = {k: F.sqrt(v) for k, v in ratios().items() if k.endswith("_share")}
    return scaled | {k: F.log1p(v) for k, v in ratios().items() if not k.endswith("_share")}


@dataclass(frozen=True)
class Ranking:
    names: list[str]
    weights: list[float]
    #: Score below which as many labelled rows lie as are rejected.
    threshold: float
    prior: float

    def score(self, columns: dict[str, Column]) -> Column:
        total = F.lit(0.0)
        for name, weight in zip(self.names, self.weights):
            total = total + F.lit(weight) * columns[name]
        return total

    def probability(self, columns: dict[str, Column]) -> Column:
        """The chance to be preferred to a document at the threshold."""
        if not any(self.weights):
            return F.lit(self.prior)
        return 1 / (1 + F.exp(F.lit(self.threshold) - self.score(columns)))


def pair_blocks(labelled: DataFrame, good: int, bad: int) -> DataFrame:
    """``y, x`` arrays of blocks of rows.  Every row is in a block, with rows of the other class."""
    blocks = -(-max(good, bad) // BLOCK)
    rarer = min(good, bad)
    copies = F.when(F.col("y") == int(good < bad), -(-LEAST * blocks // rarer)).otherwise(1) if blocks > 1 else F.lit(1)
    rows = labelled.select("doc_id", "y", "x", F.explode(F.sequence(F.lit(1), F.least(copies, F.lit(blocks)))).alias("copy"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "copy"), F.lit(blocks)))
    return rows.groupBy("block").agg(F.collect_list(F.struct("y", "x")).alias("rows")).select("rows.y", "rows.x")


def newton_sums(blocks: DataFrame, w: np.ndarray, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean gradient and Hessian of the logistic loss of score differences over all pairs of all blocks."""
    size = len(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + size + size * size)
        for batch in batches:
            for y, x in zip(batch.column(0), batch.column(1)):
                y = y.values.to_numpy()
                x = x.values.flatten().to_numpy().reshape(len(y), size) / spread
                better, worse = x[y == 1], x[y == 0]
                p = 1 / (1 + np.exp(np.clip((better @ w)[:, None] - worse @ w, -30, 30)))
                q = p * (1 - p)
                cross = better.T @ q @ worse
                hessian = (better.T * q.sum(1)) @ better + (worse.T * q.sum(0)) @ worse - cross - cross.T
                total += np.concatenate(([p.size], better.T @ p.sum(1) - worse.T @ p.sum(0), hessian.ravel()))
        yield pa.RecordBatch.from_pydict({"place": pa.array(range(len(total)), pa.int32()), "n": pa.array(total, pa.float64())})

    sums = blocks.mapInArrow(run, "place int, n double").groupBy("place").agg(F.sum("n").alias("n")).collect()
    total = np.array([r["n"] for r in sorted(sums)])
    return total[1 : 1 + size] / total[0], total[1 + size :].reshape(size, size) / total[0]


def value_at(values: DataFrame, column: str, rank: int) -> float:
    """The value of a rank, from 0, among all values, found by ever narrower bins."""
    v = F.col(column)
    low, high = values.agg(F.min(v), F.max(v)).first()
    below = 0
    while low < high:
        place = F.least(F.floor((v - low) / F.lit((high - low) / BINS)), F.lit(BINS - 1))
        bins = values.filter(v.between(low, high)).groupBy(place.alias("place")).agg(F.count("*").alias("n"), F.min(v).alias("low"), F.max(v).alias("high"))
        for r in sorted(bins.collect(), key=lambda r: r["place"]):
            if rank < below + r["n"]:
                low, high = r["low"], r["high"]
                break
            below += r["n"]
    return low


def fit(labelled: DataFrame, names: list[str]) -> Ranking:
    """Newton steps over pairs (better, worse) of all rows of ``doc_id, y, x``, each step a pass over them."""
    spreads = [F.stddev_pop(F.get("x", i)).alias(k) for i, k in enumerate(names)]
    sums = labelled.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("good"), *spreads).first()
    good, bad = sums["good"], sums["n"] - sums["good"]
    prior = good / sums["n"] if sums["n"] else 0.5
    if not good or not bad:
        return Ranking(names, [0.0] * len(names), 0.0, prior)
    spread = np.array([sums[k] or 1.0 for k in names])
    blocks = stored(pair_blocks(labelled, good, bad), "ranking-blocks")
    w = np.zeros(len(names))
    for _ in range(STEPS):
        gradient, hessian = newton_sums(blocks, w, spread)
        step = np.linalg.solve(hessian + PENALTY * np.eye(len(w)), gradient - PENALTY * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    model = Ranking(names, (w / spread).tolist(), 0.0, prior)
    scores = labelled.select(model.score({k: F.get("x", i) for i, k in enumerate(names)}).alias("score"))
    threshold = (value_at(scores, "score", bad - 1) + value_at(scores, "score", bad)) / 2
    return replace(model, threshold=threshold)


def learn_ranking(stats: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> Ranking:
    """``labels`` are the rows to learn from; NULL labels and ids are left out."""
    given = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter("y in (0, 1) and doc_id is not null")
    x = F.array(*[c.cast("double") for c in features().values()])
    return fit(stored(given.join(stats, "doc_id").select("doc_id", "y", x.alias("x")), "ranking-rows"), list(features()))


def quality_scores(
    docs: DataFrame, labels: DataFrame, learn_from: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> DataFrame:
    """``doc_id, score, predicted`` for every row of ``docs``.

    ``learn_from`` selects rows of ``labels``.  A NULL text scores as an empty one; repeated
    ids each get a score; with labels of one class only, the score is that class's share.
    """
    stats = stored(text_stats(docs, id_col, text_col), "ranking-stats")
    model = learn_ranking(stats, labels.filter(learn_from) if learn_from is not None else labels, id_col, label_col)
    scored = stats.select("doc_id", model.probability(features()).cast("double").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that no quality label is learned from; a NULL id is not in it."""
    return F.coalesce(fold(id_col, 3) == 1, F.lit(False))
