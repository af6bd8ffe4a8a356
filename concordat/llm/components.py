"""Connected components of an edge list by repeated joins."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.llm.common import stored

#: Edges of one task of ``thinned``, and nodes that it remembers before it starts anew.
TASK_EDGES = 500_000
TASK_NODES = 1_000_000


class Forest:
    """Union-find over any values; the smallest of a set is its root."""

    def __init__(self):
        self.up: dict = {}

    def __len__(self) -> int:
        return len(self.up)

    def root(self, x):
        up = self.up
        at = up.setdefault(x, x)
        while at != up[at]:
            up[at] = at = up[up[at]]
        up[x] = at
        return at

    def join(self, x, y) -> bool:
        """Joins the sets of both; False if they were one before."""
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y

    def stars(self) -> list[tuple]:
        return [(x, self.root(x)) for x in self.up if self.root(x) != x]


def thinned(edges: DataFrame) -> DataFrame:
    """Fewer edges (``a, b``) with the same components: of all that meet in a task one spanning
    forest is left, each node tied to the smallest one of its tree.

    The edges of a node to smaller ones meet in a task, so that what many groups have said of it
    becomes one edge.  A task that has seen too many nodes gives out its forest and forgets it.
    """
    kind = edges.schema["a"].dataType.simpleString()
    arrow = {"binary": pa.binary(), "bigint": pa.int64(), "string": pa.string()}[kind]
    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b"), "edges")

    def given(forest: Forest) -> pa.RecordBatch:
        a, b = zip(*forest.stars())
        return pa.RecordBatch.from_arrays([pa.array(a, arrow), pa.array(b, arrow)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                forest.join(x, y)
            if len(forest) > TASK_NODES:
                yield given(forest)
                forest = Forest()
        if len(forest):
            yield given(forest)

    tasks = max(1, math.ceil(edges.count() / TASK_EDGES))
    return stored(edges.repartition(tasks, "a").mapInArrow(run, f"a {kind}, b {kind}"), "forest")


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every end of ``edges`` (``a, b``); a component is its smallest node.

    Every round a node takes the smallest label among its own and its neighbours', then its
    label's label, so chains shorten by powers.  Rounds are cut by written tables.  A hub is no
    hot key: minima are combined before they are shuffled, and skewed joins are split.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(both.filter("a <> b").distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("component").alias("far"))
        step = step.join(jump, "mid", "left").select("node", "old", F.least("mid", F.coalesce("far", "mid")).alias("component"))
        step = stored(step, "labels")
        changed = step.filter(F.col("old") != F.col("component")).limit(1).count()
        labels = step.select("node", "component")
        if not changed:
            return labels
