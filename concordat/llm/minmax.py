"""Near duplicates by min-max hashing of word shingles.

Under every permutation both the smallest and the largest value of a set are kept.  Each is equal
for two sets with the probability of their similarity, so ``PERMUTATIONS`` hash evaluations of a
shingle give twice as many signature values, unbiased and of a lower variance than as many minima.
Texts with equal sets are one *node*.  Nodes meet in bands of ``ROWS`` values; a pair that meets is
likely if the values of its *brief* agree often enough, and likely pairs fall into clusters.

Clusters are then confirmed on full sets.  Only which nodes hang together is asked for, so a pair
that is connected already is not counted: in a cluster of one part a task walks its pairs, most
alike first.  In a larger one every node is first held against the nodes it agrees with best, which
connects nearly all; what remains outside the largest set of connected nodes is then held against
every part of the cluster.  With ``BANDS`` bands a pair at the threshold is missed with a
probability of about 1e-11, a more similar one with less; no pair is left out for a group's size.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.llm.common import ROW, keyed_text, numbered_rows, slices, stored, words_of
from concordat.llm.components import Forest, components, thinned

WORDS = 2
#: Links have ``100 * intersection >= PERCENT * union``.
PERCENT = 80
BANDS = 48
ROWS = 4
#: Each gives two values.
PERMUTATIONS = BANDS * ROWS // 2
#: Signature values in a brief, eight bits of each.
BRIEF = 64
#: A likely pair's agreement is not less than what a pair at the threshold has with this probability.
TOLERANCE = 1e-9
#: Nodes and shingles of one part of a band's group or of a cluster.
PART_NODES = 512
PART_SHINGLES = 1_000_000
#: Words whose hashes a Python worker remembers.
MEMORY_WORDS = 150_000

_MULTIPLIERS = np.random.default_rng(13).integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str, memory: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``WORDS`` words; of all words, if they are fewer."""
    tokens = words_of(text)
    if len(memory) > MEMORY_WORDS:
        memory.clear()
    for w in set(tokens).difference(memory):
        memory[w] = xxhash.xxh3_64_intdigest(w)
    hashes = np.array([memory[w] for w in tokens], np.uint64)
    width = min(WORDS, len(hashes))
    if not width:
        return hashes
    n = len(hashes) - width + 1
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out = (out ^ hashes[i : i + n]) * _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(own: np.ndarray) -> np.ndarray:
    """The smallest and the largest product with each multiplier, side by side."""
    least, most = np.full(PERMUTATIONS, np.iinfo(np.uint64).max), np.zeros(PERMUTATIONS, np.uint64)
    for lo in range(0, len(own), 1024):
        products = own[lo : lo + 1024, None] * _MULTIPLIERS
        least, most = np.minimum(least, products.min(0)), np.maximum(most, products.max(0))
    return np.column_stack((least, most)).ravel()


def band_keys(values: np.ndarray) -> np.ndarray:
    """A band holds minimum and maximum of ``ROWS // 2`` permutations."""
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in values.reshape(BANDS, ROWS).T:
        keys = (keys ^ (column >> np.uint64(16))) * np.uint64(0xD6E8FEB86659FD93)
        keys ^= keys >> np.uint64(32)
    return keys.view(np.int64)


def brief_of(values: np.ndarray) -> bytes:
    """Minimum and maximum of every permutation of the first ``BRIEF // 2``."""
    return (values[:BRIEF] >> np.uint64(32)).astype(np.uint8).tobytes()


@functools.cache
def least_agreement() -> int:
    """Fewest equal values of a brief that a pair at the threshold falls below with ``TOLERANCE`` or less."""
    total, share = 0.0, PERCENT / 100
    for m in range(BRIEF + 1):
        total += math.comb(BRIEF, m) * share**m * (1 - share) ** (BRIEF - m)
        if total > TOLERANCE:
            return m
    return BRIEF


def agreements(briefs: np.ndarray, sizes: np.ndarray, i: int, others: np.ndarray) -> np.ndarray:
    """How many values of their briefs row ``i`` shares with each of ``others``; -1 for unlikely pairs."""
    same = (briefs[others] == briefs[i]).sum(1)
    small, large = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
    return np.where((same >= least_agreement()) & (100 * small >= PERCENT * large), same, -1)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets reach the threshold, in whole numbers."""
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


def groups_of(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows with equal leading ``keys`` columns (integers) from sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        own = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)])
        cuts = [0, *(np.flatnonzero((own[1:] != own[:-1]).any(1)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            if held and tuple(own[lo]) != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = tuple(own[lo])
    if held:
        yield pa.Table.from_batches(held)


def _briefs(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), BRIEF)


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return rows.repartition(tasks, *keys).sortWithinPartitions(*keys, "node")


def nodes_of(texts: DataFrame) -> DataFrame:
    """``row, doc_id, node, n_shingles, bands, brief`` per text (``row, doc_id, text``); ``node`` is
    a 128-bit digest of the whole set, NULL without a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[bytes, int] = {}
        for batch in slices(batches, "text", 2 << 20):
            rows = []
            for text in batch.column(2).to_pylist():
                own = shingles(text, memory)
                if len(own):
                    values = signature(own)
                    rows.append((hashlib.blake2b(own.tobytes(), digest_size=16).digest(), len(own), band_keys(values).tolist(), brief_of(values)))
                else:
                    rows.append((None, 0, None, None))
            kinds = (pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            made = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *made], ["row", "doc_id", "node", "n_shingles", "bands", "brief"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("row", "doc_id", "text").mapInArrow(run, f"row long, doc_id {kind}, node binary, n_shingles long, bands array<long>, brief binary")


def likely_edges(nodes: DataFrame) -> DataFrame:
    """``a, b, agreed``: edges that join the likely pairs of every band, and each node to the one it
    agrees with best.

    A band's group of more than ``PART_NODES`` nodes is taken for one cluster as it stands, tied
    to its smallest node; its parts still tell which nodes agree best.
    """
    bands = nodes.select("node", F.explode("bands").alias("key"))
    shared = bands.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("first")).filter("n > 1")
    met = bands.join(shared, "key").select("key", "node", "first", F.ceil(F.col("n") / PART_NODES).alias("parts"))
    met = stored(met, "minmax-met")
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("node"), F.col("parts"))).otherwise(F.lit(0)).cast("long")
    groups = met.select("key", part.alias("part"), "node").join(nodes.select("node", "n_shingles", "brief"), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[tuple[bytes, bytes], int] = {}
        for group in groups_of(batches, 2):
            n = group.num_rows
            if n < 2:
                continue
            ids, sizes, briefs = group.column(2).to_pylist(), group.column(3).to_numpy(), _briefs(group.column(4))
            forest = Forest()
            for i in range(n):
                same = agreements(briefs, sizes, i, np.arange(n))
                same[i] = -1
                best = int(same.argmax())
                if same[best] < 0:
                    continue
                out[max(ids[i], ids[best]), min(ids[i], ids[best])] = int(same[best])
                for j in np.flatnonzero(same[:i] >= 0).tolist():
                    forest.join(i, j)
            for i, root in forest.stars():
                # A root is tied to every node of its tree, whether or not they agree themselves.
                out.setdefault((max(ids[i], ids[root]), min(ids[i], ids[root])), 0)
            if len(out) > 100_000:
                yield _edge_batch(out)
                out = {}
        if out:
            yield _edge_batch(out)

    found = _dealt(groups.select("key", "part", "node", "n_shingles", "brief"), "key", "part").mapInArrow(run, "a binary, b binary, agreed int")
    tied = met.filter("parts > 1 and node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"), F.lit(0).alias("agreed"))
    return found.unionByName(tied).groupBy("a", "b").agg(F.max("agreed").alias("agreed"))


def _edge_batch(edges: dict[tuple[bytes, bytes], int]) -> pa.RecordBatch:
    a, b = zip(*edges)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(list(edges.values()), pa.int32())], ["a", "b", "agreed"])


def _sets(texts: DataFrame, members: DataFrame) -> DataFrame:
    """``node, brief, shingles`` for every row of ``members`` (``node, row, brief``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[bytes, int] = {}
        for batch in slices(batches, "text", 2 << 20):
            sets = pa.array([shingles(t, memory).tobytes() for t in batch.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], sets], ["node", "brief", "shingles"])

    rows = members.join(texts.select("row", "text"), "row").select("node", "brief", "text")
    return rows.mapInArrow(run, "node binary, brief binary, shingles binary")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose full sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ours, theirs = (batch.column(i).to_pylist() for i in (2, 3))
            keep = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(ours, theirs)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # A node that many pairs name is joined first, while rows are still small.
    rows = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("theirs")), "b")
    rows = rows.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("ours")), "a")
    return rows.select("a", "b", "ours", "theirs").mapInArrow(run, "a binary, b binary")


def _within(clusters: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges ``a, b`` that connect whatever hangs together in the clusters.

    ``clusters`` holds ``node, cluster, parts, label``: nodes of one label are known to hang
    together.  The nodes of the label with the most nodes are *settled*; the others are held
    against every part, part by part, so that a pair of which one is not settled meets once.
    """
    counts = clusters.groupBy("cluster", "label").agg(F.count("*").alias("n"))
    settled = counts.groupBy("cluster").agg(F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("labels"), F.sum("n").alias("m"))
    # Every label is a node, and the parts of what is open are those of its own number.
    open_ = settled.filter("labels > 1").select("cluster", F.col("top.label").alias("main"), (F.col("m") - F.col("top.n")).alias("open_n"), "m")
    rows = clusters.join(open_, "cluster").withColumn("open", F.col("label") != F.col("main"))
    open_parts = F.ceil(F.col("open_n") / F.col("m") * F.col("parts")).cast("int")
    spread = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    rows = rows.withColumn("open_parts", F.when(F.col("parts") > 1, open_parts).otherwise(1)).withColumn("parts", F.col("parts").cast("int"))
    # As a part of the cluster, a node meets all parts of the open ones; as an open one, all parts.
    as_part = F.transform(F.sequence(F.lit(0), F.col("open_parts") - 1), lambda q: F.struct(spread(F.col("parts")).alias("p"), q.alias("q"), F.lit(False).alias("asks")))
    as_open = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(p.alias("p"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("open_parts")).cast("int").alias("q"), F.lit(True).alias("asks")))
    none = F.array().cast("array<struct<p:int,q:int,asks:boolean>>")
    meets = F.when(F.col("parts") == 1, F.array(F.struct(F.lit(0).alias("p"), F.lit(0).alias("q"), F.col("open").alias("asks")))).otherwise(
        F.concat(as_part, F.when(F.col("open"), as_open).otherwise(none))
    )
    rows = rows.select(F.xxhash64("cluster").alias("group"), "node", "cluster", "label", F.explode(meets).alias("at"))
    rows = rows.select("group", F.col("at.p").cast("long").alias("p"), F.col("at.q").cast("long").alias("q"), "node", "cluster", "label", F.col("at.asks").alias("asks"))
    rows = rows.join(sets, "node").select("group", "p", "q", "node", "cluster", "label", "asks", "brief", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, 3):
            asks = np.array(group.column(6).to_pylist(), bool)
            if not asks.any() or group.num_rows < 2:
                continue
            ids, labels = group.column(3).to_pylist(), group.column(5).to_pylist()
            briefs = _briefs(group.column(7))
            sets = [np.frombuffer(x, np.uint64) for x in group.column(8).to_pylist()]
            sizes, place, forest, links = np.array([len(x) for x in sets]), np.arange(len(ids)), Forest(), []
            for i in np.flatnonzero(asks).tolist():
                # Two that ask meet here once; with one part there are no rows twice.
                same = agreements(briefs, sizes, i, place)
                same[(asks & (place <= i)) | (place == i)] = -1
                for j in np.argsort(-same, kind="stable")[: int((same >= 0).sum())].tolist():
                    if forest.root(labels[i]) != forest.root(labels[j]) and similar(sets[i], sets[j]):
                        forest.join(labels[i], labels[j])
                        links.append((ids[i], ids[j]))
            if links:
                a, b = zip(*links)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return _dealt(rows, "group", "p", "q").mapInArrow(run, "a binary, b binary")


def linked_nodes(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges ``a, b`` over full sets with the same components as all links between ``nodes``."""
    edges = stored(likely_edges(nodes), "minmax-edges")
    clusters = components(thinned(edges)).withColumnRenamed("component", "cluster")
    members = stored(clusters.join(nodes.select("node", "row", "n_shingles", "brief"), "node"), "minmax-members")
    sets = stored(_sets(texts, members), "minmax-sets")
    sizes = members.groupBy("cluster").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("total"))
    parts = F.ceil(F.greatest(F.col("m") / PART_NODES, F.col("total") / PART_SHINGLES))
    members = stored(members.join(sizes.select("cluster", parts.alias("parts")), "cluster").select("node", "cluster", "parts"), "minmax-parts")
    # In clusters of several parts, the node that agrees best and the smallest one are asked first.
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("other"), "agreed").unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"), "agreed"))
    ends = ends.join(members.filter("parts > 1").select("node"), "node")
    asked = ends.groupBy("node").agg(F.max(F.struct("agreed", "other")).alias("best"), F.min("other").alias("least"))
    asked = asked.select("node", F.explode(F.array_distinct(F.array("best.other", "least"))).alias("other"))
    pairs = asked.select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")).distinct()
    known = stored(_confirmed(pairs, sets), "minmax-known")
    labels = components(thinned(known)).withColumnRenamed("component", "label")
    labelled = members.join(labels, "node", "left").select("node", "cluster", "parts", F.coalesce("label", "node").alias("label"))
    return known.unionByName(_within(stored(labelled, "minmax-labels"), sets))


def minmax_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Words are those of ``words_of``, A-Z in lower case; ``n_shingles`` is the size of a text's set.
    ``component_id`` is the smallest doc_id that is reached over links, a row's own if it has none;
    ``kept`` tells whether it is the row's own.  A NULL text is empty; a text without a word links
    with nothing; one of fewer than ``WORDS`` words has all of them as its one shingle.  Rows that
    repeat an id, or a text, are documents of their own.  A NULL id names no component: such a row
    is kept only if no row of its component has an id.  Other columns are not looked at.
    """
    texts = numbered_rows(keyed_text(docs, id_col, text_col), "minmax-texts").withColumnRenamed(ROW, "row")
    rows = stored(nodes_of(texts), "minmax-rows")
    nodes = stored(
        rows.filter("node is not null").groupBy("node").agg(
            F.min("doc_id").alias("least"), F.min("row").alias("row"), F.count("*").alias("copies"),
            F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("brief").alias("brief"),
        ),
        "minmax-nodes",
    )
    groups = components(thinned(linked_nodes(texts, nodes)))
    least = nodes.select("node", "least").join(groups, "node").groupBy("component").agg(F.min("least").alias("group_least"))
    linked = groups.join(least, "component").select("node", "group_least")
    # Only a node with copies or links can have a component of another id.
    known = nodes.join(linked, "node", "left").filter("copies > 1 or group_least is not null or least is null")
    known = stored(known.select("node", F.coalesce("group_least", "least").alias("known")), "minmax-known")
    out = rows.select("doc_id", "n_shingles", "node").join(known, "node", "left")
    own = F.coalesce("known", "doc_id")
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))
