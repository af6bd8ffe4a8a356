"""Near duplicates by the Jaccard similarity of word n-grams, pruned by Bayesian estimates.

Texts with equal shingle sets are one *node*.  Nodes meet in bands of MinHash values; within a
meeting their values are compared a few at a time, and a pair is dropped once the posterior
probability that its similarity reaches the threshold is below ``TOLERANCE``.  What is left
falls into clusters, and every pair within a cluster is pruned the same way or counted exactly
from the shingle sets.  With ``BANDS`` bands of ``ROWS`` values a pair at the threshold is missed
with a probability of about 1e-11, a more similar one with less.
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

from concordat.llm.common import ROW, keyed_text, numbered_rows, slices, stored, without_rows, words_of
from concordat.llm.components import components, thinned

WORDS = 5
THRESHOLD = 0.8
BANDS = 48
ROWS = 4
#: MinHash values that pairs are compared by, eight bits of each.
BRIEF = 64
#: Numbers of values after which a pair is judged anew.
CHECKPOINTS = (16, 32, 64)
TOLERANCE = 1e-9
#: Rows of one band key that one group compares; larger keys are split into pairs of parts.
KEY_ROWS = 2048
#: Nodes and shingles of a cluster's part; every pair of parts is one group.
PART_NODES = 512
PART_SHINGLES = 1_000_000
#: Words whose hashes a Python worker remembers.
MEMORY_WORDS = 150_000

_MULTIPLIERS = np.random.default_rng(5).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Hashes(dict):
    """64-bit hashes of words; forgets all when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMORY_WORDS:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


_hashes = _Hashes()


def shingles(text: str) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``WORDS`` words; of all words, if they are fewer."""
    words = np.array(list(map(_hashes.__getitem__, words_of(text))), np.uint64)
    if not len(words):
        return words
    n = max(1, len(words) - WORDS + 1)
    out = np.full(n, len(words) if len(words) < WORDS else WORDS, np.uint64)
    for i in range(min(WORDS, len(words))):
        out = (out ^ words[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def min_hashes(own: np.ndarray) -> np.ndarray:
    """The smallest product with each multiplier, over blocks of shingles."""
    least = np.full(len(_MULTIPLIERS), np.iinfo(np.uint64).max)
    for lo in range(0, len(own), 2048):
        least = np.minimum(least, (own[lo : lo + 2048, None] * _MULTIPLIERS).min(0))
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    keys = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        keys = (keys ^ (least[i::ROWS] >> np.uint64(20))) * np.uint64(0xD6E8FEB86659FD93)
        keys ^= keys >> np.uint64(32)
    return keys.view(np.int64)


@functools.cache
def least_matches(n: int) -> int:
    """Fewest equal values among ``n`` for which the posterior, from a flat prior, still allows
    the threshold: a binomial tail."""
    total = 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * THRESHOLD**m * (1 - THRESHOLD) ** (n + 1 - m)
        if total >= TOLERANCE:
            return m
    return n


def likely(brief: np.ndarray, sizes: np.ndarray, i: int, others: np.ndarray) -> np.ndarray:
    """Those of ``others`` that may reach the threshold with row ``i``."""
    small, large = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
    others = others[small >= THRESHOLD * large - 1e-9]
    done, matches = 0, np.zeros(len(others), np.int64)
    for n in CHECKPOINTS:
        matches = matches + (brief[others, done:n] == brief[i, done:n]).sum(1)
        keep = matches >= least_matches(n)
        others, matches, done = others[keep], matches[keep], n
    return others


class _Forest:
    """Union-find over the rows of one group."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, others: list[int]) -> None:
        # The smallest row of a set is its root: rows are in order of their nodes, so the sets that
        # different groups find have few roots, and their edges repeat each other.
        for j in others:
            a, b = self.root(i), self.root(j)
            self.up[max(a, b)] = min(a, b)

    def stars(self) -> list[tuple[int, int]]:
        return [(i, self.root(i)) for i in range(len(self.up)) if self.root(i) != i]


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows with equal leading ``keys`` columns from sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_pylist() for i in range(keys)]
        start = 0
        for at, key in enumerate(zip(*columns)):
            if key != last:
                if at > start:
                    held.append(batch.slice(start, at - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], at, key
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def _split(rows: DataFrame, parts: str, node: str) -> DataFrame:
    """Deals rows of a key with several ``parts`` to all pairs of parts that they belong to:
    adds ``pair`` and ``side``, the row's own part."""
    own = F.when(F.col(parts) > 1, F.pmod(F.xxhash64(node), F.col(parts))).otherwise(F.lit(0))
    rows = rows.withColumn("side", own.cast("int"))
    other = F.sequence(F.lit(0), F.col(parts).cast("int") - 1)
    rows = rows.withColumn("other", F.explode(other))
    pair = F.least("side", "other") * F.col(parts) + F.greatest("side", "other")
    return rows.withColumn("pair", pair.cast("long")).drop("other")


def _of_two_parts(group: pa.Table) -> bool:
    """Whether a group is a pair of different parts, told by its number: one of them may be empty."""
    pair, parts = (group.column(c)[0].as_py() for c in ("pair", "parts"))
    return pair // parts != pair % parts


def _dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return rows.repartition(n, *keys).sortWithinPartitions(*keys, "node")


def nodes_of(texts: DataFrame) -> DataFrame:
    """``row, doc_id, hash, node, n_shingles, bands, brief`` per text; ``node`` is NULL without a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            rows = []
            for text in batch.column(3):
                own = shingles(text.as_py())
                if len(own):
                    least = min_hashes(own)
                    brief = (least[:: BANDS * ROWS // BRIEF] >> np.uint64(32)).astype(np.uint8).tobytes()
                    rows.append((hashlib.blake2b(own.tobytes(), digest_size=16).digest(), len(own), band_keys(least).tolist(), brief))
                else:
                    rows.append((None, 0, None, None))
            kinds = (pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], [*batch.schema.names[:3], "node", "n_shingles", "bands", "brief"]
            )
        _hashes.clear()

    hashed = texts.select("row", "doc_id", F.xxhash64("text").alias("hash"), "text")
    return hashed.mapInArrow(run, "row long, doc_id long, hash long, node binary, n_shingles int, bands array<long>, brief binary")


def _likely_edges(nodes: DataFrame) -> DataFrame:
    """Edges that join, within every band key, the nodes that may be similar."""
    bands = nodes.select("node", F.explode("bands").alias("key"))
    shared = bands.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    met = bands.join(shared, "key").select("key", "node", F.ceil(F.col("n") / KEY_ROWS).alias("parts"))
    met = _split(met.join(nodes.select("node", "n_shingles", "brief"), "node"), "parts", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: set[tuple[bytes, bytes]] = set()
        for group in _groups(batches, 2):
            n = group.num_rows
            if n > 1:
                ids = group.column(2).to_pylist()
                brief = np.frombuffer(b"".join(group.column(4).to_pylist()), np.uint8).reshape(n, BRIEF)
                sizes, side = (np.array(group.column(i).to_pylist(), np.int64) for i in (3, 5))
                mixed, forest = _of_two_parts(group), _Forest(n)
                for i in range(n - 1):
                    others = np.arange(i + 1, n)
                    found = likely(brief, sizes, i, others[side[others] != side[i]] if mixed else others)
                    forest.join(i, found.tolist())
                out.update((ids[i], ids[j]) for i, j in forest.stars())
                if len(out) > 100_000:
                    yield _edge_batch(out)
                    out = set()
        if out:
            yield _edge_batch(out)

    ready = _dealt(met.select("key", "pair", "node", "n_shingles", "brief", "side", "parts"), ["key", "pair"])
    return ready.mapInArrow(run, "a binary, b binary").distinct()


def _edge_batch(edges: set[tuple[bytes, bytes]]) -> pa.RecordBatch:
    a, b = zip(*sorted(edges))
    return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def _intersections(sets: list[np.ndarray], pairs: list[tuple[int, np.ndarray]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Exact sizes of intersections: one product of 0/1 matrices over the shingles that several
    sets hold, a slice of them at a time; a few pairs are counted one by one."""
    if sum(len(o) for _, o in pairs) <= 4 * len(sets):
        for i, others in pairs:
            yield i, others, np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in others.tolist()], np.int64)
        return
    everything = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    kept, place, times = np.unique(everything, return_inverse=True, return_counts=True)
    column = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[place]
    total = np.zeros((len(sets), len(sets)))
    for lo in range(0, int(column.max()) + 1, 2048):
        own = (column >= lo) & (column < lo + 2048)
        dense = np.zeros((len(sets), 2048), np.float32)
        dense[owner[own], column[own] - lo] = 1
        total += dense @ dense.T
    for i, others in pairs:
        yield i, others, np.rint(total[i, others]).astype(np.int64)


def _verified(texts: DataFrame, nodes: DataFrame, clusters: DataFrame) -> DataFrame:
    """For every node of a cluster and group: the documents it links to, and an edge (``root``)
    for each set of linked nodes in the group."""
    members = clusters.join(nodes.select("node", "first.row", "n_shingles", "copies", "brief"), "node")
    sizes = members.groupBy("component").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("total"))
    parts = F.ceil(F.greatest(F.col("m") / PART_NODES, F.col("total") / PART_SHINGLES))
    members = members.join(sizes.select("component", parts.alias("parts")), "component")
    with_text = members.join(texts.select("row", "text"), "row")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            rows = [shingles(t.as_py()) for t in batch.column(batch.schema.get_field_index("text"))]
            sets = pa.array([r.tobytes() for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], sets], [*batch.schema.names[:-1], "shingles"])
        _hashes.clear()

    named = with_text.select("node", "component", "parts", "copies", "brief", "text")
    named = named.mapInArrow(sets_of, "node binary, component binary, parts long, copies long, brief binary, shingles binary")
    dealt = _split(named, "parts", "node")
    dealt = _dealt(dealt.select("component", "pair", "node", "copies", "brief", "shingles", "side", "parts"), ["component", "pair"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 2):
            n = group.num_rows
            ids, copies = group.column(2).to_pylist(), np.array(group.column(3).to_pylist(), np.int64)
            brief = np.frombuffer(b"".join(group.column(4).to_pylist()), np.uint8).reshape(n, BRIEF)
            sets = [np.frombuffer(s, np.uint64) for s in group.column(5).to_pylist()]
            side = np.array(group.column(6).to_pylist(), np.int64)
            sizes, mixed = np.array([len(s) for s in sets]), _of_two_parts(group)
            pairs = []
            for i in range(n - 1):
                others = np.arange(i + 1, n)
                others = likely(brief, sizes, i, others[side[others] != side[i]] if mixed else others)
                if len(others):
                    pairs.append((i, others))
            links, forest = np.zeros(n, np.int64), _Forest(n)
            for i, others, common in _intersections(sets, pairs):
                # In whole numbers, so that a similarity of exactly 0.8 counts.
                linked = others[5 * common >= 4 * (sizes[i] + sizes[others] - common)]
                links[i] += copies[linked].sum()
                links[linked] += copies[i]
                forest.join(i, linked.tolist())
            at = np.flatnonzero(links)
            if len(at):
                yield pa.RecordBatch.from_pydict(
                    {
                        "node": pa.array([ids[i] for i in at], pa.binary()), "root": pa.array([ids[forest.root(int(i))] for i in at], pa.binary()),
                        "links": pa.array(links[at], pa.int64()),
                    }
                )

    return dealt.mapInArrow(run, "node binary, root binary, links long")


def _judged(texts: DataFrame) -> DataFrame:
    """``row, doc_id, node, first, n_links, n_copies`` per row of ``texts`` (``row, doc_id, text``);
    ``first`` is the first row of its group: the smallest id, ties by the text's hash, then by the
    row's number; rows without an id come last.  It is NULL for a text that is a group by itself.
    """
    rows = stored(nodes_of(texts), "near-rows")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "hash", "row")
    nodes = stored(
        rows.filter("node is not null").groupBy("node").agg(
            F.min(order).alias("first"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"),
            F.first("bands").alias("bands"), F.first("brief").alias("brief"),
        ),
        "near-nodes",
    )
    clusters = components(thinned(_likely_edges(nodes)))
    found = stored(_verified(texts, nodes, clusters), "near-links")
    groups = components(thinned(found.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    linked = nodes.select("node", "first").join(groups, "node").groupBy("component").agg(F.min("first").alias("group_first"))
    linked = groups.join(linked, "component").join(links, "node").select("node", "group_first", "links")
    # Only nodes with copies or links differ from what a document is by itself.
    known = nodes.select("node", "first", "copies").join(linked, "node", "left").filter((F.col("copies") > 1) | F.col("links").isNotNull())
    known = stored(
        known.select("node", F.coalesce("group_first", "first").alias("first"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), (F.col("copies") - 1).alias("n_copies")),
        "near-known",
    )
    return rows.select("row", "doc_id", "node").join(known, "node", "left")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, class_id, n_links, n_copies`` for every row of ``docs``.

    Words are those of ``words_of``, A-Z in lower case.  ``n_links`` counts the other documents
    whose similarity is ``THRESHOLD`` or more, copies included; ``class_id`` is the smallest
    doc_id that is reached over links.  A text without a word is its own class; one of fewer
    than ``WORDS`` words has all of them as its one shingle.  A NULL id names no class; rows
    without an id and rows that repeat one count as documents of their own.
    """
    out = _judged(numbered_rows(keyed_text(docs, id_col, text_col), "near-texts").withColumnRenamed(ROW, "row"))
    zero = F.lit(0).cast("long")
    return out.select("doc_id", F.coalesce("first.doc_id", "doc_id").alias("class_id"), F.coalesce("n_links", zero).alias("n_links"), F.coalesce("n_copies", zero).alias("n_copies"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of every class the first row, with all its columns: the smallest id, and one row only where
    rows repeat that id or have none."""
    docs = numbered_rows(docs, "near-docs")
    texts = docs.select(F.col(ROW).alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return without_rows(docs, stored(_judged(texts).filter("first.row <> row").select("row"), "near-gone"))
