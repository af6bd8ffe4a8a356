"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max index.

Terms are those whose presence differs between the classes of the labelled sample; their
document frequencies come from all documents.  Examples lie in blocks of ``BLOCK``, each an
inverted index of its own terms, and a matrix holds every term's largest weight in every
block.  A query scores blocks in order of their upper bounds and stops when no block left can
hold a neighbour, so the neighbours are exact.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.llm.common import first_by_hash, fold, keyed_text, slices, stored

#: Labelled rows that serve as examples, chosen by a hash of their id.
EXAMPLES = 16_384
#: Terms of the vectors, those with the largest difference between the classes.
TERMS = 1024
#: Least difference, in standard errors, and least documents for a term to be used.
Z_SCORE = 4.0
LEAST_DOCS = 5
BLOCK = 64
NEIGHBOURS = 15
#: Votes that the classes' shares count for, next to neighbours of weight up to 1.
PRIOR_VOTES = 0.5
#: Marks taken out of words before they are looked up.
MARKS = b".,;:!?\"'()[]#*$%&|<>"


def terms_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().translate(None, MARKS).split()


@dataclass
class Index:
    """Examples by number: their vectors in blocks, labels and ids."""

    terms: dict[bytes, int]
    idf: np.ndarray
    prior: float
    labels: np.ndarray
    ids: np.ndarray
    #: Per block: the terms in it and their postings, terms x ``BLOCK``.
    blocks: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    #: Largest weight of every term in every block.
    largest: np.ndarray | None = None

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers in ascending order and their weights, of unit length."""
        counts = Counter(map(self.terms.get, terms_of(text)))
        counts.pop(None, None)
        places = np.array(sorted(counts), np.int64)
        weights = (1 + np.log(np.array([counts[p] for p in places.tolist()], float))) * self.idf[places]
        length = math.sqrt(float(weights @ weights))
        return (places, (weights / length).astype(np.float32)) if length else (places[:0], np.zeros(0, np.float32))

    def build(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.largest = np.zeros((len(self.terms), -(-len(vectors) // BLOCK)), np.float32)
        for b in range(self.largest.shape[1]):
            own = vectors[b * BLOCK : (b + 1) * BLOCK]
            used = np.unique(np.concatenate([v[0] for v in own]))
            postings = np.zeros((len(used), len(own)), np.float32)
            for i, (places, weights) in enumerate(own):
                postings[np.searchsorted(used, places), i] = weights
            self.blocks.append((used, postings))
            self.largest[used, b] = postings.max(1)

    def nearest(self, places: np.ndarray, weights: np.ndarray, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and cosines of the ``k`` nearest examples with a positive cosine, nearest
        first and by number among equals."""
        if not len(places) or not self.blocks:
            return np.zeros(0, np.int64), np.zeros(0, np.float32)
        bounds = weights @ self.largest[places]
        query = np.zeros(len(self.terms), np.float32)
        query[places] = weights
        found, cosines = np.zeros(0, np.int64), np.zeros(0, np.float32)
        for b in np.argsort(-bounds, kind="stable").tolist():
            least = cosines[-1] if len(cosines) == k else 0
            if bounds[b] <= 0 or bounds[b] < least - 1e-5:
                break
            used, postings = self.blocks[b]
            scores = query[used] @ postings
            near = np.flatnonzero((scores > 0) & (scores >= least - 1e-5))
            if len(near):
                found, cosines = np.concatenate((found, near + b * BLOCK)), np.concatenate((cosines, scores[near]))
                # Rounded, so that the order of additions decides no tie.
                order = np.lexsort((found, -np.round(cosines, 5)))[:k]
                found, cosines = found[order], cosines[order]
        return found, cosines

    def score(self, text: str) -> tuple[float, np.ndarray, np.ndarray]:
        """Smoothed share of toxic votes, each weighted by its squared cosine, and the evidence."""
        found, cosines = self.nearest(*self.vector(text))
        votes = cosines.astype(float) ** 2
        score = (float(votes @ self.labels[found]) + PRIOR_VOTES * self.prior) / (float(votes.sum()) + PRIOR_VOTES)
        return score, found, cosines


def select_terms(counts: dict[bytes, list[int]], n0: int, n1: int) -> list[bytes]:
    """Terms by the difference of their shares between the classes in standard errors."""
    scored = []
    for term, (c0, c1) in counts.items():
        if c0 + c1 < LEAST_DOCS:
            continue
        share = (c0 + c1) / (n0 + n1)
        error = math.sqrt(max(share * (1 - share), 1e-12) * (1 / n0 + 1 / n1))
        z = abs(c1 / n1 - c0 / n0) / error
        if z >= Z_SCORE:
            scored.append((-z, term))
    return [term for _, term in sorted(scored)[:TERMS]]


def _term_counts(examples: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies = Counter(), Counter()
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist()):
                tallies[y].update(set(terms_of(text.as_py())))
            if sum(map(len, tallies)) > 400_000:
                yield from out(tallies)
        yield from out(tallies)

    def out(tallies: tuple[Counter, Counter]) -> Iterator[pa.RecordBatch]:
        for y, tally in enumerate(tallies):
            if tally:
                yield pa.RecordBatch.from_pydict(
                    {"term": pa.array(tally.keys(), pa.binary()), "y": pa.array([y] * len(tally), pa.int32()), "n": pa.array(tally.values(), pa.int64())}
                )
            tally.clear()

    counted = examples.select("text", "y").mapInArrow(run, "term binary, y int, n long")
    sums = counted.groupBy("term").agg(
        F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("n0"), F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("n1")
    )
    return sums.filter(F.col("n0") + F.col("n1") >= LEAST_DOCS)


def _document_frequencies(texts: DataFrame, terms: list[bytes]) -> tuple[np.ndarray, int]:
    """In how many of all documents each term occurs, and how many documents there are."""
    number = {t: i for i, t in enumerate(terms)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rows = np.zeros(len(number) + 1, np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for text in batch.column(0):
                found[[number[t] for t in number.keys() & set(terms_of(text.as_py()))]] += 1
        found[-1] = rows
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_pydict({"i": pa.array(at, pa.int64()), "n": pa.array(found[at], pa.int64())})

    rows = texts.select("text").mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(len(terms) + 1, np.int64)
    for row in rows:
        counts[row["i"]] = row["n"]
    return counts[:-1], int(counts[-1])


def learn_index(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Index:
    """Index over a bounded sample of the labelled rows; the driver holds that sample alone."""
    texts = keyed_text(docs, id_col, text_col)
    given = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter("y in (0, 1) and doc_id is not null")
    chosen = stored(first_by_hash(given, F.xxhash64("doc_id"), EXAMPLES, given.count(), "doc_id", "y"), "toxic-sample")
    examples = stored(texts.join(F.broadcast(chosen), "doc_id"), "toxic-examples")
    sizes = {r["y"]: r["count"] for r in examples.groupBy("y").count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    prior = n1 / (n0 + n1) if n0 + n1 else 0.0
    if not n0 or not n1:
        return Index({}, np.zeros(0), prior, np.zeros(0), np.zeros(0, np.int64))
    # Only terms that may pass the test come to the driver: the same bound on the difference.
    share = (F.col("n0") + F.col("n1")) / (n0 + n1)
    error = F.sqrt(F.greatest(share * (1 - share), F.lit(1e-12)) * (1 / n0 + 1 / n1))
    z = F.abs(F.col("n1") / n1 - F.col("n0") / n0) / error
    best = _term_counts(examples).withColumn("z", z).filter(F.col("z") >= Z_SCORE).orderBy(F.desc("z"), "term").limit(TERMS).collect()
    terms = select_terms({bytes(r["term"]): [r["n0"], r["n1"]] for r in best}, n0, n1)
    frequencies, total = _document_frequencies(texts, terms)
    idf = np.log((1 + total) / (1 + frequencies)) + 1
    index = Index({t: i for i, t in enumerate(terms)}, idf, prior, np.zeros(0), np.zeros(0, np.int64))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [index.vector(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_pydict(
                {
                    "y": batch.column(1), "doc_id": batch.column(2), "places": pa.array([p.tolist() for p, _ in made], pa.list_(pa.int64())),
                    "weights": pa.array([w.tolist() for _, w in made], pa.list_(pa.float32())),
                }
            )

    rows = examples.select("text", "y", "doc_id").mapInArrow(vectors, "y int, doc_id long, places array<long>, weights array<float>").filter("size(places) > 0").collect()
    # Alike examples share blocks; the order comes from the vectors, never from ids.
    rows.sort(key=lambda r: (max(zip(r["weights"], r["places"]))[1], r["places"], r["weights"], r["y"]))
    index.labels, index.ids = np.array([r["y"] for r in rows], float), np.array([r["doc_id"] for r in rows], np.int64)
    index.build([(np.array(r["places"], np.int64), np.array(r["weights"], np.float32)) for r in rows])
    return index


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, learn_from: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    key_col: str | None = None,
) -> DataFrame:
    """``doc_id, score, predicted, evidence, cosines`` for every row of ``docs``.

    ``doc_id`` is ``key_col`` where one is given.  ``learn_from`` selects rows of ``labels``.  ``evidence`` lists the nearest examples' ids.
    A text without any chosen term, as an empty or NULL one, has no evidence and the
    examples' toxic share as its score.  Repeated ids each get a score; without labels of both
    classes every text scores that share, 0 if there are none.
    """
    index = learn_index(docs, labels.filter(learn_from) if learn_from is not None else labels, id_col, text_col, label_col)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in slices(batches, "text", 4 << 20):
            made = [index.score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0), "score": pa.array([s for s, _, _ in made], pa.float64()),
                    "evidence": pa.array([index.ids[f].tolist() for _, f, _ in made], pa.list_(pa.int64())),
                    "cosines": pa.array([c.tolist() for _, _, c in made], pa.list_(pa.float32())),
                }
            )

    scored = keyed_text(docs, key_col or id_col, text_col).mapInArrow(run, "doc_id long, score double, evidence array<long>, cosines array<float>")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that no toxicity label is learned from; a NULL id is not in it."""
    return F.coalesce(fold(id_col, 5) == 0, F.lit(False))
