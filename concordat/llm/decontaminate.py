"""Benchmark passages in documents: latent semantic search, then word-order and answer checks.

Passages are runs of words; their TF-IDF vectors over the benchmark's words are projected on
the singular vectors of a block of items.  A block has as many vectors as its items need to be
held whole, so a product with an item is the same there as over all words.  An item is a
candidate where that product is as large as the words in order that ``check`` asks for make it
at least, so no passage that would pass is left out.  A candidate counts if the longest common
subsequence of words says so, or if it says nearly so and the item's answer stands in the
passage.  The benchmark is the query set: every passage of every document meets every block.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.llm.common import ROW, keyed_text, numbered_rows, slices, stored, without_rows

#: Items that the driver holds at a time.
READ_ITEMS = 20_000
#: Items of a block, which have a space of their own.
ITEMS = 256
#: Blocks that one pass over the documents looks for.
PASS_BLOCKS = 8
#: Singular values below this share of the largest are rounding, not directions of the items.
NULL_VALUE = 1e-7
#: Words of a block; passages start at every block and have as many blocks as items need.
BLOCK = 8
#: What single precision may take off a product: a share of the bound, and a length.
ROUNDING = 0.02
ROUNDING_LENGTH = 0.005
#: Blocks whose passages are compared at once.
PART = 1024
#: Share of an item's words that must stand in the passage in order.
LCS_SURE = 0.8
#: The same where the item's answer, its last sentence, stands in the passage unbroken.
LCS_WITH_ANSWER = 0.6
#: Marks taken out of words before they are compared.
MARKS = b".,;:!?\"'()[]#*$%&|<>"
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().translate(None, MARKS).split()


def lcs(item: dict[bytes, int], length: int, passage: list[bytes]) -> int:
    """Length of the longest common subsequence, by one bit per word of the item."""
    full = (1 << length) - 1
    open_ = full
    for word in passage:
        here = open_ & item.get(word, 0)
        if here:
            open_ = ((open_ + here) | (open_ - here)) & full
    return length - open_.bit_count()


def _masks(words: list[bytes]) -> dict[bytes, int]:
    out: dict[bytes, int] = {}
    for i, word in enumerate(words):
        out[word] = out.get(word, 0) | 1 << i
    return out


def _holds(passage: list[bytes], run: list[bytes]) -> bool:
    return bool(run) and any(passage[i : i + len(run)] == run for i in range(len(passage) - len(run) + 1))


def stride(blocks: int) -> int:
    """Blocks from the start of one passage to the next."""
    return max(1, blocks // 4)


@dataclass
class Item:
    item_id: int
    words: list[bytes]
    answer: list[bytes]
    masks: dict[bytes, int]
    #: Blocks of the passages that it is compared with.
    blocks: int


def as_item(item_id: int, text: str | None) -> Item | None:
    """None for a text without a word, which nothing can repeat."""
    words = words_of(text or "")
    if not words:
        return None
    sentences = [w for w in map(words_of, _SENTENCE.split(text or "")) if w]
    # Sizes grow by halves, so that few serve all items; wherever an item starts, some passage holds
    # its words and a block more.
    blocks = 2
    while blocks * BLOCK < len(words) + BLOCK * (stride(blocks) + 1):
        blocks = math.ceil(blocks * 1.5)
    return Item(item_id, words, sentences[-1], _masks(words), blocks)


def least_product(item: Item, weights: dict[bytes, float]) -> float:
    """The smallest product of the item's TF-IDF vector with that of a passage that ``check``
    accepts: of the words that have to be there, the lightest are taken."""
    counts, answer = Counter(item.words), Counter(item.words) & Counter(item.answer)
    weigh = {w: n * weights[w] ** 2 for w, n in counts.items()}

    def lightest(words: Counter[bytes], n: int) -> float:
        return sum(sorted(weigh[w] for w in words.elements())[: max(0, n)])

    sure, some = (math.ceil(share * len(item.words) - 1e-9) for share in (LCS_SURE, LCS_WITH_ANSWER))
    with_answer = lightest(answer, answer.total()) + lightest(counts - answer, some - answer.total())
    return min(lightest(counts, sure), with_answer)


@dataclass
class Space:
    """The projection for a block of items: weighted singular vectors, items by passage size."""

    #: The row of each term of the benchmark; terms of other blocks share a row of zeros.
    rows: np.ndarray
    vectors: np.ndarray
    #: Blocks of the passages, and the unit vectors, least products and items compared with them.
    sizes: list[tuple[int, np.ndarray, np.ndarray, list[Item]]]

    def candidates(self, places: np.ndarray, counts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int, Item, float]]:
        """``(document, first word, last word, item, cosine)`` of passages that may repeat an item.

        Block vectors are summed once; a passage is the difference of two running sums, and
        the first starts where the document does, the others a ``stride`` further each.
        """
        # Running sums start anew in every part, so that single precision is enough.
        for lo in range(0, len(places), PART):
            part = self.rows[places[lo : lo + PART + self.sizes[-1][0]]]
            blocks = self.vectors[part[:, 0]]
            for i in range(1, BLOCK):
                blocks += self.vectors[part[:, i]]
            yield from self._near(blocks, lo, min(PART, len(places) - lo), counts, ends)

    def _near(self, blocks: np.ndarray, lo: int, n: int, counts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int, Item, float]]:
        sums = np.zeros((len(blocks) + 1, blocks.shape[1]), np.float32)
        np.cumsum(blocks, axis=0, out=sums[1:])
        owners = np.searchsorted(ends, np.arange(lo, lo + n), side="right")
        place = np.arange(lo, lo + n) - (ends - counts)[owners]
        for size, items, least, own in self.sizes:
            starts = np.flatnonzero(place % stride(size) == 0)
            owner = owners[starts]
            stops = np.minimum(starts + size, ends[owner] - lo)
            windows = sums[stops] - sums[starts]
            lengths = np.sqrt(np.einsum("ij,ij->i", windows, windows))
            dots = windows @ items.T
            near, which = np.nonzero(dots >= least)
            for w, i in zip(near.tolist(), which.tolist()):
                doc = int(owner[w])
                base = int(ends[doc] - counts[doc]) - lo
                yield doc, (int(starts[w]) - base) * BLOCK, (int(stops[w]) - base) * BLOCK, own[i], float(dots[w, i] / lengths[w])


def numbered(docs: list[list[bytes]], terms: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Term numbers of the documents' words, a row per block; blocks of each, and their ends."""
    other = len(terms)
    counts = np.array([-(-len(d) // BLOCK) for d in docs], np.int64)
    ids = np.full(int(counts.sum()) * BLOCK, other, np.int32)
    ends = np.cumsum(counts)
    for words, end, n in zip(docs, ends.tolist(), counts.tolist()):
        at = (end - n) * BLOCK
        ids[at : at + len(words)] = [terms.get(w, other) for w in words]
    return ids.reshape(-1, BLOCK), counts, ends


def word_weights(texts: DataFrame, terms: dict[bytes, int]) -> np.ndarray:
    """Inverse document frequencies of the terms, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(len(terms) + 1, np.int64)
        known = terms.keys()
        for batch in batches:
            found[-1] += batch.num_rows
            for text in batch.column(0):
                found[[terms[t] for t in known & set(words_of(text.as_py()))]] += 1
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_pydict({"i": pa.array(at, pa.int64()), "n": pa.array(found[at], pa.int64())})

    counts = np.zeros(len(terms) + 1, np.int64)
    for row in texts.select("text").mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():
        counts[row["i"]] = row["n"]
    return np.log((1 + counts[-1]) / (1 + counts[:-1])) + 0.1


def latent_space(items: list[Item], terms: dict[bytes, int], weights: np.ndarray) -> Space:
    """The space of one block: all singular vectors of its items' unit TF-IDF rows."""
    own = sorted({terms[w] for i in items for w in i.words})
    rows = np.full(len(terms) + 1, len(own), np.int32)
    rows[own] = np.arange(len(own))
    dense = np.zeros((len(items), len(own)))
    for i, item in enumerate(items):
        np.add.at(dense[i], rows[[terms[w] for w in item.words]], 1)
    dense *= weights[own]
    norms = np.linalg.norm(dense, axis=1)
    dense /= norms[:, None]
    _, values, base = np.linalg.svd(dense, full_matrices=False)
    base = base[values > NULL_VALUE * values[0]].T
    vectors = np.zeros((len(own) + 1, base.shape[1]), np.float32)
    vectors[:-1] = weights[own][:, None] * base
    unit = (dense @ base).astype(np.float32)
    weigh = {w: float(weights[terms[w]]) for i in items for w in i.words}
    least = np.array([least_product(i, weigh) for i in items]) / norms
    least = (least * (1 - ROUNDING) - ROUNDING_LENGTH).astype(np.float32)
    sizes = []
    for size in sorted({i.blocks for i in items}):
        at = [k for k, i in enumerate(items) if i.blocks == size]
        sizes.append((size, unit[at], least[at], [items[k] for k in at]))
    return Space(rows, vectors, sizes)


LEAK_SCHEMA = "doc_id long, item_id long, cosine double, lcs double, answer_found boolean, first_word long, last_word long"


def check(passage: list[bytes], item: Item) -> tuple[float, bool, bool]:
    """Share of the item's words in order, whether its answer is there, and the verdict."""
    share = lcs(item.masks, len(item.words), passage) / len(item.words)
    answer = share >= LCS_WITH_ANSWER and _holds(passage, item.answer)
    return share, answer, share >= LCS_SURE or answer


def _leaks_of(texts: DataFrame, terms: dict[bytes, int], spaces: list[Space]) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast((terms, spaces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, spaces = shared.value
        for batch in slices(batches, "text", 1 << 20):
            docs = [words_of(t.as_py()) for t in batch.column(1)]
            places = numbered(docs, terms)
            best: dict[tuple[int, int], tuple] = {}
            for doc, first, last, item, cosine in chain.from_iterable(s.candidates(*places) for s in spaces):
                reach = stride(item.blocks) * BLOCK
                first, last = max(0, first - reach), min(last + reach, len(docs[doc]))
                share, answer, leaked = check(docs[doc][first:last], item)
                key = doc, id(item)
                if leaked and (key not in best or share > best[key][3]):
                    best[key] = doc, item.item_id, cosine, share, answer, first, last
            doc_ids = batch.column(0).to_pylist()
            rows = [(doc_ids[r[0]], *r[1:]) for r in best.values()]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.int64(), pa.int64())
                names = [c.split()[0] for c in LEAK_SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return texts.mapInArrow(run, LEAK_SCHEMA)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document row and benchmark item that it repeats, with the evidence.

    Words compare in lower case (A-Z) and without ``MARKS``.  NULL and empty texts hold
    nothing; items without a word match nothing; rows that repeat an id are told apart only
    by their rows, items of equal text each match.  Without items the result is empty.
    """
    texts = keyed_text(docs, id_col, text_col)
    asked = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    parts = max(1, math.ceil(asked.count() / READ_ITEMS))
    out = docs.sparkSession.createDataFrame([], LEAK_SCHEMA)
    for part in range(parts):
        rows = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()
        items = [i for i in (as_item(r["item_id"], r["text"]) for r in rows) if i]
        # Items of like size share a block, so that a block has few sizes of passages.
        items.sort(key=lambda i: (i.blocks, str(i.item_id), i.words))
        terms: dict[bytes, int] = {}
        for item in items:
            for word in item.words:
                terms.setdefault(word, len(terms))
        weights = word_weights(texts, terms) if items else np.zeros(0)
        for lo in range(0, len(items), ITEMS * PASS_BLOCKS):
            own = items[lo : lo + ITEMS * PASS_BLOCKS]
            spaces = [latent_space(own[at : at + ITEMS], terms, weights) for at in range(0, len(own), ITEMS)]
            out = out.unionByName(_leaks_of(texts, terms, spaces))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows without a leak, with all their columns, whatever their id."""
    docs = numbered_rows(docs, "leak-docs")
    return without_rows(docs, stored(leaks(docs, benchmark, ROW, text_col).select("doc_id").distinct(), "leaks"))
