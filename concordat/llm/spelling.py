"""Spelling variants: words one edit apart, found by walking a trie that is a table of edges.

The vocabulary's prefixes are the nodes of a trie, kept as rows ``(side, node, depth, tails, n)``:
the letters that lead on, and the count of the word that ends there.  A frontier of states
``(word, position, node, edits)`` is joined with the nodes of one depth after the other; a state
moves on along its own letter, along another one, or past its own letter, the last two only once.
A state at the end of its word with one edit on a node where a word ends is a pair of neighbours.

An edit lies in the second half of a word or in the first.  So there are two tries, of the words and
of the words read backwards, and a word starts half way down each: the crowded nodes near the root
are never branched at.  A replaced letter is looked for from the word with the smaller letter only, a
missing one from the longer word only; pairs count both ways.

Words of more than ``LONG`` letters would make the walk as deep as they are long.  They meet by hashes
of what is left without each of their letters, and each such pair is then confirmed on the words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.llm.common import stored
from concordat.session import work_dir

# Letters of a word (A-Z in lower case), the least length and the least number of occurrences.
LETTERS = "[a-z\\u00C0-\\u00FF]"
LEAST_LENGTH = 7
LEAST_COUNT = 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: How many times as frequent a neighbour must be to be a word's form.
RATIO = 10
#: Letters up to which words are walked through the tries.
LONG = 48

#: Odd base of the hashes of long words, modulo 2^64, and its inverse.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def runs(text: Column) -> Column:
    """Maximal runs of letters of at least ``LEAST_LENGTH``, A-Z in lower case."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(f"{LETTERS}{{{LEAST_LENGTH},}}"), F.lit(0))


def with_letters_lost(key: Column, run: Column, one_in: int) -> Column:
    """``run`` without one letter where ``one_in`` divides the crc32 of ``key:run``; the crc32 also
    tells which letter.  A NULL key counts as empty."""
    h = F.crc32(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("")), run))
    at = (h % F.length(run)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def corpus_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", one_in: int | None = None) -> DataFrame:
    """``word, n``: words of whole texts with their occurrences, ``LEAST_COUNT`` at least.

    A NULL text has none.  With ``one_in``, occurrences lose letters as ``with_letters_lost`` says.
    Counts are combined before they are shuffled, so a frequent word is no hot key.
    """
    rows = docs.select(F.col(id_col).alias("key"), F.explode(runs(F.col(text_col).cast("string"))).alias("run"))
    word = F.col("run") if one_in is None else with_letters_lost(F.col("key"), F.col("run"), one_in)
    counts = rows.select(word.alias("word")).filter(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") >= LEAST_COUNT)


def _both_ways(words: DataFrame) -> DataFrame:
    """``side, own, n, size``: every word as it is (0) and read backwards (1)."""
    ways = F.array(F.struct(F.lit(0).alias("side"), F.col("word").alias("own")), F.struct(F.lit(1).alias("side"), F.reverse("word").alias("own")))
    return words.select(F.explode(ways).alias("way"), "n").select("way.side", "way.own", "n", F.length("way.own").alias("size"))


def trie_nodes(words: DataFrame) -> DataFrame:
    """``side, node, depth, tails, n`` of both tries, from the depth on at which a word one letter
    shorter starts.  ``tails`` are the next two letters of the words that go on from a node, one
    letter where a word ends with it; ``n`` is NULL where no word ends.  A node has no more tails
    than the alphabet has pairs of letters, so none grows with the vocabulary."""
    depth = F.explode(F.sequence(F.floor((F.col("size") - 1) / 2).cast("int"), F.col("size")))
    steps = _both_ways(words).select("side", "own", "n", "size", depth.alias("depth"))
    steps = steps.select(
        "side", F.substring("own", F.lit(1), F.col("depth")).alias("node"), "depth",
        F.when(F.col("depth") < F.col("size"), F.substring("own", F.col("depth") + 1, F.lit(2))).alias("tail"),
        F.when(F.col("depth") == F.col("size"), F.col("n")).alias("n"),
    )
    return steps.groupBy("side", "node", "depth").agg(F.collect_set("tail").alias("tails"), F.max("n").alias("n"))


def _moves() -> Column:
    """Where a state leads from its node: an array of ``(node, at, edits, found, found_n)``, ``found``
    where a neighbour ends.  ``at`` counts the word's letters that are used up.  With an edit made
    a state moves only where the letter after next is at hand too, so that few dead ends are kept."""
    own, at, node, tails = F.col("own"), F.col("at"), F.col("node"), F.col("tails")
    size = F.length(own)
    letters = lambda i, n: F.substring(own, i + 1, F.lit(n))
    step = lambda to, at, edits, found, n: F.struct(to.alias("node"), at.alias("at"), F.lit(edits).alias("edits"), found.alias("found"), n.alias("found_n"))
    no, no_n = F.lit(False), F.lit(None).cast("long")
    nowhere = F.array().cast("array<struct<node:string,at:int,edits:int,found:boolean,found_n:bigint>>")

    def along(i: Column) -> Column:
        """With one edit, on by letter ``i`` of the word."""
        return F.when((i < size) & F.array_contains(tails, letters(i, 2)), F.array(step(F.concat(node, letters(i, 1)), i + 1, 1, no, no_n))).otherwise(nowhere)

    def ending(where: Column) -> Column:
        return F.when(where & F.col("ends").isNotNull(), F.array(step(node, size, 1, F.lit(True), F.col("ends")))).otherwise(nowhere)

    same = F.array(step(F.concat(node, letters(at, 1)), at + 1, 0, no, no_n))
    rest = letters(at + 1, 1)
    other = F.filter(tails, lambda t: (F.substring(t, 2, 1) == rest) & (F.substring(t, 1, 1) > letters(at, 1)))
    replaced = F.transform(other, lambda t: step(F.concat(node, F.substring(t, 1, 1)), at + 1, 1, no, no_n))
    # Of equal letters in a row the last one is left out; with it, the state takes its next letter.
    skips = (at + 1 == size) | (letters(at, 1) != rest)
    skipped = F.when(skips, F.concat(along(at + 1), ending(at + 1 == size))).otherwise(nowhere)
    clean = F.when(at < size, F.concat(F.when(at + 1 < size, same).otherwise(nowhere), replaced, skipped)).otherwise(nowhere)
    return F.when(F.col("edits") == 0, clean).otherwise(F.concat(along(at), ending(at == size)))


def walked_pairs(words: DataFrame) -> DataFrame:
    """``a, a_n, b, b_n``: pairs of ``words`` one edit apart, each once or more and one way only.

    One level of the tries is a join of the frontier with that level's nodes and one written
    table; a level reads what the level above wrote and no more.  A crowded node is one row on its
    side of the join, so its states may be dealt to several tasks.
    """
    spark = words.sparkSession
    place = work_dir(spark, "trie")
    trie_nodes(words).write.partitionBy("depth").parquet(place)
    nodes = spark.read.schema("side int, node string, tails array<string>, n long, depth int").parquet(place)
    least, most = words.agg(F.min(F.length("word")), F.max(F.length("word"))).first()
    states = "side int, own string, own_n long, at int, node string, edits int, found boolean, found_n long"
    half = F.floor(F.col("size") / 2).cast("int")
    starts = _both_ways(words).withColumn("at", F.when(F.col("side") == 0, half).otherwise(F.col("size") - half))
    starts = starts.select(
        "side", "own", F.col("n").alias("own_n"), "at", F.substring("own", F.lit(1), F.col("at")).alias("node"), F.lit(0).alias("edits"),
        F.lit(False).alias("found"), F.lit(None).cast("long").alias("found_n"),
    )
    levels, frontier = [], None
    for depth in range(least // 2 if least else 0, (most or -1) + 1):
        here = starts.filter(F.col("at") == depth)
        here = here if frontier is None else here.unionByName(frontier)
        level = nodes.filter(F.col("depth") == depth).select("side", "node", "tails", F.col("n").alias("ends"))
        moves = here.join(level, ["side", "node"]).select("side", "own", "own_n", F.explode(_moves()).alias("to"))
        levels.append(work_dir(spark, "trie-level"))
        moves.select("side", "own", "own_n", "to.at", "to.node", "to.edits", "to.found", "to.found_n").write.parquet(levels[-1])
        frontier = spark.read.schema(states).parquet(levels[-1]).filter("not found")
    if not levels:
        return spark.createDataFrame([], "a string, a_n long, b string, b_n long")
    whole = lambda c: F.when(F.col("side") == 0, F.col(c)).otherwise(F.reverse(c))
    found = spark.read.schema(states).parquet(*levels).filter("found")
    return found.select(whole("own").alias("a"), F.col("own_n").alias("a_n"), whole("node").alias("b"), F.col("found_n").alias("b_n"))


def _shortened(word: str) -> tuple[np.ndarray, int]:
    """Hashes of ``word`` without each of its letters in turn, and of the whole word, modulo 2^64."""
    points = np.frombuffer(word.encode("utf-32-le"), "<u4").astype(np.uint64)
    powers = np.full(len(points), _BASE, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((points + np.uint64(1)) * powers, dtype=np.uint64)))
    # What follows the letter moves one place forward, which divides it by the base.
    return (sums[:-1] + (sums[-1] - sums[1:]) * np.uint64(_INVERSE)).view(np.int64), int(sums[-1:].view(np.int64)[0])


def long_pairs(words: DataFrame) -> DataFrame:
    """``a, a_n, b, b_n`` of pairs one edit apart of which one has more than ``LONG`` letters.

    Words that share a shortened form at one place differ in that letter alone, so no group of
    equal hashes has more words than the alphabet has letters; memory is a word's own length.
    """
    long = words.filter(F.length("word") >= LONG).select("word", "n", F.xxhash64("word").alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for word, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shortened, whole = _shortened(word)
                hashes = pa.array(np.append(shortened, whole), pa.int64())
                places = pa.array(np.append(np.arange(len(word)), -1), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hashes), key), pa.int64()), hashes, places], ["key", "hash", "place"])

    forms = stored(long.select("word", "key").mapInArrow(run, "key long, hash long, place int"), "long-forms")
    shorter, whole = forms.filter("place >= 0"), forms.filter("place < 0")
    other = shorter.select(F.col("key").alias("other"), "hash", "place")
    replaced = shorter.join(other, ["hash", "place"]).filter(F.col("key") < F.col("other")).select("key", "other")
    lost = shorter.select("key", "hash").join(whole.select(F.col("key").alias("other"), "hash"), "hash").select("key", "other")
    pairs = replaced.unionByName(lost).distinct()
    pairs = pairs.join(long.select("key", F.col("word").alias("a"), F.col("n").alias("a_n")), "key")
    pairs = pairs.join(long.select(F.col("key").alias("other"), F.col("word").alias("b"), F.col("n").alias("b_n")), "other")
    exceeds = F.greatest(F.length("a"), F.length("b")) > LONG
    return pairs.filter(exceeds & (F.levenshtein("a", "b", 1) == 1)).select("a", "a_n", "b", "b_n")


def neighbours(words: DataFrame) -> DataFrame:
    """``word, word_n, near, near_n``: every pair of ``words`` (``word, n``, each word once) that one
    inserted, deleted or replaced code point tells apart, both ways."""
    pairs = walked_pairs(words.filter(F.length("word") <= LONG)).unionByName(long_pairs(words))
    pairs = stored(pairs, "near-words")
    back = pairs.select(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n"))
    return pairs.unionByName(back).distinct().toDF("word", "word_n", "near", "near_n")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for every row of ``forms`` (``word, form``): the last word that forms lead to.

    Every round a word takes its target's target, so the rounds are the logarithm of the longest
    chain; chains are short, as each form is ``RATIO`` times as frequent as the word before it.
    """
    ways = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = ways.select(F.col("word").alias("root"), F.col("root").alias("last"))
        ways = stored(ways.join(further, "root", "left").select("word", F.coalesce("last", "root").alias("root"), F.col("last").isNotNull().alias("moved")), "roots")
        if not ways.filter("moved").limit(1).count():
            return ways.select("word", "root")
        ways = ways.select("word", "root")


def variant_groups(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every row of ``words`` (``word, n``, each word once).

    ``form`` is the near word of largest ``n`` (ties: the smallest in code-point order) if it is at
    least ``ratio`` times as frequent, else NULL; ``root`` is reached over forms, the word itself
    if it has none.  No words give no rows.
    """
    words = stored(words, "words")
    near = neighbours(words).groupBy("word", "word_n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("by"), "near")).alias("best"))
    near = near.withColumn("form", F.when(-F.col("best.by") >= ratio * F.col("word_n"), F.col("best.near")))
    near = stored(near.select("word", "n_near", "form", F.when(F.col("form").isNotNull(), -F.col("best.by")).alias("form_n")), "near-best")
    last = roots(near.filter(F.col("form").isNotNull()))
    out = words.join(near, "word", "left").join(last, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", one_in: int | None = None) -> DataFrame:
    """``variant_groups`` of the words of whole texts.

    NULL and empty texts have no words; rows that repeat count again; ids may be NULL or repeat;
    other columns are not looked at; no documents give no rows.
    """
    return variant_groups(corpus_words(docs, id_col, text_col, one_in))
