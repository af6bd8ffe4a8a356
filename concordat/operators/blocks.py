"""Texts of a key that are too long for one task, as overlapping blocks.

A submission's readings, folded and joined by blanks, are one long text.  Here it is held as blocks
of ``BLOCK_READINGS`` readings, each with the offset at which it starts and with the ``reach``
characters that follow it.  What is found in the blocks merges by minimum, which is associative, so
partial results meet in any order and no task ever holds a key's whole text, whatever share of all
readings the key has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from concordat.functions.text import let, normalize_text
from concordat.session import written
from concordat.sources.files import spread_rank

#: Readings of a block.
BLOCK_READINGS = 1_000


def folded_reading(text: Column | str) -> Column:
    """The comparison form of a reading, with the marks at its end, which other text may follow."""
    c = F.col(text) if isinstance(text, str) else text
    # With a word behind them, its marks are not at the end of the text.
    return let(lambda folded: F.left(folded, F.length(folded) - 2), folded=normalize_text(F.concat(c, F.lit(" x"))))


def text_blocks(
    ocr: DataFrame, reach: int, key: str = "submission_id", order: str = "id", ties: Sequence[str] = (), text: str = "extracted_text",
) -> DataFrame:
    """``(key, block, start, text, ahead)``: the joined comparison form of each key's readings.

    Readings come in the order of ``order``, a whole-number column, and of ``ties``; blank ones should
    be left out before.  ``start`` counts the characters before the block, ``ahead`` holds the
    ``reach`` characters after it, with the blank between them.  A block has ``BLOCK_READINGS``
    readings of a character and a blank at least, or is the key's last one, so ``reach`` must not
    exceed twice that number.
    """
    if reach > 2 * BLOCK_READINGS:
        raise ValueError(f"reach {reach} is more than a block of {BLOCK_READINGS} readings is sure to hold")
    rows = ocr.select(F.col(key).alias("key"), F.col(order).alias("order"), *[F.col(c).alias(f"tie_{i}") for i, c in enumerate(ties)], folded_reading(text).alias("part"))
    ranked = spread_rank(rows, "key", "order", "rank", [f"tie_{i}" for i in range(len(ties))])
    ranked = ranked.withColumn("block", F.floor((F.col("rank") - 1) / BLOCK_READINGS))
    blocks = ranked.groupBy("key", "block").agg(F.expr("listagg(part, ' ') within group (order by rank)").alias("text"))
    blocks = written(blocks, "text-blocks")
    # Only lengths and heads of blocks meet per key, a thousandth of its readings.
    heads = blocks.select("key", "block", F.length("text").alias("n"), F.left("text", F.lit(reach)).alias("head"))
    w = W.partitionBy("key").orderBy("block")
    before = F.sum(F.col("n") + 1).over(w.rowsBetween(W.unboundedPreceding, -1))
    heads = heads.select("key", "block", F.coalesce(before, F.lit(0)).alias("start"), F.concat(F.lit(" "), F.lead("head").over(w)).alias("ahead"))
    return blocks.join(heads, ["key", "block"]).select("key", "block", "start", "text", F.coalesce("ahead", F.lit("")).alias("ahead"))


def positions(blocks: DataFrame, needles: DataFrame, key: str = "key", needle: str = "needle") -> DataFrame:
    """``(*needles, first)``: where each needle first occurs in the key's joined text, from 1; NULL
    where it does not or is empty.

    ``needles`` holds comparison forms; none may be longer than the blocks reach.
    """
    rows = needles.select(F.col(key).alias("key"), F.col(needle).alias("needle")).filter("needle <> ''").distinct()
    # An occurrence belongs to the block in which it starts, and ends in what lies ahead at the latest.
    at = F.position(F.col("needle"), F.concat(F.col("text"), F.left(F.col("ahead"), F.length("needle"))))
    found = blocks.join(rows, "key").select("key", "needle", (F.col("start") + F.nullif(at, F.lit(0))).alias("at"))
    merged = found.filter("at is not null").groupBy("key", "needle").agg(F.min("at").alias("first"))
    return needles.join(merged.withColumnsRenamed({"key": key, "needle": needle}), [key, needle], "left")
