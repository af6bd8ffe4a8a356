"""From raw documents to token ids in five stages, each a job over all that the one before kept.

Every stage but the last returns the columns of ``documents``; its rows are written and read
again before the next one starts, so a lost executor costs at most one stage's tasks.  A stage
begins by dropping the folders of the one before, whose output has been written by then; folders
that its own input still reads are kept.

Every stage has a defined result for odd rows.  NULL and empty texts are not toxic, repeat nothing,
hold no leak and encode to no ids, so their rows stay, a NULL text as NULL.  Rows that repeat an id,
or have none, are decided one by one.  Rows of equal texts are copies: one stays.  Texts of any
length are taken whole.  Other columns are handed on untouched.  No documents give no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.llm.bpe import encode_decode
from concordat.llm.common import ROW, SCRATCH, numbered_rows, stored, table, without_rows
from concordat.llm.decontaminate import without_leaks
from concordat.llm.dedup import with_repeats_removed
from concordat.llm.jaccard import one_of_each
from concordat.llm.queries import tokenizer_file
from concordat.llm.toxicity import held_out, toxicity_scores

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def tidy(stage: Stage) -> Stage:
    """The stage, which first drops the folders of the one before it and records its own."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        SCRATCH.drop(spark, docs)
        with SCRATCH.recording():
            return stage(spark, docs, sf_dir)

    return run_stage


@tidy
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples reject go."""
    docs = numbered_rows(docs, "toxic-docs")
    scored = toxicity_scores(docs, table(spark, sf_dir, "labels"), ~held_out(), key_col=ROW)
    return without_rows(docs, stored(scored.filter("predicted = 1").select("doc_id"), "toxic"))


@tidy
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays, of the smallest id."""
    return one_of_each(docs)


@tidy
def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of long repeated strings go; every row stays, with what is left of its text."""
    rows = with_repeats_removed(docs)
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


@tidy
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat a benchmark item go."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


@tidy
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left."""
    return encode_decode(docs, tokenizer_file("word_bpe_49k.json"), keep=False)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_dedup", drop_repeated_passages),
    ("decontamination", drop_leaks),
    ("bpe", encode),
]

#: No stage but the last has a form in SQL; the tests hold each against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        with SCRATCH.recording():
            docs = stored(out, f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
