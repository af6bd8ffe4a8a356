"""Many phrases looked for in many texts, by an index of their rarest grams.

A contained phrase shows all its grams (runs of words or of characters) in the text.  Every gram of
every phrase is counted over the texts; each phrase is then looked for by the one that fewest texts
have.  Only ids and hashes of grams are exploded and shuffled: a text is folded once, written, and
read once more for all its candidates together, where they are verified.  A gram that very many
texts have, because a phrase has no rarer one, is split over several keys.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.functions.text import let
from concordat.session import written

#: Texts that share one key of a gram; a more frequent gram has several keys.
KEY_TEXTS = 100_000
#: Candidates that one copy of a text is verified against.
TEXT_PHRASES = 1_000


@dataclass(frozen=True)
class Grams:
    """How a class of phrases is cut into grams: which phrases it is for (of ``phrase``), the grams of
    a text and those of a phrase, both as arrays of hashes.  All grams of a phrase of the class must
    be among the text's where it is contained."""

    wanted: Column
    of_text: Callable[[Column], Column]
    of_phrase: Callable[[Column], Column]


def runs(items: Column, n: int, kind: str) -> Column:
    """Hashes of all runs of ``n`` strings of an array; no array if it is shorter."""

    def hashed(items):
        starts = F.sequence(F.lit(1), F.size(items) - n + 1)
        return F.when(F.size(items) >= n, F.transform(starts, lambda i: F.xxhash64(F.lit(kind), F.array_join(F.slice(items, i, n), " "))))

    return let(hashed, items=items)


def pieces(text: Column, n: int, kind: str) -> Column:
    """Hashes of all runs of ``n`` characters."""

    def hashed(text):
        starts = F.sequence(F.lit(1), F.length(text) - n + 1)
        return F.when(F.length(text) >= n, F.transform(starts, lambda i: F.xxhash64(F.lit(kind), F.substring(text, i, F.lit(n)))))

    return let(hashed, text=text)


def find_phrases(
    texts: DataFrame, phrases: DataFrame, classes: Sequence[Grams], verify: Callable[[Column, Column], Column]
) -> DataFrame:
    """``(text_id, phrase_id)`` for every phrase that a text holds.

    ``texts`` is ``(text_id, text)``, both folded, with an id to each text; ``phrases`` is ``(phrase_id,
    phrase)`` and what else ``verify(text, row of phrases)`` needs.  A phrase belongs to the first class
    that wants it; one of no class is not found.
    """
    spark = texts.sparkSession
    texts = written(texts.select("text_id", "text").filter(F.col("text") != ""), "phrase-texts")
    number = F.lit(None).cast("int")
    for i in reversed(range(len(classes))):
        number = F.when(classes[i].wanted, F.lit(i)).otherwise(number)
    phrases = written(phrases.withColumn("_class", number).filter("_class is not null"), "phrases")
    used = [r[0] for r in phrases.select("_class").distinct().collect()]  # at most one row per class
    if not used:
        return spark.createDataFrame([], f"text_id {texts.schema['text_id'].dataType.simpleString()}, phrase_id {phrases.schema['phrase_id'].dataType.simpleString()}")

    none = F.array().cast("array<bigint>")
    own = F.array().cast("array<bigint>")
    for i in used:
        own = F.when(F.col("_class") == i, F.coalesce(classes[i].of_phrase(F.col("phrase")), none)).otherwise(own)
    grams = written(phrases.select("phrase_id", F.explode(F.array_distinct(own)).alias("gram")), "phrase-grams")
    all_of = F.array_distinct(F.concat(*[F.coalesce(classes[i].of_text(F.col("text")), none) for i in used]))
    met = texts.select("text_id", F.explode(all_of).alias("gram")).join(grams.select("gram").distinct(), "gram", "left_semi")
    met = written(met, "phrase-met")

    # A phrase with a gram that no text has is in none.
    counts = met.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = grams.join(counts, "gram", "left").groupBy("phrase_id").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("best")
    )
    keys = F.ceil(F.col("best.n") / KEY_TEXTS).cast("int")
    rarest = written(rarest.filter("best.n > 0").select("phrase_id", F.col("best.gram").alias("gram"), keys.alias("keys")), "phrase-rarest")
    asked = rarest.groupBy("gram").agg(F.first("keys").alias("keys"))
    keyed = met.join(asked, "gram").select("text_id", "gram", F.pmod(F.xxhash64("text_id"), F.col("keys")).cast("int").alias("key"))
    wanted = rarest.select("phrase_id", "gram", F.explode(F.sequence(F.lit(0), F.col("keys") - 1)).alias("key"))
    pairs = written(keyed.join(wanted, ["gram", "key"]).select("text_id", "phrase_id"), "phrase-pairs")

    # All candidates of a text meet it together; where they are very many, in several groups.
    many = pairs.groupBy("text_id").agg(F.ceil(F.count(F.lit(1)) / TEXT_PHRASES).alias("groups"))
    listed = pairs.join(many, "text_id").join(phrases.drop("_class"), "phrase_id")
    rows = F.struct(*[c for c in phrases.columns if c != "_class"])
    listed = listed.groupBy("text_id", F.pmod(F.xxhash64("phrase_id"), F.col("groups")).alias("group")).agg(F.collect_list(rows).alias("rows"))
    held = let(lambda text, rows: F.filter(rows, lambda p: verify(text, p)), text=F.col("text"), rows=F.col("rows"))
    return listed.join(texts, "text_id").select("text_id", F.explode(held).alias("found")).select("text_id", "found.phrase_id")
