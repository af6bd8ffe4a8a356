"""Keyword catalogs: recognition and conflicts between exclusive groups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat import vocab
from concordat.functions.text import let, literal_regex, normalize_text
from concordat.operators.phrases import Grams, find_phrases, runs
from concordat.vocab import FAIL, PASS, REVIEW


def phrase_pattern(phrase: str) -> str:
    """Whole-word match of a phrase whose words may be hyphenated."""
    return "(?U)\\b" + "[\\s-]+".join(literal_regex(w) for w in phrase.split(" ")) + "\\b"


#: Keywords that one number of a mask tells of; a long has one bit more, its sign.
MASK_BITS = 63


def _words_of(bits: int, size: int) -> list[int]:
    """A set of keyword numbers as the ``size`` whole numbers of a mask."""
    return [bits >> (MASK_BITS * i) & ((1 << MASK_BITS) - 1) for i in range(size)]


def mask_size(catalog: Mapping[str, str]) -> int:
    return max(1, -(-len(catalog) // MASK_BITS))


def keyword_mask(normalized: Column, catalog: Mapping[str, str] = vocab.CLASS_KEYWORDS) -> Column:
    """The catalog keywords found, one bit each, as an array of longs; any catalog size will do.

    A plain substring test comes first, so the pattern runs on likely texts only.
    """
    def scan(text):
        words = [F.lit(0).cast("bigint")] * mask_size(catalog)
        for number, word in enumerate(catalog):
            at, bit = divmod(number, MASK_BITS)
            hit = F.contains(text, F.lit(word.split(" ")[0])) & text.rlike(phrase_pattern(word))
            words[at] = words[at].bitwiseOR(F.when(hit, F.lit(1 << bit)).otherwise(F.lit(0)).cast("bigint"))
        return F.array(*words)

    return let(scan, text=F.coalesce(normalized, F.lit("")))


def either(a: Column, b: Column) -> Column:
    """The keywords of either mask."""
    return F.zip_with(a, b, lambda x, y: x.bitwiseOR(y))


def merged_mask(mask: Column, catalog: Mapping[str, str] = vocab.CLASS_KEYWORDS) -> Column:
    """Aggregate: the keywords of all masks of a group.  Masks are combined before they are
    shuffled, so a group of any number of texts sends one per task."""
    return F.array(*[F.bit_or(F.get(mask, i)) for i in range(mask_size(catalog))])


def has_any(mask: Column, wanted: int) -> Column:
    found = F.lit(False)
    for i, bits in enumerate(_words_of(wanted, wanted.bit_length() // MASK_BITS + 1)):
        if bits:
            found = found | (F.get(mask, i).bitwiseAND(F.lit(bits).cast("bigint")) != 0)
    return found


def only(mask: Column, wanted: int) -> Column:
    """The keywords of a mask that are among ``wanted``."""
    kept = _words_of(wanted, wanted.bit_length() // MASK_BITS + 1)
    return F.transform(mask, lambda word, i: word.bitwiseAND(F.coalesce(F.get(F.array(*[F.lit(k).cast("bigint") for k in kept]), i), F.lit(0).cast("bigint"))))


def keywords_in(mask: Column, catalog: Mapping[str, str] = vocab.CLASS_KEYWORDS) -> Column:
    return F.array_compact(F.array(*[F.when(has_any(mask, 1 << number), F.lit(w)) for number, w in enumerate(catalog)]))


def groups_in(
    mask: Column,
    catalog: Mapping[str, str] = vocab.CLASS_KEYWORDS,
    skip: Sequence[str] = vocab.NON_EXCLUSIVE_GROUPS,
) -> Column:
    """The exclusive groups among the found keywords, sorted."""
    groups: dict[str, int] = {}
    for number, (_, group) in enumerate(catalog.items()):
        if group not in skip:
            groups[group] = groups.get(group, 0) | (1 << number)
    names = [F.when(has_any(mask, bits), F.lit(g)) for g, bits in sorted(groups.items())]
    return F.array_compact(F.array(*names))


def keyword_sets(
    texts: DataFrame, by: Sequence[str], text: str, catalog: Mapping[str, str] = vocab.CLASS_KEYWORDS
) -> DataFrame:
    """``(*by, mask)``: the keywords of all texts of a group; texts themselves are not shuffled."""
    marked = texts.select(*by, keyword_mask(normalize_text(text), catalog).alias("mask"))
    return marked.groupBy(*by).agg(merged_mask(F.col("mask"), catalog).alias("mask"))


def conflict(
    declared: Column, observed: Column,
    catalog: Mapping[str, str] = vocab.CLASS_KEYWORDS,
    skip: Sequence[str] = vocab.NON_EXCLUSIVE_GROUPS,
) -> Column:
    """``struct<conflict, groups, keywords>`` from a declared and an observed mask.

    A conflict needs a declared exclusive group and two groups in all.
    """
    exclusive = sum(1 << b for b, g in enumerate(catalog.values()) if g not in skip)

    def judge(declared, both, groups):
        is_conflict = (F.size(groups_in(declared, catalog, skip)) > 0) & (F.size(groups) >= 2)
        words = F.array_sort(keywords_in(only(both, exclusive), catalog))
        return F.struct(
            is_conflict.alias("conflict"),
            F.when(is_conflict, groups).alias("groups"),
            F.when(is_conflict, words).alias("keywords"),
        )

    return let(
        lambda d, both: let(judge, declared=d, both=both, groups=groups_in(both, catalog, skip)),
        d=declared, both=either(declared, observed),
    )


def conflict_groups(df: DataFrame, declared: str, observed: str, **kw) -> DataFrame:
    """Adds ``conflict, groups, keywords`` for rows with a declared and an observed text."""
    df = df.withColumn("_d", keyword_mask(normalize_text(declared), kw.get("catalog", vocab.CLASS_KEYWORDS)))
    df = df.withColumn("_o", keyword_mask(normalize_text(observed), kw.get("catalog", vocab.CLASS_KEYWORDS)))
    return df.withColumn("_c", conflict(F.col("_d"), F.col("_o"), **kw)).select(
        *[c for c in df.columns if c not in ("_d", "_o")], "_c.conflict", "_c.groups", "_c.keywords"
    )


def class_verdict(declared: Column, observed: Column, designation: Column, catalog=vocab.CLASS_KEYWORDS, skip=vocab.NON_EXCLUSIVE_GROUPS) -> Column:
    """``struct<verdict, detail>``: conflict, else recognition, else a person."""
    cite = F.lit(f" | {vocab.CLASS_CITATION}")

    def judge(c, word, name):
        return (
            F.when(
                c["conflict"],
                F.struct(
                    F.lit(FAIL).alias("verdict"),
                    F.concat(
                        F.lit("classes conflict: "), F.array_join(c["keywords"], ", "),
                        F.lit(" in "), F.array_join(c["groups"], ", "), cite,
                    ).alias("detail"),
                ),
            )
            .when(
                word.isNotNull(),
                F.struct(F.lit(PASS).alias("verdict"), F.concat(F.lit("known class: "), word, cite).alias("detail")),
            )
            .otherwise(
                F.struct(
                    F.lit(REVIEW).alias("verdict"),
                    F.concat(F.lit("class is not in the catalog: "), F.coalesce(name, F.lit("")), cite).alias("detail"),
                )
            )
        )

    return let(
        lambda d, o, name: let(
            judge,
            c=conflict(d, o, catalog, skip),
            word=F.coalesce(F.get(keywords_in(d, catalog), 0), F.get(keywords_in(o, catalog), 0)),
            name=name,
        ),
        d=declared, o=observed, name=designation,
    )


def class_type(df: DataFrame, declared: str, observed: str, catalog=vocab.CLASS_KEYWORDS, skip=vocab.NON_EXCLUSIVE_GROUPS) -> DataFrame:
    """Adds ``verdict, match_status, detail`` of the class check."""
    df = df.withColumn("_d", keyword_mask(normalize_text(declared), catalog)).withColumn(
        "_o", keyword_mask(normalize_text(observed), catalog)
    )
    df = df.withColumn("_v", class_verdict(F.col("_d"), F.col("_o"), F.col(declared), catalog, skip))
    return (
        df.withColumn("verdict", F.col("_v.verdict"))
        .withColumn("match_status", class_status(F.col("verdict")))
        .withColumn("detail", F.col("_v.detail"))
        .drop("_d", "_o", "_v")
    )


def class_status(verdict: Column) -> Column:
    return (
        F.when(verdict == PASS, vocab.MATCH).when(verdict == FAIL, vocab.MISMATCH).otherwise(vocab.UNVERIFIABLE)
    )


#: Most words of a phrase that its gram takes in; longer phrases have several grams.
PHRASE_RUN = 5


def catalog_hits(texts: DataFrame, catalog: DataFrame, text_id: str, text: str = "text", phrase: str = "phrase") -> DataFrame:
    """``(text_id, phrase)`` for every catalog phrase found whole in a text.

    A phrase shows all its words in the text, so its rarest run of them (see `find_phrases`) finds
    every candidate by an equi-join; the match is then verified with its word boundaries.
    """
    words = lambda c: F.regexp_extract_all(c, F.lit("(?U)(\\w+)"), F.lit(1))
    count = F.size(words(F.col("phrase")))
    of = lambda n: lambda c: runs(words(c), n, f"p{n}")
    classes = [Grams(count >= n if n == PHRASE_RUN else count == n, of(n), of(n)) for n in range(PHRASE_RUN, 0, -1)]
    # The pattern mirrors `phrase_pattern` for a phrase that arrives as data.
    quoted = F.regexp_replace(F.col(phrase), "([\\\\.\\[\\]{}()*+?^$|])", "\\\\$1")
    pattern = F.concat(F.lit("(?U)\\b"), F.regexp_replace(quoted, " ", "[\\\\s-]+"), F.lit("\\b"))
    phrases = catalog.select(F.col(phrase).alias("phrase_id"), F.col(phrase).alias("phrase"), pattern.alias("pattern")).distinct()
    t = texts.select(F.col(text_id).alias("text_id"), normalize_text(text).alias("text"))
    found = find_phrases(t, phrases, classes, lambda text, row: F.regexp_like(text, row["pattern"]))
    return found.select(F.col("text_id").alias(text_id), F.col("phrase_id").alias(phrase))
