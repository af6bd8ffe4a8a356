"""Counts over whole texts as Column expressions, all evaluated inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.functions.text import let

# The characters that count as symbols, and the words of a window.
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` in order."""
    return F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")


def repeated_lines(lines: Column) -> Column:
    """Lines with a word that equal an earlier line."""

    def of_lines(ls: Column) -> Column:
        full = F.filter(ls, lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
        return F.when(F.size(F.array_distinct(ls)) == F.size(ls), F.lit(0)).otherwise(
            let(lambda own: F.size(own) - F.size(F.array_distinct(own)), own=full)
        )

    return let(of_lines, ls=lines)


def _count_of(text: Column, characters: str) -> Column:
    """How many characters of a set there are; texts without any are only scanned."""
    return F.when(text.rlike(characters), F.regexp_count(text, F.lit(characters))).otherwise(0)


def repeated_words(tokens: Column) -> Column:
    """Words in windows of ``WINDOW`` words found twice or more, the first occurrence included.

    Windows are compared by 64-bit hashes of their words.  Only a text in which a window
    repeats is looked at further: its (hash, place) pairs are sorted, places with an equal
    neighbour are kept, and in order of place each adds the words the one before it did not
    cover.  Sorting keeps this at n log n for texts of any length.
    """

    def covered(pairs: Column) -> Column:
        same = lambda i, j: F.coalesce(F.get(pairs, i)["h"] == F.get(pairs, j)["h"], F.lit(False))
        twins = F.filter(pairs, lambda p, i: same(i, i - 1) | same(i, i + 1))
        places = F.array_sort(F.transform(twins, lambda p: p["i"]))
        return let(
            lambda at: F.aggregate(
                F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(p - F.get(at, k - 1), F.lit(WINDOW)))),
                F.lit(0), lambda total, n: total + n,
            ),
            at=places,
        )

    def of_windows(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(covered, pairs=pairs))

    def joined(hashes: Column, step: int) -> Column:
        kept = F.size(hashes) - step
        return F.zip_with(
            F.slice(hashes, F.lit(1), kept), F.slice(hashes, F.lit(step + 1), kept), lambda x, y: F.xxhash64(x, y)
        )

    def of_words(ws: Column) -> Column:
        # Each word is hashed once; hashes of 2, 4 and then 8 words are joined from halves.
        eights = let(
            lambda twos: let(lambda fours: joined(fours, 4), fours=joined(twos, 2)), twos=joined(ws, 1)
        )
        return F.when(F.size(ws) < WINDOW, F.lit(0)).otherwise(let(of_windows, hashes=eights))

    return let(of_words, ws=tokens)


#: Counts that ``text_stats`` gives, all long.
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_exclaims",
)


def text_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``COUNTS`` for every row; a NULL text has zero everywhere."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", "text", words(F.col("text")).alias("words"), F.split("text", "\n").alias("lines"))
    t, ws, lines = F.col("text"), F.col("words"), F.col("lines")
    counts = {
        "n_words": F.size(ws),
        "word_chars": F.length(F.array_join(ws, "")),
        "n_symbols": _count_of(t, SYMBOLS),
        "n_dup_lines": repeated_lines(lines),
        "n_repeat_words": repeated_words(ws),
        "n_lines": F.size(lines),
        "n_capitals": F.length(F.regexp_replace(t, "[^A-Z]+", "")),
        "n_exclaims": _count_of(t, "!"),
    }
    return rows.select("doc_id", *(c.cast("long").alias(k) for k, c in counts.items()))


def ratios() -> dict[str, Column]:
    """Features free of a text's length, from the columns of ``text_stats``."""
    n, chars, lines = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "word_chars", "n_lines"))
    return {
        "words": F.col("n_words").cast("double"),
        "mean_word": F.col("word_chars") / n,
        "symbol_share": F.col("n_symbols") / chars,
        "dup_line_share": F.col("n_dup_lines") / lines,
        "repeat_share": F.col("n_repeat_words") / n,
        "capital_share": F.col("n_capitals") / chars,
        "exclaim_share": F.col("n_exclaims") / chars,
        "words_per_line": F.col("n_words") / lines,
    }
