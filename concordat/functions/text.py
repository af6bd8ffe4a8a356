"""Text normalization and predicates as Column expressions.

ASCII text is folded inside the JVM.  Only rows that hold a non-ASCII character
are handed to Arrow, because Spark has neither NFKC nor full case folding.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The blank characters, quote pairs and trailing marks that the
# comparison form ignores.
ODD_BLANKS = "\\t\\n\\x0b\\f\\r\\x1c\\x1d\\x1e\\x1f\\x85\\xa0"
STRAIGHT_QUOTES = {"‘": "'", "’": "'", "“": '"', "”": '"', "′": "'", "″": '"'}
TRAILING_MARKS = ".,;:!?…'\" "

# The regex engine tests listed Latin characters by table and \\p{Z} by category,
# which is far cheaper than a chain of ranges.  \\p{Z} covers the blanks above 0xff.
BLANKS = f" {ODD_BLANKS}\\p{{Z}}"
_RUN_OF_BLANKS = f"[{BLANKS}]+"
# Runs that are not a single space already, in ASCII text and in any text.
_ASCII_RUN = "[\\t\\n\\x0b\\f\\r\\x1c\\x1d\\x1e\\x1f][\\t\\n\\x0b\\f\\r\\x1c\\x1d\\x1e\\x1f ]*| [\\t\\n\\x0b\\f\\r\\x1c\\x1d\\x1e\\x1f ]+"
# An ASCII text without any of these has no such run.
_ASCII_RUN_SIGNS = ("  ", *"\t\n\x0b\f\r\x1c\x1d\x1e\x1f")
_ODD_RUN = f"[{ODD_BLANKS}[\\p{{Z}}&&[^ ]]][{BLANKS}]*| [{BLANKS}]+"
LINE_BREAKS = "(?:\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029])"
_PY_LINE_BREAK = re.compile(LINE_BREAKS)
_QUOTE_TABLE = str.maketrans(STRAIGHT_QUOTES)


def _as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def literal_regex(text: str) -> str:
    """``text`` as a Java/Python regex that matches it literally."""
    return re.sub(r"([\\.\[\]{}()*+?^$|])", r"\\\1", text)


def is_ascii(col: Column | str) -> Column:
    c = _as_col(col)
    return F.length(c) == F.octet_length(c)


def has_value(col: Column | str) -> Column:
    """Not NULL and not made of blanks only."""
    c = _as_col(col)
    return F.coalesce(c.rlike(f"[^{BLANKS}]"), F.lit(False))


def nullify_blank(col: Column | str) -> Column:
    """Trimmed text, or NULL where nothing is left."""
    c = _as_col(col)
    trimmed = F.regexp_replace(c, f"^{_RUN_OF_BLANKS}|{_RUN_OF_BLANKS}$", "")
    return F.when(has_value(c), trimmed)


def holds_any(c: Column, parts: Iterable[str]) -> Column:
    """Whether any of the parts occurs; searches for fixed bytes, far cheaper than one pattern."""
    found = F.lit(False)
    for part in parts:
        found = found | F.contains(c, F.lit(part))
    return found


def collapse_ws(col: Column | str) -> Column:
    """Runs of blanks become one space; the ends are trimmed; case is kept.

    Most ASCII texts have no run to replace, and are not handed to the regex engine.
    """
    def collapsed(c):
        plain = is_ascii(c)
        return F.trim(
            F.when(plain & ~holds_any(c, _ASCII_RUN_SIGNS), c)
            .when(plain, F.regexp_replace(c, _ASCII_RUN, " "))
            .otherwise(F.regexp_replace(c, _ODD_RUN, " "))
        )

    return let(collapsed, c=_as_col(col))


def dehyphenate(col: Column | str) -> Column:
    """Rejoin words split by a soft hyphen or by a hyphen before a blank."""
    def joined(c):
        whole = F.regexp_replace(F.translate(c, "\xad", ""), f"-{_RUN_OF_BLANKS}", "")
        return F.when(holds_any(c, ("-", "\xad")), whole).otherwise(c)

    return let(joined, c=_as_col(col))


def letters_only(col: Column | str) -> Column:
    """The a-z projection used to compare wording and nothing else."""
    return F.regexp_replace(F.lower(dehyphenate(collapse_ws(col))), "[^a-z]+", "")


def is_all_caps(col: Column | str) -> Column:
    c = _as_col(col)
    return (F.upper(c) == c) & (F.lower(c) != c)


def initial_capital(col: Column | str, word: str) -> Column:
    """The first occurrence of ``word`` (any case) starts with a capital."""
    def capital(first, at):
        return (at > 0) & (F.upper(first) == first) & (F.lower(first) != first)

    c = _as_col(col)
    return let(lambda c, at: let(capital, first=F.substring(c, at, F.lit(1)), at=at), c=c, at=F.locate(word.lower(), F.lower(c)))


@F.pandas_udf(T.StringType())
def _compare_form_unicode(values: pd.Series) -> pd.Series:
    def one(s):
        if s is None:
            return None
        folded = unicodedata.normalize("NFKC", " ".join(s.split())).casefold()
        return folded.translate(_QUOTE_TABLE).rstrip(TRAILING_MARKS)

    return values.map(one, na_action="ignore")


def folded_lines(text: str) -> str:
    """The line form of any text, outside the JVM."""
    lines = (" ".join(part.split()) for part in _PY_LINE_BREAK.split(text))
    return "\n".join(unicodedata.normalize("NFKC", line).casefold() for line in lines)


@F.pandas_udf(T.StringType())
def _line_form_unicode(values: pd.Series) -> pd.Series:
    return values.map(lambda s: None if s is None else folded_lines(s), na_action="ignore")


def normalize_text(col: Column | str) -> Column:
    """The comparison form: trimmed, collapsed, compatibility-folded, caseless,
    straight-quoted, without trailing marks.  NULL becomes the empty string."""
    c = _as_col(col)
    plain = is_ascii(c)
    native = F.rtrim(F.lower(collapse_ws(c)), F.lit(TRAILING_MARKS))
    other = _compare_form_unicode(F.when(~plain, c))
    return F.coalesce(F.when(plain, native), other, F.lit(""))


def line_form(col: Column | str) -> Column:
    """Folded text that keeps its line breaks, as the measure scanner reads it."""
    c = _as_col(col)
    plain = is_ascii(c)
    # Each pattern runs only on texts that hold something for it to replace.
    step = lambda signs, pattern, by, t: F.when(holds_any(t, signs), F.regexp_replace(t, pattern, by)).otherwise(t)
    native = let(lambda t: step("\r\x0b\x0c\x1c\x1d\x1e", LINE_BREAKS, "\n", t), t=F.lower(c))
    native = let(lambda t: step(("\t", "\x1f", "  "), "[\\t\\x1f ]+", " ", t), t=native)
    native = let(lambda t: step((" \n", "\n "), " ?\\n ?", "\n", t), t=native)
    return F.coalesce(F.when(plain, native), _line_form_unicode(F.when(~plain, c)))


def distinct_lines(col: Column | str) -> Column:
    """The text with each of its lines once, where it first stands."""
    return F.array_join(F.array_distinct(F.split(_as_col(col), LINE_BREAKS, -1)), "\n")


def truncate(col: Column | str, n: int, marker: str = "…[truncated]") -> Column:
    c = _as_col(col)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(marker))).otherwise(c)


def with_model(detail: Column | str, model: Column | str) -> Column:
    """Provenance text with the model that assisted, if one did."""
    d, m = _as_col(detail), _as_col(model)
    tag = F.when(F.coalesce(m, F.lit("")) != "", F.concat(F.lit("model="), m))
    return F.when(tag.isNull(), d).otherwise(
        F.concat_ws(" | ", F.when(F.coalesce(d, F.lit("")) != "", d), tag)
    )


def word_present(col: Column | str, token: str) -> Column:
    """``token`` occurs with no letter or digit of a-z0-9 on either side."""
    return _as_col(col).rlike(f"(?<![a-z0-9]){literal_regex(token)}(?![a-z0-9])")


def any_word(col: Column | str, tokens: Iterable[str]) -> Column:
    body = "|".join(literal_regex(t) for t in tokens)
    return F.coalesce(
        _as_col(col).rlike(f"(?<![a-z0-9])(?:{body})(?![a-z0-9])"), F.lit(False)
    )


def any_phrase(col: Column | str, phrases: Iterable[str]) -> Column:
    """Any phrase occurs as a substring, case ignored."""
    body = "|".join(literal_regex(p) for p in phrases)
    return F.coalesce(F.lower(_as_col(col)).rlike(body), F.lit(False))


def count_phrases(col: Column | str, phrases: Iterable[str]) -> Column:
    """How many of the phrases occur at least once in the collapsed text."""
    return phrases_in(F.lower(collapse_ws(col)), phrases)


def phrases_in(low: Column, phrases: Iterable[str]) -> Column:
    """How many of the phrases a collapsed and lower-cased text holds; the text is worked out once."""
    def count(low):
        total = F.lit(0)
        for phrase in phrases:
            total = total + F.coalesce(low.contains(phrase), F.lit(False)).cast("int")
        return total

    return let(count, low=low)


def lookup(col: Column, table: Mapping[str, str]) -> Column:
    """Value of a small fixed table, NULL where the key is unknown."""
    entries = [F.lit(part) for pair in table.items() for part in pair]
    return F.try_element_at(F.create_map(*entries), col)


def let(body: Callable[..., Column], **values: Column) -> Column:
    """``body`` over values that are each evaluated once per row.

    The optimizer merges projections and may repeat an expression wherever its
    column was named, also inside a lambda, where it would run per element.
    Binding the values to a lambda variable rules that out.
    """
    packed = F.array(F.struct(*[v.alias(name) for name, v in values.items()]))
    return F.get(F.transform(packed, lambda s: body(**{name: s[name] for name in values})), 0)


def once(df: DataFrame, values: Mapping[str, Column]) -> DataFrame:
    """``df`` with columns that are each evaluated once per row, however often they are read.

    What ``withColumns`` adds is inlined into every later expression that reads it, so a folded text
    would be folded again for each of its readers.  The optimizer leaves a generator's output alone.
    """
    kept = [c for c in df.columns if c not in values]
    return df.select(*kept, F.inline_outer(F.array(F.struct(*[v.alias(name) for name, v in values.items()]))))


def edit_rate(extracted: Column | str, gold: Column | str) -> Column:
    """Character error rate of two raw texts, taken on their comparison forms."""
    return edit_rate_normalized(normalize_text(extracted), normalize_text(gold))


#: Longest text that is looked for as a subsequence; each of its characters nests the matcher once.
_SUBSEQUENCE_CHARS = 1000


def edit_distance(a: Column, b: Column) -> Column:
    """The edit distance of two texts.

    Where ``b`` is a subsequence of ``a``, as short texts mostly are of long ones, the distance is the
    difference of their lengths: one scan instead of a table of all pairs of characters.
    """

    def distance(a, b):
        # Possessive, so that the matcher never goes back.
        spread = F.regexp_replace(b, "(?s)(.)", r"[^\\Q$1\\E]*+\\Q$1\\E")
        inside = (F.length(b) <= _SUBSEQUENCE_CHARS) & (F.length(a) >= F.length(b)) & F.rlike(a, F.concat(F.lit("^"), spread))
        return F.when(inside, F.length(a) - F.length(b)).otherwise(F.levenshtein(a, b))

    return let(distance, a=a, b=b)


def edit_rate_normalized(extracted: Column, gold: Column) -> Column:
    return F.when(
        gold == "", F.when(extracted == "", F.lit(0.0)).otherwise(F.lit(1.0))
    ).otherwise(edit_distance(extracted, gold) / F.length(gold))
