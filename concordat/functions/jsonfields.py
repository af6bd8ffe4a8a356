"""Tolerant JSON access, small set/map updates and step captions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from concordat import vocab
from concordat.functions import exact
from concordat.functions.text import has_value, let, lookup, nullify_blank

STEP_LOG = "array<struct<step:string,applied:boolean>>"


def _as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Quotes are double as in the standard; a text after the object makes it unreadable.
_STRICT = {"allowSingleQuotes": "false"}


def _member(col: Column, kind: str, *keys: str) -> Column:
    """Members ``keys`` of the one JSON object that a text is, the last where a key is repeated; NULL
    where it has none, and the struct around them NULL where the text is no object."""
    shape = ", ".join(f"`{key}`:{kind}" for key in keys)
    listed = F.from_json(F.concat(F.lit("["), col, F.lit("]")), f"array<struct<{shape}>>", _STRICT)
    return let(lambda rows: F.when(F.size(rows) == 1, F.get(rows, 0)), rows=listed)


def is_json_object(col: Column | str) -> Column:
    return F.coalesce(_member(_as_col(col), "string", "_").isNotNull(), F.lit(False))


def json_scalar(col: Column | str, key: str, numbers: bool = True) -> Column:
    """A scalar member of a JSON object as text.

    Without ``numbers`` only text counts.  Text stays text and a number becomes plain decimal text:
    whole numbers keep all their digits, others are doubles in their shortest form (as the JVM
    prints it).  Of a repeated key the last member counts.  Lists, objects and booleans, blanks,
    missing keys, other JSON and broken JSON give NULL.
    """
    return json_scalars(col, (key,), () if numbers else (key,))[key]


def json_scalars(col: Column | str, keys: Sequence[str], only_text: Sequence[str] = ()) -> Column:
    """The `json_scalar` of several members as a struct; the text is parsed once for their kinds and
    once for their values.  Of the members ``only_text`` numbers do not count."""
    def read(key, kind, raw):
        text = F.when(kind == "STRING", raw)
        if key in only_text:
            return text
        number = F.when(kind.isin("DOUBLE", "FLOAT", "BIGINT") | kind.startswith("DECIMAL"), exact.plain(raw))
        return F.coalesce(text, number)

    def member(key, kinds, values):
        return let(
            lambda kind, raw: nullify_blank(read(key, kind, raw)), kind=F.schema_of_variant(kinds[key]), raw=values[key]
        )

    return let(
        lambda kinds, values: F.struct(*[member(k, kinds, values).alias(k) for k in keys]),
        kinds=_member(_as_col(col), "variant", *keys), values=_member(_as_col(col), "string", *keys),
    )


def statement_text(col: Column | str, key: str = "government_warning") -> Column:
    """A model payload yields its own statement member; other text is itself."""
    c = _as_col(col)
    return F.when(
        has_value(c), F.when(is_json_object(c), json_scalar(c, key)).otherwise(c)
    )


def string_list(col: Column | str) -> Column:
    """JSON array of strings; NULL or malformed gives an empty array."""
    return F.coalesce(F.from_json(_as_col(col), "array<string>"), F.array().cast("array<string>"))


def string_map(col: Column | str) -> Column:
    """JSON object of strings; NULL or malformed gives an empty map."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.coalesce(F.from_json(_as_col(col), "map<string,string>"), empty)


def set_add(col: Column | str, key: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array_append(_as_col(col), key)))


def set_remove(col: Column | str, key: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array_remove(_as_col(col), key)))


def map_set(col: Column | str, key: Column, value: Column) -> Column:
    """The map with one key set, or cleared where ``value`` is not pass/fail."""
    rest = F.map_filter(_as_col(col), lambda k, _: k != key)
    return F.when(
        value.isin("pass", "fail"), F.map_concat(rest, F.create_map(key, value))
    ).otherwise(rest)


def sorted_map_json(col: Column | str) -> Column:
    """A string map as JSON text with its keys in order."""
    entries = F.array_sort(F.map_entries(_as_col(col)))
    return F.to_json(F.map_from_entries(entries))


def step_caption(col: Column | str) -> Column:
    """Names of the corrective steps that were applied, else ``preprocessed``."""
    steps = F.from_json(_as_col(col), STEP_LOG)
    names = F.transform(
        F.filter(steps, lambda s: s["applied"] & s["step"].isin(*vocab.STEP_CAPTIONS)),
        lambda s: lookup(s["step"], vocab.STEP_CAPTIONS),
    )
    joined = F.array_join(names, " · ")
    return F.when(F.coalesce(joined, F.lit("")) != "", joined).otherwise(F.lit("preprocessed"))
