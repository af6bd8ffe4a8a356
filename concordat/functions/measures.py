"""Numbers with units, read from free text with JVM regular expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from concordat import vocab
from concordat.functions import exact
from concordat.functions.text import LINE_BREAKS, any_word, let, line_form, lookup, normalize_text

# Spellings of each unit, longest first, and its canonical form.
UNIT_FORMS = {
    "%": "%", "proof": "proof",
    "milliliter": "ml", "millilitre": "ml", "ml": "ml",
    "fluid ounces": "fl oz", "fluid ounce": "fl oz", "fl. oz.": "fl oz",
    "fl.oz.": "fl oz", "fl oz": "fl oz", "floz": "fl oz", "oz": "fl oz",
    "gallons": "gal", "gallon": "gal", "gal": "gal",
    "liter": "l", "litre": "l", "l": "l",
}
# Number shape, the guard before it, the guard after a unit, and
# the wider unit list of the format scan.
NUMBER = "[-+]?\\d*\\.?\\d+"
BEFORE = "(?<![\\d.,])"
AFTER = "(?![a-z])"
THOUSANDS = "(?<=\\d),(?=\\d{3}(?:\\D|$))"
UNITS = "|".join(form.replace(".", "\\.") for form in UNIT_FORMS)
SCAN_UNITS = "%|proof|milliliters?|millilitres?|ml|liters?|litres?|l"

TOKEN = f"{BEFORE}({NUMBER}) *({UNITS}){AFTER}"
SCAN_TOKEN = f"(?i){BEFORE}({NUMBER})\\s*({SCAN_UNITS}){AFTER}"
VALUE_TYPE = "decimal(30,10)"
#: ``digits`` is the number's plain form where ``value`` cannot hold it, else NULL; ``value`` is then
#: rounded, or NULL.
MEASURE = f"struct<value:{VALUE_TYPE},digits:string,unit:string>"
# Numbers that VALUE_TYPE holds as they are.
_HELD = "^[-+]?0*\\d{0,20}(?:\\.\\d{0,10}0*)?$"


def _as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_thousands(col: Column | str) -> Column:
    return let(lambda t: F.when(F.contains(t, F.lit(",")), F.regexp_replace(t, THOUSANDS, "")).otherwise(t), t=_as_col(col))


def canonical_unit(col: Column | str) -> Column:
    return lookup(_as_col(col), UNIT_FORMS)


def plain_number(value: Column) -> Column:
    """A decimal without exponent or trailing zeros."""
    text = F.regexp_replace(value.cast("string"), "(\\.\\d*?)0+$", "$1")
    return F.when(value == 0, F.lit("0")).otherwise(F.regexp_replace(text, "\\.$", ""))


def shown_number(measure: Column) -> Column:
    """The plain form of a measure's number, whatever its length."""
    return F.coalesce(measure["digits"], plain_number(measure["value"]))


def measures_in(folded: Column) -> Column:
    """Every ``number unit`` token of folded text, in order; one scan of the text."""
    hits = F.regexp_extract_all(strip_thousands(folded), F.lit(TOKEN), F.lit(0))

    def described(number, hit):
        return F.struct(
            number.try_cast(VALUE_TYPE).alias("value"),
            F.when(~number.rlike(_HELD), exact.plain(number)).alias("digits"),
            canonical_unit(F.ltrim(F.substr(hit, F.length(number) + 1))).alias("unit"),
        )

    def parse(hit):
        return let(described, number=F.regexp_extract(hit, f"^{NUMBER}", 0), hit=hit)

    known = lambda m: (m["value"].isNotNull() | m["digits"].isNotNull()) & m["unit"].isNotNull()
    return F.filter(F.transform(hits, parse), known)


def parse_all_numeric(col: Column | str, key: str) -> Column:
    """All measures of a measured field; an empty array for any other field."""
    if key not in vocab.NUMERIC_FIELDS:
        return F.array().cast(f"array<{MEASURE}>")
    one_line = F.regexp_replace(line_form(col), "\\n", " ")
    return F.coalesce(measures_in(F.trim(one_line)), F.array().cast(f"array<{MEASURE}>"))


def parse_numeric(col: Column | str, key: str) -> Column:
    """The first measure of a measured field, else NULL."""
    return F.get(parse_all_numeric(col, key), 0)


def measures_by_line(col: Column | str) -> Column:
    """Measures of a multi-line text; no token reaches over a line break."""
    return F.coalesce(measures_in(line_form(col)), F.array().cast(f"array<{MEASURE}>"))


def normalize_field(col: Column | str, key: str) -> Column:
    """Comparison form; measured fields become ``<number> <unit>`` if they parse."""
    text = normalize_text(col)
    if key not in vocab.NUMERIC_FIELDS:
        return text
    first = F.get(measures_in(text), 0)
    return F.when(
        first.isNotNull(), F.concat(shown_number(first), F.lit(" "), first["unit"])
    ).otherwise(text)


def unit_tokens(col: Column | str, spans: bool = False) -> Column:
    """Format-scan tokens as ``array<struct<value, unit, near>>``.

    ``near`` is the lower-cased text within reach of a cue on both sides.  The
    text is cut once at its tokens; each token then looks at the few pieces
    around it, so the cost stays linear in the text.  ``spans`` adds the token's
    ``start`` and ``end`` offsets.
    """
    # A token is two characters or more, so this many pieces always cover the reach.
    reach = vocab.CUE_REACH
    span = reach + 2

    def describe(hit, i, pieces):
        at = i * 2 + 2  # 1-based place of this hit in `pieces`
        first = F.greatest(F.lit(1), at - span)
        before = F.array_join(F.slice(pieces, first, at - first), "")
        after = F.array_join(F.slice(pieces, at + 1, F.lit(span)), "")
        near = F.concat(F.right(before, F.lit(reach)), hit, F.left(after, F.lit(reach)))
        fields = [
            F.get(measures_in(F.lower(F.regexp_replace(hit, "\\s+", ""))), 0).alias("m"),
            F.lower(near).alias("near"),
        ]
        if spans:
            start = F.length(F.array_join(F.slice(pieces, F.lit(1), at - 1), ""))
            fields += [start.alias("start"), (start + F.length(hit)).alias("end")]
        return F.struct(*fields)

    def scan(text):
        return let(
            lambda gaps, hits: let(
                lambda pieces, hits: F.transform(hits, lambda h, i: describe(h, i, pieces)),
                pieces=F.flatten(
                    F.zip_with(gaps, hits, lambda g, h: F.array(g, F.coalesce(h, F.lit(""))))
                ),
                hits=hits,
            ),
            gaps=F.split(text, SCAN_TOKEN, -1),
            hits=F.regexp_extract_all(text, F.lit(SCAN_TOKEN), F.lit(0)),
        )

    found = F.filter(let(scan, text=_as_col(col)), lambda t: t["m"]["value"].isNotNull())
    extra = ("start", "end") if spans else ()
    return F.transform(
        found,
        lambda t: F.struct(
            t["m"]["value"].alias("value"), t["m"]["unit"].alias("unit"), t["near"].alias("near"),
            *[t[name].alias(name) for name in extra],
        ),
    )


def cue_near(token: Column, cues: Iterable[str]) -> Column:
    return any_word(token["near"], cues)


def pick_abv(tokens: Column, text: Column | str) -> Column:
    """The stated strength: the first cued percentage, else the only percentage
    when an abbreviation word occurs anywhere, else NULL."""
    def choose(pct, worded):
        return let(
            lambda pct, cued, worded: F.when(F.size(cued) > 0, F.get(cued, 0)["value"]).when(
                (F.size(pct) == 1) & worded, F.get(pct, 0)["value"]
            ),
            pct=pct, worded=worded, cued=F.filter(pct, lambda t: cue_near(t, vocab.ABV_CUES)),
        )

    return let(
        choose,
        pct=F.filter(tokens, lambda t: t["unit"] == "%"),
        worded=any_word(F.lower(_as_col(text)), vocab.ABV_WORDS),
    )


def pick_size_ml(tokens: Column) -> Column:
    """The stated size in millilitres: the last cued size, else the last size."""
    sized = F.transform(
        F.filter(tokens, lambda t: t["unit"].isin("ml", "l") & (t["value"] > 0)),
        lambda t: F.struct(
            F.when(t["unit"] == "l", t["value"] * 1000)
            .otherwise(t["value"])
            .cast(VALUE_TYPE)
            .alias("value"),
            t["near"].alias("near"),
        ),
    )

    def choose(sized):
        return let(
            lambda sized, cued: F.coalesce(
                F.try_element_at(cued, F.lit(-1))["value"], F.try_element_at(sized, F.lit(-1))["value"]
            ),
            sized=sized, cued=F.filter(sized, lambda t: cue_near(t, vocab.NET_CUES)),
        )

    return let(choose, sized=sized)


def first_of_unit(tokens: Column, unit: str) -> Column:
    return F.get(F.filter(tokens, lambda t: t["unit"] == unit), 0)["value"]


def numeric_line(text: Column | str, filed: Column | str | None, key: str) -> Column:
    """The first line that holds a measure of the filed unit; without a filed
    value, of any unit that suits the field."""
    any_unit = {"alcohol_content": ("%", "proof"), "net_contents": ("ml", "l")}[key]
    unit = parse_numeric(filed, key)["unit"] if filed is not None else F.lit(None).cast("string")

    def first_line(raw, folded, unit):
        pairs = F.zip_with(
            F.split(raw, LINE_BREAKS), F.split(folded, "\n"),
            lambda r, f: F.struct(r.alias("raw"), f.alias("folded")),
        )
        fits = lambda m: F.when(unit.isNotNull(), m["unit"] == unit).otherwise(m["unit"].isin(*any_unit))
        holding = F.filter(pairs, lambda line: F.exists(measures_in(line["folded"]), fits))
        return F.trim(F.get(holding, 0)["raw"])

    return let(first_line, raw=_as_col(text), folded=line_form(text), unit=unit)
