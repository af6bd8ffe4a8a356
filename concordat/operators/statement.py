"""Required-statement checks: wording, casing, presence and scoring."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat import vocab
from concordat.functions.similarity import char_diff
from concordat.functions.text import (
    collapse_ws, count_phrases, dehyphenate, has_value, initial_capital, is_all_caps, let,
    literal_regex, normalize_text, phrases_in,
)
from concordat.operators.phrases import Grams, find_phrases, pieces, runs
from concordat.vocab import FAIL, PASS, REVIEW

COULD_NOT = "couldnt_verify"
STATEMENT = (
    "struct<verdict:string,outcome:string,deviation:string,found:string,message:string>"
)


@dataclass(frozen=True)
class Statement:
    """A statement that a label must carry, as data."""

    header: str = vocab.STATEMENT_HEADER
    body: str = vocab.STATEMENT_BODY
    capitals: tuple[str, ...] = vocab.STATEMENT_CAPITALS
    anchors: tuple[str, ...] = vocab.STATEMENT_ANCHORS
    end_anchors: tuple[str, ...] = vocab.STATEMENT_END_ANCHORS
    citation: str = vocab.STATEMENT_CITATION
    full: str = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "full", " ".join(f"{self.header} {self.body}".split()))


WARNING = Statement()


def anchor_hits(text: Column | str, anchors=vocab.STATEMENT_ANCHORS) -> Column:
    return count_phrases(text, anchors)


def statement_region(text: Column | str, anchors=vocab.STATEMENT_ANCHORS) -> Column:
    """What to show when only phrases were found: from 60 characters before the
    first of them, 420 long."""
    return let(lambda flat: _region(flat, anchors), flat=collapse_ws(text))


def _region(flat: Column, anchors) -> Column:
    """The region of a collapsed text; every phrase is looked for once."""
    def first(low):
        return F.array_min(F.filter(F.array(*[F.locate(a, low) for a in anchors]), lambda at: at > 0))

    return let(
        lambda flat, first: F.when(first.isNull(), F.substring(flat, 1, 400)).otherwise(
            F.trim(F.substring(flat, F.greatest(F.lit(1), first - 60), F.lit(420)))
        ),
        flat=flat, first=let(first, low=F.lower(flat)),
    )


def clip_statement(text: Column | str, spec: Statement = WARNING) -> Column:
    """The statement without the label copy that follows it."""
    return _clip_flat(collapse_ws(text), spec)


def _clip_flat(flat: Column, spec: Statement) -> Column:
    """The clipped form of a collapsed text; every end is looked for once."""
    limit = len(spec.full) + vocab.STATEMENT_DISPLAY_MARGIN

    def clip(flat, **spots):
        out = F.when(F.lit(False), flat)
        for anchor, at in zip(spec.end_anchors, spots.values()):
            end = at + len(anchor)
            stop = F.when(F.substring(flat, end, F.lit(1)) == ".", end).otherwise(end - 1)
            out = out.when(at > 0, F.substring(flat, F.lit(1), stop))
        return out.when(F.length(flat) <= limit, flat).otherwise(
            F.concat(F.rtrim(F.substring(flat, 1, limit)), F.lit("…"))
        )

    def ends(flat, low):
        return let(clip, flat=flat, **{f"at_{i}": F.locate(a, low) for i, a in enumerate(spec.end_anchors)})

    return let(lambda flat: let(ends, flat=flat, low=F.lower(flat)), flat=flat)


def header_pattern(header: str) -> str:
    return "(?i)" + "\\s+".join(literal_regex(word) for word in header.split())


def judge_statement(text: Column | str, spec: Statement = WARNING, bold_unsure: Column | None = None) -> Column:
    """The verdict on one text as a struct, with no shuffle and no Python."""
    return _judge_flat(collapse_ws(text), spec, bold_unsure)


def _judge_flat(flat: Column, spec: Statement, bold_unsure: Column | None) -> Column:
    """The verdict on a collapsed text.

    The text is cut at its headers.  Each header is judged on
    a short stretch behind it; the rest of the text is read only where hyphens
    used that stretch up.
    """
    header = " ".join(spec.header.split())
    pattern = header_pattern(spec.header)
    body = " ".join(spec.body.split())
    letters = "".join(ch for ch in body.lower() if "a" <= ch <= "z")
    need, stretch, width = len(body), 4 * len(body), len(header)
    only_letters = lambda c: F.regexp_replace(F.lower(c), "[^a-z]+", "")

    def verdict(fh, end, head, near, more, flat, unsure):
        at = end - width + 1
        capitals = F.lit(True)
        for word in spec.capitals:
            capitals = capitals & initial_capital(head, word)
        # Branches run only when reached, so clean wording never pays for letters.
        seen = let(
            lambda seen, more, flat, end: F.when(more & (F.length(seen) <= len(letters)), only_letters(_tail(flat, end))).otherwise(seen),
            seen=only_letters(near), more=more, flat=flat, end=end,
        )
        reworded = F.when(
            F.left(seen, F.lit(len(letters))) == letters, _found(REVIEW, COULD_NOT, "marks", at)
        ).otherwise(_found(FAIL, "reworded", "body wording or punctuation", at))
        return (
            F.when(fh != header, _found(FAIL, "reworded", "header casing", at))
            .when(F.lower(head) != body.lower(), reworded)
            .when(~is_all_caps(head) & ~capitals, _found(FAIL, "reworded", "capital initials", at))
            .when(unsure, _found(REVIEW, COULD_NOT, "styling", at))
            .otherwise(_found(PASS, "pass", None, at))
        )

    def occurrence(fh, end, flat, unsure):
        near = dehyphenate(F.ltrim(F.substring(flat, end + 1, F.lit(stretch))))
        return let(
            lambda near, more, end, flat, fh, unsure: let(
                verdict,
                head=F.substring(
                    F.when(more & (F.length(near) < need + 2), _tail(flat, end)).otherwise(near), 1, need
                ),
                near=near, more=more, end=end, flat=flat, fh=fh, unsure=unsure,
            ),
            near=near, more=F.length(flat) - end > stretch, end=end, flat=flat, fh=fh, unsure=unsure,
        )

    def scan(flat, gaps, hits, unsure):
        def one(found_header, i):
            start = F.aggregate(F.slice(gaps, F.lit(1), i + 1), F.lit(0), lambda n, g: n + F.length(g))
            return let(
                lambda end, fh: occurrence(fh, end, flat, unsure),
                end=start + (i + 1) * width, fh=found_header,
            )

        return F.transform(hits, one)

    def pick(seen):
        return F.coalesce(F.get(F.filter(seen, lambda o: o["verdict"] == PASS), 0), F.get(seen, 0))

    unsure = F.lit(False) if bold_unsure is None else F.coalesce(bold_unsure, F.lit(False))
    return let(
        lambda flat, unsure: let(
            lambda seen: pick(seen),
            seen=let(
                scan,
                flat=flat,
                gaps=F.split(flat, pattern, -1),
                hits=F.regexp_extract_all(flat, F.lit(pattern), F.lit(0)),
                unsure=unsure,
            ),
        ),
        flat=flat,
        unsure=unsure,
    )


def _tail(flat: Column, end: Column) -> Column:
    return dehyphenate(F.ltrim(F.substr(flat, end + 1)))


def _found(verdict: str, outcome: str, deviation: str | None, at: Column) -> Column:
    return F.struct(
        F.lit(verdict).alias("verdict"),
        F.lit(outcome).alias("outcome"),
        F.lit(deviation).cast("string").alias("deviation"),
        at.alias("at"),
    )


def statement_result(text: str, spec: Statement = WARNING, bold_unsure: str | None = None) -> Column:
    """The full statement result of one text as a struct.

    The text shown to a reader is cut out for the chosen occurrence only.
    """
    unsure = F.col(bold_unsure) if bold_unsure else None

    def finish(pick, flat):
        shown = (pick["verdict"] == FAIL) | (pick["deviation"] == "marks")
        read = _statement(
            pick["verdict"], pick["outcome"],
            F.when(pick["outcome"] == "reworded", pick["deviation"]),
            # What is cut from a collapsed text between characters that are not blank is collapsed.
            F.when(shown, _clip_flat(F.substr(flat, pick["at"]), spec)),
            F.when(pick["deviation"] == "marks", F.lit("wording is present; confirm marks and casing on the label"))
            .when(pick["deviation"] == "styling", F.lit("bold styling cannot be confirmed from a photo")),
        )
        phrases = _statement(
            F.lit(REVIEW), F.lit(COULD_NOT), F.lit(None),
            _clip_flat(F.trim(_region(flat, spec.anchors)), spec),
            F.lit("phrases of the statement were read, but not its header; confirm on the label"),
        )
        enough = phrases_in(F.lower(flat), spec.anchors) >= vocab.STATEMENT_ANCHORS_NEEDED
        return F.when(pick.isNotNull(), read).when(enough, phrases).otherwise(absent())

    # The text is collapsed once; `finish` and the judge read the collapsed form.
    return let(
        lambda flat, unsure: let(finish, pick=_judge_flat(flat, spec, unsure), flat=flat),
        flat=collapse_ws(text), unsure=F.lit(None).cast("boolean") if unsure is None else unsure,
    )


def with_statement(df: DataFrame, text: str, out: str, spec: Statement = WARNING, bold_unsure: str | None = None) -> DataFrame:
    return df.withColumn(out, statement_result(text, spec, bold_unsure))


def absent() -> Column:
    return _statement(
        F.lit(FAIL), F.lit("absent"), F.lit(None), F.lit(None),
        F.lit("the statement was not found on any label"),
    )


def _statement(verdict, outcome, deviation, found, message) -> Column:
    return F.struct(
        verdict.alias("verdict"),
        outcome.alias("outcome"),
        deviation.cast("string").alias("deviation"),
        found.cast("string").alias("found"),
        message.cast("string").alias("message"),
    )


def statement_detail(result: Column, spec: Statement = WARNING) -> Column:
    """The stored JSON payload of a statement result."""
    return F.to_json(
        F.struct(
            result["outcome"].alias("outcome"),
            result["deviation"].alias("deviation"),
            F.when(result["outcome"] == "reworded", F.lit(spec.full)).alias("expected"),
            result["found"].alias("found"),
            result["message"].alias("message"),
            F.lit(spec.citation).alias("cfr_citation"),
        )
    )


def verdict_rank(verdict: Column) -> Column:
    return F.when(verdict == PASS, 0).when(verdict == REVIEW, 1).otherwise(2)


def best_source(results: DataFrame, key: str = "submission_id", result: str = "statement") -> DataFrame:
    """PASS of any source wins, then REVIEW, then the first source's result."""
    r = F.col(result)
    return results.groupBy(key).agg(
        F.min_by(r, F.struct(verdict_rank(r["verdict"]), F.col("source_order"))).alias(result)
    )


def required_statement(
    texts: DataFrame, spec: Statement = WARNING, bold_unsure: str | None = None
) -> DataFrame:
    """``(submission_id, source_order, text)`` to one result per submission.

    Source 0 is the model's transcription and source 1 the OCR text, so a tie in
    rank goes to the model.  Parts of a split OCR text merge the same way.
    """
    judged = with_statement(texts.filter(has_value("text")), "text", "statement", spec, bold_unsure)
    best = best_source(judged.select("submission_id", "source_order", "statement"))
    keys = texts.select("submission_id").distinct()
    return keys.join(best, "submission_id", "left").withColumn(
        "statement", F.coalesce("statement", absent())
    )


def diff_segments(df: DataFrame, expected: str = "expected", found: str = "found") -> DataFrame:
    """Edit scripts of deviating rows, one row per step."""
    rows = df.filter(F.col(expected).isNotNull() & F.col(found).isNotNull() & (F.col(expected) != F.col(found)))
    return rows.select(
        *[c for c in df.columns if c not in (expected, found)],
        F.posexplode(char_diff(expected, found)).alias("step", "_d"),
    ).select("*", "_d.op", "_d.segment").drop("_d")


def altered_segments(diffs: DataFrame) -> DataFrame:
    """How often each segment was altered, and how."""
    return diffs.filter(F.col("op") != "equal").groupBy("op", "segment").agg(F.count(F.lit(1)).alias("n"))


# --- containment of many statements in many texts -----------------------------


#: Sizes of runs of inner words that phrases are looked for by, and of runs of characters for
#: phrases of one or two words; the longest that fits a phrase is used.
WORD_RUNS = (5, 3, 2, 1)
CHARACTER_RUNS = (4, 3, 2, 1)


def _containment_classes() -> list[Grams]:
    """A contained statement shows all its inner words whole; one without inner words shows its
    characters."""
    inner = lambda c: F.regexp_replace(c, "^[^ ]* | [^ ]*$", "")
    words = lambda c: F.split(c, " ")
    count, length = F.size(words(F.col("phrase"))), F.length("phrase")
    classes = [Grams(count >= n + 2, lambda c, n=n: runs(words(c), n, f"w{n}"), lambda c, n=n: runs(words(inner(c)), n, f"w{n}")) for n in WORD_RUNS]
    for n in CHARACTER_RUNS:
        cut = lambda c, n=n: pieces(c, n, f"c{n}")
        classes.append(Grams(length >= n, cut, cut))
    return classes


def statement_hits(
    texts: DataFrame, statements: DataFrame, text_id: str, statement_id: str,
    text: str = "text", statement: str = "statement",
) -> DataFrame:
    """``(text_id, statement_id)`` where the normalized statement is contained in the normalized text.

    Blank statements are in no text.  Each statement is looked for by its rarest run of inner words
    (see `find_phrases`) and then verified.
    """
    t = texts.select(F.col(text_id).alias("text_id"), normalize_text(text).alias("text"))
    s = statements.select(F.col(statement_id).alias("phrase_id"), normalize_text(statement).alias("phrase")).filter("phrase != ''")
    found = find_phrases(t, s, _containment_classes(), lambda text, row: F.contains(text, row["phrase"]))
    return found.select(F.col("text_id").alias(text_id), F.col("phrase_id").alias(statement_id))
