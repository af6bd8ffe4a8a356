"""Scalar semantics, each case over a small frame."""

import random
import unicodedata
from decimal import Decimal
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from concordat.functions import jsonfields as js
from concordat.functions import measures as ms
from concordat.functions import similarity as sim
from concordat.functions import text as tx


def one(spark, values, build, schema="v string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(build(F.col("v"))).collect()]


def test_normalize_text(spark):
    cases = {
        "STONE’S  THROW": "stone's throw",
        "Stone's Throw.": "stone's throw",
        "  a\tb \n c!? ": "a b c",
        "Straße": "strasse",
        "ﬁne Ｗine": "fine wine",
        " pad ": "pad",
        "“Quote”…": '"quote',
        "x\x1fy": "x y",
        None: "",
        "   ": "",
    }
    assert one(spark, list(cases), tx.normalize_text) == list(cases.values())


def test_normalize_matches_python_on_random_text(spark):
    rng = random.Random(7)
    alphabet = "aB ß\t éİﬁ’\"….,;x1\n Ⅷ"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(300)]

    def expected(s):
        s = unicodedata.normalize("NFKC", " ".join(s.split())).casefold()
        return s.translate(str.maketrans(tx.STRAIGHT_QUOTES)).rstrip(tx.TRAILING_MARKS)

    assert one(spark, texts, tx.normalize_text) == [expected(t) for t in texts]


def test_has_value(spark):
    assert one(spark, ["a", " ", " \n", None, ""], tx.has_value) == [True, False, False, False, False]


@pytest.mark.parametrize(
    "text,expected",
    [
        ("750 ml", [("750", "ml")]),
        ("750ML | 12.5% ALC./VOL.", [("750", "ml"), ("12.5", "%")]),
        ("1,000 ml", [("1000", "ml")]),
        ("1,5 l", []),
        ("1.2.3 %", []),
        ("16 FL OZ and 15.5 Gallons", [("16", "fl oz"), ("15.5", "gal")]),
        ("90 Proof (45%)", [("90", "proof"), ("45", "%")]),
        ("5 lakes", []),
        ("７５０ ｍｌ", [("750", "ml")]),
        ("12 fl. oz.", [("12", "fl oz")]),
        ("-750 ml", [("-750", "ml")]),
    ],
)
def test_parse_all_numeric(spark, text, expected):
    got = one(spark, [text], lambda c: ms.parse_all_numeric(c, "net_contents"))[0]
    assert [(m.value, m.unit) for m in got] == [(Decimal(v), u) for v, u in expected]


def test_parse_is_for_measured_fields_only(spark):
    assert one(spark, ["750 ml"], lambda c: ms.parse_numeric(c, "brand_name")) == [None]


def test_lines_do_not_join_tokens(spark):
    assert one(spark, ["750\nml 5 l"], lambda c: F.size(ms.measures_by_line(c))) == [1]


def test_normalize_field(spark):
    got = one(spark, ["45.0% Alc./Vol.", "45 % alc", "about half"], lambda c: ms.normalize_field(c, "alcohol_content"))
    assert got == ["45 %", "45 %", "about half"]


def test_pick_abv_and_size(spark):
    texts = ["30% off every case you buy this week\nAlc. 12% by vol", "100% natural", "45%\nAlc./Vol.", "NET 750 ml, and you may pour servings of 50 ml", "1.75 L", "-750 ml", "12 liters"]
    df = spark.createDataFrame([(t,) for t in texts], "v string").withColumn("t", ms.unit_tokens("v", spans=True))
    rows = df.select(ms.pick_abv(F.col("t"), "v").alias("abv"), ms.pick_size_ml(F.col("t")).alias("ml"), "t").collect()
    assert [r.abv for r in rows] == [Decimal(12), None, Decimal(45), None, None, None, None]
    assert [r.ml for r in rows] == [None, None, None, Decimal(750), Decimal(1750), None, None]
    assert [(t.start, t.end) for t in rows[0].t] == [(0, 3), (42, 45)]


def test_json_scalar(spark):
    payloads = ['{"k": "a"}', '{"k": 45.0}', '{"k": 45}', '{"k": ["x"]}', '{"k": true}', '{"k": null}', '{"k": " "}', "[1]", "no", "{}"]
    assert one(spark, payloads, lambda c: js.json_scalar(c, "k")) == ["a", "45", "45"] + [None] * 7


def test_best_ratio_is_exact():
    rng = random.Random(3)
    words = ["old", "tom", "gin", "stone", "throw", "distillery", "a", "ab", "750"]
    for _ in range(400):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))
        needle = " ".join(rng.choice(words) for _ in range(rng.randint(1, 4)))
        parts, n = text.split(), len(needle.split())
        runs = [text] + ([" ".join(parts[i : i + n]) for i in range(len(parts) - n + 1)] if len(parts) > n else [])
        brute = max(SequenceMatcher(None, needle, r).ratio() for r in runs)
        assert sim.best_ratio(needle, text) == brute


def test_char_diff(spark):
    df = spark.createDataFrame([("abc", "axc"), (None, "x")], "a string, b string")
    got = [r[0] for r in df.select(sim.char_diff("a", "b")).collect()]
    assert [(d.op, d.segment) for d in got[0]] == [("equal", "a"), ("replace", "b→x"), ("equal", "c")]
    assert got[1] is None


def test_exact_numbers(spark):
    from decimal import getcontext, localcontext

    from concordat.functions import exact

    r = random.Random(2)

    def number():
        whole = "".join(r.choice("0123456789") for _ in range(r.randint(0, r.choice([3, 20, 60]))))
        places = "".join(r.choice("0019") for _ in range(r.randint(0, r.choice([0, 2, 30]))))
        return r.choice(["", "-", "+"]) + ((whole or "0") if not places else f"{whole}.{places}")

    rows = [(number(), number()) for _ in range(300)]
    rows += [(a, a + ("1" if "." in a else ".0001")) for a, _ in rows[:100]]
    df = spark.createDataFrame(rows, "a string, b string")
    df = df.select("a", "b", exact.plain(F.col("a")).alias("pa"), exact.plain(F.col("b")).alias("pb"))
    df = df.select("*", exact.gap(F.col("pa"), F.col("pb")).alias("gap"), exact.magnitude_key(F.col("pa")).alias("ka"), exact.magnitude_key(F.col("pb")).alias("kb"))
    with localcontext() as context:
        context.prec = 200

        def plain(x):
            text = f"{x:f}"
            return "0" if x == 0 else text.rstrip("0").rstrip(".") if "." in text else text

        for row in df.collect():
            a, b = Decimal(row.a), Decimal(row.b)
            assert (row.pa, row.pb, row.gap) == (plain(a), plain(b), plain(abs(a - b)))
            assert (row.ka < row.kb) == (abs(a) < abs(b)) and (row.ka == row.kb) == (abs(a) == abs(b))
    texts = ["1e30", "-2.5e-4", "12.50e1", "0e5", ".5", "5.", "e5", ".", "", "x", None]
    got = one(spark, texts, lambda c: exact.plain(F.col(c) if isinstance(c, str) else c))
    assert got == ["1" + "0" * 30, "-0.00025", "125", "0", "0.5", "5", None, None, None, None, None]


def test_measures_beyond_decimals(spark):
    from concordat.functions.measures import parse_numeric, shown_number
    from concordat.operators.compare import compare_numeric

    long = "7" * 40
    rows = [
        ("750.00000000001 ml", "750 ml"), ("750 ml", "750.000000000000 ml"), (f"{long} ml", f"net {long}ml | 5 ml"), (f"{long} ml", f"{long[:-1]}8 ml"),
        ("45.000000000001%", "45.3%"), ("45%", "45.300000000000000000001%"), ("45%", "45.3%"), ("-0.5%", "0.1%"),
    ]
    df = spark.createDataFrame(rows, "filed string, value string")
    nets = [r.result.match_status for r in compare_numeric(df, "net_contents").collect()]
    assert nets[:4] == ["MISMATCH", "MATCH", "MATCH", "MISMATCH"]
    strengths = [r.result.match_status for r in compare_numeric(df, "alcohol_content").collect()]
    assert strengths[4:] == ["MATCH", "MISMATCH", "MATCH", "MISMATCH"]
    assert one(spark, [f"{long}.5000 ml"], lambda c: shown_number(parse_numeric(c, "net_contents"))) == [f"{long}.5"]


def test_json_members(spark):
    payloads = [
        '{"k": 1, "k": "last"}', '{"k": 123456789012345678901234567890123456789012}', '{"k": 1e30}', '{"k": 2.50e-1}', '{"k": {"a": 1, "a": 2}}',
        '{"z": {"a": 1, "a": 2}, "k": "v"}', '{"k": 1} and more', '{"k": 1}{"k": 2}', "{'k': 1}", '{"k": -0}', '{"k": "a", "k": null}', '{"k": "45 %"}', None, "",
    ]
    got = one(spark, payloads, lambda c: js.json_scalar(c, "k"))
    assert got == ["last", "123456789012345678901234567890123456789012", "1" + "0" * 30, "0.25", None, "v", None, None, None, "0", None, "45 %", None, None]


def test_parse_all_numeric_query_shows_long_numbers(spark, tmp_path):
    import duckdb

    from concordat.plans import registry

    registry.load_all()
    path = str(tmp_path / "documents.parquet")
    rows = [(1, "a 123456789012345678901234567 ml b", 9), (2, "a 0.12345678901234 oz, b 7 l x", 9)]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").write.parquet(path)
    got = registry.QUERIES["parse_all_numeric"](spark, str(tmp_path)).collect()
    sql = registry.ORACLES["parse_all_numeric"].replace("from documents", f"from '{path}/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(duckdb.sql(sql).fetchall())


def test_edit_distance_of_long_texts(spark):
    """The subsequence test gives what the table gives, whatever the characters are."""
    r = random.Random(4)
    letters = "ab\\]^-$[.\n é😀E"
    rows = [("".join(r.choices(letters, k=r.randrange(0, 60))), "".join(r.choices(letters, k=r.randrange(0, 9)))) for _ in range(300)]
    df = spark.createDataFrame([*rows, ("x" * 3000, "x" * 1500), (None, "a")], "a string, b string")
    got = df.select("a", "b", tx.edit_distance(F.col("a"), F.col("b")).alias("n"), F.levenshtein("a", "b").alias("want")).collect()
    assert [x.n for x in got] == [x.want for x in got]


def test_edit_rate_ranks_ids_without_their_texts(spark, tmp_path):
    from concordat.plans import registry

    registry.load_all()
    docs = [(i, f"some text {i}") for i in (5, 9, 9, 70, 71)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "some"), (2, "text")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = registry.QUERIES["edit_rate"](spark, str(tmp_path))
    assert sorted((x.doc_id, x.item_id) for x in out.collect()) == [(5, 1), (9, 1), (9, 2), (70, 2), (71, 1)]
    # No exchange of texts gathers them on one key.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Window" in line and "all#" in line and "text#" in line]


def test_windows_that_recur_are_rated_once():
    """Two texts that share most windows; long windows are not kept."""
    sim._short_ratio.cache_clear()
    first, second = "old tam gin net 500ml extra", "new tam gin net 500ml extra"
    got = [sim.best_ratio("tom gin net", t) for t in (first, second)]
    before = sim._short_ratio.cache_info()
    assert before.hits and before.currsize
    assert got == [max(SequenceMatcher(None, "tom gin net", w).ratio() for w in [t, *(" ".join(t.split()[i : i + 3]) for i in range(4))]) for t in (first, second)]
    assert sim.ratio("a" * 200, "b") == 0.0 and sim._short_ratio.cache_info().currsize == before.currsize
