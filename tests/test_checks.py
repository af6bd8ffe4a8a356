"""Decision tables of the checks."""

import pytest
from pyspark.sql import functions as F

from concordat import vocab
from concordat.operators import catalog as cat
from concordat.operators import compare as cp
from concordat.operators import policy as pol
from concordat.operators import rollup as ru
from concordat.operators import statement as st

PAIR = "submission_id int, field_key string, filed string, value string, source string, confidence double"


def judge(spark, rows):
    out = cp.compare_pairs(spark.createDataFrame(rows, PAIR)).orderBy("submission_id").collect()
    return [(r.match_status, r.verdict) for r in out]


def test_bands(spark):
    rows = [
        (1, "class_type_designation", "STONE'S THROW", "Stone’s Throw", "llm", None),
        (2, "class_type_designation", "Old Tom", "label says old tom gin", "ocr", 0.9),
        (3, "class_type_designation", "Old Tom Distillery", "Old Tom Distilery", "ocr", 0.9),
        (4, "class_type_designation", "Old Tom", "quite another thing", "ocr", 0.9),
        (5, "class_type_designation", "  ", "x", "ocr", 0.9),
        (6, "class_type_designation", "x", None, "ocr", 0.9),
        (7, "class_type_designation", "Old Tom", "old tom", "ocr", 0.4),
        (8, "brand_name", "Old Tom", "quite another thing", "ocr", 0.9),
        (9, "alcohol_content", "45%", "45.3% alc", "ocr", 0.9),
        (10, "alcohol_content", "45%", "45.4% alc", "ocr", 0.9),
        (11, "net_contents", "750 ml", "0% 700 ml 750 ML", "ocr", 0.9),
        (12, "net_contents", "750 ml", "45 %", "ocr", 0.9),
        (13, "net_contents", "a bottle", "750 ml", "ocr", 0.9),
        (14, "net_contents", "750 ml", "0.75 l", "llm", None),
    ]
    assert judge(spark, rows) == [
        ("MATCH", "PASS"), ("MATCH", "PASS"), ("MISMATCH", "REVIEW"), ("MISMATCH", "FAIL"),
        ("UNVERIFIABLE", "REVIEW"), ("MISSING", "REVIEW"), ("MATCH", "REVIEW"), ("MISMATCH", "REVIEW"),
        ("MATCH", "PASS"), ("MISMATCH", "FAIL"), ("MATCH", "PASS"), ("UNVERIFIABLE", "REVIEW"),
        ("UNVERIFIABLE", "REVIEW"), ("UNVERIFIABLE", "REVIEW"),
    ]


@pytest.mark.parametrize(
    "verdicts,rolled,agreed",
    [
        (["PASS", "PASS"], "PASS", "PASS"), (["PASS", "FAIL"], "FAIL", "REVIEW"), (["PASS", "REVIEW"], "REVIEW", "PASS"),
        (["NA", "NA"], "REVIEW", "REVIEW"), (["fail", "PASS"], "REVIEW", "PASS"), (["FAIL", "REVIEW"], "FAIL", "FAIL"),
        ([None, "PASS"], "REVIEW", "PASS"), (["NA", "PASS"], "PASS", "PASS"),
    ],
)
def test_rollup_and_agreement(spark, verdicts, rolled, agreed):
    df = spark.createDataFrame([(v,) for v in verdicts], "v string")
    assert df.agg(ru.rollup_verdict("v"), ru.agree("v")).first() == (rolled, agreed)


def test_rollup_keeps_submissions_without_checks(spark):
    checks = spark.createDataFrame([(1, "PASS")], "submission_id int, verdict string")
    subs = spark.createDataFrame([(1,), (2,)], "id int")
    assert {tuple(r) for r in ru.rollup_verdicts(checks, subs).collect()} == {(1, "PASS"), (2, "REVIEW")}


FULL = vocab.STATEMENT_HEADER + " " + vocab.STATEMENT_BODY
STATEMENTS = {
    FULL: "pass",
    FULL.upper(): "pass",
    "front label\n" + FULL.replace("pregnancy", "preg-\nnancy") + "\nBrand X": "pass",
    FULL.replace("GOVERNMENT WARNING", "Government Warning"): "reworded",
    FULL.replace("General, women", "General women"): "couldnt_verify",
    FULL.replace("birth defects", "harm"): "reworded",
    FULL.replace("Surgeon", "surgeon"): "reworded",
    "drink well": "absent",
    vocab.STATEMENT_BODY: "couldnt_verify",
    "Government Warning: tagline\n" + FULL: "pass",
    "GOVERNMENT\n WARNING:   " + vocab.STATEMENT_BODY.replace(" ", "  "): "pass",
    "GOVERNMENT WARNING: " + "- " * 900 + vocab.STATEMENT_BODY: "pass",
}


def test_statement_outcomes(spark):
    df = spark.createDataFrame(list(enumerate(STATEMENTS)), "i int, text string")
    rows = st.with_statement(df, "text", "s").orderBy("i").collect()
    assert [r.s.outcome for r in rows] == list(STATEMENTS.values())
    assert rows[5].s.found.endswith("health problems.")


def test_statement_best_source(spark):
    rows = [(1, 0, "nothing"), (1, 1, FULL), (2, 0, FULL.replace("birth defects", "harm")), (2, 1, "nothing"), (3, 1, None)]
    df = spark.createDataFrame(rows, "submission_id int, source_order int, text string")
    got = {r.submission_id: r.statement.outcome for r in st.required_statement(df).collect()}
    assert got == {1: "pass", 2: "reworded", 3: "absent"}


def test_bold_flag_defers(spark):
    df = spark.createDataFrame([(FULL, True), (FULL, False)], "text string, b boolean")
    got = [r.s.verdict for r in st.with_statement(df, "text", "s", bold_unsure="b").collect()]
    assert got == ["REVIEW", "PASS"]


def test_class_type(spark):
    cases = [
        ("Bourbon", "fine vodka", "FAIL"), ("Straight Bourbon Whiskey", "bourbon", "PASS"), ("Coffee Liqueur with Rum", "liqueur", "PASS"),
        ("Oddity", "nothing", "REVIEW"), ("Single-Malt", "", "PASS"), ("virgin drum", "", "REVIEW"), ("Oddity", "rum and gin", "PASS"),
        (None, None, "REVIEW"),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, d string, o string, want string")
    out = cat.class_type(df, "d", "o").orderBy("i").collect()
    assert [r.verdict for r in out] == [c[2] for c in cases]


def test_catalog_hits_against_brute_force(spark):
    import re

    texts = ["single-malt scotch", "a single  malt!", "(gin)", "virgin gins", "rye whiskey, rye", "x_gin", ""]
    phrases = ["single malt", "gin", "rye whiskey", "rye"]
    t = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    c = spark.createDataFrame([(p,) for p in phrases], "phrase string")
    got = {tuple(r) for r in cat.catalog_hits(t, c, "id").collect()}
    want = {
        (i, p) for i, x in enumerate(texts) for p in phrases
        if re.search(r"\b" + p.replace(" ", r"[\s-]+") + r"\b", x.lower())
    }
    assert got == want


def test_statement_hits_against_brute_force(spark):
    import random

    rng = random.Random(5)
    words = ["aa", "bb", "cc", "dd", "a"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(60)]
    items = [" ".join(rng.choice(words) for _ in range(n)) for n in (1, 2, 3, 4, 6, 7, 8, 9)] + ["a", "b", "bb c"]
    items += [" ".join(t.split()[2:11])[1:] for t in texts[:8] if len(t.split()) > 12]
    t = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    s = spark.createDataFrame(list(enumerate(items)), "sid int, statement string")
    got = sorted(tuple(r) for r in st.statement_hits(t, s, "id", "sid").collect())
    assert got == sorted((i, j) for i, x in enumerate(texts) for j, y in enumerate(items) if y and y in x)


def test_abv_policy(spark):
    cases = [
        ("DISTILLED_SPIRITS", "40%", "plain", "FAIL"), ("WINE", "12%", "plain", "PASS"), ("WINE", "15%", "plain", "REVIEW"),
        ("WINE", None, "plain", "REVIEW"), ("MALT_BEVERAGE", None, "30% off", "REVIEW"), ("CIDER", None, "plain", "REVIEW"),
        ("WINE", "12%", "alc 12% by vol", "PASS"), ("WINE", "12%", "100% estate grown", "PASS"), ("WINE", "12%", "alcohol 12%", "FAIL"),
    ]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "id int, beverage_type string, alcohol_content string, text string")
    got = pol.format_checks(df, ("abv_format", "nothing_known")).orderBy("id").collect()
    assert [r.verdict for r in got if r.check_key == "abv_format"] == [c[3] for c in cases]
    assert {r.verdict for r in got if r.check_key == "nothing_known"} == {"REVIEW"}


def test_catalog_of_any_width(spark):
    """Every one of 200 keywords is told apart, alone and merged over rows."""
    from concordat.operators import catalog as cat

    catalog = {f"kw{i}x": f"g{i % 7}" for i in range(200)}
    rows = [(i, f"a kw{i}x here and kw{(i * 3) % 200}x") for i in range(200)] + [(500, "nothing"), (501, None)]
    df = spark.createDataFrame(rows, "k int, t string").select("k", cat.keyword_mask(F.col("t"), catalog).alias("m"))
    for r in df.select("k", cat.keywords_in(F.col("m"), catalog).alias("w"), cat.groups_in(F.col("m"), catalog, ("g0",)).alias("g")).collect():
        numbers = {r.k, (r.k * 3) % 200} if r.k < 200 else set()
        assert r.w == [f"kw{i}x" for i in sorted(numbers)]
        assert r.g == sorted({f"g{i % 7}" for i in numbers} - {"g0"})
    merged = spark.createDataFrame(rows, "k int, t string").withColumn("part", F.col("k") % 2)
    got = {r.part: r.w for r in cat.keyword_sets(merged, ["part"], "t", catalog).select("part", cat.keywords_in(F.col("mask"), catalog).alias("w")).collect()}
    # Odd rows name odd keywords only, even rows even ones.
    assert got == {p: [f"kw{i}x" for i in range(p, 200, 2)] for p in (0, 1)}


@pytest.mark.parametrize("small", [False, True])
def test_phrases_with_a_hot_gram(spark, monkeypatch, small):
    """Nine of ten texts share every gram of one phrase; keys and groups are split where they are many."""
    from concordat.operators import phrases as ph

    if small:
        monkeypatch.setattr(ph, "KEY_TEXTS", 7)
        monkeypatch.setattr(ph, "TEXT_PHRASES", 2)
    texts = [(i, f"so begins the common passage of number {i % 13} that all share" if i % 10 else f"other text {i}") for i in range(200)] + [(900, None), (901, "")]
    items = ["begins the common passage of number 3 that", "the common passage", "common passage of", "o", "her tex", "number 7", "absent words here", "", "x", "all share", "number 1"]
    t = spark.createDataFrame(texts, "id int, text string")
    s = spark.createDataFrame(list(enumerate(items)), "sid int, statement string")
    got = sorted(tuple(r) for r in st.statement_hits(t, s, "id", "sid").collect())
    assert got == sorted((i, j) for i, x in texts for j, y in enumerate(items) if y and x and y in x)
    assert st.statement_hits(t, s.limit(0), "id", "sid").count() == 0
    hits = sorted(tuple(r) for r in cat.catalog_hits(t, s.select(F.col("statement").alias("phrase")), "id").collect())
    whole = lambda x, y: f" {y} " in f" {x} "
    assert hits == sorted((i, y) for i, x in texts for y in items if y and x and whole(x, y))


def test_equal_pairs_of_texts_are_rated_once(spark):
    from concordat.functions.similarity import best_ratio
    from concordat.operators import compare as cp

    texts = ["old tum gin", "old tam", "old tom gin", "", None]
    rows = [(i, "brand_name", "Old Tom", texts[i % 5], "ocr", 0.9) for i in range(200)]
    df = spark.createDataFrame(rows, "submission_id long, field_key string, filed string, value string, source string, confidence double")
    rated = spark.sparkContext.accumulator(0)
    count = lambda a, b: rated.add(1) or best_ratio(a, b)
    from pyspark.sql import functions as F

    saved, cp.best_similarity = cp.best_similarity, F.udf(count, "double")
    try:
        got = {r.submission_id: r.similarity for r in cp.compare_pairs(df).collect()}
    finally:
        cp.best_similarity = saved
    assert len(got) == 200 and rated.value == 2
    assert [got[i] for i in (0, 1, 2)] == [best_ratio("old tom", texts[0]), best_ratio("old tom", texts[1]), 1.0]
    assert got[195] == got[0]
