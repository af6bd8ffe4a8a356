"""Long texts are folded and scanned once each, and quick ways give what the patterns give."""

import re

from concordat import vocab
from concordat.functions import measures as ms
from concordat.functions import similarity
from concordat.functions.text import collapse_ws, dehyphenate, line_form
from concordat.operators import statement as st
from concordat.plans.text_queries import unit_tokens


def test_statement_expressions_are_named_once(spark):
    """A text is collapsed, and each phrase looked for, in one place of the plan."""
    df = spark.createDataFrame([("a",)], "t string")
    plan = lambda c: df.select(c)._jdf.queryExecution().optimizedPlan().toString().split(" AS ")[0]
    region, clip = plan(st.statement_region("t").alias("o")), plan(st.clip_statement("t").alias("o"))
    assert region.count("regexp_replace(") == 2 and region.count("locate(") == len(vocab.STATEMENT_ANCHORS)
    assert clip.count("regexp_replace(") == 2 and clip.count("locate(") == len(vocab.STATEMENT_END_ANCHORS)


def test_collapse_and_dehyphenate_odd_texts(spark):
    texts = [None, "", " ", "  ", "a", "a b", "a  b", " a\tb", "a\x1cb", "a \x1f b", "a\r\n b ", "é  b", "a\xa0b", "a  b", "x\x00y", "a- b", "a-b", "a\xadb", "é- b", "a-\xa0b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", "t", collapse_ws("t").alias("c"), dehyphenate("t").alias("d"))
    for row in df.collect():
        want = None if row.t is None else " ".join(row.t.split())
        assert row.c == want, row
        assert row.d == (None if row.t is None else re.sub(r"-\s+", "", row.t.replace("\xad", ""))), row


def test_label_texts_are_scanned_in_one_place(spark, tmp_path):
    """The optimizer derives no filter that scans every text again."""
    spark.createDataFrame([(1, 1, 1, 1, "A", "F", 0.01, 0.02, 3.0)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string, l_linestatus string, l_tax double, l_discount double, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "blue anvil", 7)], "p_partkey long, p_name string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    df = unit_tokens(spark, str(tmp_path))
    assert [(r.value, r.unit) for r in df.collect()] == [(350.0, "ml"), (7.0, "%")]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 2


def test_number_is_read_once(spark):
    """A number's text is cut from its token in one place, and its parts from the text."""
    df = spark.createDataFrame([("1,234 ml 0012.50 l 007 fl oz .5gal 1e3ml",), ("a\tb \r\n 5  % ",), (None,)], "t string")
    found = ms.measures_in(line_form("t"))
    rows = [[(ms_.unit, str(ms_.value.normalize())) for ms_ in r.m or ()] for r in df.select(found.alias("m")).collect()]
    assert rows == [[("ml", "1234"), ("l", "12.5"), ("fl oz", "7"), ("gal", "0.5"), ("ml", "3")], [("%", "5")], []]
    plan = df.select(found.alias("m"))._jdf.queryExecution().optimizedPlan().toString().split(" AS ")[0]
    assert plan.count(f"^{ms.NUMBER}, 0)") == 1


def test_equal_runs_win_without_rating(monkeypatch):
    monkeypatch.setattr(similarity, "ratio", lambda a, b: 1 / 0)
    assert similarity.closest_run("blue anvil", "x BLUE Anvil, blue anvil 5ML".split()) == (1, 2, 1.0)
    assert similarity.closest_run("anvil", ["Anvil!"]) == (0, 1, 1.0)
