"""Measures are compared without lambdas that Spark would interpret, and as `closest` does it."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from concordat.functions.measures import measures_by_line, parse_numeric
from concordat.operators import compare as cp

LONG = "7" * 45
TEXTS = [
    None, "", "  ", "750 ml", "750ML", "NET 0,750.50 mL | 12% alc", "1,750 ml 1,7500 ml", "749.7 ml\n750.3 ml", "750\nml", "750\t ML", "750\x1fml", "750\r\nml 751 ml",
    "-0 ml", "-.5 ml +.5 ml", "00.30 %", "12.3%", "12.30000000000000000000001 %", f"{LONG} ml", f"{LONG}.0 ml x {LONG}1 ml", "７５０ ﬂ oz", "750 fl. oz.", "3 FL OZ 4 oz", "0.0000000001 ml",
    "0.00000000001 ml", "1.2.3 ml", "5 mlx", "x", "é 750 ML\x85751 ml", "0" * 60 + "1 ml", "1." + "0" * 60 + " ml",
]


@pytest.mark.parametrize("field", ["net_contents", "alcohol_content"])
def test_nearest_equals_closest(spark, field):
    df = spark.createDataFrame([(t,) for t in TEXTS], "filed string").crossJoin(spark.createDataFrame([(t,) for t in TEXTS], "value string"))
    near = cp.closest(parse_numeric("filed", field), measures_by_line("value"))
    want = cp.guard(F.col("filed"), F.col("value"), cp.numeric_outcome(parse_numeric("filed", field), near, cp.vocab.TOLERANCE[field]))
    rows = cp.compare_numeric(df.withColumn("want", want), field).collect()
    assert len(rows) == len(TEXTS) ** 2 and {r.want.match_status for r in rows} == {"MATCH", "MISMATCH", "MISSING", "UNVERIFIABLE"}
    for r in rows:
        assert r.result == r.want, r


def test_measures_are_compared_without_interpreted_lambdas(spark):
    df = spark.createDataFrame([("750 ml", "700 ml 749 ml")], "filed string, value string")
    out = cp.compare_numeric(df, "net_contents", tolerance=Decimal(1))
    assert out.first().result.detail == "750ml is 749ml (±1)"
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
