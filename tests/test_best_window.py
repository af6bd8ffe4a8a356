"""The closest run of words over dealt documents."""

from concordat.plans.text_queries import best_window
from concordat.session import work_dir


def test_documents_are_ranked_without_their_texts(spark):
    sf = work_dir(spark, "sf")
    texts = [(i, f"some words before harbor lane {i} and after") for i in range(7)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([("harbor lane",), ("words before",), ("harbor lane",)], "p_name string").write.parquet(f"{sf}/part.parquet")
    df = best_window(spark, sf)
    assert {(r.doc_id, r.window, r.score) for r in df.collect()} == {(i, "words before" if i % 2 else "harbor lane", 1.0) for i in range(7)}
    lines = df._jdf.queryExecution().optimizedPlan().toString().split("\n")
    windows = [i for i, line in enumerate(lines) if "Window [row_number()" in line and "_slice" in line]
    assert windows and all("text#" not in lines[i + 1] for i in windows)
