"""The pipeline against brute force, stage by stage, over small tables."""

import hashlib
import re

import numpy as np
import pytest
from test_operators import classes_by_force, prose, removal_by_force, tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, documents, tmp_path):
    shared = prose(900, 90)
    items = [(i, prose(1000 + i, 25) + ". " + prose(2000 + i, 4)) for i in range(20)]
    rows = []
    for i in range(200):
        text = prose(i, 60) + (" you rotten fiend" if i % 5 == 0 else "")
        if i % 20 == 1:
            text = f"{prose(i, 30)} {shared} {prose(i + 500, 30)}"
        if i % 20 == 2:
            text += " " + items[i // 20][1].upper()
        rows.append((i, text))
    rows += [(300, rows[7][1]), (301, rows[8][1].replace(" ", "  ")), (302, rows[9][1] + " more"), (400, ""), (401, None)]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    marks = [(i, int(i % 5 == 0)) for i in range(200)]
    spark.createDataFrame(marks, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, after = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns, name
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.schema(docs.schema).parquet(f"{tmp_path}/{name}")
        after.append({r.doc_id: r.text for r in docs.collect()})

    want = {i: t for i, t in rows if not (i < 200 and i % 5 == 0)}
    assert after[0] == want
    want = {i: t for (i, t), (_, c, _) in zip(want.items(), classes_by_force(list(want.items()))) if c == str(i)}
    assert after[1] == want and not {300, 301, 302} & set(want)
    force = removal_by_force(list(want.values()), 400)
    got = [(after[2][i], f) for i, f in zip(want, force)]
    assert all(hashlib.sha256((t or "").encode()).hexdigest() == f[3] for t, f in got) and sum(f[1] for _, f in got) > 0
    held = lambda text: any(re.sub(r"[.]", "", t).lower() in re.sub(r"[.]", "", text or "").lower() for _, t in items)
    assert set(after[3]) == {i for i, t in after[2].items() if not held(t)}
    _, library = tokenizer("word_bpe_49k.json")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == set(after[3])
    for r in out:
        ids = library.encode(after[3][r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_stages_decide_by_row(spark, documents, tmp_path):
    item = prose(1000, 25) + ". " + prose(2000, 4)
    bad, fine = prose(1, 60) + " you rotten fiend", [prose(10 + i, 60) for i in range(8)]
    leak = f"{prose(3, 40)} {item} {prose(4, 40)}"
    train = [(100 + i, prose(100 + i, 60) + (" you rotten fiend" if i % 5 == 0 else "")) for i in range(100)]
    spark.createDataFrame([(100 + i, int(i % 5 == 0)) for i in range(100)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)

    def left(stage, rows):
        out = stages[stage](spark, documents(rows), str(tmp_path))
        return sorted(((str(r.doc_id), r.text) for r in out.collect() if r.doc_id is None or r.doc_id < 100), key=str)

    assert left("toxicity", [(None, bad), (7, bad), (7, fine[0]), (None, fine[1]), *train]) == [("7", fine[0]), ("None", fine[1])]
    assert left("decontamination", [(None, leak), (7, leak), (7, fine[0]), (None, fine[1])]) == [("7", fine[0]), ("None", fine[1])]
    near = [(5, fine[0]), (5, fine[0]), (5, fine[1]), (6, fine[1]), (6, fine[2]), (None, fine[3]), (None, fine[3]), (None, fine[3] + " more"), (None, fine[0]), (8, None), (8, "")]
    want = [("5", fine[0]), ("5", fine[1]), ("6", fine[2]), ("8", ""), ("8", None)]
    got = left("near_duplicates", near)
    assert sorted(map(str, [g for g in got if g[0] != "None"])) == sorted(map(str, want))
    assert [g for g in got if g[0] == "None"] in ([("None", fine[3])], [("None", fine[3] + " more")])
