from concordat.functions.jsonfields import json_scalar


def test_a_number_is_no_transcription(spark):
    df = spark.createDataFrame([('{"w": 5}',), ('{"w": "5"}',)], "j string")
    assert [r[0] for r in df.select(json_scalar("j", "w", numbers=False)).collect()] == [None, "5"]
