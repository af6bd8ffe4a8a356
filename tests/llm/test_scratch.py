"""Folders of a stage go once nothing reads them."""

import os


def test_folders_are_dropped_unless_read(spark):
    from concordat.llm.common import SCRATCH, stored

    kept = stored(spark.range(3), "other")
    with SCRATCH.recording():
        a, b = stored(spark.range(5), "first"), stored(spark.range(7), "second")
    places = [df.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0] for df in (a, b)]
    SCRATCH.drop(spark, b.filter("id > 1"))
    assert [os.path.exists(p) for p in places] == [False, True] and b.count() == 7 and kept.count() == 3
    SCRATCH.drop(spark)
    assert not os.path.exists(places[1]) and not SCRATCH.paths and kept.count() == 3
