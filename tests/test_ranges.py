"""Replacing writes by a manifest of ranges against a dictionary."""

import random

from concordat.session import work_dir


def test_versions_equal_a_dictionary_and_touch_their_ranges_only(spark, monkeypatch):
    from concordat.sources import ranges as rg

    monkeypatch.setattr(rg, "RANGE_ROWS", 25)
    r, path, want = random.Random(7), work_dir(spark, "ranges"), {}
    schema = "k long, v string"
    assert rg.versions(spark, path) == [] and rg.read_ranges(spark, path, schema).count() == 0
    for version in range(1, 5):
        keys = [None, 5, *r.sample(range(150), 60 if version == 1 else 3)]
        # One key holds a third of all rows.
        rows = [(k, f"{version}-{k}-{n}") for k in keys for n in range(60 if k == 5 else r.randint(1, 3))]
        rows.append(rows[0])
        for k in keys:
            want[k] = [row for row in rows if row[0] == k]
        before = {(x.depth, x.prefix): x.folder for x in rg.manifest(spark, path).collect()}
        assert rg.replace_rows(spark, spark.createDataFrame(rows, schema), path, "k") == version
        got = rg.read_ranges(spark, path, schema).collect()
        assert sorted(map(tuple, got), key=str) == sorted((row for rows in want.values() for row in rows), key=str)
        after = {(x.depth, x.prefix): (x.folder, x.n) for x in rg.manifest(spark, path).collect()}
        assert sum(n for _, n in after.values()) == len(got)
        # The ranges cover every place once.
        assert sum(2.0**-depth for depth, _ in after) == 1
        if version > 1:
            kept = [key for key, folder in before.items() if after.get(key, (None, 0))[0] == folder]
            assert len(kept) >= len(before) - len(keys)
    assert len(after) > 4 and rg.versions(spark, path) == [1, 2, 3, 4]
    assert rg.read_ranges(spark, path, schema, version=1).count() > 0
    # Keys that fall where no key was before, also after a first write of nothing.
    other = work_dir(spark, "ranges")
    for version, keys in enumerate([[], [1], range(40), range(1000, 1200)], 1):
        assert rg.replace_rows(spark, spark.createDataFrame([(k, "x") for k in keys], schema), other, "k") == version
    assert sorted(x.k for x in rg.read_ranges(spark, other, schema).collect()) == [*range(40), *range(1000, 1200)]
    # No rows: a version like the one before.
    assert rg.replace_rows(spark, spark.createDataFrame([], schema), path, "k") == 5
    assert rg.read_ranges(spark, path, schema).count() == sum(map(len, want.values()))
