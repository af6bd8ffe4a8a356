"""Tables in which the rows of some keys are replaced, with a manifest of what lies where.

Keys are placed by a 64-bit hash.  A *range* is all places that share their first ``depth`` bits, and
the manifest of a version names the folder of each range and how many rows it has.  A write reads and
rewrites the ranges its keys fall in and no others; a range that has grown beyond ``RANGE_ROWS`` is
split in two, four and so on.  So the number of ranges follows the size of the table.

A version counts once its manifest is complete, which is written last: a write that fails leaves the
version before as it was, and readers of a version are not disturbed by the next one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.session import written

#: Rows above which a range is split, and rows of a file.
RANGE_ROWS = 1_000_000
_MANIFEST = "depth int, prefix bigint, folder string, n bigint"
_OWN = ("_place", "_depth", "_prefix")


def _prefix(depth: Column) -> Column:
    """The first ``depth`` bits of a row's place."""
    return F.when(depth == 0, F.lit(0).cast("bigint")).otherwise(F.expr("shiftrightunsigned(_place, 64 - _depth)"))


def versions(spark: SparkSession, path: str) -> list[int]:
    """The complete versions of a table."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(place):
        return []
    done = [s.getPath() for s in fs.listStatus(place)]
    Path = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(int(p.getName().split("=")[1]) for p in done if fs.exists(Path(p, "_SUCCESS")))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """``(depth, prefix, folder, n)``: one row per range of the newest, or the given, version."""
    known = versions(spark, path)
    if not known:
        return spark.createDataFrame([], _MANIFEST)
    return spark.read.schema(_MANIFEST).parquet(f"{path}/manifest/version={known[-1] if version is None else version}")


def read_ranges(spark: SparkSession, path: str, schema, version: int | None = None) -> DataFrame:
    """The rows of a version."""
    folders = [r.folder for r in manifest(spark, path, version).filter("folder is not null").select("folder").collect()]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def replace_rows(spark: SparkSession, df: DataFrame, path: str, key: str) -> int:
    """Makes a version in which the keys of ``df`` have the rows of ``df`` and no others, and returns its
    number.

    Keys that ``df`` does not name keep their rows.  A NULL key counts as a key.  A key with more rows
    than a range should have stays in one range, whose rows are dealt to several files.
    """
    schema = df.schema
    known = versions(spark, path)
    ranges = manifest(spark, path)
    depths = [r.depth for r in ranges.select("depth").distinct().collect()] or [0]  # at most 64
    placed = df.withColumn("_place", F.xxhash64(key)).withColumn("_depth", F.explode(F.array(*[F.lit(d) for d in depths])))
    placed = placed.withColumn("_prefix", _prefix(F.col("_depth")))
    if known:
        placed = placed.join(ranges.select(F.col("depth").alias("_depth"), F.col("prefix").alias("_prefix")), ["_depth", "_prefix"])
    new = written(placed.select(*schema.names, *_OWN), "ranges-new")
    hit = written(new.select(F.col("_depth").alias("depth"), F.col("_prefix").alias("prefix")).distinct(), "ranges-hit")
    touched = ranges.join(hit, ["depth", "prefix"], "left_semi")
    folders = [r.folder for r in touched.filter("folder is not null").select("folder").collect()]
    rows = new
    if folders:
        old = spark.read.schema(schema).parquet(*folders).withColumn("_place", F.xxhash64(key))
        # Rows of equal place but another key stay, and NULL is a key.
        named = new.select(F.col(key).alias("_key"), F.col("_place").alias("_at")).distinct()
        old = old.join(named, (F.col("_place") == F.col("_at")) & F.col(key).eqNullSafe(F.col("_key")), "left_anti")
        old = old.withColumn("_depth", F.explode(F.array(*[F.lit(d) for d in depths]))).withColumn("_prefix", _prefix(F.col("_depth")))
        old = old.join(hit.select(F.col("depth").alias("_depth"), F.col("prefix").alias("_prefix")), ["_depth", "_prefix"])
        rows = written(new.unionByName(old.select(*schema.names, *_OWN)), "ranges-rows")
    # As many bits more as its rows call for, and no more than its different keys can fill.
    sizes = rows.groupBy("_depth", "_prefix").agg(F.count(F.lit(1)).alias("_n"), F.approx_count_distinct("_place").alias("_keys"))
    more = F.ceil(F.greatest(F.least(F.log2(F.col("_n") / RANGE_ROWS), F.log2("_keys")), F.lit(0.0))).cast("int")
    base = hit.toDF("_d", "_p") if known else spark.createDataFrame([(0, 0)], "_d int, _p bigint")
    base = base.join(sizes, (F.col("_d") == F.col("_depth")) & (F.col("_p") == F.col("_prefix")), "left")
    base = base.select("_d", "_p", F.least(F.coalesce(more, F.lit(0)), 60 - F.col("_d")).alias("_more"))
    deeper = written(base.withColumn("_to", F.col("_d") + F.col("_more")), "ranges-depths")
    rows = rows.join(deeper, (F.col("_depth") == F.col("_d")) & (F.col("_prefix") == F.col("_p"))).drop("_d", "_p", "_more", "_depth", "_prefix")
    rows = rows.withColumnRenamed("_to", "_depth").withColumn("_prefix", _prefix(F.col("_depth")))
    counts = written(rows.groupBy("_depth", "_prefix").agg(F.count(F.lit(1)).alias("n")), "ranges-counts")
    version = (known[-1] if known else 0) + 1
    folder = f"{path}/rows/{version}-{uuid.uuid4().hex[:12]}"
    files = counts.select("_depth", "_prefix", F.ceil(F.col("n") / RANGE_ROWS).alias("_files"))
    dealt = rows.join(files, ["_depth", "_prefix"]).withColumn("_file", F.pmod(F.monotonically_increasing_id(), F.col("_files")))
    # Each range is a folder of its own, named by its bits.
    name = F.concat_ws("-", F.col("_depth").cast("string"), F.col("_prefix").cast("string"))
    dealt = dealt.withColumn("_range", name).repartition("_range", "_file").select(*schema.names, "_range")
    dealt.write.partitionBy("_range").parquet(folder)
    # A range without rows has no folder, but is in the manifest: the ranges cover every place.
    low = F.expr("shiftleft(_p, _more)")
    cover = deeper.select(F.col("_to").alias("_depth"), F.explode(F.sequence(low, low + F.expr("shiftleft(1L, _more)") - 1)).alias("_prefix"))
    place = F.concat(F.lit(f"{folder}/_range="), F.concat_ws("-", "_depth", "_prefix"))
    fresh = cover.join(counts, ["_depth", "_prefix"], "left").select(
        F.col("_depth").alias("depth"), F.col("_prefix").alias("prefix"), F.when(F.col("n").isNotNull(), place).alias("folder"), F.coalesce("n", F.lit(0).cast("bigint")).alias("n")
    )
    kept = ranges.join(hit, ["depth", "prefix"], "left_anti").select("depth", "prefix", "folder", "n")
    kept.unionByName(fresh).coalesce(1).write.parquet(f"{path}/manifest/version={version}")
    return version
