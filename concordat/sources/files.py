"""Reading and writing the engine's files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from concordat import schemas, vocab
from concordat.functions.text import lookup, nullify_blank
from concordat.sources.cleaning import PRODUCT_TYPES

CSV_OPTIONS = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"', "mode": "PERMISSIVE"}


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """The golden corpus as text columns, without inference."""
    return spark.read.options(**CSV_OPTIONS).schema(schemas.CORPUS_CSV).csv(path)


def nullified(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[nullify_blank(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def load_submissions(spark: SparkSession, path: str) -> DataFrame:
    """Filed columns with blanks as NULL and the first status; typed dates."""
    df = nullified(read_corpus(spark, path).select(*schemas.FILED_COLUMNS), schemas.FILED_COLUMNS)
    return (
        df.withColumn("application_date", F.col("application_date").try_cast("date"))
        .withColumn("submitted_at", F.try_to_timestamp("submitted_at"))
        .withColumn("status", F.lit("RECEIVED"))
    )


def last_per_key(df: DataFrame, key: str, order: Sequence[Column | str]) -> DataFrame:
    """The last row of each key; keys are trimmed and blank keys dropped."""
    keyed = df.withColumn(key, nullify_blank(key)).filter(F.col(key).isNotNull())
    rank = W.partitionBy(key).orderBy(*[F.col(c).desc() if isinstance(c, str) else c.desc() for c in order])
    return keyed.withColumn("_rank", F.row_number().over(rank)).filter("_rank = 1").drop("_rank")


def load_gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold values by key; the last row of the file wins.

    File order is the file name and then the row order Spark numbers inside it:
    a multi-line CSV file is read as one partition.
    """
    df = read_corpus(spark, path).select("ttb_id", *schemas.GOLD_COLUMNS).withColumns(
        {"_file": F.input_file_name(), "_row": F.monotonically_increasing_id()}
    )
    gold = last_per_key(df, "ttb_id", ("_file", "_row"))
    return nullified(gold.select("ttb_id", *schemas.GOLD_COLUMNS), schemas.GOLD_COLUMNS)


def explode_manifest(df: DataFrame, json_col: str = "images", key: str = "ttb_id") -> tuple[DataFrame, DataFrame]:
    """``(images, rejected)``: one row per listed image, and the rows whose list
    is broken, not a list, too long, or has an entry without a file name."""
    v = F.try_parse_json(F.coalesce(nullify_blank(json_col), F.lit("[]")))
    kind = F.schema_of_variant(v)
    entries = F.from_json(F.coalesce(nullify_blank(json_col), F.lit("[]")), schemas.MANIFEST)
    named = F.from_json(F.coalesce(nullify_blank(json_col), F.lit("[]")), "array<map<string,string>>")
    reason = (
        F.when(v.isNull(), "malformed JSON")
        .when(~kind.startswith("ARRAY"), "not a list")
        .when(F.size(named) > vocab.MAX_IMAGES, "too many images")
        .when(
            named.isNull() | F.exists(named, lambda m: m.isNull() | ~F.map_contains_key(m, "filename")),
            "entry without a file name",
        )
    )
    marked = df.withColumn("reject_reason", reason)
    good = marked.filter("reject_reason is null").select(
        key, F.posexplode(entries).alias("ordinal", "_i")
    ).select(
        key, "ordinal", F.col("_i.role").alias("image_role"), "_i.position", "_i.filename",
        "_i.mime_type", "_i.width_px", "_i.height_px", "_i.file_size_bytes",
    )
    return good, marked.filter("reject_reason is not null").select(key, "reject_reason")


def split_list(df: DataFrame, cols: Sequence[str], sep: str = "|") -> DataFrame:
    """Separated list columns to one row per element, kept in step."""
    quoted = "\\" + sep
    arrays = F.arrays_zip(*[F.split(F.col(c), quoted, -1).alias(c) for c in cols])
    rest = [c for c in df.columns if c not in cols]
    return df.select(*rest, F.posexplode(arrays).alias("pos", "_z")).select(
        *rest, "pos", *[F.trim(F.col("_z")[c]).alias(c) for c in cols]
    )


def read_evolved(spark: SparkSession, paths: Sequence[str], schema: str, defaults: dict | None = None) -> DataFrame:
    """Parquet files of different ages as one frame of the current schema."""
    from pyspark.sql.types import StructType

    wanted = StructType.fromDDL(schema)
    out = None
    for path in paths:
        part = spark.read.parquet(path)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    for f in wanted.fields:
        if f.name not in out.columns:
            out = out.withColumn(f.name, F.lit(None).cast(f.dataType))
    out = out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted.fields])
    return out.fillna(defaults) if defaults else out


def write_readings(df: DataFrame, path: str) -> None:
    """Append readings, one row per (image, engine, variant), never merged."""
    df.write.mode("append").partitionBy("engine_name", "image_variant").parquet(path)


def bucket(key: str, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def write_replacing(spark: SparkSession, df: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """Write rows so that a re-run replaces, not appends, the rows of its keys.

    The table is partitioned by a hash bucket of the key; only the buckets that
    the new rows fall in are rewritten, with the other keys of those buckets
    carried over through a checkpointed copy.
    """
    from pyspark.errors import AnalysisException

    new = df.withColumn("_bucket", bucket(key, buckets))
    try:
        old = spark.read.parquet(path)
    except AnalysisException:
        new.repartition("_bucket").write.partitionBy("_bucket").parquet(path)
        return
    touched = new.select("_bucket").distinct()
    kept = (
        old.join(F.broadcast(touched), "_bucket", "left_semi")
        .join(new.select(key).distinct(), key, "left_anti")
        .select(*new.columns)
    )
    staged = checkpointed(kept.unionByName(new))
    (
        staged.repartition("_bucket")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("_bucket")
        .parquet(path)
    )


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable copy in the shared folder, safe against executor loss."""
    from concordat.session import work_dir

    spark = df.sparkSession
    where = work_dir(spark, "stage")
    df.write.parquet(where)
    return spark.read.schema(df.schema).parquet(where)


def reload(df: DataFrame, path: str, only_if_empty: bool = False) -> bool:
    """Replace a table as a whole; optionally only where it holds nothing yet.

    The new version is written beside the old one and published by one rename of
    a pointer file, so a reader sees the old table or the new one.
    """
    spark = df.sparkSession
    if only_if_empty and current_version(spark, path) is not None:
        if not spark.read.parquet(current_version(spark, path)).isEmpty():
            return False
    import uuid

    version = f"v-{uuid.uuid4().hex[:12]}"
    df.write.parquet(f"{path}/{version}")
    jvm, fs, root = _filesystem(spark, path)
    staged = jvm.org.apache.hadoop.fs.Path(f"{path}/.{version}.next")
    stream = fs.create(staged, True)
    stream.write(bytearray(version, "utf-8"))
    stream.close()
    pointer = jvm.org.apache.hadoop.fs.Path(f"{path}/_CURRENT-{_next_number(fs, root):010d}")
    fs.rename(staged, pointer)
    return True


def current_version(spark: SparkSession, path: str) -> str | None:
    """Folder of the published version of a table written by `reload`."""
    jvm, fs, root = _filesystem(spark, path)
    if not fs.exists(root):
        return None
    names = sorted(
        s.getPath().getName() for s in fs.listStatus(root) if s.getPath().getName().startswith("_CURRENT-")
    )
    if not names:
        return None
    stream = fs.open(jvm.org.apache.hadoop.fs.Path(f"{path}/{names[-1]}"))
    try:
        return f"{path}/{jvm.org.apache.commons.io.IOUtils.toString(stream, 'UTF-8')}"
    finally:
        stream.close()


def _filesystem(spark: SparkSession, path: str):
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, root.getFileSystem(spark._jsc.hadoopConfiguration()), root


def _next_number(fs, root) -> int:
    taken = [
        int(s.getPath().getName().rsplit("-", 1)[1])
        for s in fs.listStatus(root)
        if s.getPath().getName().startswith("_CURRENT-")
    ]
    return max(taken, default=0) + 1


RANK_SLICE = 1_000_000


def spread_rank(df: DataFrame, key: str, order: str, out: str, ties: Sequence[str] = ()) -> DataFrame:
    """1-based rank by a whole-number column, then by ``ties``, inside ``key``, in bounded groups.

    Rows are ranked inside (key, slice of the order column) and moved up by the
    sizes of the slices before, so a hot key is shared by many tasks.
    """
    sliced = df.withColumn("_slice", F.floor(F.col(order) / RANK_SLICE))
    sizes = sliced.groupBy(key, "_slice").agg(F.count(F.lit(1)).alias("_c"))
    before = W.partitionBy(key).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    inside = W.partitionBy(key, "_slice").orderBy(order, *ties)
    return (
        sliced.withColumn("_in", F.row_number().over(inside))
        .join(sizes, [key, "_slice"])
        .withColumn(out, (F.col("_in") + F.col("_before")).cast("bigint"))
        .drop("_in", "_before", "_slice")
    )


def mint_keys(new: DataFrame, existing: DataFrame, order: str, key: str = "ttb_id") -> DataFrame:
    """Copies under fresh keys ``<stem>-ENQ<n>`` with the lowest free numbers.

    The r-th free number of a stem is r plus the taken numbers below it.  If the
    k-th taken number is n, then n - k numbers are free before it, so it lies
    below the r-th free number exactly when n - k < r.  Ranks and this look-up
    run in slices, never over a whole stem at once.  ``order`` is a whole-number
    column that numbers the copies.
    """
    stem = F.coalesce(nullify_blank(key), F.lit("ENQUEUED"))
    wanted = spread_rank(new.withColumn("_stem", stem), "_stem", order, "_rank")
    pattern = "^(.*)-ENQ([1-9]\\d*)$"
    taken = (
        existing.select(
            F.regexp_extract(key, pattern, 1).alias("_stem"), F.regexp_extract(key, pattern, 2).alias("_n")
        )
        .filter("_n != ''")
        # A number beyond 18 digits lies above every number that is minted.
        .withColumn("_n", F.when(F.length("_n") > 18, F.lit(10**18)).otherwise(F.col("_n").cast("bigint")))
        .join(wanted.select("_stem").distinct(), "_stem", "left_semi")
        .distinct()
    )
    gaps = (
        spread_rank(taken, "_stem", "_n", "_k")
        .groupBy("_stem", (F.col("_n") - F.col("_k") + 1).alias("_rank"))
        .agg(F.max("_k").alias("_skip"))
    )
    part = F.floor(F.col("_rank") / RANK_SLICE).alias("_part")
    marks = wanted.select("_stem", "_rank", part, F.lit(1).alias("_is")).unionByName(
        gaps.select("_stem", "_rank", part, F.lit(0).alias("_is"), "_skip"), allowMissingColumns=True
    )
    earlier = W.partitionBy("_stem").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    carry = (
        marks.groupBy("_stem", "_part")
        .agg(F.max("_skip").alias("_top"))
        .select("_stem", "_part", F.max("_top").over(earlier).alias("_carry"))
    )
    upto = W.partitionBy("_stem", "_part").orderBy("_rank", "_is").rowsBetween(W.unboundedPreceding, W.currentRow)
    skips = (
        marks.withColumn("_seen", F.max("_skip").over(upto))
        .filter("_is = 1")
        .join(carry, ["_stem", "_part"])
        .select("_stem", "_rank", F.greatest(F.coalesce("_seen", F.lit(0)), F.coalesce("_carry", F.lit(0))).alias("_skipped"))
    )
    n = (F.col("_rank") + F.col("_skipped")).cast("string")
    fresh = {key: F.concat(F.col("_stem"), F.lit("-ENQ"), n), "serial_number": F.concat(F.lit("ENQ-"), n)}
    return wanted.join(skips, ["_stem", "_rank"]).select(
        *[fresh[c].alias(c) if c in fresh else F.col(c) for c in new.columns]
    )


def read_sidecars(spark: SparkSession, directory: str, listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(good, bad)`` records of a folder of JSON files.

    A file that is no JSON object goes to ``bad``; a good record is of a known
    type and lists at least one image that exists in ``listing(file)``.
    """
    files = (
        spark.read.option("wholetext", "true").option("pathGlobFilter", "*.json").text(directory)
        .withColumn("path", F.input_file_name())
        .filter(~F.substring_index("path", "/", -1).startswith("harvest_metadata"))
    )
    record = (
        "ttb_id string, product_type string, serial string, brand_name string, fanciful_name string, "
        "class_type_code string, applicant_principal string, alcohol_content string, net_contents string, "
        "origin_code string, approval_date string, images array<struct<file:string,role:string>>"
    )
    is_object = F.coalesce(
        F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), F.lit(False)
    )
    parsed = files.withColumn("_ok", is_object).withColumn("r", F.from_json("value", record))
    bad = parsed.filter(~F.col("_ok")).select("path")
    known = parsed.filter("_ok").select("path", "r.*").withColumn(
        "beverage_type", lookup(F.upper(F.trim("product_type")), PRODUCT_TYPES)
    ).filter(F.col("beverage_type").isNotNull())
    present = (
        known.select("path", F.explode("images").alias("i"))
        .select("path", F.col("i.file").alias("file"), F.lower(F.coalesce("i.role", F.lit(""))).alias("role"))
        .join(listing.select("file"), "file", "left_semi")
        .groupBy("path")
        .agg(F.bool_or(F.col("role") == "back").alias("has_back"))
    )
    return known.join(present, "path"), bad
