"""The benchmark's generic tables seen as the engine's tables.

Each adapter is a projection, and has a SQL text with the same columns so that
an oracle can build the same input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Heavy per-row work on a table that is scanned by fewer tasks than there are
    cores is spread first.  Such a table is at most a few scan splits; any larger one is
    left as it is scanned."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


# --- submissions from part -----------------------------------------------------

FILED_SQL = """
select p_partkey as id,
       'T' || cast(p_partkey as varchar) as ttb_id,
       case when p_size = 50 then 'CIDER' when p_partkey % 3 = 0 then 'DISTILLED_SPIRITS'
            when p_partkey % 3 = 1 then 'WINE' else 'MALT_BEVERAGE' end as beverage_type,
       case when p_partkey % 2 = 0 then 'DOMESTIC' else 'IMPORTED' end as source_of_product,
       case when p_size = 49 then '  ' else p_name end as brand_name,
       case p_type when 'STANDARD' then 'Straight Bourbon Whiskey' when 'SMALL' then 'Dry Gin'
                   when 'LARGE' then 'Spiced Rum' when 'PROMO' then 'Coffee Liqueur'
                   when 'ECONOMY' then 'Table Wine' else 'Single-Malt Scotch' end as class_type_designation,
       cast(p_size as varchar) || '% Alc./Vol.' as alcohol_content,
       case when p_size = 48 then 'one bottle' else cast(p_size * 50 as varchar) || ' ml' end as net_contents,
       p_brand || ' Works, Main Street' as applicant_name_address,
       case when p_partkey % 5 = 0 then 'Scotland' when p_partkey % 5 = 1 then 'France' else 'Mexico' end as country_of_origin
from part
"""


def filed(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    k, size = F.col("p_partkey"), F.col("p_size")
    kinds = {
        "STANDARD": "Straight Bourbon Whiskey", "SMALL": "Dry Gin", "LARGE": "Spiced Rum",
        "PROMO": "Coffee Liqueur", "ECONOMY": "Table Wine",
    }
    designation = None
    for name, text in kinds.items():
        hit = F.col("p_type") == name
        designation = F.when(hit, text) if designation is None else designation.when(hit, text)
    return p.select(
        k.alias("id"),
        F.concat(F.lit("T"), k.cast("string")).alias("ttb_id"),
        F.when(size == 50, "CIDER").when(k % 3 == 0, "DISTILLED_SPIRITS")
        .when(k % 3 == 1, "WINE").otherwise("MALT_BEVERAGE").alias("beverage_type"),
        F.when(k % 2 == 0, "DOMESTIC").otherwise("IMPORTED").alias("source_of_product"),
        F.when(size == 49, "  ").otherwise(F.col("p_name")).alias("brand_name"),
        designation.otherwise("Single-Malt Scotch").alias("class_type_designation"),
        F.concat(size.cast("string"), F.lit("% Alc./Vol.")).alias("alcohol_content"),
        F.when(size == 48, "one bottle").otherwise(F.concat((size * 50).cast("string"), F.lit(" ml"))).alias("net_contents"),
        F.concat(F.col("p_brand"), F.lit(" Works, Main Street")).alias("applicant_name_address"),
        F.when(k % 5 == 0, "Scotland").when(k % 5 == 1, "France").otherwise("Mexico").alias("country_of_origin"),
    )


# --- OCR readings from lineitem and part ------------------------------------------

LINE_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")

LABEL_TEXT_SQL = """
upper(p_name) || case when l_orderkey % 101 = 5 then 'X' else '' end || chr(10)
|| 'net ' || cast(p_size * 50 + case when l_orderkey % 97 = 3 then 10 else 0 end as varchar)
|| case when l_orderkey % 89 = 4 then 'OZ' else 'ML' end
|| ' | ' || cast(p_size as varchar) || case when l_orderkey % 3 = 0 then '.5' else '' end || '% alc'
|| chr(10) || case when l_orderkey % 7 = 0 then 'fine vodka' when l_orderkey % 7 = 1 then 'bourbon' else 'product of Scotland' end
"""

READINGS_SQL = f"""
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey as submission_id,
       cast(l_orderkey as varchar) || '-' || cast(l_linenumber as varchar) || '-' || cast(l_suppkey as varchar) as id,
       l_returnflag as engine_name, l_linestatus as image_variant,
       case when l_tax = 0.08 then 'ERROR' else 'OK' end as status,
       case when l_discount = 0.0 then null else l_discount * 10 end as confidence,
       cast(l_quantity as integer) as latency_ms,
       case when l_tax = 0.05 then null else l_linenumber <> 7 end as ran_on_cpu,
       case when l_tax = 0.07 then '   ' else {LABEL_TEXT_SQL} end as extracted_text
from lineitem join part on l_partkey = p_partkey
"""


def label_text():
    k = F.col("l_orderkey")
    return F.concat(
        F.upper("p_name"), F.when(k % 101 == 5, "X").otherwise(""), F.lit("\n"),
        F.lit("net "), (F.col("p_size") * 50 + F.when(k % 97 == 3, 10).otherwise(0)).cast("string"),
        F.when(k % 89 == 4, "OZ").otherwise("ML"),
        F.lit(" | "), F.col("p_size").cast("string"), F.when(k % 3 == 0, ".5").otherwise(""), F.lit("% alc"),
        F.lit("\n"), F.when(k % 7 == 0, "fine vodka").when(k % 7 == 1, "bourbon").otherwise("product of Scotland"),
    )


def readings(spark: SparkSession, sf: str) -> DataFrame:
    li, p = spread(table(spark, sf, "lineitem")), table(spark, sf, "part")
    return li.join(p, F.col("l_partkey") == F.col("p_partkey")).select(
        *LINE_KEY,
        F.col("l_partkey").alias("submission_id"),
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_suppkey").cast("string")).alias("id"),
        F.col("l_returnflag").alias("engine_name"),
        F.col("l_linestatus").alias("image_variant"),
        F.when(F.col("l_tax") == 0.08, "ERROR").otherwise("OK").alias("status"),
        F.when(F.col("l_discount") != 0.0, F.col("l_discount") * 10).alias("confidence"),
        F.col("l_quantity").cast("int").alias("latency_ms"),
        F.when(F.col("l_tax") != 0.05, F.col("l_linenumber") != 7).alias("ran_on_cpu"),
        F.when(F.col("l_tax") == 0.07, "   ").otherwise(label_text()).alias("extracted_text"),
    )


# --- model readings ------------------------------------------------------------------

EXTRACTIONS_SQL = """
select l_partkey as submission_id, l_orderkey, l_linenumber, l_suppkey,
       cast(l_orderkey as varchar) || '-' || cast(l_linenumber as varchar) || '-' || cast(l_suppkey as varchar) as id,
       'extract_fields' as task,
       case when l_tax = 0.06 then 'ERROR' else 'OK' end as status,
       l_linenumber = 7 as is_benchmark_only,
       l_returnflag as model_id,
       case when l_returnflag = 'N' then 'local' when l_tax = 0.02 then null else 'api' end as provider,
       cast(l_quantity as integer) as completion_tokens,
       case when l_discount = 0.04 then null else cast(floor(l_extendedprice) as bigint) end as prompt_tokens,
       cast(l_quantity as integer) as latency_ms,
       case when l_tax = 0.03 then 'not json'
            else '{"brand_name": "' || upper(p_name) || '", "alcohol_content": ' || cast(p_size as varchar)
              || case when l_orderkey % 4 = 0 then '.50' else '' end
              || ', "net_contents": "' || cast(p_size * 50 + case when l_orderkey % 5 = 0 then 5 else 0 end as varchar) || ' mL"'
              || ', "class_type_designation": ["x"], "applicant_name_address": null, "government_warning": ""}' end as result_text
from lineitem join part on l_partkey = p_partkey
"""


def extractions(spark: SparkSession, sf: str) -> DataFrame:
    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    k, size = F.col("l_orderkey"), F.col("p_size")
    payload = F.concat(
        F.lit('{"brand_name": "'), F.upper("p_name"), F.lit('", "alcohol_content": '), size.cast("string"),
        F.when(k % 4 == 0, ".50").otherwise(""), F.lit(', "net_contents": "'),
        (size * 50 + F.when(k % 5 == 0, 5).otherwise(0)).cast("string"), F.lit(' mL"'),
        F.lit(', "class_type_designation": ["x"], "applicant_name_address": null, "government_warning": ""}'),
    )
    return li.join(p, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_partkey").alias("submission_id"), "l_orderkey", "l_linenumber", "l_suppkey",
        F.concat_ws("-", k.cast("string"), F.col("l_linenumber").cast("string"), F.col("l_suppkey").cast("string")).alias("id"),
        F.lit("extract_fields").alias("task"),
        F.when(F.col("l_tax") == 0.06, "ERROR").otherwise("OK").alias("status"),
        (F.col("l_linenumber") == 7).alias("is_benchmark_only"),
        F.col("l_returnflag").alias("model_id"),
        F.when(F.col("l_returnflag") == "N", "local").when(F.col("l_tax") == 0.02, F.lit(None)).otherwise("api").alias("provider"),
        F.col("l_quantity").cast("int").alias("completion_tokens"),
        F.when(F.col("l_discount") != 0.04, F.floor("l_extendedprice")).alias("prompt_tokens"),
        F.col("l_quantity").cast("int").alias("latency_ms"),
        F.when(F.col("l_tax") == 0.03, "not json").otherwise(payload).alias("result_text"),
    )


# --- checks from lineitem ---------------------------------------------------------------

CHECKS_SQL = """
select l_partkey as submission_id, l_linenumber, l_orderkey, l_suppkey,
       cast(l_orderkey as varchar) || '-' || cast(l_linenumber as varchar) || '-' || cast(l_suppkey as varchar) as id,
       'check_' || cast(l_linenumber as varchar) as check_key,
       case when l_quantity > 48 then null
            when l_returnflag = 'A' and l_discount >= 0.09 then 'FAIL'
            when l_returnflag = 'N' and l_discount <= 0.01 then 'REVIEW'
            when l_discount = 0.05 then 'NA'
            when l_quantity < 2 then 'pass'
            else 'PASS' end as verdict
from lineitem
"""


def checks(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    d, q, r = F.col("l_discount"), F.col("l_quantity"), F.col("l_returnflag")
    return li.select(
        F.col("l_partkey").alias("submission_id"), "l_linenumber", "l_orderkey", "l_suppkey",
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_suppkey").cast("string")).alias("id"),
        F.concat(F.lit("check_"), F.col("l_linenumber").cast("string")).alias("check_key"),
        F.when(q > 48, F.lit(None))
        .when((r == "A") & (d >= 0.09), "FAIL")
        .when((r == "N") & (d <= 0.01), "REVIEW")
        .when(d == 0.05, "NA")
        .when(q < 2, "pass")
        .otherwise("PASS").alias("verdict"),
    )


# --- queue from orders, lifecycle from events --------------------------------------------

QUEUE_SQL = """
select o_orderkey as id, o_orderdate as submitted_at, o_orderpriority as beverage_type, o_custkey as specialist_id,
       case o_orderstatus when 'O' then 'READY_FOR_REVIEW' when 'F' then 'DECIDED' else 'RECEIVED' end as status
from orders
"""


def queue(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("submitted_at"),
        F.col("o_orderpriority").alias("beverage_type"), F.col("o_custkey").alias("specialist_id"),
        F.when(F.col("o_orderstatus") == "O", "READY_FOR_REVIEW")
        .when(F.col("o_orderstatus") == "F", "DECIDED").otherwise("RECEIVED").alias("status"),
    )


LIFECYCLE_SQL = """
select user_id as submission_id, event_id, ts as occurred_at,
       case event_type when 'signup' then 'SEEDED' when 'click' then 'OCR_STARTED' when 'view' then 'READY'
                       when 'purchase' then case when value < 20 then 'OPENED' else 'DECIDED' end
                       else case when value < 5 then 'BROKEN' when value < 25 then 'UNDONE' else 'ANALYSIS_COMPLETED' end end as event_type,
       case event_type when 'signup' then 'RECEIVED' when 'click' then 'PROCESSING' when 'view' then 'READY_FOR_REVIEW'
                       when 'purchase' then case when value < 20 then 'IN_REVIEW' else 'DECIDED' end
                       else case when value >= 5 and value < 25 then 'READY_FOR_REVIEW' end end as to_status
from events
"""


def lifecycle_events(events: DataFrame) -> DataFrame:
    t, v = F.col("event_type"), F.col("value")
    kind = (
        F.when(t == "signup", "SEEDED").when(t == "click", "OCR_STARTED").when(t == "view", "READY")
        .when(t == "purchase", F.when(v < 20, "OPENED").otherwise("DECIDED"))
        .otherwise(F.when(v < 5, "BROKEN").when(v < 25, "UNDONE").otherwise("ANALYSIS_COMPLETED"))
    )
    target = (
        F.when(t == "signup", "RECEIVED").when(t == "click", "PROCESSING").when(t == "view", "READY_FOR_REVIEW")
        .when(t == "purchase", F.when(v < 20, "IN_REVIEW").otherwise("DECIDED"))
        .otherwise(F.when((v >= 5) & (v < 25), "READY_FOR_REVIEW"))
    )
    return events.select(
        F.col("user_id").alias("submission_id"), "event_id", F.col("ts").alias("occurred_at"),
        kind.alias("event_type"), target.alias("to_status"),
    )


# --- text normalization in the oracle's dialect --------------------------------------------


def sql_norm(expr: str) -> str:
    """Comparison form over the characters that occur in the tables."""
    return (
        f"coalesce(rtrim(replace(lower(trim(regexp_replace({expr}, '\\s+', ' ', 'g'))), 'ß', 'ss'), '.,;:!?''\" '), '')"
    )


def sql_one_byte(expr: str) -> str:
    """Accented letters as control characters: the oracle's edit distance counts bytes."""
    marks = "éóèñüçäöêí"
    codes = " || ".join(f"chr({c})" for c in (1, 2, 3, 4, 5, 6, 7, 14, 15, 16))
    return f"translate({expr}, '{marks}', {codes})"
