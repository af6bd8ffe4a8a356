"""Reading, join and window queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from concordat import vocab
from concordat.functions.text import normalize_text
from concordat.operators import blocks as bl
from concordat.operators import cards as cd
from concordat.operators import quality as ql
from concordat.operators import readings as rd
from concordat.plans import adapters as ad
from concordat.plans.check_queries import BEST_SQL, JOINED_SQL, LATEST_SQL, OK_READINGS, ORDER
from concordat.plans.registry import query

ID4 = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


@query("tokens_to_text", """with w as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) as line_no, unnest(string_split(text, chr(10))) as line from documents),
  c as (select doc_id, line_no, trim(regexp_replace(line, '\\s+', ' ', 'g')) as line from w)
  select doc_id, string_agg(line, chr(10) order by line_no) as text from c where line <> '' group by doc_id""")
def tokens_to_text(spark, sf):
    d = ad.spread(ad.table(spark, sf, "documents"))
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    tokens = lines.select("doc_id", "line_no", F.posexplode(F.split("line", " ")).alias("word_no", "text"))
    tokens = tokens.withColumn("pos", F.struct("line_no", "word_no"))
    return rd.tokens_to_text(tokens, "doc_id", ("line_no",))


@query("zip_lines", "select vec_id, pos, text, round(case when pos < 32 then score else 0.0 end, 6) as score from (select vec_id, label, unnest(range(0, len(embedding))) as pos, 'L' || cast(unnest(range(0, len(embedding))) as varchar) as text, cast(unnest(embedding) as double) as score from embeddings)")
def zip_lines(spark, sf):
    e = ad.table(spark, sf, "embeddings").withColumns(
        {
            "texts": F.transform("embedding", lambda x, i: F.concat(F.lit("L"), i.cast("string"))),
            "scores": F.slice("embedding", 1, 32),
            "boxes": F.transform(F.slice("embedding", 1, 3), lambda x: F.array(x)),
        }
    )
    out = rd.zip_lines(e, ("vec_id",), "texts", "scores", "boxes")
    return out.select("vec_id", F.col("pos").cast("bigint").alias("pos"), "text", F.round("score", 6).alias("score"))


@query("ok_text", f"select {ID4}, extracted_text from ({OK_READINGS})")
def ok_text(spark, sf):
    return rd.ok_text(ad.readings(spark, sf)).select(*ad.LINE_KEY, "extracted_text")


@query("scoring_rows", f"select id, submission_id, engine_name, image_variant, extracted_text from ({ad.READINGS_SQL}) where status = 'OK'")
def scoring_rows(spark, sf):
    return rd.scoring_rows(ad.readings(spark, sf), ad.extractions(spark, sf))[0]


@query("scoring_rows_model", f"select id, submission_id, model_id, result_text from ({ad.EXTRACTIONS_SQL}) where status = 'OK'")
def scoring_rows_model(spark, sf):
    return rd.scoring_rows(ad.readings(spark, sf), ad.extractions(spark, sf))[1]


@query("cost_rows", f"select model_id, provider, latency_ms, prompt_tokens, completion_tokens, count(*) as n from ({ad.EXTRACTIONS_SQL}) where status = 'OK' group by all")
def cost_rows(spark, sf):
    rows = rd.cost_rows(ad.readings(spark, sf), ad.extractions(spark, sf))[1]
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))


@query("total_tokens", f"select id, l_orderkey, prompt_tokens + completion_tokens as total_tokens from ({ad.EXTRACTIONS_SQL})")
def total_tokens(spark, sf):
    return rd.with_total_tokens(ad.extractions(spark, sf)).select("id", "l_orderkey", "total_tokens")


@query("telemetry", f"select model_id, provider, task, status, latency_ms, prompt_tokens, completion_tokens, prompt_tokens + completion_tokens as total_tokens, count(*) as n from ({ad.EXTRACTIONS_SQL}) group by all")
def telemetry(spark, sf):
    x = ad.extractions(spark, sf)
    for c in ("model_name", "model_full_id", "requested_at", "responded_at"):
        x = x.withColumn(c, F.lit(None).cast("string"))
    t = rd.telemetry(x).drop("model_name", "model_full_id", "requested_at", "responded_at")
    return t.groupBy(*t.columns).agg(F.count(F.lit(1)).alias("n"))


@query("processed", "select count(*) as n, round(sum(value), 2) as total from events where event_type <> 'error'")
def processed(spark, sf):
    e = ad.table(spark, sf, "events").withColumn("processing_ms", F.when(F.col("event_type") != "error", F.col("value")))
    return rd.processed(e).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("processing_ms"), 2).alias("total"))


@query("reading_tasks", """select p_partkey as id, e as engine_name, 'ORIGINAL' as image_variant, p_name as path from part, (select unnest(['tesseract','paddleocr','third']) as e) where p_size <> 9
  union all select p_partkey, 'tesseract', 'BINARIZED', 'b/' || p_name from part where p_size % 2 = 0
  union all select p_partkey, 'paddleocr', 'ENHANCED', 'e/' || p_name from part where p_size % 3 = 0""")
def reading_tasks(spark, sf):
    s = F.col("p_size")
    images = ad.table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_partkey").alias("submission_id"),
        F.when(s == 9, "").otherwise(F.col("p_name")).alias("filename"),
        F.when(s % 2 == 0, F.concat(F.lit("b/"), F.col("p_name"))).alias("binarized_path"),
        F.when(s % 3 == 0, F.concat(F.lit("e/"), F.col("p_name"))).alias("enhanced_path"),
    )
    return rd.reading_tasks(images, ("tesseract", "paddleocr", "third")).drop("submission_id")


@query("joined_text", f"select submission_id, text from ({JOINED_SQL})")
def joined_text(spark, sf):
    return rd.joined_text(rd.ok_text(ad.readings(spark, sf)), order_id=ORDER).select("submission_id", "text")


@query("conversation_text", "select conv_id, string_agg(text, chr(10) order by turn) as text from conversations group by conv_id")
def conversation_text(spark, sf):
    c = ad.table(spark, sf, "conversations")
    return rd.joined_text(c, "conv_id", ("turn",), "text").select("conv_id", "text")


@query("mean_confidence", "select user_id, round(avg(value) filter (where event_type <> 'error' and event_type <> 'view') / 100, 10) as confidence from events group by user_id")
def mean_confidence(spark, sf):
    t = F.col("event_type")
    e = ad.table(spark, sf, "events").withColumn(
        "conf", F.when(t == "error", "-1").when(t == "view", "n/a").otherwise(F.col("value").cast("string"))
    )
    return rd.mean_confidence(e, ("user_id",)).withColumn("confidence", F.round("confidence", 10))


@query("mean_score_clamped", "select user_id, round(least(1.0, greatest(0.0, avg(value / 40))), 10) as confidence from events group by user_id")
def mean_score_clamped(spark, sf):
    e = ad.table(spark, sf, "events").withColumn("score", F.col("value") / 40)
    return rd.mean_score_clamped(e, ("user_id",)).withColumn("confidence", F.round("confidence", 10))


@query("best_ocr", f"select submission_id, id, confidence from ({BEST_SQL})")
def best_ocr(spark, sf):
    return rd.best_ocr(ad.readings(spark, sf), order_id=ORDER).select("submission_id", "id", "confidence")


@query("latest_extraction", f"select submission_id, id, result_text from ({LATEST_SQL})")
def latest_extraction(spark, sf):
    return rd.latest_extraction(ad.extractions(spark, sf), order_id=ORDER).select("submission_id", "id", "result_text")


@query("latest_turn", "select conv_id, turn, text from (select *, row_number() over (partition by conv_id order by turn desc) as rk from conversations where role <> 'system') where rk = 1")
def latest_turn(spark, sf):
    c = ad.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("submission_id"), F.col("turn").alias("id"), F.lit("extract_fields").alias("task"),
        F.when(F.col("role") == "system", "ERROR").otherwise("OK").alias("status"),
        F.lit(False).alias("is_benchmark_only"), F.col("text").alias("result_text"),
    )
    return rd.latest_extraction(c).select(F.col("submission_id").alias("conv_id"), F.col("id").alias("turn"), F.col("result_text").alias("text"))


@query("extraction_degraded", f"select p_partkey as id, p_partkey in (select submission_id from ({ad.EXTRACTIONS_SQL}) where status = 'ERROR' and not is_benchmark_only) as degraded from part")
def extraction_degraded(spark, sf):
    subs = ad.table(spark, sf, "part").select(F.col("p_partkey").alias("id"))
    return rd.extraction_degraded(subs, ad.extractions(spark, sf))


@query("filed_values", f"""select id, field_key, filed from (select id, unnest(['brand_name','net_contents','country_of_origin']) as field_key,
   unnest([brand_name, net_contents, country_of_origin]) as filed from ({ad.FILED_SQL}))""")
def filed_values(spark, sf):
    return rd.filed_values(ad.filed(spark, sf), ("brand_name", "net_contents", "country_of_origin"))


@query(
    "pair_readings",
    f"""with f as (select id as submission_id, 'net_contents' as field_key, net_contents as filed from ({ad.FILED_SQL})),
  o as (select submission_id, text as value, 'ocr' as source from ({JOINED_SQL})),
  l as (select submission_id, json_extract_string(result_text, '$.net_contents') as value, 'llm' as source from ({LATEST_SQL}) where result_text <> 'not json'),
  r as (select * from o union all select * from l)
  select f.submission_id, filed, value, source from f left join r using (submission_id)""",
)
def pair_readings(spark, sf):
    filed = rd.filed_values(ad.filed(spark, sf), ("net_contents",))
    key = F.lit("net_contents").alias("field_key")
    ocr = rd.joined_text(rd.ok_text(ad.readings(spark, sf)), order_id=ORDER).select("submission_id", key, F.col("text").alias("value"))
    latest = ad.extractions(spark, sf).withColumn("id", F.struct(*ORDER))
    llm = rd.extracted_values(latest, ("net_contents",)).select("submission_id", key, F.col("net_contents").alias("value"))
    return rd.pair_readings(filed, ocr, llm).select("submission_id", "filed", "value", "source")


@query("union_readings", f"select source, count(*) as n from (select 'ocr' as source from ({OK_READINGS}) union all select 'llm' from ({ad.EXTRACTIONS_SQL}) where result_text is not null) group by 1")
def union_readings(spark, sf):
    ocr = ad.readings(spark, sf).filter("status = 'OK'").select("submission_id", F.col("extracted_text").alias("value"))
    llm = ad.extractions(spark, sf).select("submission_id", F.col("result_text").alias("value"))
    return rd.union_readings(ocr, llm).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("primary_image", "select submission_id, id, filename from (select l_partkey as submission_id, l_orderkey as id, case when l_quantity > 25 then l_returnflag || '.jpg' end as filename, row_number() over (partition by l_partkey order by l_linenumber, l_orderkey) as rk from lineitem) where rk = 1")
def primary_image(spark, sf):
    li = ad.table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("submission_id"), F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("position"),
        F.when(F.col("l_quantity") > 25, F.concat("l_returnflag", F.lit(".jpg"))).otherwise("  ").alias("filename"),
    )
    return rd.primary_image(li)


@query(
    "comparison_view",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_linenumber % 3 = 0 and o_orderkey is not null then 'ocr:' || o_orderpriority
     when l_linenumber % 3 = 1 and p_partkey is not null then 'llm:' || p_type end as extracted_source
   from lineitem left join orders on o_orderkey = l_orderkey left join part on p_partkey = l_partkey""",
)
def comparison_view(spark, sf):
    n = F.col("l_linenumber") % 3
    cmp = ad.table(spark, sf, "lineitem").select(
        *ad.LINE_KEY, F.when(n == 0, F.col("l_orderkey")).alias("source_ocr_result_id"),
        F.when(n == 1, F.col("l_partkey")).alias("source_llm_result_id"),
    )
    ocr = ad.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("engine_name"))
    llm = ad.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("model_id"))
    return cd.comparison_view(cmp, ocr, llm).select(*ad.LINE_KEY, "extracted_source")


@query("fk_check", "select c_nationkey, count(*) as n from customer left join nation on c_nationkey = n_nationkey and n_nationkey < 20 where n_nationkey is null and c_nationkey is not null group by 1")
def fk_check(spark, sf):
    parents = ad.table(spark, sf, "nation").filter("n_nationkey < 20")
    return ql.check_fk(ad.table(spark, sf, "customer"), parents, "c_nationkey", "n_nationkey").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))


@query("fk_set_null", "select o_orderkey, case when o_custkey in (select c_custkey from customer where c_mktsegment <> 'BUILDING') then o_custkey end as o_custkey from orders")
def fk_set_null(spark, sf):
    parents = ad.table(spark, sf, "customer").filter("c_mktsegment <> 'BUILDING'")
    return ql.set_null(ad.table(spark, sf, "orders"), parents, "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


@query("fk_cascade", "select count(*) as kept from orders where o_custkey in (select c_custkey from customer where c_mktsegment <> 'BUILDING')")
def fk_cascade(spark, sf):
    parents = ad.table(spark, sf, "customer").filter("c_mktsegment <> 'BUILDING'")
    return ql.cascade(ad.table(spark, sf, "orders"), parents, "o_custkey", "c_custkey").agg(F.count(F.lit(1)).alias("kept"))


@query(
    "joined_positions",
    f"""
with j as (select submission_id, {ad.sql_norm('text')} as t from (
  select submission_id, string_agg(extracted_text, chr(10) order by l_orderkey, l_linenumber, l_suppkey) as text
  from ({ad.READINGS_SQL}) where status = 'OK' and trim(extracted_text) <> '' group by submission_id)),
f as (select id as submission_id, needle from (select id, unnest([{ad.sql_norm('brand_name')}, 'alc bourbon ' || {ad.sql_norm('brand_name')}, 'vodka', 'of scotland']) as needle from ({ad.FILED_SQL})))
select f.submission_id, f.needle, nullif(instr(t, nullif(needle, '')), 0) as first
from (select distinct * from f) f left join j using (submission_id)
""",
)
def joined_positions(spark, sf):
    """Where names and phrases, also over the borders of readings, stand in a submission's joined text."""
    reads = rd.ok_text(ad.readings(spark, sf))
    blocks = bl.text_blocks(reads, 64, order="l_orderkey", ties=("l_linenumber", "l_suppkey"))
    name = normalize_text("brand_name")
    needles = F.array(name, F.concat(F.lit("alc bourbon "), name), F.lit("vodka"), F.lit("of scotland"))
    wanted = ad.filed(spark, sf).select(F.col("id").alias("submission_id"), F.explode(needles).alias("needle")).distinct()
    return bl.positions(blocks, wanted, key="submission_id")
