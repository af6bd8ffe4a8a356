"""Scoring, latency, cost and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from concordat import vocab
from concordat.operators import cost as co
from concordat.operators import report as rp
from concordat.operators import scoring as sc
from concordat.operators.statement import statement_hits
from concordat.plans import adapters as ad
from concordat.plans.check_queries import CANON, HITS_SQL, OK_READINGS, TOK, first_number, first_unit
from concordat.plans.registry import query
from concordat.rules import RULES  # noqa: F401

# --- accuracy -----------------------------------------------------------------

# Gold is the filed value, wrong for every eleventh part and missing for every thirteenth.
GOLD_SQL = f"""
select id, ttb_id, case when id % 13 = 0 then null when id % 11 = 0 then '900 ml' else net_contents end as gt_net_contents,
  case when id % 13 = 1 then null else alcohol_content end as gt_alcohol_content,
  case when id % 11 = 2 then 'another name' else brand_name end as gt_brand_name,
  case when id % 7 = 0 then country_of_origin end as gt_government_warning
from ({ad.FILED_SQL}) where id % 17 <> 0
"""


def gold(spark, sf):
    f = ad.filed(spark, sf).filter("id % 17 <> 0")
    k = F.col("id")
    return f.select(
        "ttb_id",
        F.when(k % 13 == 0, F.lit(None)).when(k % 11 == 0, "900 ml").otherwise(F.col("net_contents")).alias("gt_net_contents"),
        F.when(k % 13 == 1, F.lit(None)).otherwise(F.col("alcohol_content")).alias("gt_alcohol_content"),
        F.when(k % 11 == 2, "another name").otherwise(F.col("brand_name")).alias("gt_brand_name"),
        F.lit(None).cast("string").alias("gt_class_type_designation"),
        F.lit(None).cast("string").alias("gt_applicant_name_address"),
        F.when(k % 7 == 0, F.col("country_of_origin")).alias("gt_government_warning"),
    )


def _num(field, gold_col, tol):
    return f"""case when g.{gold_col} is null then 'UNVERIFIABLE' when trim(coalesce(extracted_text,'')) = '' then 'MISSING'
      when {first_number('g.' + gold_col)} is null then 'UNVERIFIABLE' when gap_{field} is null then 'MISSING'
      when gap_{field} <= {tol} then 'MATCH' else 'MISMATCH' end"""


SCORED_SQL = f"""
with g as (select * from ({GOLD_SQL})),
r as (select l_orderkey, l_linenumber, l_suppkey, submission_id, engine_name, image_variant, extracted_text,
             {ad.sql_norm('extracted_text')} as tn from ({ad.READINGS_SQL}) where status = 'OK'),
tok as (select l_orderkey, l_linenumber, l_suppkey, submission_id,
  unnest(regexp_extract_all(lower(extracted_text), '{TOK}', 2)) as n, unnest(regexp_extract_all(lower(extracted_text), '{TOK}', 3)) as u from r),
gap as (select l_orderkey, l_linenumber, l_suppkey, submission_id,
  min(abs(try_cast(n as decimal(30,10)) - {first_number('gt_net_contents')})) filter (where {CANON.format(u='u')} = {first_unit('gt_net_contents')}) as gap_net,
  min(abs(try_cast(n as decimal(30,10)) - {first_number('gt_alcohol_content')})) filter (where {CANON.format(u='u')} = {first_unit('gt_alcohol_content')}) as gap_abv
  from tok join g on g.id = submission_id group by all),
s as (select engine_name, image_variant, r.submission_id, r.l_orderkey, r.l_linenumber, r.l_suppkey,
  {_num('net', 'gt_net_contents', '0')} as net_contents, {_num('abv', 'gt_alcohol_content', '0.3')} as alcohol_content,
  case when gt_brand_name is null or trim(gt_brand_name) = '' then 'UNVERIFIABLE' when trim(extracted_text) = '' then 'MISSING'
       when contains(tn, {ad.sql_norm('gt_brand_name')}) then 'MATCH'
       when 1 - levenshtein({ad.sql_norm('gt_brand_name')}, tn) / greatest(length({ad.sql_norm('gt_brand_name')}), length(tn))::double >= 0.85 then 'MATCH' else 'MISMATCH' end as brand_name,
  trim(extracted_text) <> '' as present,
  trim(extracted_text) <> '' and gt_government_warning is not null and contains(tn, {ad.sql_norm('gt_government_warning')}) as exact,
  case when gt_government_warning is not null then levenshtein(tn, {ad.sql_norm('gt_government_warning')}) / length({ad.sql_norm('gt_government_warning')})::double end as cer
  from r join g on g.id = r.submission_id left join gap using (l_orderkey, l_linenumber, l_suppkey, submission_id)),
f as (select engine_name, image_variant, unnest(['net_contents','alcohol_content','brand_name','class_type_designation','applicant_name_address']) as field_key,
   unnest([net_contents, alcohol_content, brand_name, 'UNVERIFIABLE', 'UNVERIFIABLE']) as st from s)
"""
COUNTS = ", ".join(f"count(*) filter (where st = '{n}') as {n.lower()}" for n in vocab.MATCH_STATUSES)
RATE = "round(sum(match) / nullif(sum(match) + sum(mismatch) + sum(missing), 0), 8)"
KEYS = ("engine_name", "image_variant")


def scored(spark, sf, method="levenshtein"):
    subs = ad.filed(spark, sf).select(F.col("id").alias("submission_id"), "ttb_id")
    keyed = sc.with_gold(subs, gold(spark, sf))
    rows = ad.readings(spark, sf).filter("status = 'OK'").join(keyed, "submission_id")
    return sc.score_readings(rows, "extracted_text", KEYS, False, method)


@query("field_outcomes", f"{SCORED_SQL} select engine_name, image_variant, field_key, {COUNTS} from f group by all")
def field_outcomes(spark, sf):
    rows = scored(spark, sf).select(*KEYS, F.inline_outer("scores"))
    return sc.field_outcomes(rows, KEYS)


@query("match_rate", f"{SCORED_SQL} select engine_name, image_variant, field_key, {RATE.replace('sum(', '(')} as match_rate from (select engine_name, image_variant, field_key, {COUNTS} from f group by all)")
def match_rate(spark, sf):
    rows = scored(spark, sf).select(*KEYS, F.inline_outer("scores"))
    out = sc.match_rate(sc.field_outcomes(rows, KEYS))
    return out.select(*KEYS, "field_key", F.round("match_rate", 8).alias("match_rate"))


@query("overall_rate", f"{SCORED_SQL} select engine_name, image_variant, {RATE} as field_match_rate, sum(unverifiable)::bigint as unverifiable from (select engine_name, image_variant, field_key, {COUNTS} from f group by all) group by 1, 2")
def overall_rate(spark, sf):
    rows = scored(spark, sf).select(*KEYS, F.inline_outer("scores"))
    out = sc.overall_rate(sc.field_outcomes(rows, KEYS), KEYS)
    return out.withColumn("field_match_rate", F.round("field_match_rate", 8))


@query("statement_rates", f"{SCORED_SQL} select engine_name, image_variant, count(*) as readings, round(avg(present::int), 8) as presence_rate, round(avg(exact::int), 8) as exactness_rate, round(avg(cer), 6) as mean_cer from s group by 1, 2")
def statement_rates(spark, sf):
    out = sc.statement_rates(scored(spark, sf), KEYS)
    return out.select(*KEYS, "readings", F.round("presence_rate", 8).alias("presence_rate"), F.round("exactness_rate", 8).alias("exactness_rate"), F.round("mean_cer", 6).alias("mean_cer"))


@query(
    "score_corpus_engines",
    f"""{SCORED_SQL}, a as (select engine_name, image_variant, {COUNTS} from f group by 1, 2),
  b as (select engine_name, image_variant, count(*) as readings, round(avg(cer), 6) as mean_cer from s group by 1, 2)
  select engine_name, image_variant, match, mismatch, missing, unverifiable, readings, mean_cer, round(match / (match + mismatch + missing), 8) as field_match_rate
  from a join b using (engine_name, image_variant)""",
)
def score_corpus_engines(spark, sf):
    subs = ad.filed(spark, sf)
    engines, _ = sc.score_corpus(subs, ad.readings(spark, sf), ad.extractions(spark, sf), gold(spark, sf), "levenshtein")
    return engines.select(
        *KEYS, "match", "mismatch", "missing", "unverifiable", "readings",
        F.round("mean_cer", 6).alias("mean_cer"), F.round("field_match_rate", 8).alias("field_match_rate"),
    )


@query("score_corpus_models")
def score_corpus_models(spark, sf):
    """Accuracy per model with the sequence similarity."""
    _, models = sc.score_corpus(ad.filed(spark, sf), ad.readings(spark, sf), ad.extractions(spark, sf), gold(spark, sf))
    return models


@query("scored_count", f"select count(distinct ttb_id) as scored_submissions from ({GOLD_SQL})")
def scored_count(spark, sf):
    return sc.scored_count(ad.filed(spark, sf), gold(spark, sf))


@query("common_keys", "select doc_id from documents intersect select doc_id from labels")
def common_keys(spark, sf):
    return sc.common_keys(ad.table(spark, sf, "documents"), ad.table(spark, sf, "labels"), "doc_id")


@query("with_gold", "select lang, quality, count(*) as n from documents join labels using (doc_id) group by all")
def with_gold(spark, sf):
    d = ad.table(spark, sf, "documents").select("doc_id", "lang")
    return sc.with_gold(d, ad.table(spark, sf, "labels"), "doc_id").groupBy("lang", "quality").agg(F.count(F.lit(1)).alias("n"))


@query("statement_scores", f"""with h as ({HITS_SQL}) select item_id, count(doc_id) as exact_in from (select item_id from benchmark) left join h using (item_id) group by item_id""")
def statement_scores(spark, sf):
    """In how many texts each required statement is found exactly."""
    items = ad.table(spark, sf, "benchmark").select("item_id", F.col("text").alias("statement"))
    hits = statement_hits(ad.spread(ad.table(spark, sf, "documents")), items, "doc_id", "item_id")
    counted = hits.groupBy("item_id").agg(F.count(F.lit(1)).alias("exact_in"))
    return items.select("item_id").join(counted, "item_id", "left").withColumn("exact_in", F.coalesce("exact_in", F.lit(0)))


@query(
    "win_rate",
    """with s as (select l_orderkey, 'f' || cast(l_linenumber as varchar) as field_key, l_returnflag as extractor, l_discount as similarity from lineitem where l_linestatus = 'O')
  select field_key, extractor, count(*) as wins from (select *, rank() over (partition by l_orderkey, field_key order by similarity desc) as rk from s) where rk = 1 group by all""",
)
def win_rate(spark, sf):
    li = ad.table(spark, sf, "lineitem").select(
        "l_orderkey", F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("field_key"),
        F.col("l_returnflag").alias("extractor"), F.col("l_discount").alias("similarity"),
        F.when(F.col("l_linestatus") == "O", "MATCH").otherwise("MISMATCH").alias("match_status"),
    )
    return sc.win_rate(li, ("l_orderkey",))


# --- latency and cost ------------------------------------------------------------


@query("latency_stats", "select event_type, count(value) as n, round(avg(value), 6) as mean_ms, round(median(value), 6) as median_ms, quantile_disc(value, 0.95) as p95_ms from events group by 1")
def latency_stats(spark, sf):
    out = co.latency_stats(ad.table(spark, sf, "events"), ("event_type",), "value")
    return out.select("event_type", "n", F.round("mean_ms", 6).alias("mean_ms"), F.round("median_ms", 6).alias("median_ms"), "p95_ms")


@query("latency_stats_engine", f"select engine_name, image_variant, count(latency_ms) as n, round(avg(latency_ms), 6) as mean_ms, median(latency_ms) as median_ms, quantile_disc(latency_ms, 0.95)::double as p95_ms from ({ad.READINGS_SQL}) group by 1, 2")
def latency_stats_engine(spark, sf):
    r = ad.readings(spark, sf).select(*KEYS, F.col("latency_ms"))
    out = co.latency_stats(r, KEYS)
    return out.select(*KEYS, "n", F.round("mean_ms", 6).alias("mean_ms"), "median_ms", F.col("p95_ms").cast("double").alias("p95_ms"))


@query("processing_summary", "select count(value) as n, min(value) as min_ms, round(median(value), 6) as median_ms, round(avg(value), 6) as mean_ms, quantile_disc(value, 0.95) as p95_ms, max(value) as max_ms from events")
def processing_summary(spark, sf):
    out = co.processing_summary(ad.table(spark, sf, "events"), "value")
    return out.withColumns({"mean_ms": F.round("mean_ms", 6), "median_ms": F.round("median_ms", 6)})


@query("latency_percentiles", "select event_type, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95, quantile_disc(value, 0.99) as p99 from events group by 1")
def latency_percentiles(spark, sf):
    return co.latency_percentiles(ad.table(spark, sf, "events"), ("event_type",), "value", (0.5, 0.95, 0.99))


@query("cpu_only", f"select engine_name, image_variant, bool_and(ran_on_cpu) as cpu_only from ({ad.READINGS_SQL}) group by 1, 2")
def cpu_only(spark, sf):
    return co.cpu_only(ad.readings(spark, sf), KEYS)


@query("mean_tokens", f"select model_id, round(avg(prompt_tokens), 6) as mean_prompt_tokens, round(avg(completion_tokens), 6) as mean_completion_tokens from ({ad.EXTRACTIONS_SQL}) group by 1")
def mean_tokens(spark, sf):
    out = co.mean_tokens(ad.extractions(spark, sf), ("model_id",))
    return out.select("model_id", F.round("mean_prompt_tokens", 6).alias("mean_prompt_tokens"), F.round("mean_completion_tokens", 6).alias("mean_completion_tokens"))


@query("is_local", f"select model_id, bool_and(coalesce(provider, '') = 'local') as is_local from ({ad.EXTRACTIONS_SQL}) group by 1")
def is_local(spark, sf):
    return co.is_local(ad.extractions(spark, sf), ("model_id",))


# Prices come from the region table: a model is priced by the region of its number.
PRICES_SQL = "select case r_regionkey when 0 then 'A' when 1 then 'N' else r_name end as model_id, cast(0.00015 * (r_regionkey + 1) as decimal(12,8)) as input_price_per_1k, cast(0.0006 as decimal(12,8)) as output_price_per_1k from region"


def prices(spark, sf):
    k = F.col("r_regionkey")
    return ad.table(spark, sf, "region").select(
        F.when(k == 0, "A").when(k == 1, "N").otherwise(F.col("r_name")).alias("model_id"),
        (F.lit(0.00015).cast("decimal(12,8)") * (k + 1)).cast("decimal(12,8)").alias("input_price_per_1k"),
        F.lit(0.0006).cast("decimal(12,8)").alias("output_price_per_1k"),
        F.lit("list price").alias("source"), F.lit("2026-01").alias("as_of"),
    )


@query(
    "cost_per_1000",
    f"""with m as (select model_id, avg(prompt_tokens) as p, avg(completion_tokens) as c, bool_and(coalesce(provider, '') = 'local') as loc from ({ad.EXTRACTIONS_SQL}) group by 1),
  x as (select m.*, input_price_per_1k as ip, output_price_per_1k as op from m left join ({PRICES_SQL}) using (model_id)),
  y as (select model_id, case when loc then 0 else round_even(cast((cast(p as decimal(24,8)) * ip + cast(c as decimal(24,8)) * op) as decimal(38,12)) / 1000, 6) end as one from x)
  select model_id, cast(one as double) as cost_per_verification, cast(one * 1000 as double) as cost_per_1000 from y""",
)
def cost_per_1000(spark, sf):
    out = co.cost_per_1000(ad.extractions(spark, sf), prices(spark, sf))
    return out.select("model_id", F.col("cost_per_verification").cast("double").alias("cost_per_verification"), F.col("cost_per_1000").cast("double").alias("cost_per_1000"))


@query("with_price", f"select model_id, cast(input_price_per_1k as double) as price, count(*) as n from ({ad.EXTRACTIONS_SQL}) left join ({PRICES_SQL}) using (model_id) group by all")
def with_price(spark, sf):
    rows = ad.extractions(spark, sf).select("model_id")
    return co.with_price(rows, prices(spark, sf)).groupBy("model_id", F.col("input_price_per_1k").cast("double").alias("price")).agg(F.count(F.lit(1)).alias("n"))


@query("cost_report_engines", f"select engine_name, image_variant, count(latency_ms) as n, round(avg(latency_ms), 6) as mean_ms, quantile_disc(latency_ms, 0.95)::double as p95_ms, bool_and(ran_on_cpu) as cpu_only, 0.0 as cost from ({ad.READINGS_SQL}) where status = 'OK' group by 1, 2")
def cost_report_engines(spark, sf):
    engines, _ = co.cost_report(ad.readings(spark, sf), ad.extractions(spark, sf), prices(spark, sf))
    return engines.select(*KEYS, "n", F.round("mean_ms", 6).alias("mean_ms"), F.col("p95_ms").cast("double").alias("p95_ms"), "cpu_only", F.col("cost_per_1000").cast("double").alias("cost"))


@query("cost_report_models", f"select model_id, count(latency_ms) as n, median(latency_ms) as median_ms, bool_and(coalesce(provider, '') = 'local') as is_local from ({ad.EXTRACTIONS_SQL}) where status = 'OK' group by 1")
def cost_report_models(spark, sf):
    _, models = co.cost_report(ad.readings(spark, sf), ad.extractions(spark, sf), prices(spark, sf))
    return models.select("model_id", "n", "median_ms", "is_local")


@query("verification_count", "select count(*) as verification_count from orders")
def verification_count(spark, sf):
    return co.verification_count(ad.table(spark, sf, "orders"))


@query("compute_cost", "select event_type, round(avg(value) * 1000 * 0.0001, 6) as cost from events group by 1")
def compute_cost(spark, sf):
    out = co.compute_cost(ad.table(spark, sf, "events"), 0.0001, "value", ("event_type",))
    return out.select("event_type", F.round("compute_cost_per_1000", 6).alias("cost"))


# --- report ------------------------------------------------------------------------

ACC_SQL = "select event_type as k, avg(value) / 100 as rate from events where event_type <> 'click' group by 1"
COST_SQL = "select event_type as k, avg(user_id) as mean_ms from events where event_type <> 'error' group by 1"


def acc(spark, sf):
    return ad.table(spark, sf, "events").filter("event_type <> 'click'").groupBy(F.col("event_type").alias("k")).agg((F.avg("value") / 100).alias("rate"))


def cost(spark, sf):
    return ad.table(spark, sf, "events").filter("event_type <> 'error'").groupBy(F.col("event_type").alias("k")).agg(F.avg("user_id").alias("mean_ms"))


@query("report_join", f"select k, round(rate, 8) as rate, round(mean_ms, 6) as mean_ms from ({ACC_SQL}) full join ({COST_SQL}) using (k)")
def report_join(spark, sf):
    return rp.report_join(acc(spark, sf), cost(spark, sf), ("k",)).select("k", F.round("rate", 8).alias("rate"), F.round("mean_ms", 6).alias("mean_ms"))


@query("all_keys", f"select k from ({ACC_SQL}) union select k from ({COST_SQL})")
def all_keys(spark, sf):
    return rp.all_keys(acc(spark, sf), cost(spark, sf), ("k",))


@query("flag_best", f"with a as ({ACC_SQL}) select k, k = (select k from a order by rate desc, k limit 1) as is_best from a")
def flag_best(spark, sf):
    return rp.flag_best(acc(spark, sf), "rate", ("k",)).select("k", "is_best")


@query("engine_report")
def engine_report(spark, sf):
    """The whole display report of the OCR engines."""
    subs, r, x, g = ad.filed(spark, sf), ad.readings(spark, sf), ad.extractions(spark, sf), gold(spark, sf)
    engines, _ = sc.score_corpus(subs, r, x, g, "levenshtein")
    costs, _ = co.cost_report(r, x, prices(spark, sf))
    return rp.engine_report(engines, costs)


@query("model_report")
def model_report(spark, sf):
    subs, r, x, g = ad.filed(spark, sf), ad.readings(spark, sf), ad.extractions(spark, sf), gold(spark, sf)
    _, models = sc.score_corpus(subs, r, x, g, "levenshtein")
    _, costs = co.cost_report(r, x, prices(spark, sf))
    return rp.model_report(models, costs)
