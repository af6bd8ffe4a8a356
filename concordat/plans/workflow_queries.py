"""Review tables, lifecycle and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from concordat import vocab
from concordat.operators import cards as cd
from concordat.operators import lifecycle as lc
from concordat.plans import adapters as ad
from concordat.plans.registry import query
from concordat.plans.sequence_sql import best_window_ctes
from concordat.session import work_dir
from concordat.streaming import intake as si
from concordat.streaming.lifecycle import lifecycle_stream
from concordat.streaming.timed import STORE, timed_lifecycle

# --- cards ----------------------------------------------------------------------------

# Comparisons are keyed by part, items by line: a line points to its part's
# comparison, to none, or to one that is missing.
CMP_SQL = """select p_partkey as id, p_partkey as submission_id, case when p_size % 2 = 0 then 'brand_name' else 'net_contents' end as field_key,
  case when p_size = 7 then ' ' else p_name end as application_value, case when p_size % 5 = 0 then p_name when p_size % 5 = 1 then upper(p_name) when p_size % 5 = 2 then null else p_brand end as extracted_value,
  case when p_size % 5 in (0, 1) then 'MATCH' when p_size % 5 = 2 then 'MISSING' when p_size % 5 = 3 then 'MISMATCH' else 'UNVERIFIABLE' end as match_status,
  case when p_size % 2 = 0 then 'ocr:tesseract' else 'llm:m' end as extracted_source from part where p_size <> 50"""
ITEMS_SQL = """select l_orderkey, l_linenumber, l_partkey as submission_id, l_suppkey, 'k' || cast(l_linenumber as varchar) as check_key,
  case when l_quantity > 40 then 'FAIL' when l_quantity > 25 then 'REVIEW' when l_quantity > 20 then 'NA' when l_quantity > 18 then null else 'PASS' end as verdict,
  case when l_linenumber = 7 then null else l_partkey end as field_comparison_id from lineitem"""


def card_comparisons(spark, sf):
    s = F.col("p_size")
    return ad.table(spark, sf, "part").filter("p_size <> 50").select(
        F.col("p_partkey").alias("id"), F.col("p_partkey").alias("submission_id"),
        F.when(s % 2 == 0, "brand_name").otherwise("net_contents").alias("field_key"),
        F.when(s == 7, " ").otherwise(F.col("p_name")).alias("application_value"),
        F.when(s % 5 == 0, F.col("p_name")).when(s % 5 == 1, F.upper("p_name")).when(s % 5 == 2, F.lit(None)).otherwise(F.col("p_brand")).alias("extracted_value"),
        F.when((s % 5).isin(0, 1), "MATCH").when(s % 5 == 2, "MISSING").when(s % 5 == 3, "MISMATCH").otherwise("UNVERIFIABLE").alias("match_status"),
        F.when(s % 2 == 0, "ocr:tesseract").otherwise("llm:m").alias("extracted_source"),
    )


def card_items(spark, sf):
    q = F.col("l_quantity")
    return ad.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_partkey").alias("submission_id"), "l_suppkey",
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_suppkey").cast("string")).alias("id"),
        F.concat(F.lit("k"), F.col("l_linenumber").cast("string")).alias("check_key"),
        F.lit(None).cast("string").alias("label"), F.lit("27 CFR 1").alias("cfr_citation"), F.lit("d").alias("detail"),
        F.when(q > 40, "FAIL").when(q > 25, "REVIEW").when(q > 20, "NA").when(q > 18, F.lit(None)).otherwise("PASS").alias("verdict"),
        F.when(F.col("l_linenumber") != 7, F.col("l_partkey")).alias("field_comparison_id"),
    )


def progress(spark, sf):
    k = F.col("p_partkey")
    return ad.table(spark, sf, "part").filter("p_partkey % 3 <> 0").select(
        k.alias("submission_id"),
        F.when(k % 2 == 0, F.create_map(F.lit("k1"), F.lit("fail"), F.lit("k2"), F.lit("pass")))
        .otherwise(F.create_map(F.lit("k3"), F.lit("pass"), F.lit("k4"), F.lit("maybe"))).alias("decisions"),
    )


EXPLICIT = "case when submission_id % 3 = 0 then null when submission_id % 2 = 0 then case check_key when 'k1' then 'fail' when 'k2' then 'pass' end else case check_key when 'k3' then 'pass' end end"
DECISION = f"coalesce({EXPLICIT}, case when verdict in ('PASS','NA') then 'pass' end, '')"
CARD_SQL = f"""
with i as (select *, l_orderkey || '-' || l_linenumber || '-' || l_suppkey as item from ({ITEMS_SQL})),
b as (select i.*, c.id is null as is_error, field_key, application_value, extracted_value, match_status, extracted_source
  from i left join ({CMP_SQL}) c on c.id = i.field_comparison_id where field_comparison_id is not null),
s as (select *, case when is_error then 'REVIEW' else coalesce(verdict, 'REVIEW') end as v,
  case when is_error then 'error' when trim(application_value) = '' and trim(coalesce(extracted_value, '')) <> '' then 'blank_application'
   when match_status = 'UNVERIFIABLE' then 'unreadable' when match_status = 'MISSING' then 'not_found'
   when match_status = 'MATCH' and verdict = 'REVIEW' then case when application_value is distinct from extracted_value then 'soft' else 'unreadable' end
   when match_status = 'MISMATCH' then case when verdict = 'FAIL' then 'mismatch' else 'near_miss' end else 'match' end as state from b)
"""


@query("cards_base", f"{CARD_SQL} select item, submission_id, is_error, match_status from b")
def cards_base(spark, sf):
    return cd.cards_base(card_items(spark, sf), card_comparisons(spark, sf)).select(F.col("id").alias("item"), "submission_id", "is_error", "match_status")


@query("card_state", f"{CARD_SQL} select item, submission_id, state from s where not is_error")
def card_state(spark, sf):
    df = cd.cards_base(card_items(spark, sf), card_comparisons(spark, sf)).filter("not is_error")
    state = cd.card_state(F.col("verdict"), F.col("match_status"), F.col("application_value"), F.col("extracted_value"))
    return df.select(F.col("id").alias("item"), "submission_id", state.alias("state"))


@query(
    "review_cards",
    f"""{CARD_SQL} select item, submission_id, v as verdict, state, {DECISION.replace('verdict in', 'v in')} as decision, v <> 'PASS' as is_problem,
   case v when 'FAIL' then 0 when 'PASS' then 2 else 1 end as sort_rank, case when is_error then null else 1 end as readings from s""",
)
def review_cards(spark, sf):
    cards = cd.review_cards(card_items(spark, sf), card_comparisons(spark, sf), progress(spark, sf))
    return cards.select(
        F.col("id").alias("item"), "submission_id", "verdict", "state", "decision", "is_problem", "sort_rank",
        F.when(F.col("readings").isNotNull(), F.size("readings")).alias("readings"),
    )


@query("readings_by_field", f"""select submission_id, check_key as field_key, string_agg(case when l_suppkey % 2 = 0 then 'OCR' else 'AI' end || ':' || coalesce(verdict, '-'), '|'
   order by l_suppkey % 2, l_orderkey, l_linenumber, l_suppkey) as readings from ({ITEMS_SQL}) group by all""")
def readings_by_field(spark, sf):
    rows = card_items(spark, sf).select(
        "submission_id", F.col("check_key").alias("field_key"), F.struct("l_orderkey", "l_linenumber", "l_suppkey").alias("id"),
        F.when(F.col("l_suppkey") % 2 == 0, "ocr:x").otherwise("llm:y").alias("extracted_source"),
        F.coalesce("verdict", F.lit("-")).alias("extracted_value"), F.lit("MATCH").alias("match_status"),
    )
    out = cd.readings_by_field(rows)
    shown = F.transform("readings", lambda r: F.concat(r["source_label"], F.lit(":"), r["value"]))
    return out.select("submission_id", "field_key", F.array_join(shown, "|").alias("readings"))


@query("overlay_decisions", f"select l_orderkey, l_linenumber, submission_id, l_suppkey, {DECISION} as decision from ({ITEMS_SQL})")
def overlay_decisions(spark, sf):
    out = cd.overlay_decisions(card_items(spark, sf), progress(spark, sf))
    return out.select("l_orderkey", "l_linenumber", "submission_id", "l_suppkey", "decision")


@query("checklist_tally", f"select submission_id, count(*) filter (where {DECISION} <> '') as done, count(*) as total, count(*) filter (where {DECISION} <> '') < count(*) as has_open from ({ITEMS_SQL}) group by 1")
def checklist_tally(spark, sf):
    return cd.checklist_tally(card_items(spark, sf), progress(spark, sf))


@query("problems_first", f"select l_orderkey, l_linenumber, submission_id, l_suppkey, case verdict when 'FAIL' then 0 when 'PASS' then 2 else 1 end as rank from ({ITEMS_SQL})")
def problems_first(spark, sf):
    out = cd.problems_first(card_items(spark, sf), "id")
    return out.select("l_orderkey", "l_linenumber", "submission_id", "l_suppkey", cd.severity("verdict").alias("rank"))


@query("steps", """select submission_id, unnest(range(1, len(n) + 1))::int as number, unnest(n) as label from (select l_partkey as submission_id,
   case when bool_or(l_linenumber = 6 and l_returnflag = 'A') then ['Identity','Mandatory text','Gov. Warning','Conditional','Decide'] else ['Identity','Mandatory text','Gov. Warning','Decide'] end as n from lineitem group by 1)""")
def steps(spark, sf):
    items = ad.table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("submission_id"), F.when(F.col("l_linenumber") == 6, "sulfites").otherwise("brand_name").alias("check_key"),
        F.when(F.col("l_returnflag") == "A", "MANUAL").otherwise("FIELD_MATCH").alias("check_type"),
    )
    return cd.steps(items)


@query("item_group", "select l_linenumber, case when l_linenumber = 1 then 'Identity' when l_linenumber = 2 then 'Gov. Warning' else 'Conditional' end as step, count(*) as n from lineitem group by all")
def item_group(spark, sf):
    n = F.col("l_linenumber")
    key = F.when(n == 1, "name_address").when(n == 2, "government_warning").otherwise("sulfites")
    return ad.table(spark, sf, "lineitem").groupBy("l_linenumber", cd.item_group(key).alias("step")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "statement_card",
    """select event_id as submission_id, case event_type when 'click' then 'pass' when 'view' then 'absent' when 'purchase' then 'reworded' else 'couldnt_verify' end as outcome,
   case when event_type in ('error','signup') then 'REVIEW' when value > 30 then 'FAIL' else 'REVIEW' end as verdict,
   case when event_type = 'purchase' then 'ABC' end as required_text, case when event_type = 'purchase' then 'u' || cast(user_id as varchar) end as onlabel_text from events""",
)
def statement_card(spark, sf):
    t = F.col("event_type")
    detail = (
        F.when(t == "click", '{"outcome": "pass"}').when(t == "view", '{"outcome": "absent"}')
        .when(t == "purchase", F.concat(F.lit('{"outcome": "reworded", "expected": "abc", "found": "u'), F.col("user_id").cast("string"), F.lit('"}')))
        .when(t == "error", "broken").otherwise('{"outcome": "odd", "found": "x"}')
    )
    items = ad.table(spark, sf, "events").select(
        F.col("event_id").alias("submission_id"), F.lit("government_warning").alias("check_key"), detail.alias("detail"),
        F.when(F.col("value") > 30, "FAIL").alias("verdict"), F.lit("27 CFR 16.21").alias("cfr_citation"),
    )
    return cd.statement_card(items).select("submission_id", "outcome", "verdict", "required_text", "onlabel_text")


# What a numeric card shows is the first line with a measure of the filed unit; a filed size that is
# no measure takes any unit of size.
SNIPPETS_SQL = f"""
with recursive x as materialized (
  select row_number() over () as row_no, r.id, f.brand_name, f.net_contents, extracted_text as text, {ad.sql_norm('brand_name')} as fn
  from ({ad.READINGS_SQL}) r join ({ad.FILED_SQL}) f on f.id = r.submission_id where status = 'OK'
), {best_window_ctes("select row_no as id, fn as needle, text from x where trim(brand_name) <> '' and trim(text) <> ''", ad.sql_norm)}
select x.id, 'brand_name' as field_key, case when trim(text) = '' then text when trim(brand_name) <> '' then coalesce(run, text) end as shown
from x left join closest on closest.id = row_no
union all
select id, 'net_contents', case when trim(text) = '' then text else (
  select trim(first(line order by n)) from (select unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n)
  where regexp_matches(lower(line), case when net_contents like '% ml' then '(^|[^0-9.,])[0-9]+ *ml([^a-z]|$)' else '(^|[^0-9.,])[0-9]+ *(ml|l)([^a-z]|$)' end)) end
from x
"""


@query("card_snippets", SNIPPETS_SQL)
def card_snippets(spark, sf):
    """What each card shows of a whole-label text."""
    texts = ad.readings(spark, sf).filter("status = 'OK'")
    filed = ad.filed(spark, sf).select(F.col("id").alias("submission_id"), "brand_name", "net_contents")
    rows = texts.join(filed, "submission_id").select(
        "id", "submission_id", F.col("extracted_text").alias("extracted_value"),
        F.explode(F.create_map(F.lit("brand_name"), F.col("brand_name"), F.lit("net_contents"), F.col("net_contents"))).alias("field_key", "application_value"),
        F.lit(1).alias("source_ocr_result_id"), F.lit(None).cast("int").alias("source_llm_result_id"),
    )
    return cd.displayed_value(rows).select("id", "field_key", "shown")


# --- lifecycle ----------------------------------------------------------------------------

FOLD_SQL = f"""
with recursive e as (select *, row_number() over (partition by submission_id order by occurred_at, event_id) as rn from ({ad.LIFECYCLE_SQL})),
idx as (select * from (values ('RECEIVED', 0), ('PROCESSING', 1), ('READY_FOR_REVIEW', 2), ('IN_REVIEW', 3), ('DECIDED', 4)) t(name, i)),
x as (select e.*, i as ti from e left join idx on name = to_status),
f as (select submission_id, 0::bigint as rn, null::bigint as event_id, null::int as state, null::int as before, true as accepted from (select distinct submission_id from e)
  union all
  select x.submission_id, x.rn, x.event_id,
   case when x.event_type = 'BROKEN' then f.state when f.state is null then case when x.event_type = 'SEEDED' then 0 end
        when x.ti is null then f.state
        when x.event_type = 'UNDONE' then case when f.state = 4 then 2 else f.state end
        when x.event_type = 'DECIDED' then case when f.state = 3 then 4 else f.state end
        else greatest(x.ti, f.state) end,
   f.state,
   case when x.event_type = 'BROKEN' then false when f.state is null then x.event_type = 'SEEDED' when x.ti is null then true
        when x.event_type = 'UNDONE' then f.state = 4 when x.event_type = 'DECIDED' then f.state = 3 else x.ti > f.state end
  from f join x on x.submission_id = f.submission_id and x.rn = f.rn + 1)
"""
FOLD_OUT = f"{FOLD_SQL} select event_id, accepted, b.name as from_status from f left join idx b on b.i = f.before where rn > 0"


@query("lifecycle", FOLD_OUT)
def lifecycle(spark, sf):
    events = ad.lifecycle_events(ad.table(spark, sf, "events"))
    return lc.lifecycle(events).select("event_id", "accepted", "from_status")


@query("lifecycle_sliced", FOLD_OUT)
def lifecycle_sliced(spark, sf):
    """The same fold with its groups cut in time, as it runs for hot submissions."""
    events = ad.lifecycle_events(ad.table(spark, sf, "events"))
    return lc.lifecycle(events, slice_rows=1500).select("event_id", "accepted", "from_status")


@query("current_status", f"""{FOLD_SQL} select submission_id, arg_max(to_status, rn) as status from (select f.submission_id, f.rn, case when f.before is null then 'RECEIVED' else x.to_status end as to_status, f.accepted
   from f join x on x.event_id = f.event_id where f.accepted) where to_status is not null group by 1""")
def current_status(spark, sf):
    return lc.current_status(lc.lifecycle(ad.lifecycle_events(ad.table(spark, sf, "events"))))


TRANSITIONS_SQL = f"""with e as (select *, lag(to_status) over (partition by submission_id order by occurred_at, event_id) as from_status from ({ad.LIFECYCLE_SQL}) where to_status is not null),
  idx as (select * from (values ('RECEIVED', 0), ('PROCESSING', 1), ('READY_FOR_REVIEW', 2), ('IN_REVIEW', 3), ('DECIDED', 4)) t(name, i))
  select event_id, from_status, coalesce(a.i > b.i, true) as is_forward from e left join idx a on a.name = to_status left join idx b on b.name = from_status"""


@query("with_transitions", TRANSITIONS_SQL)
def with_transitions(spark, sf):
    e = ad.lifecycle_events(ad.table(spark, sf, "events")).filter("to_status is not null").withColumnRenamed("event_id", "id")
    return lc.with_transitions(e).select(F.col("id").alias("event_id"), "from_status", "is_forward")


@query("transitions_sliced", TRANSITIONS_SQL)
def transitions_sliced(spark, sf):
    """The same in slices, as it runs for submissions with very many events."""
    e = ad.lifecycle_events(ad.table(spark, sf, "events")).filter("to_status is not null").withColumnRenamed("event_id", "id")
    return lc.with_transitions(e, slice_rows=700).select(F.col("id").alias("event_id"), "from_status", "is_forward")


@query("stuck", f"""select submission_id, since from (select submission_id, arg_max(to_status, row(occurred_at, event_id)) as st, max(occurred_at) as since from ({ad.LIFECYCLE_SQL}) group by 1)
  where st = 'PROCESSING' and since + interval 1 hour <= timestamp '2030-01-01'""")
def stuck(spark, sf):
    e = ad.lifecycle_events(ad.table(spark, sf, "events"))
    return lc.stuck(e, "1 hour", F.lit("2030-01-01").cast("timestamp_ntz" if dict(e.dtypes)["occurred_at"] == "timestamp_ntz" else "timestamp")).select("submission_id", "since")


@query("collect_errors", """select p_partkey as submission_id, nullif(concat_ws('; ', case when p_size % 2 = 0 then 'stage=ocr failed: ' || p_type end, case when p_size % 3 = 0 then 'stage=llm failed: ' || p_brand end), '') as note from part""")
def collect_errors(spark, sf):
    s = F.col("p_size")
    stage = lambda no, name, err: F.struct(F.lit(no).alias("stage_no"), F.lit(name).alias("stage"), err.alias("error"))
    rows = ad.table(spark, sf, "part").select(
        F.col("p_partkey").alias("submission_id"),
        F.inline(F.array(stage(1, "ocr", F.when(s % 2 == 0, F.col("p_type"))), stage(2, "llm", F.when(s % 3 == 0, F.col("p_brand"))))),
    )
    return lc.collect_errors(rows)


@query("time_to_decision", f"""select submission_id, round(epoch(max(occurred_at) filter (where event_type = 'DECIDED')) - epoch(min(occurred_at) filter (where event_type = 'SEEDED')), 3) as seconds from ({ad.LIFECYCLE_SQL}) group by 1""")
def time_to_decision(spark, sf):
    e = ad.lifecycle_events(ad.table(spark, sf, "events")).withColumn("occurred_at", F.col("occurred_at").cast("timestamp"))
    return lc.time_to_decision(e).select("submission_id", F.round("seconds", 3).alias("seconds"))


# --- streaming -----------------------------------------------------------------------------


def event_stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    rows = si.read_files(spark, sf, schema, "events.parquet")
    return ad.lifecycle_events(rows).withColumn("occurred_at", F.col("occurred_at").cast("timestamp"))


@query("throughput", "select time_bucket(interval '1 hour', ts) as window_start, count(*) as n from events group by 1")
def throughput(spark, sf):
    e = ad.lifecycle_events(ad.table(spark, sf, "events"))
    return si.throughput(e, "1 hour", "1 day")


@query("claim_once", "select user_id as submission_id, 1::bigint as claims from events group by 1")
def claim_once(spark, sf):
    """Claims granted per submission from a stream in which all of them compete."""
    out = work_dir(spark, "claims")
    s = si.claim_once(event_stream(spark, sf), "submission_id", "occurred_at", "400 days")
    si.run_to_end(s.select("submission_id", "event_id"), out)
    return spark.read.parquet(out).groupBy("submission_id").agg(F.count(F.lit(1)).alias("claims"))


@query("lifecycle_stream", FOLD_OUT)
def lifecycle_streamed(spark, sf):
    out = si.run_to_end(lifecycle_stream(event_stream(spark, sf)), work_dir(spark, "lifecycle"))
    return spark.read.parquet(out).select("event_id", "accepted", "from_status")


RESCUE_HOURS = 6
# The fold of event order, in which a submission that has been in PROCESSING for too long is finished
# before its next event, or at the end of all events.
TIMED_SQL = FOLD_SQL.replace("true as accepted from (select distinct", "true as accepted, null::timestamp as seen_at, null::timestamp as rescued from (select distinct").replace(
    "from f join x on x.submission_id = f.submission_id and x.rn = f.rn + 1)",
    f""", x.occurred_at, case when f.before_rescue then f.seen_at + interval {RESCUE_HOURS} hour end
  from (select g.submission_id, g.rn, g.seen_at, g.state = 1 and y.occurred_at > g.seen_at + interval {RESCUE_HOURS} hour as before_rescue,
          case when g.state = 1 and y.occurred_at > g.seen_at + interval {RESCUE_HOURS} hour then 2 else g.state end as state
        from f g join x y on y.submission_id = g.submission_id and y.rn = g.rn + 1) f
  join x on x.submission_id = f.submission_id and x.rn = f.rn + 1)""",
)


@query(
    "lifecycle_timed",
    f"""{TIMED_SQL} select submission_id, event_id, epoch_us(seen_at) as micros, accepted, b.name as from_status from f left join idx b on b.i = f.before where rn > 0
    union all select submission_id, -1, epoch_us(rescued), true, 'PROCESSING' from f where rescued is not null
    union all select submission_id, -1, epoch_us(seen_at + interval {RESCUE_HOURS} hour), true, 'PROCESSING' from (select *, max(rn) over (partition by submission_id) as last from f)
      where rn = last and state = 1 and epoch_ms(seen_at + interval {RESCUE_HOURS} hour) <= (select epoch_ms(max(occurred_at)) from e)""",
)
def lifecycle_timed(spark, sf):
    """The stream in event order with its rescue timer, which fires between events and at the end."""
    out = si.run_to_end(timed_lifecycle(event_stream(spark, sf), "0 seconds", RESCUE_HOURS * 3_600_000), work_dir(spark, "timed"), store=STORE)
    rows = spark.read.parquet(out)
    return rows.select("submission_id", "event_id", F.unix_micros("occurred_at").alias("micros"), "accepted", "from_status")


@query("append_audit", f"{FOLD_SQL} select event_id, x.event_type from f join x using (event_id) where accepted and event_id is not null")
def append_audit(spark, sf):
    folded = lc.audit_rows(lifecycle_stream(event_stream(spark, sf)))
    out = si.append_audit(folded, work_dir(spark, "audit"))
    return spark.read.parquet(out).select("event_id", "event_type")


@query("serve_queue", f"select beverage_type, id from (select *, row_number() over (partition by beverage_type order by submitted_at, id) as rk from ({ad.QUEUE_SQL}) where status = 'READY_FOR_REVIEW') where rk = 1")
def serve_queue(spark, sf):
    schema = spark.read.parquet(f"{sf}/orders.parquet").schema
    o = si.read_files(spark, sf, schema, "orders.parquet")
    rows = o.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("submitted_at"), F.col("o_orderpriority").alias("beverage_type"),
        F.when(F.col("o_orderstatus") == "O", "READY_FOR_REVIEW").otherwise("DECIDED").alias("status"),
    )
    out = si.serve_queue(rows, work_dir(spark, "queue"), work_dir(spark, "serve"))
    return spark.read.parquet(f"{out}/next").select("beverage_type", "id")
