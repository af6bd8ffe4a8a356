"""Constraint, keyed-update and queue queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from concordat import vocab
from concordat.operators import keyed as ky
from concordat.operators import quality as ql
from concordat.operators import queue as qu
from concordat.operators import report  # noqa: F401
from concordat.plans import adapters as ad
from concordat.plans.registry import query

# --- constraints -----------------------------------------------------------------


@query(
    "check_domains",
    """select id, c as constraint from (select o_orderkey as id, unnest([case when o_orderstatus not in ('O','F') then 'status_known' end,
   case when o_totalprice < 50000 then 'price_range' end, case when o_orderpriority = '5-LOW' then 'priority_known' end]) as c from orders) where c is not null""",
)
def check_domains(spark, sf):
    rules = {
        "status_known": ql.in_domain("o_orderstatus", ("O", "F")),
        "price_range": ql.in_range("o_totalprice", 50000),
        "priority_known": ql.in_domain("o_orderpriority", ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED")),
    }
    return ql.check_domains(ad.table(spark, sf, "orders"), rules, ("o_orderkey",)).withColumnRenamed("o_orderkey", "id")


READING_RULES_SQL = f"""select c as constraint, count(*) as n from (select unnest([case when confidence not between 0 and 0.9 then 'confidence_range' end,
   case when image_variant not in ('O') then 'variant_known' end, case when latency_ms < 2 then 'latency_low' end]) as c from ({ad.READINGS_SQL})) where c is not null group by 1"""


@query("violation_counts", READING_RULES_SQL)
def violation_counts(spark, sf):
    rules = {
        "confidence_range": ql.in_range("confidence", 0, 0.9),
        "variant_known": ql.in_domain("image_variant", ("O",)),
        "latency_low": ql.in_range("latency_ms", 2),
    }
    return ql.violation_counts(ad.readings(spark, sf), rules)


@query("engine_constraints", f"""select 'event_known' as constraint, count(*) as n from ({ad.LIFECYCLE_SQL}) where event_type = 'BROKEN' having count(*) > 0""")
def engine_constraints(spark, sf):
    return ql.violation_counts(ad.lifecycle_events(ad.table(spark, sf, "events")), ql.table_constraints("audit_events"))


DECIDED_SQL = """select o_orderkey as id, o_orderstatus, case when o_orderstatus = 'F' then 'DECIDED' else 'RECEIVED' end as status,
  case when o_orderstatus = 'F' and o_orderpriority <> '5-LOW' then 'APPROVED' when o_orderpriority = '1-URGENT' then 'NEEDS_CORRECTION' end as disposition,
  case when o_orderstatus = 'F' then o_orderdate end as decided_at, case when o_orderpriority in ('1-URGENT','2-HIGH') and o_custkey % 3 = 0 then o_orderdate end as correction_due_at from orders"""


@query(
    "check_rows",
    f"""select id, unnest(list_filter([case when not ((status = 'DECIDED' and disposition is not null and decided_at is not null) or (status <> 'DECIDED' and disposition is null and decided_at is null)) then 'decided_iff_disposition' end,
   case when correction_due_at is not null and coalesce(disposition, '') <> 'NEEDS_CORRECTION' then 'due_only_for_correction' end], lambda x: x is not null)) as constraint from ({DECIDED_SQL})""",
)
def check_rows(spark, sf):
    o = ad.table(spark, sf, "orders")
    s, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    rows = o.select(
        F.col("o_orderkey").alias("id"), F.when(s == "F", "DECIDED").otherwise("RECEIVED").alias("status"),
        F.when((s == "F") & (p != "5-LOW"), "APPROVED").when(p == "1-URGENT", "NEEDS_CORRECTION").alias("disposition"),
        F.when(s == "F", F.col("o_orderdate")).alias("decided_at"),
        F.when(p.isin("1-URGENT", "2-HIGH") & (F.col("o_custkey") % 3 == 0), F.col("o_orderdate")).alias("correction_due_at"),
    )
    return ql.check_rows(rows, ql.row_predicates(), ("id",))


@query("check_unique", "select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def check_unique(spark, sf):
    return ql.check_unique(ad.table(spark, sf, "lineitem"), ("l_orderkey", "l_linenumber"))


@query("quarantine", "select event_type in ('click','view','error') or event_type is null as good, count(*) as n from events group by 1")
def quarantine(spark, sf):
    good, bad = ql.quarantine(ad.table(spark, sf, "events"), {"event_type": ("click", "view", "error")})
    count = lambda df, flag: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(flag).alias("good"), "n")
    return count(good, True).unionByName(count(bad, False))


@query("check_dispositions", "select o_orderkey, case when o_orderstatus = 'P' then 'unknown disposition' when o_orderstatus = 'F' and o_custkey % 2 = 0 then 'notes are required' end as problem from orders")
def check_dispositions(spark, sf):
    s = F.col("o_orderstatus")
    rows = ad.table(spark, sf, "orders").select(
        "o_orderkey", F.when(s == "O", "APPROVED").when(s == "F", "REJECTED").otherwise("LATER").alias("disposition"),
        F.when(F.col("o_custkey") % 2 == 1, "see label").otherwise("  ").alias("notes"),
    )
    return ql.check_dispositions(rows).select("o_orderkey", "problem")


@query("extra_fields_wide", "select user_id as submission_id, max(props) filter (where event_type = 'click') as click, max(props) filter (where event_type = 'view') as view from events where event_type in ('click','view') group by 1")
def extra_fields_wide(spark, sf):
    eav = ad.table(spark, sf, "events").select(F.col("user_id").alias("submission_id"), F.col("event_type").alias("field_key"), F.col("props").alias("value_text"))
    return ql.extra_fields_wide(eav, ("click", "view"))


# --- keyed updates ------------------------------------------------------------------


@query(
    "upsert",
    """with u as (select o_custkey as k, arg_max(o_totalprice, o_orderkey) as price, max(o_orderkey) as ts from orders where o_orderstatus <> 'O' or o_custkey % 5 = 0 group by 1),
  t as (select c_custkey as k, c_name, c_acctbal from customer where c_custkey % 4 <> 0)
  select coalesce(t.k, u.k) as k, c_name, coalesce(u.price, c_acctbal) as c_acctbal, coalesce(u.ts, -1) as ts from t full join u on t.k = u.k""",
)
def upsert(spark, sf):
    target = ad.table(spark, sf, "customer").filter("c_custkey % 4 <> 0").select(
        F.col("c_custkey").alias("k"), "c_name", "c_acctbal", F.lit(-1).cast("bigint").alias("ts")
    )
    updates = ad.table(spark, sf, "orders").filter("o_orderstatus <> 'O' or o_custkey % 5 = 0").select(
        F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("c_acctbal"), F.col("o_orderkey").alias("ts")
    )
    return ky.upsert(target, updates, "k", "ts")


@query("update_columns", "select o_orderkey, coalesce(case when c_mktsegment = 'BUILDING' then 'X' end, o_orderstatus) as o_orderstatus from orders left join customer on c_custkey = o_orderkey")
def update_columns(spark, sf):
    target = ad.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    updates = ad.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("o_orderkey"), F.when(F.col("c_mktsegment") == "BUILDING", "X").alias("o_orderstatus")
    )
    return ky.update_columns(target, updates, "o_orderkey")


CAS_SQL = """
with r as (select event_id, user_id * 7 as id, ts, event_type from events),
w as (select * from (select *, row_number() over (partition by id order by ts, event_id) as rk from r) where rk = 1 and id in (select o_orderkey from orders where o_orderstatus = 'O'))
"""


def cas(spark, sf):
    target = ad.queue(spark, sf).withColumn("disposition", F.lit(None).cast("string"))
    requests = ad.table(spark, sf, "events").select(
        (F.col("user_id") * 7).alias("id"), F.col("ts").alias("requested_at"), F.col("event_id").alias("request_id"), F.col("event_type").alias("wanted")
    )
    return ky.compare_and_swap(
        target, requests, "id", "status", "READY_FOR_REVIEW", {"status": F.lit("DECIDED"), "disposition": F.col("wanted")}
    )


@query("compare_and_swap_outcome", f"{CAS_SQL} select event_id as request_id, r.event_id in (select event_id from w) as won from r")
def compare_and_swap_outcome(spark, sf):
    return cas(spark, sf)[1].select("request_id", "won")


@query("compare_and_swap_target", f"{CAS_SQL} select o_orderkey as id, case when w.id is not null then 'DECIDED' when o_orderstatus = 'O' then 'READY_FOR_REVIEW' when o_orderstatus = 'F' then 'DECIDED' else 'RECEIVED' end as status, w.event_type as disposition from orders left join w on w.id = o_orderkey")
def compare_and_swap_target(spark, sf):
    return cas(spark, sf)[0].select("id", "status", "disposition")


@query("overwrite_keys", "select o_custkey, o_orderkey, case when o_custkey % 3 = 0 then 'new' else 'old' end as version from orders where o_custkey % 3 <> 0 or o_orderstatus = 'O' or o_custkey % 3 = 0 and o_custkey not in (select o_custkey from orders where o_custkey % 3 = 0 and o_orderstatus = 'O')")
def overwrite_keys(spark, sf):
    o = ad.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    old = o.select("o_custkey", "o_orderkey", F.when(F.col("o_custkey") % 3 == 0, "new").otherwise("old").alias("version"))
    new = o.filter("o_custkey % 3 = 0 and o_orderstatus = 'O'").select("o_custkey", "o_orderkey", F.lit("new").alias("version"))
    return ky.overwrite_keys(old, new, "o_custkey")


# --- queue ----------------------------------------------------------------------------


@query("waiting", "select count(*) as waiting from orders where o_orderstatus = 'O' and o_orderpriority = '2-HIGH'")
def waiting(spark, sf):
    return qu.waiting(ad.queue(spark, sf), "2-HIGH")


@query("waiting_by_type", f"select beverage_type, count(*) as waiting, grouping(beverage_type)::int as is_total from ({ad.QUEUE_SQL}) where status = 'READY_FOR_REVIEW' group by cube(beverage_type)")
def waiting_by_type(spark, sf):
    return qu.waiting_by_type(ad.queue(spark, sf))


@query("oldest_ready", f"select id, submitted_at from ({ad.QUEUE_SQL}) where status = 'READY_FOR_REVIEW' order by submitted_at, id limit 1")
def oldest_ready(spark, sf):
    return qu.oldest_ready(ad.queue(spark, sf)).select("id", "submitted_at")


@query("oldest_ready_per_type", f"select beverage_type, id, submitted_at from (select *, row_number() over (partition by beverage_type order by submitted_at, id) as rk from ({ad.QUEUE_SQL}) where status = 'READY_FOR_REVIEW') where rk = 1")
def oldest_ready_per_type(spark, sf):
    return qu.oldest_ready_per_type(ad.queue(spark, sf))


@query("intake_batch", f"select id, submitted_at from ({ad.QUEUE_SQL}) where status = 'RECEIVED' order by submitted_at, id limit 10")
def intake_batch(spark, sf):
    return qu.intake_batch(ad.queue(spark, sf), 10).select("id", "submitted_at")


@query("ordered_read", f"select id, submitted_at from ({ad.QUEUE_SQL})")
def ordered_read(spark, sf):
    return qu.ordered(ad.queue(spark, sf).select("id", "submitted_at"), ("submitted_at", "id"))


@query("lookup", "select o_orderkey, o_orderpriority from orders where o_orderkey = 77")
def lookup(spark, sf):
    return qu.lookup(ad.table(spark, sf, "orders"), "o_orderkey", 77).select("o_orderkey", "o_orderpriority")
