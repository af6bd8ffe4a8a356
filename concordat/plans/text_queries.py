"""Scalar functions at work over whole tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from concordat import vocab
from concordat.functions import display as dp
from concordat.functions import jsonfields as js
from concordat.functions import measures as ms
from concordat.functions import text as tx
from concordat.operators import cards as cd
from concordat.plans import adapters as ad
from concordat.plans.check_queries import CANON, TOK
from concordat.plans.registry import query
from concordat.plans.sequence_sql import best_window_ctes
from concordat.session import written
from concordat.sources import cleaning as cl
from concordat.sources.files import spread_rank


def docs(spark, sf):
    return ad.spread(ad.table(spark, sf, "documents"))


@query("normalize_text", f"select doc_id, md5({ad.sql_norm('text')}) as digest, length({ad.sql_norm('text')}) as n from documents")
def normalize_text(spark, sf):
    t = docs(spark, sf).select("doc_id", tx.normalize_text("text").alias("t"))
    return t.select("doc_id", F.md5("t").alias("digest"), F.length("t").cast("bigint").alias("n"))


@query("normalize_field", """select p_partkey, cast(p_size * 50 as varchar) || ' ml' as net, cast(p_size as varchar) || '.5 %' as abv,
   lower(p_name) as name from part""")
def normalize_field(spark, sf):
    p = ad.table(spark, sf, "part")
    net = F.concat((F.col("p_size") * 50).cast("string"), F.lit(".00  Milliliter."))
    abv = F.concat(F.col("p_size").cast("string"), F.lit(".50 % Alc/Vol"))
    return p.select(
        "p_partkey", ms.normalize_field(net, "net_contents").alias("net"),
        ms.normalize_field(abv, "alcohol_content").alias("abv"),
        ms.normalize_field(F.concat(F.lit(" "), F.upper("p_name"), F.lit("!.")), "brand_name").alias("name"),
    )


@query("strip_thousands", """select o_orderkey, regexp_replace(regexp_replace(cast(floor(o_totalprice) as bigint)::varchar, ',', ''), ',', '') || ' ml, 1,5 l' as cleaned from orders""")
def strip_thousands(spark, sf):
    o = ad.table(spark, sf, "orders")
    text = F.concat(F.format_number(F.floor("o_totalprice"), 0), F.lit(" ml, 1,5 l"))
    return o.select("o_orderkey", ms.strip_thousands(text).alias("cleaned"))


@query(
    "parse_all_numeric",
    f"""select doc_id, len(n) as tokens, array_to_string(list_transform(range(1, len(n) + 1), lambda i: n[i] || ' ' || {CANON.format(u='u[i]')}), ';') as found
 from (select doc_id, regexp_extract_all(t, '{TOK}', 2) as n, regexp_extract_all(t, '{TOK}', 3) as u
       from (select doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) || ' ' || cast(n_chars as varchar) || ' fl oz' as t from documents))""",
)
def parse_all_numeric(spark, sf):
    """Every measure of each document, with one appended so that none is empty."""
    d = docs(spark, sf).withColumn("t", F.concat("text", F.lit(" "), F.col("n_chars").cast("string"), F.lit(" FL OZ")))
    d = d.withColumn("m", ms.parse_all_numeric("t", "net_contents"))
    shown = F.transform("m", lambda m: F.concat(ms.shown_number(m), F.lit(" "), m["unit"]))
    return d.select("doc_id", F.size("m").cast("bigint").alias("tokens"), F.array_join(shown, ";").alias("found"))


@query("canonical_unit", f"""select word, {CANON.format(u='word')} as unit, count(*) as n from (
   select case when l_linenumber = 1 then 'ml' when l_linenumber = 2 then 'litre' when l_linenumber = 3 then 'fl. oz.' when l_linenumber = 4 then '%' when l_linenumber = 5 then 'gallons' else 'oz' end as word from lineitem) group by all""")
def canonical_unit(spark, sf):
    n = F.col("l_linenumber")
    word = F.when(n == 1, "ml").when(n == 2, "litre").when(n == 3, "fl. oz.").when(n == 4, "%").when(n == 5, "gallons").otherwise("oz")
    li = ad.table(spark, sf, "lineitem").groupBy(word.alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return li.select("word", ms.canonical_unit("word").alias("unit"), "n")


@query("unit_tokens")
def unit_tokens(spark, sf):
    """Format tokens with their spans over whole label texts."""
    r = ad.readings(spark, sf).select("id", ms.unit_tokens("extracted_text", spans=True).alias("t"))
    # The outer form keeps the optimizer from scanning every text twice more in a filter on the array.
    return r.select("id", F.explode_outer("t").alias("t")).filter("t is not null").select(
        "id", F.col("t.value").cast("double").alias("value"), "t.unit", "t.start", "t.end"
    )


@query("word_present", "select doc_id, regexp_matches(lower(text), '(^|[^a-z0-9])the($|[^a-z0-9])') as has_the, regexp_matches(lower(text), '(^|[^a-z0-9])ing($|[^a-z0-9])') as has_ing from documents")
def word_present(spark, sf):
    low = F.lower("text")
    return docs(spark, sf).select("doc_id", tx.word_present(low, "the").alias("has_the"), tx.word_present(low, "ing").alias("has_ing"))


@query("has_value", "select doc_id, regexp_matches(left(text, 1), '\\S') as first_filled, regexp_matches(text, '\\S') as filled from documents")
def has_value(spark, sf):
    return docs(spark, sf).select("doc_id", tx.has_value(F.left("text", F.lit(1))).alias("first_filled"), tx.has_value("text").alias("filled"))


@query(
    "edit_rate",
    f"""
select d.doc_id, b.item_id, round(levenshtein({ad.sql_one_byte(ad.sql_norm('d.text'))}, {ad.sql_one_byte(ad.sql_norm('b.text'))})
   / length({ad.sql_norm('b.text')})::double, 6) as cer
from (select *, (row_number() over (order by doc_id) - 1) % (select count(*) from benchmark) as k from documents) d
join (select *, row_number() over (order by item_id) - 1 as k from benchmark) b using (k)
""",
)
def edit_rate(spark, sf):
    """Edit rate of each document against one benchmark item, dealt by rank."""
    ranked = lambda df, key: spread_rank(df.withColumn("all", F.lit(0)), "all", key, "k").withColumn("k", F.col("k") - 1)
    b = ad.table(spark, sf, "benchmark").withColumnRenamed("text", "gold")
    n = b.count()
    d = docs(spark, sf).select("doc_id", "text")
    # Only ids are ranked: a task of the ranking holds a slice of ids, which may be those of all texts.
    first = ranked(d.select("doc_id"), "doc_id").groupBy("doc_id").agg(F.min("k").alias("k"))
    again = F.row_number().over(W.partitionBy("doc_id").orderBy("doc_id")) - 1
    d = d.repartition("doc_id").join(first, "doc_id").withColumn("k", (F.col("k") + again) % n)
    rows = d.join(ranked(b, "item_id").select("k", "item_id", "gold"), "k")
    return rows.select("doc_id", "item_id", F.round(tx.edit_rate("text", "gold"), 6).alias("cer"))


@query("letters_only", "select doc_id, md5(regexp_replace(lower(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '-\\s+', '', 'g')), '[^a-z]', '', 'g')) as digest from documents")
def letters_only(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(tx.letters_only("text")).alias("digest"))


@query("casing_tests", "select doc_id, text = upper(text) and text <> lower(text) as all_caps, strpos(lower(text), 'the') > 0 and substr(text, strpos(lower(text), 'the'), 1) = 'T' as capital_the from documents")
def casing_tests(spark, sf):
    return docs(spark, sf).select("doc_id", tx.is_all_caps("text").alias("all_caps"), tx.initial_capital("text", "the").alias("capital_the"))


@query("truncate_text", "select doc_id, case when length(text) > 200 then left(text, 200) || '…[truncated]' else text end as shown from documents")
def truncate_text(spark, sf):
    return docs(spark, sf).select("doc_id", tx.truncate("text", 200).alias("shown"))


@query("any_phrase", "select doc_id, contains(lower(text), 'the the') or contains(lower(text), 'in and') as found from documents")
def any_phrase(spark, sf):
    return docs(spark, sf).select("doc_id", tx.any_phrase("text", ("the the", "in and")).alias("found"))


@query("with_model", "select event_id, case when value > 50 then 'seen ' || event_type || ' | model=' || event_type else 'seen ' || event_type end as detail from events")
def with_model(spark, sf):
    e = ad.table(spark, sf, "events")
    d = F.concat(F.lit("seen "), F.col("event_type"))
    return e.select("event_id", tx.with_model(d, F.when(F.col("value") > 50, F.col("event_type"))).alias("detail"))


# --- JSON -----------------------------------------------------------------------

PAYLOAD_SQL = """case event_type when 'click' then props when 'view' then '{"k": [1, 2]}' when 'error' then 'oops'
   when 'signup' then '{"k": "' || event_type || ' ' || cast(user_id as varchar) || '"}' else '{"k": ' || cast(user_id as varchar) || '.50}' end"""


def payloads(spark, sf):
    t = F.col("event_type")
    user = F.col("user_id").cast("string")
    body = (
        F.when(t == "click", F.col("props")).when(t == "view", '{"k": [1, 2]}').when(t == "error", "oops")
        .when(t == "signup", F.concat(F.lit('{"k": "'), t, F.lit(" "), user, F.lit('"}')))
        .otherwise(F.concat(F.lit('{"k": '), user, F.lit(".50}")))
    )
    return ad.table(spark, sf, "events").select("event_id", "event_type", "user_id", "value", "props", body.alias("body"))


@query(
    "json_scalar",
    f"""select event_id, case event_type when 'click' then json_extract_string(props, '$.k') when 'signup' then 'signup ' || cast(user_id as varchar)
     when 'purchase' then cast(user_id as varchar) || '.5' end as k from (select *, {PAYLOAD_SQL} as body from events)""",
)
def json_scalar(spark, sf):
    return payloads(spark, sf).select("event_id", js.json_scalar("body", "k").alias("k"))


NUMBERS_SQL = """
select event_id, case event_id % 6 when 0 then '9' || lpad(event_id::varchar, 40, '0') when 1 then (user_id + 1)::varchar || repeat('0', 30)
  when 2 then user_id::varchar || '.5' when 3 then event_type when 4 then '0.' || repeat('0', 12) || (user_id + 1)::varchar || '1' end as k from events
"""


@query("json_numbers", NUMBERS_SQL)
def json_numbers(spark, sf):
    """Numbers of forty digits, with exponents, and members that are repeated in a payload."""
    e = ad.table(spark, sf, "events")
    user, i = F.col("user_id").cast("string"), F.col("event_id") % 6
    last = (
        F.when(i == 0, F.concat(F.lit("9"), F.lpad(F.col("event_id").cast("string"), 40, "0"))).when(i == 1, F.concat((F.col("user_id") + 1).cast("string"), F.lit("e30")))
        .when(i == 2, F.concat(user, F.lit(".500"))).when(i == 3, F.concat(F.lit('"'), "event_type", F.lit('"')))
        .when(i == 4, F.concat((F.col("user_id") + 1).cast("string"), F.lit("1e-"), (F.length((F.col("user_id") + 1).cast("string")) + 13).cast("string"))).otherwise("[1]")
    )
    body = F.concat(F.lit('{"k": "first", "other": {"k": 1, "k": 2}, "k": '), last, F.lit("}"))
    return e.select("event_id", js.json_scalar(body, "k").alias("k"))


@query(
    "statement_text",
    f"""select event_id, case event_type when 'error' then 'oops' when 'click' then json_extract_string(props, '$.k') when 'signup' then 'signup ' || cast(user_id as varchar)
     when 'purchase' then cast(user_id as varchar) || '.5' end as statement from events""",
)
def statement_text(spark, sf):
    return payloads(spark, sf).select("event_id", js.statement_text("body", "k").alias("statement"))


@query("set_updates", """select user_id, array_to_string(list_sort(list_distinct(list_append(keys, 'added'))), ',') as added,
   array_to_string(list_sort(list_filter(keys, lambda x: x <> 'click')), ',') as removed
   from (select user_id, list(distinct event_type) as keys from events group by user_id)""")
def set_updates(spark, sf):
    e = ad.table(spark, sf, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("keys"))
    return e.select(
        "user_id", F.array_join(js.set_add("keys", F.lit("added")), ",").alias("added"),
        F.array_join(js.set_remove("keys", F.lit("click")), ",").alias("removed"),
    )


@query("map_set", """select event_id, case when value > 40 then '{"a":"pass","b":"fail","' || event_type || '":"pass"}' else '{"a":"pass","b":"fail"}' end as decisions from events""")
def map_set(spark, sf):
    e = ad.table(spark, sf, "events")
    base = F.create_map(F.lit("b"), F.lit("fail"), F.lit("a"), F.lit("pass"))
    value = F.when(F.col("value") > 40, "pass")
    return e.select("event_id", js.sorted_map_json(js.map_set(base, F.col("event_type"), value)).alias("decisions"))


@query("read_progress", """select p_partkey as submission_id, case when p_size = 1 then 0 when p_size % 3 = 0 then 0 else 2 end as ticked,
   case when p_size = 1 then null when p_size % 4 = 0 then 'pass' end as brand, case when p_size = 1 then null else p_name end as notes from part""")
def read_progress(spark, sf):
    p = ad.table(spark, sf, "part")
    rows = p.filter("p_size <> 1").select(
        F.col("p_partkey").alias("submission_id"),
        F.when(F.col("p_size") % 3 == 0, F.lit(None)).otherwise('["a", "b"]').alias("ticked_check_keys"),
        F.when(F.col("p_size") % 4 == 0, '{"brand_name": "pass"}').otherwise("{broken").alias("decisions"),
        F.col("p_name").alias("draft_notes"),
    )
    out = cd.read_progress(rows, p.select(F.col("p_partkey").alias("id")))
    return out.select(
        "submission_id", F.size("ticked_check_keys").alias("ticked"),
        F.try_element_at("decisions", F.lit("brand_name")).alias("brand"), F.col("draft_notes").alias("notes"),
    )


@query("step_caption", """select event_id, case when event_type = 'error' then 'preprocessed' when value > 50 then 'deskew · contrast' when value > 10 then 'deskew' else 'preprocessed' end as caption from events""")
def step_caption(spark, sf):
    v = F.col("value")
    flag = lambda c: F.when(c, "true").otherwise("false")
    log = F.concat(
        F.lit('[{"step": "decode", "applied": true}, {"step": "deskew", "applied": '), flag(v > 10),
        F.lit(', "deskew_angle": 1.5}, {"step": "clahe_contrast", "applied": '), flag(v > 50), F.lit("}]"),
    )
    e = ad.table(spark, sf, "events")
    return e.select("event_id", js.step_caption(F.when(F.col("event_type") == "error", "{bad").otherwise(log)).alias("caption"))


# --- labels and formats -------------------------------------------------------------


@query("source_label", "select event_id, case event_type when 'click' then 'OCR' when 'view' then 'AI' else 'On label' end as label from events")
def source_label(spark, sf):
    t = F.col("event_type")
    src = F.when(t == "click", "ocr:tesseract").when(t == "view", "llm:m1").when(t == "error", "other")
    return ad.table(spark, sf, "events").select("event_id", dp.source_label(src).alias("label"))


@query("resolve_type", "select o_orderkey, case o_orderstatus when 'O' then 'WINE' when 'F' then 'MALT_BEVERAGE' end as type from orders")
def resolve_type(spark, sf):
    s = F.col("o_orderstatus")
    raw = F.when(s == "O", " Wine ").when(s == "F", "BEER").otherwise("any")
    return ad.table(spark, sf, "orders").select("o_orderkey", dp.resolve_type(raw).alias("type"))


@query("label_or_raw", "select event_id, case event_type when 'click' then 'Tesseract 5' when 'view' then 'PaddleOCR (PP-OCRv5)' else event_type end as label from events")
def label_or_raw(spark, sf):
    t = F.col("event_type")
    name = F.when(t == "click", "tesseract").when(t == "view", "paddle").otherwise(t)
    return ad.table(spark, sf, "events").select("event_id", dp.label_or_raw(name, vocab.ENGINE_LABELS).alias("label"))


@query(
    "report_formats",
    """select event_id, printf('%.1f', round_even(cast(value as decimal(30,10)), 1)) as pct,
   format('{:,}', cast(round_even(cast(value * 100 as decimal(30,10)), 0) as bigint)) as ms,
   case when value > 100 then 'not priced' else '$' || printf('%.2f', cast(value as decimal(30,10))) end as cost from events""",
)
def report_formats(spark, sf):
    v = F.col("value")
    return ad.table(spark, sf, "events").select(
        "event_id", dp.fmt_percent(v.cast("decimal(20,6)") / 100).alias("pct"), dp.fmt_ms(v * 100).alias("ms"),
        dp.fmt_cost(F.when(v <= 100, v)).alias("cost"),
    )


@query("indicator", "select l_linenumber, case when l_linenumber = 1 then 'matches' when l_linenumber = 2 then 'differs' when l_linenumber = 3 then 'not found' when l_linenumber = 4 then 'can’t verify' else '' end as indicator, count(*) as n from lineitem group by all")
def indicator(spark, sf):
    n = F.col("l_linenumber")
    status = F.when(n == 1, "MATCH").when(n == 2, "MISMATCH").when(n == 3, "MISSING").when(n == 4, "UNVERIFIABLE")
    return ad.table(spark, sf, "lineitem").groupBy("l_linenumber", dp.indicator(status).alias("indicator")).agg(F.count(F.lit(1)).alias("n"))


# --- cleaning -------------------------------------------------------------------------


@query("iso_date", "select o_orderkey, case when o_orderstatus = 'P' then '2023-01-01' else strftime(o_orderdate, '%Y-%m-%d') end as iso from orders")
def iso_date(spark, sf):
    text = F.when(F.col("o_orderstatus") == "P", "soon").otherwise(F.date_format("o_orderdate", "M/d/yyyy"))
    return ad.table(spark, sf, "orders").select("o_orderkey", cl.iso_date(text).alias("iso"))


@query(
    "permit_and_applicant",
    """select s_suppkey, case when s_suppkey % 2 = 0 then 'NY-I-20' || cast(s_suppkey as varchar) else '' end as permit,
   'C & P ' || s_name as applicant from supplier""",
)
def permit_and_applicant(spark, sf):
    s = ad.table(spark, sf, "supplier")
    code = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("NY-I-20"), F.col("s_suppkey").cast("string"), F.lit(" "))).otherwise("")
    raw = F.concat(code, F.lit("C &amp; P  "), F.col("s_name"))
    return s.select("s_suppkey", cl.permit_code(raw).alias("permit"), cl.clean_applicant(raw).alias("applicant"))


@query("unescape_pages", """select page_id, md5(replace(replace(replace(replace(replace(replace(replace(replace(replace(html,'&lt;','<'),'&gt;','>'),'&quot;','"'),'&#39;',''''),'&apos;',''''),'&nbsp;',chr(160)),'&copy;','©'),'&middot;','·'),'&amp;','&')) as digest
  from pages""")
def unescape_pages(spark, sf):
    return ad.spread(ad.table(spark, sf, "pages")).select("page_id", F.md5(cl.unescape_html("html")).alias("digest"))


@query("clean_origin", "select n_nationkey, 'Nation_' || cast(n_nationkey as varchar) as origin, case when n_nationkey % 2 = 0 then 'DOMESTIC' else 'IMPORTED' end as source from nation")
def clean_origin(spark, sf):
    n = ad.table(spark, sf, "nation")
    origin = F.when(F.col("n_nationkey") % 2 == 0, " new york ").otherwise(F.col("n_name"))
    return n.select(
        "n_nationkey", cl.clean_origin(F.concat("n_name", F.lit(" (UNION OF)"))).alias("origin"), cl.product_source(origin).alias("source")
    )


@query("clean_measures", """select p_partkey, case when p_size % 4 = 0 then cast(p_size as varchar) || ' mL' when p_size % 4 = 1 then cast(p_size as varchar) || '.5 Gallons'
   when p_size % 4 = 2 then cast(p_size as varchar) || ' fl oz' else '' end as net, case when p_size % 5 = 0 then '' else cast(p_size as varchar) || '% Alc./Vol.' end as abv from part""")
def clean_measures(spark, sf):
    p = ad.table(spark, sf, "part")
    s = F.col("p_size")
    n = s.cast("string")
    net = F.when(s % 4 == 0, F.concat(n, F.lit(" MILLILITERS"))).when(s % 4 == 1, F.concat(n, F.lit(".5 GAL. (1/2 BBL)"))).when(s % 4 == 2, F.concat(n, F.lit(" Fl. Oz."))).otherwise("a keg")
    abv = F.when(s % 5 == 0, " ").when(s % 5 == 1, F.concat(n, F.lit("%"))).otherwise(n)
    return p.select("p_partkey", cl.clean_net(net).alias("net"), cl.clean_abv(abv).alias("abv"))


@query("clean_class", """select p_partkey, case when p_size % 2 = 0 then 'Flavored ' else '' end || upper(left(p_type, 1)) || lower(substr(p_type, 2)) || ' Rum' as designation from part""")
def clean_class(spark, sf):
    p = ad.table(spark, sf, "part")
    code = F.concat(
        F.lit("OTHER "), "p_type", F.lit(" rum/PORT (COOKING) 80-89 PROOF FB"), F.when(F.col("p_size") % 2 == 0, " FLAVORED").otherwise("")
    )
    return p.select("p_partkey", cl.clean_class(code).alias("designation"))


@query("image_role", "select p_partkey, case p_type when 'SMALL' then 'BRAND' when 'LARGE' then 'BACK' when 'PROMO' then 'NECK' else 'OTHER' end as role from part")
def image_role(spark, sf):
    t = F.col("p_type")
    return ad.table(spark, sf, "part").select("p_partkey", cl.image_role(F.when(t == "SMALL", "Front").when(t == "LARGE", "back").when(t == "PROMO", "NECK").otherwise(F.lower(t))).alias("role"))


@query("numeric_line", f"""select l_orderkey, l_linenumber, l_partkey, l_suppkey,
   'net ' || cast(p_size * 50 + case when l_orderkey % 97 = 3 then 10 else 0 end as varchar) || case when l_orderkey % 89 = 4 then 'OZ' else 'ML' end
     || ' | ' || cast(p_size as varchar) || case when l_orderkey % 3 = 0 then '.5' else '' end || '% alc' as abv_line,
   case when l_orderkey % 89 = 4 then null else 'net ' || cast(p_size * 50 + case when l_orderkey % 97 = 3 then 10 else 0 end as varchar) || 'ML | '
     || cast(p_size as varchar) || case when l_orderkey % 3 = 0 then '.5' else '' end || '% alc' end as net_line
   from lineitem join part on l_partkey = p_partkey where l_tax <> 0.07""")
def numeric_line(spark, sf):
    r = ad.readings(spark, sf).filter(F.col("extracted_text") != "   ")
    return r.select(
        *ad.LINE_KEY, ms.numeric_line("extracted_text", None, "alcohol_content").alias("abv_line"),
        ms.numeric_line("extracted_text", F.lit("750 ml"), "net_contents").alias("net_line"),
    )


# Documents are dealt to brand names by rank: the k-th document has the k-th name, and so on around.
NAMED_SQL = f"""
select doc_id as id, text, {ad.sql_norm('p_name')} as needle
from (select doc_id, text, (row_number() over (order by doc_id) - 1) % (select count(distinct p_name) from part) as k from documents)
join (select p_name, row_number() over (order by p_name) - 1 as k from (select distinct p_name from part)) using (k)
"""


@query(
    "best_window",
    f"with recursive {best_window_ctes(NAMED_SQL, ad.sql_norm)} select id as doc_id, run as window, round(score, 6) as score from closest",
)
def best_window(spark, sf):
    """The run of words of each whole document that comes closest to a whole brand name."""
    from concordat.functions.similarity import best_window as window

    # Distinct names are few however many parts there are; documents' ids are ranked in slices.
    names = ad.table(spark, sf, "part").select("p_name").distinct()
    n = names.count()
    names = names.select("p_name", (F.row_number().over(W.orderBy("p_name")) - 1).cast("bigint").alias("k"))
    # A slice holds a million ids, but no texts: those are joined to the names by their rows' numbers.
    docs = written(ad.table(spark, sf, "documents").select("doc_id", "text", F.monotonically_increasing_id().alias("row")), "window-docs")
    ranked = spread_rank(docs.select("doc_id", "row", F.lit(0).alias("all")), "all", "doc_id", "rank", ["row"])
    named = ranked.select("row", ((F.col("rank") - 1) % n).alias("k")).join(names, "k").select("row", "p_name")
    rows = docs.join(named, "row")
    found = ad.spread(rows).select("doc_id", window(tx.normalize_text("p_name"), F.col("text")).alias("w"))
    return found.select("doc_id", "w.window", F.round("w.score", 6).alias("score"))
