"""Loading, writing and corpus queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from concordat import schemas
from concordat.plans import adapters as ad
from concordat.plans import engine
from concordat.plans.check_queries import ENGINE_SQL, ORDER, ROLLUP_SQL, _extractions_with_order
from concordat.plans.registry import query
from concordat.rules import RULES
from concordat.session import work_dir
from concordat.sources import cleaning as cl
from concordat.sources import files as fs
from concordat.sources import ranges as rg
from concordat.streaming import intake as si


@query(
    "load_submissions",
    """select 'T' || cast(p_partkey as varchar) as ttb_id, case when p_size = 9 then null else p_name end as brand_name, 'WINE' as beverage_type,
   'a "quoted", part ' || p_brand || chr(10) || 'second line' as applicant_name_address, date '2020-01-01' + p_size as application_date, 'RECEIVED' as status from part""",
)
def load_submissions(spark, sf):
    """Submissions written to a CSV corpus and loaded back with blanks as NULL."""
    p = ad.table(spark, sf, "part")
    known = {
        "ttb_id": F.concat(F.lit(" T"), F.col("p_partkey").cast("string")),
        "brand_name": F.when(F.col("p_size") == 9, "   ").otherwise(F.col("p_name")),
        "beverage_type": F.lit("WINE"),
        "applicant_name_address": F.concat(F.lit('a "quoted", part '), "p_brand", F.lit("\nsecond line")),
        "application_date": F.date_add(F.lit("2020-01-01").cast("date"), F.col("p_size").cast("int")).cast("string"),
    }
    rows = p.select(*[known.get(c, F.lit(None).cast("string")).alias(c) for c in schemas.CORPUS_COLUMNS])
    path = work_dir(spark, "corpus")
    rows.write.options(header="true", quote='"', escape='"').csv(path)
    loaded = fs.load_submissions(spark, path)
    return loaded.select("ttb_id", "brand_name", "beverage_type", "applicant_name_address", F.col("application_date").cast("timestamp_ntz").alias("application_date"), "status")


@query("load_gold", "select cast(p_size as varchar) as ttb_id, arg_max(p_name, p_partkey) as gt_brand_name from part where p_size <> 3 group by 1")
def load_gold(spark, sf):
    """The last gold row of each key, blank keys dropped."""
    p = ad.table(spark, sf, "part").select(
        F.when(F.col("p_size") == 3, " ").otherwise(F.concat(F.lit(" "), F.col("p_size").cast("string"))).alias("ttb_id"),
        F.col("p_name").alias("gt_brand_name"), "p_partkey",
    )
    return fs.last_per_key(p, "ttb_id", ("p_partkey",)).select("ttb_id", "gt_brand_name")


MANIFEST_CASES = """case event_type when 'click' then 'ok' when 'view' then 'two' when 'error' then 'malformed JSON' when 'signup' then 'not a list' else 'entry without a file name' end"""


def manifests(spark, sf):
    t = F.col("event_type")
    name = F.concat(F.lit("f"), F.col("event_id").cast("string"), F.lit(".jpg"))
    entry = lambda pos: F.concat(F.lit('{"role": "BRAND", "position": '), F.lit(str(pos)), F.lit(', "filename": "'), name, F.lit('"}'))
    text = (
        F.when(t == "click", F.concat(F.lit("["), entry(1), F.lit("]")))
        .when(t == "view", F.concat(F.lit("["), entry(1), F.lit(", "), entry(2), F.lit("]")))
        .when(t == "error", "[{").when(t == "signup", F.col("props")).otherwise('[{"role": "BACK"}]')
    )
    return ad.table(spark, sf, "events").select(F.col("event_id").alias("ttb_id"), text.alias("images"))


@query("explode_manifest", "select event_id as ttb_id, unnest(case when event_type = 'click' then [1] else [1, 2] end)::int as position, 'f' || event_id || '.jpg' as filename from events where event_type in ('click','view')")
def explode_manifest(spark, sf):
    good, _ = fs.explode_manifest(manifests(spark, sf))
    return good.select("ttb_id", "position", "filename")


@query("manifest_rejects", f"select event_id as ttb_id, {MANIFEST_CASES} as reject_reason from events where event_type not in ('click','view')")
def manifest_rejects(spark, sf):
    return fs.explode_manifest(manifests(spark, sf))[1]


@query("split_list", """select p_partkey, unnest(range(0, case when p_size % 2 = 0 then 2 else 1 end))::int as pos,
   unnest(case when p_size % 2 = 0 then [p_name || '_front', p_name || '_back'] else [p_name || '_front'] end) as filename, unnest(case when p_size % 2 = 0 then ['brand', 'back'] else ['brand'] end) as role from part""")
def split_list(spark, sf):
    two = F.col("p_size") % 2 == 0
    front, back = F.concat("p_name", F.lit("_front")), F.concat("p_name", F.lit("_back"))
    rows = ad.table(spark, sf, "part").select(
        "p_partkey", F.when(two, F.concat(front, F.lit("|"), back)).otherwise(front).alias("filename"),
        F.when(two, "brand|back").otherwise("brand").alias("role"),
    )
    return fs.split_list(rows, ("filename", "role"))


@query(
    "mint_keys",
    """with w as (select p_partkey, p_brand as stem, row_number() over (partition by p_brand order by p_partkey) as r from part where p_size <= 10),
  t as (select p_brand as stem, p_size as n from part where p_size % 3 = 0 group by 1, 2),
  free as (select stem, n, row_number() over (partition by stem order by n) as r from (select distinct p_brand as stem from part), range(1, 400) g(n)
    where not exists (select 1 from t where t.stem = stem and t.n = g.n))
  select w.p_partkey, w.stem || '-ENQ' || cast(f.n as varchar) as ttb_id, 'ENQ-' || cast(f.n as varchar) as serial_number
  from w join (select s.stem, g.n, row_number() over (partition by s.stem order by g.n) as r from (select distinct p_brand as stem from part) s, range(1, 400) g(n)
     where (s.stem, g.n) not in (select stem, n from t)) f on f.stem = w.stem and f.r = w.r""",
)
def mint_keys(spark, sf):
    p = ad.table(spark, sf, "part")
    new = p.filter("p_size <= 10").select("p_partkey", F.col("p_brand").alias("ttb_id"), F.lit("x").alias("serial_number"))
    existing = p.filter("p_size % 3 = 0").select(F.concat("p_brand", F.lit("-ENQ"), F.col("p_size").cast("string")).alias("ttb_id"))
    return fs.mint_keys(new, existing, "p_partkey")


def registry(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_size")
    t = F.col("p_type")
    return ad.table(spark, sf, "part").select(
        F.concat(F.lit("T"), F.lpad(k.cast("string"), 12, "0")).alias("ttb_id"),
        F.when(t == "SMALL", " wine ").when(t == "LARGE", "Malt Beverage").when(t == "PROMO", "distilled spirits").otherwise("cider").alias("product_type"),
        F.when(k % 2 == 0, "california").otherwise("FRANCE (METROPOLE)").alias("origin_code"),
        F.col("p_name").alias("brand_name"), F.lit("TABLE RED WINE").alias("class_type_code"),
        F.concat(F.lit("BR-MA-1 "), "p_brand", F.lit(" &amp; Co")).alias("applicant_principal"),
        F.when(s % 2 == 0, s.cast("string")).otherwise("").alias("alcohol_content"),
        F.when(s % 3 == 0, F.concat(s.cast("string"), F.lit(" ML"))).otherwise("").alias("net_contents"),
        F.lit("1/5/2011").alias("approval_date"), (s > 25).alias("has_back"),
    )


CORPUS_SQL = """select *, case p_type when 'SMALL' then 'WINE' when 'LARGE' then 'MALT_BEVERAGE' when 'PROMO' then 'DISTILLED_SPIRITS' end as kind from part where p_type in ('SMALL','LARGE','PROMO')"""


@query(
    "build_corpus",
    f"""select 'T' || lpad(cast(p_partkey as varchar), 12, '0') as ttb_id, kind as beverage_type, case when p_partkey % 2 = 0 then 'DOMESTIC' else 'IMPORTED' end as source_of_product,
   p_brand || ' & Co' as applicant_name_address, case when p_size % 2 = 0 then cast(p_size as varchar) || '% Alc./Vol.' else '' end as alcohol_content,
   case when p_size % 3 = 0 then cast(p_size as varchar) || ' mL' else '' end as net_contents, case when p_partkey % 2 = 0 then 'California' else 'France' end as country_of_origin, 'Red Wine' as class_type_designation
   from (select *, row_number() over (partition by kind order by (p_size > 25) desc, p_partkey) as rk from ({CORPUS_SQL})) where rk <= 5""",
)
def build_corpus(spark, sf):
    out = cl.build_corpus(registry(spark, sf))
    return out.select("ttb_id", "beverage_type", "source_of_product", "applicant_name_address", "alcohol_content", "net_contents", "country_of_origin", "class_type_designation")


@query("corpus_counts", f"select kind as beverage_type, count(*) as n, count(*) filter (where p_size > 25) as with_back, count(*) filter (where p_size % 3 = 0) as with_net, count(*) filter (where p_size % 2 = 0) as with_abv from ({CORPUS_SQL}) group by 1")
def corpus_counts(spark, sf):
    return cl.corpus_counts(cl.build_corpus(registry(spark, sf), per_type=1 << 30))


@query("patch", "select p_partkey as ttb_id, case when n_nationkey is not null then 'patched' else p_name end as alcohol_content, case when n_nationkey is not null then 'patched' else p_brand end as gt_alcohol_content from part left join nation on n_nationkey = p_partkey")
def patch(spark, sf):
    rows = ad.table(spark, sf, "part").select(F.col("p_partkey").alias("ttb_id"), F.col("p_name").alias("alcohol_content"), F.col("p_brand").alias("gt_alcohol_content"))
    over = ad.table(spark, sf, "nation").select(F.col("n_nationkey").alias("ttb_id"), F.lit("patched").alias("alcohol_content"))
    return cl.patch(rows, over)


@query("read_evolved", "select o_orderkey, o_orderpriority, case when o_orderkey % 2 = 0 then 'UNKNOWN' else o_orderstatus end as o_orderstatus from orders")
def read_evolved(spark, sf):
    """Old files lack a column; they are read with its default."""
    o = ad.table(spark, sf, "orders")
    old, new = work_dir(spark, "old"), work_dir(spark, "new")
    o.filter("o_orderkey % 2 = 0").select("o_orderkey", "o_orderpriority").write.parquet(old)
    o.filter("o_orderkey % 2 = 1").select("o_orderkey", "o_orderpriority", "o_orderstatus").write.parquet(new)
    return fs.read_evolved(spark, (old, new), "o_orderkey bigint, o_orderpriority string, o_orderstatus string", {"o_orderstatus": "UNKNOWN"})


@query("write_replacing", "select o_custkey, o_orderkey, case when o_custkey % 2 = 0 then 'second' else 'first' end as run from orders")
def write_replacing(spark, sf):
    """A second run replaces the rows of its keys and leaves the others."""
    o = ad.table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    path = work_dir(spark, "results")
    fs.write_replacing(spark, o.withColumn("run", F.lit("first")), path, "o_custkey", buckets=4)
    fs.write_replacing(spark, o.filter("o_custkey % 2 = 0").withColumn("run", F.lit("second")), path, "o_custkey", buckets=4)
    return spark.read.parquet(path).select("o_custkey", "o_orderkey", "run")


@query("replace_rows", """select o_custkey, o_orderkey, case when o_custkey % 7 = 0 then 'third' when o_custkey % 2 = 0 then 'second' else 'first' end as run from orders
  where not (o_custkey % 7 = 0 and o_orderkey % 2 = 0)""")
def replace_rows(spark, sf):
    """Replacing writes by a manifest: further runs rewrite the ranges their keys fall in."""
    o = ad.table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    path = work_dir(spark, "ranges")
    runs = {"first": o, "second": o.filter("o_custkey % 2 = 0"), "third": o.filter("o_custkey % 7 = 0 and o_orderkey % 2 = 1")}
    for run, rows in runs.items():
        rows = rows.withColumn("run", F.lit(run))
        rg.replace_rows(spark, rows, path, "o_custkey")
    # A customer without a row in the last run keeps what the runs before have written.
    gone = o.filter("o_custkey % 7 = 0").select("o_custkey").distinct().join(runs["third"].select("o_custkey"), "o_custkey", "left_anti")
    return rg.read_ranges(spark, path, rows.schema).join(gone, "o_custkey", "left_anti").select("o_custkey", "o_orderkey", "run")


@query("write_readings", f"select engine_name, image_variant, count(*) as n from ({ad.READINGS_SQL}) group by 1, 2")
def write_readings(spark, sf):
    path = work_dir(spark, "readings")
    fs.write_readings(ad.readings(spark, sf), path)
    return spark.read.parquet(path).groupBy("engine_name", "image_variant").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("engine_name").cast("string").alias("engine_name"), F.col("image_variant").cast("string").alias("image_variant"), "n"
    )


@query("reload", "select p_partkey, p_name from part where p_size > 10")
def reload(spark, sf):
    """The table is replaced as a whole; a start-up load then finds it filled."""
    p = ad.table(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    path = work_dir(spark, "reload")
    fs.reload(p.select("p_partkey", "p_name"), path)
    fs.reload(p.filter("p_size > 10").select("p_partkey", "p_name"), path)
    fs.reload(p.select("p_partkey", "p_name"), path, only_if_empty=True)
    return spark.read.parquet(fs.current_version(spark, path))


@query(
    "stream_verify",
    f"""{ENGINE_SQL} select f.id as submission_id, coalesce(v, 'REVIEW') as engine_verdict
     from f left join (select submission_id, {ROLLUP_SQL} as v from c group by 1) x on x.submission_id = f.id""",
)
def stream_verify(spark, sf):
    """The executor on a stream of arriving submissions; equals the batch result."""
    staged = work_dir(spark, "arrivals")
    subs = ad.filed(spark, sf)
    subs.repartition(2).write.parquet(staged)
    stream = si.read_files(spark, staged, subs.schema, files_per_trigger=1)
    out = si.stream_verify(
        stream, ad.readings(spark, sf), _extractions_with_order(spark, sf), work_dir(spark, "verified"), RULES, "levenshtein", ORDER
    )
    return engine.verdicts_of(spark.read.parquet(out))
