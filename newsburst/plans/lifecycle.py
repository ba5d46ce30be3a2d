"""Registered queries: encoding, table changes, tenants, refresh, streaming."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F

from newsburst.functions.scalars import moment
from newsburst.operators import articles as A
from newsburst.operators import encode as N
from newsburst.operators import events as E
from newsburst.operators import filters
from newsburst.operators import tenants as T
from newsburst.operators.shared import GraphStore
from newsburst.plans.clustering import SEEN, SNAP, SNAP_COLUMNS
from newsburst.plans.oracle import STORED, TIME, hashed_sql, stored_sql, tenant_sql, with_views
from newsburst.plans.registry import ORACLES, query
from newsburst.plans.views import MODEL
from newsburst.plans.relational import (
    CREATED,
    MICROS,
    PENDING,
    _records,
    many_tenants,
    vector_sums,
    vector_sums_sql,
)
from newsburst.session import scratch_path, stage
from newsburst.sources.store import SnapshotStore
from newsburst.streaming import jobs

# -- encoding --------------------------------------------------------------------------------

TEXT = "title || '。' || coalesce(summary, '') || '。' || coalesce(full_text, '') as text"
TODO = f"select id, {TEXT} from articles, clock where {PENDING}"
TODO_1 = (
    f"select id, {TEXT} from articles, clock where {PENDING} and is_deleted = false "
    "and id in (select id from visible where system_id = 1)"
)
SLOTS = "select id, slot, round(v, 5) val from vec"
# Encoders store single precision.
FLOAT_SLOTS = "select id, slot, round(cast(cast(v as float) as double), 5) val from vec"


def slots(vectors):
    rows = vectors.select("id", F.posexplode("embedding").alias("slot", "val"))
    return rows.select("id", F.col("slot").cast("long").alias("slot"), F.round(F.col("val").cast("double"), 5).alias("val"))


@query("e1_embed_pending", hashed_sql(TODO, FLOAT_SLOTS))
def e1(t):
    return slots(N.embed_pending(t.articles, t.as_of))


@query("e2_embed_pending_tenant", hashed_sql(TODO_1, FLOAT_SLOTS))
def e2(t):
    return slots(N.embed_pending(t.articles, t.as_of, links=t.links, system_id=1))


RAW_SLOTS = """
select d.id, r.slot, round(cast(cast(coalesce(c.v, 0) as float) as double), 5) val
from docs d join range(64) r(slot) on true left join cnt c on c.id = d.id and c.slot = r.slot
"""


@query("e3_embed_through_requests", hashed_sql(TODO, RAW_SLOTS))
def e3(t):
    """Request bodies of fifty texts, answered by an encoder and decoded; vectors are stored
    as the service gave them, and articles of failed batches are listed with slot -1."""

    def service():
        encoder = N.TokenHashEncoder()
        return lambda body: json.dumps({"embeddings": encoder(json.loads(body)["texts"])})

    vectors, failed = N.embed_through_requests(N.pending_texts(t.articles, t.as_of), service)
    return slots(vectors).unionByName(_failed_slots(failed))


def _failed_slots(failed):
    return failed.select(
        F.explode("ids").alias("id"), F.lit(-1).cast("long").alias("slot"), F.lit(-1.0).alias("val")
    )


@query("e3_short_answers", f"select vec_id id, case when vec_id // 50 % 3 = 1 then -1 else len(embedding) end n from embeddings")
def e3_short(t):
    """Answers of fifty vectors, every third one vector short: it fails as a whole, with its ids."""
    batch = F.floor(F.col("vec_id") / 50)
    rows = F.array_sort(F.collect_list(F.struct("vec_id", "embedding")))
    groups = t.raw("embeddings").groupBy(batch.alias("n")).agg(rows.alias("r"))
    vectors = F.transform("r", lambda x: x["embedding"])
    sent = F.when(F.col("n") % 3 == 1, F.slice(vectors, 1, F.size("r") - 1)).otherwise(vectors)
    answers = groups.select(
        F.col("n").cast("string").alias("batch"),
        F.transform("r", lambda x: x["vec_id"]).alias("ids"),
        F.to_json(F.struct(sent.alias("embeddings"))).alias("response"),
    )
    good, failed = N.decode_responses(answers)
    return good.select("id", F.size("embedding").alias("n")).unionByName(
        failed.select(F.explode("ids").alias("id"), F.lit(-1).alias("n"))
    )


@query("e4_hash_encode", hashed_sql(f"select id, {TEXT} from articles", SLOTS))
def e4(t):
    docs = t.articles.select("id", N.article_text().alias("text"))
    return slots(N.hash_encode(N.token_rows(docs)))


# The thirty words that most documents contain serve as stop words.
STOP = """
stop as (select token as word from (select distinct id, token from tok) group by token order by count(*) desc, token limit 30)
"""


@query("x4_remove_stopwords", hashed_sql(f"select id, {TEXT} from articles", "") + f", {STOP.strip()}" + """
select id, count(*) kept from tok where token not in (select word from stop) group by id""")
def x4(t):
    docs = t.articles.select("id", N.article_text().alias("text"))
    words = N.token_rows(docs)
    common = words.distinct().groupBy("token").count().orderBy(F.col("count").desc(), "token").limit(30)
    stopwords = common.select(F.col("token").alias("word"))
    kept = N.remove_stopwords(words, stopwords)
    return kept.groupBy("id").agg(F.count("*").alias("kept"))


@query("f14_decode_responses", f"select vec_id id, {vector_sums_sql()} from embeddings")
def f14(t):
    """Vectors written as service answers of fifty, in the four known shapes, and read back."""
    batch = F.floor(F.col("vec_id") / 50)
    rows = F.array_sort(F.collect_list(F.struct("vec_id", "embedding")))
    groups = t.raw("embeddings").groupBy(batch.alias("n")).agg(rows.alias("r"))
    vectors = F.transform("r", lambda x: x["embedding"])
    objects = F.transform("r", lambda x: F.struct(x["embedding"].alias("embedding")))
    shape = F.col("n") % 4
    response = (
        F.when(shape == 0, F.to_json(F.struct(vectors.alias("embeddings"), F.lit(64).alias("dimension"))))
        .when(shape == 1, F.to_json(F.struct(objects.alias("data"))))
        .when(shape == 2, F.to_json(vectors))
        .otherwise(F.to_json(objects))
    )
    answers = groups.select(
        F.col("n").cast("string").alias("batch"),
        F.transform("r", lambda x: x["vec_id"]).alias("ids"),
        response.alias("response"),
    )
    decoded, _ = N.decode_responses(answers)
    return decoded.select("id", *vector_sums(decoded))


@query("f15_encoder_requests", with_views(f"""
select id, 'm1' model, 1 as fits, length(text) characters, md5(text) digest
from (select id, {TEXT} from articles, clock where {PENDING})"""))
def f15(t):
    """Every pending text, read back from the request bodies beside its id."""
    requests = N.encoder_requests(N.pending_texts(t.articles, t.as_of), model="m1")
    body = F.from_json("body", "STRUCT<texts: ARRAY<STRING>, model: STRING>")
    rows = requests.select("ids", body.alias("b"))
    pairs = rows.select(
        F.col("b.model").alias("model"),
        (F.size("ids") <= 50).cast("int").alias("fits"),
        F.explode(F.arrays_zip("ids", F.col("b.texts").alias("texts"))).alias("p"),
    )
    return pairs.select(
        F.col("p.ids").alias("id"), "model", "fits",
        F.length("p.texts").alias("characters"), F.md5("p.texts").alias("digest"),
    )


# -- article and link changes ----------------------------------------------------------------


@query("w1_update_weights", with_views("""
select a.id, cast(coalesce(cast(l.quality * 10 as decimal(16,4)), a.weight) as double) weight
from articles a left join labels l on l.doc_id = a.id"""))
def w1(t):
    """Two changes for each labelled article, the larger of which counts."""
    changes = t.raw("labels").select(
        F.col("doc_id").alias("id"), F.explode(F.array(F.col("quality") * 10, F.col("quality") * 10 - 5)).alias("weight")
    )
    return A.update_weights(t.articles, changes).select("id", "weight")


@query("w1_unknown_ids", "select distinct doc_id + 1000000000 id from labels")
def w1_unknown(t):
    """Changes for articles that do not exist are reported."""
    return A.unknown_ids(t.articles, _shares(t).select(F.col("article_id").alias("id")))


@query("w2_soft_delete", with_views("""
select id, coalesce(case when id in (select doc_id from labels where quality = 0) then 1 else is_deleted::int end, -1) is_deleted
from articles"""))
def w2(t):
    ids = t.raw("labels").filter("quality = 0").select(F.col("doc_id").alias("id"))
    rows = A.soft_delete(t.articles, ids)
    return rows.select("id", F.coalesce(F.col("is_deleted").cast("int"), F.lit(-1)).alias("is_deleted"))


def _shares(t):
    """Every labelled document to one tenant, and as many shares of unknown articles."""
    wanted = t.raw("labels").select("doc_id", (F.col("quality") + 1).cast("bigint").alias("system_id"))
    known = wanted.select(F.col("doc_id").alias("article_id"), "system_id")
    return known.unionByName(wanted.select((F.col("doc_id") + 1000000000).alias("article_id"), "system_id"))


@query("w3_share", with_views("""
select 'link' kind, article_id, system_id from (
  select article_id, system_id from links union select doc_id, quality + 1 from labels)
union all select 'rejected', doc_id + 1000000000, quality + 1 from labels"""))
def w3(t):
    table, rejected = A.share(t.links, _shares(t), t.articles)
    return table.select(F.lit("link").alias("kind"), "*").unionByName(
        rejected.select(F.lit("rejected").alias("kind"), "*")
    )


@query("w4_unshare", with_views("""
select article_id, system_id from links
where not exists (select 1 from labels where doc_id = article_id and quality + 1 = system_id)
  and article_id not in (select doc_id from labels where toxic = 1)"""))
def w4(t):
    gone = t.raw("labels").filter("toxic = 1").select(F.col("doc_id").alias("article_id"))
    return A.unshare(t.links, _shares(t), gone)


@query("w7_write_back_vectors", with_views(f"""
select id, {vector_sums_sql('e')} from (
  select a.id, coalesce(list_reverse(x.embedding), a.embedding) e from articles a
  left join (select * from embeddings where label % 2 = 0) x on x.vec_id = a.id)
where e is not null"""))
def w7(t):
    fresh = t.raw("embeddings").filter("label % 2 = 0").select(
        F.col("vec_id").alias("id"), F.reverse("embedding").alias("embedding")
    )
    rows = filters.embedded(A.write_back_vectors(t.articles, fresh))
    return rows.select("id", *vector_sums(rows))


# -- refresh ---------------------------------------------------------------------------------


def _refreshed(t):
    """The stored snapshot after a live refresh of tenants 3 and 4; 4 has no events."""
    store = t.store
    some = t.active_systems.filter(F.col("system_id").isin(3, 4))
    at = moment(t.as_of, t.articles)
    new, members = E.build_snapshot(t.articles, t.links, some, t.configs, t.as_of, at, model_name=MODEL)
    return (
        E.replace_tenants(store.snapshot, new, some),
        E.replace_tenants(store.event_articles, members, some),
    )


REFRESHED = STORED + """,
after as (
  select * from snap where system_id not in (3, 4)
  union all
  select ev.k - 100, tick.at_time, ev.rank_no, ev.cluster_id, ev.title, ev.article_count,
         ev.total_weight, ev.hot_score, ev.sample_titles, ev.article_ids, c.default_hours
  from ev join tick on tick.n = 1 join configs c on c.system_id = ev.k - 100
  where ev.k in (103, 104) and ev.rank_no <= c.snapshot_limit)
"""


def refreshed_sql(select):
    return stored_sql("").replace(STORED.lstrip(","), REFRESHED.lstrip(",")) + select


@query("w5_refresh_snapshot", refreshed_sql(f"select {SNAP} from after"))
def w5(t):
    return _refreshed(t)[0].select(*SNAP_COLUMNS)


@query("w5_refresh_members", refreshed_sql(f"""
select s.system_id, {SEEN} snapshot_time, s.rank_no, s.cluster_id, a.id article_id, cast(coalesce(a.weight, 1) as double) article_weight
from (select *, unnest(string_split(article_ids, ','))::bigint member from after) s join articles a on a.id = s.member"""))
def w5_members(t):
    return _refreshed(t)[1].select(
        "system_id", "snapshot_time", "rank_no", "cluster_id", "article_id", "article_weight"
    )


@query("w6_keep_history", stored_sql(f"""
select {SNAP} from (
  select *, dense_rank() over (partition by system_id order by snapshot_time desc) age from snap) where age <= 1"""))
def w6(t):
    return E.keep_history(t.store.snapshot, 1).select(*SNAP_COLUMNS)


# -- tenants ---------------------------------------------------------------------------------

MIGRATED = "select id, coalesce(system_id, 100) system_id from articles"


def _with_default(t):
    default = t.spark.range(1).select(
        F.lit(100).cast("bigint").alias("system_id"),
        F.lit(T.DEFAULT_CODE).alias("system_code"),
        F.lit("Default").alias("system_name"),
        F.lit(True).alias("is_active"),
    )
    return T.insert_if_absent(t.systems, default, "system_code")


@query("w8_migrate_to_default", with_views(MIGRATED))
def w8(t):
    return T.migrate_to_default(_with_default(t), t.articles).select("id", "system_id")


@query("w9_delete_tenant", with_views("""
select 'articles' table_name, id, coalesce(case when system_id <> 2 then system_id end, -1) system_id from articles
union all select 'links', article_id, system_id from links where system_id <> 2
union all select 'systems', system_id, system_id from systems where system_id <> 2"""))
def w9(t):
    gone = t.systems.filter("system_id = 2").select("system_id")
    rest = T.delete_tenants(gone, t.systems, t.configs, t.articles, t.links, t.store.snapshot, t.store.event_articles)
    named = lambda name, key: rest[name].select(
        F.lit(name).alias("table_name"),
        F.col(key).alias("id"),
        F.coalesce("system_id", F.lit(-1).cast("long")).alias("system_id"),
    )
    return named("articles", "id").unionByName(named("links", "article_id")).unionByName(named("systems", "system_id"))


@query("w9_delete_articles", stored_sql("""
select 'articles' table_name, count(*) n from articles where id not in (select doc_id from labels)
union all select 'links', count(*) from links where article_id not in (select doc_id from labels)
union all select 'event_articles', count(*) from snap_articles where article_id not in (select doc_id from labels)"""))
def w9_articles(t):
    gone = t.raw("labels").select(F.col("doc_id").alias("id"))
    rest = T.delete_articles(gone, t.articles, t.links, t.store.event_articles)
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("table_name"), "n") for k, df in rest.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("w10_audit", with_views("""
select 'systems: repeated system_code' rule, 0 violations
union all select 'systems: repeated system_id', 0
union all select 'configs: repeated system_id', 0
union all select 'articles: repeated id', count(*) from (select id from articles group by id having count(*) > 1)
union all select 'links: repeated article_id, system_id', count(*) from (select 1 from dlinks group by article_id, system_id having count(*) > 1)
union all select 'configs: system_id without parent', 0
union all select 'articles: system_id without parent', count(*) from articles where system_id not in (select system_id from systems)
union all select 'links: article_id without parent', count(*) from dlinks where article_id not in (select id from articles)
union all select 'links: system_id without parent', count(*) from dlinks where system_id not in (select system_id from systems)
""", """
dlinks as (
  select article_id, system_id from links
  union all select doc_id, quality + 1 from labels
  union all select doc_id + 1000000000, quality + 1 from labels)
"""))
def w10(t):
    """The links here hold repeated pairs and unknown articles."""
    return T.audit(t.systems, t.configs, t.articles, t.links.unionByName(_shares(t)))


@query("w11_insert_if_absent", with_views("""
select system_id, system_code from many
union all select c_custkey + 5001, 'no-' || lower(c_name) from customer where c_custkey % 5 = 0
""", "many as (select c_custkey + 1 system_id, lower(c_name) system_code from customer)"))
def w11(t):
    table = many_tenants(t).select("system_id", "system_code")
    name = F.lower("c_name")
    rows = t.raw("customer").select(
        (F.col("c_custkey") + 5001).alias("system_id"),
        F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("no-"), name)).otherwise(name).alias("system_code"),
    )
    # Every row comes again with a larger id; the smaller one is kept.
    again = rows.withColumn("system_id", F.col("system_id") + 1000000)
    return T.insert_if_absent(table, rows.unionByName(again), "system_code")


CREATED_TENANTS = """
with asked as (
  select case when c_custkey % 5 = 0 then 'region' else lower(c_name) end system_code, c_mktsegment system_name,
         case when c_custkey % 2 = 0 then 48 end default_hours
  from customer
  union all select lower(r_name), r_name, null from region)
select a.system_code, coalesce(a.default_hours, 24) default_hours, cast(0.38 as double) default_eps, 3 default_min_samples,
       '*/8 * * * *' embedding_cron, '*/12 * * * *' clustering_cron, 80000 max_articles_limit, 100 snapshot_limit, '' error
from asked a where a.system_code <> 'region' and a.system_code not in (select lower(r_name) from region)
union all select lower(r_name), -1, -1, -1, '', '', -1, -1, 'code already exists' from region
union all select 'region', -1, -1, -1, '', '', -1, -1, 'code given twice'
"""


@query("t1_create_tenants", CREATED_TENANTS)
def t1(t):
    custom = F.when(F.col("c_custkey") % 5 != 0, F.lower("c_name"))
    asked = (
        t.raw("customer")
        .select(
            F.coalesce(custom, F.lit("region")).alias("system_code"),
            F.col("c_mktsegment").alias("system_name"),
            F.lit("").alias("description"),
            F.when(F.col("c_custkey") % 2 == 0, 48).alias("default_hours"),
        )
        .unionByName(
            t.systems.select("system_code", "system_name", F.lit("").alias("description")), allowMissingColumns=True
        )
    )
    systems, configs, errors = T.create_tenants(t.systems, asked)
    made = systems.select("system_id", "system_code").join(configs, "system_id").select("system_code", *T.CONFIG_COLUMNS)
    filled = [
        F.lit("" if c.endswith("_cron") else -1).alias(c) for c in T.CONFIG_COLUMNS
    ]
    return made.withColumn("error", F.lit("")).unionByName(errors.select("system_code", *filled, "error"))


@query("t2_merge_configs", """
select c_custkey + 1 system_id, case when c_custkey % 3 = 0 then 12 else 24 end default_hours,
       cast(case when c_custkey % 2 = 0 then 0.5 else 0.38 end as double) default_eps, 3 default_min_samples, 100 snapshot_limit
from customer""")
def t2(t):
    key = (F.col("c_custkey") + 1).alias("system_id")
    configs = T.with_config_defaults(t.raw("customer").select(key))
    changes = t.raw("customer").select(
        key,
        F.when(F.col("c_custkey") % 3 == 0, 12).alias("default_hours"),
        F.when(F.col("c_custkey") % 2 == 0, 0.5).alias("default_eps"),
    )
    return T.merge_configs(configs, changes).select(
        "system_id", "default_hours", "default_eps", "default_min_samples", "snapshot_limit"
    )


@query("t3_list_tenants", with_views("""
select 'active' asked, system_id from many where is_active
union all select 'inactive', system_id from many where not is_active
union all select 'by id', 7
union all select 'by code', system_id from many where system_code = 'customer#000000011'
""", "many as (select c_custkey + 1 system_id, lower(c_name) system_code, c_acctbal > 0 is_active from customer)"))
def t3(t):
    many = many_tenants(t)
    parts = [
        ("active", T.list_tenants(many, is_active=True)),
        ("inactive", T.list_tenants(many, is_active=False)),
        ("by id", T.list_tenants(many, system_id=7)),
        ("by code", T.list_tenants(many, system_code="customer#000000011")),
    ]
    rows = [df.select(F.lit(name).alias("asked"), "system_id") for name, df in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


# -- streaming -------------------------------------------------------------------------------


@query("s1_ingest_stream", with_views(f"""
select id, 7 system_id, title, cast(case when source = 'src9' then 1 else weight end as double) weight, {CREATED} create_time,
  case when (source = 'src9' or weight > 0) and trim(title) <> '' then 'stored' else 'rejected' end as kind
from articles"""))
def s1(t):
    """Two runs: newer articles first, then the late older ones and all the newer ones again.
    Invalid records end beside the table, none are lost."""
    records = _records(t)
    middle = records.agg(F.percentile_approx(F.unix_micros(F.col("createTime").cast("timestamp")), 0.5)).first()[0]
    newer = F.unix_micros(F.col("createTime").cast("timestamp")) > middle
    source, target = scratch_path(t.spark, "incoming"), scratch_path(t.spark, "ingested")
    checkpoint = scratch_path(t.spark, "checkpoint")
    for part in (records.filter(newer), records.unionByName(records.filter(newer))):
        part.write.mode("append").options(**MICROS).json(source)
        jobs.ingest_stream(t.spark, source, target, checkpoint, system_id=7).awaitTermination()
    stored = t.spark.read.parquet(target).withColumn("kind", F.lit("stored"))
    rejected = t.spark.read.parquet(f"{target}_rejected").withColumn("kind", F.lit("rejected"))
    columns = ["id", "system_id", "title", "weight", "create_time", "kind"]
    return stored.select(*columns).unionByName(rejected.select(*columns))


@query("s2_embed_stream", hashed_sql(f"select id, {TEXT} from articles where embedding is null", FLOAT_SLOTS))
def s2(t):
    source = scratch_path(t.spark, "articles")
    t.articles.write.parquet(source)
    target = scratch_path(t.spark, "vectors")
    stream = t.spark.readStream.schema(t.articles.schema).parquet(source)
    jobs.embed_stream(stream, target, scratch_path(t.spark, "checkpoint"), every=None).awaitTermination()
    return slots(t.spark.read.schema(N.VECTORS).parquet(target))


@query("s3_refresh_stream", tenant_sql(f"""
select k system_id, {TIME.format('clock.t')} snapshot_time, rank_no, cluster_id, title, article_count, total_weight,
       hot_score, sample_titles, default_hours hours_window, 'token-hash-64' model_name
from ev join configs c on c.system_id = k, clock where rank_no <= c.snapshot_limit"""))
def s3(t):
    """One tick, given by the newest article, refreshes the store."""
    source = scratch_path(t.spark, "ticks")
    ticks = t.articles.agg(F.max("create_time").alias("as_of"))
    ticks.write.parquet(source)
    stream = t.spark.readStream.schema(ticks.schema).parquet(source)
    store = SnapshotStore(t.spark, scratch_path(t.spark, "store"))
    load = lambda: (t.articles, t.links, t.active_systems, t.configs)
    run = jobs.refresh_stream(stream, store, scratch_path(t.spark, "checkpoint"), load, every=None, model_name=MODEL)
    run.awaitTermination()
    return store.snapshot.select(*SNAP_COLUMNS)


@query("s3_incremental_refresh", ORACLES["s3_refresh_stream"])
def s3_incremental(t):
    """Two ticks ten days apart over one stored graph: the second compares what is new, and what shares a
    slice of time with what has left."""
    source, checkpoint = scratch_path(t.spark, "ticks"), scratch_path(t.spark, "checkpoint")
    store = SnapshotStore(t.spark, scratch_path(t.spark, "store"))
    graph = GraphStore(t.spark, scratch_path(t.spark, "graph"))
    for as_of in (t.as_of - dt.timedelta(days=10), t.as_of):
        seen = t.articles.filter(F.col("create_time") <= F.lit(as_of))
        seen.agg(F.lit(as_of).alias("as_of")).write.mode("append").parquet(source)
        stream = t.spark.readStream.schema(t.spark.read.parquet(source).schema).parquet(source)
        load = lambda seen=seen: (seen, t.links, t.active_systems, t.configs)
        run = jobs.refresh_stream(
            stream, store, checkpoint, load, every=None, model_name=MODEL, graph=graph, slice_rows=64
        )
        run.awaitTermination()
    return store.snapshot.select(*SNAP_COLUMNS)
