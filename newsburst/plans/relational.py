"""Registered queries: sources, filters, visibility, listing, statistics, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsburst.functions import scalars
from newsburst.operators import articles as A
from newsburst.operators import filters, stats, visibility
from newsburst.plans.oracle import TIME, with_views
from newsburst.plans.registry import query
from newsburst.session import scratch_path
from newsburst.sources import ingest

CREATED = TIME.format("create_time")
ARTICLE = f"id, coalesce(system_id, -1) system_id, title, cast(weight as double) weight, {CREATED} create_time, source"


def article(df):
    return df.select(
        "id", F.coalesce("system_id", F.lit(-1)).alias("system_id"), "title", "weight", "create_time", "source"
    )


def vector_sums(df):
    """Two numbers that pin a vector down well enough to compare it."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    plus = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    places = F.transform(v, lambda x, i: x * (i + 1))
    weighted = F.aggregate(places, F.lit(0.0), lambda a, x: a + x)
    return [
        F.size("embedding").alias("dims"),
        F.round(plus, 4).alias("total"),
        F.round(weighted, 3).alias("weighted"),
    ]


def vector_sums_sql(v="embedding"):
    d = f"cast({v} as double[])"
    return (
        f"len({v}) dims, round(list_sum({d}), 4) total, "
        f"round(list_sum(list_transform({d}, lambda x, i: x * i)), 3) weighted"
    )


# -- sources ---------------------------------------------------------------------------------


@query("i1_scan_articles", with_views(
    f"select id, title, cast(weight as double) weight, {CREATED} create_time, {vector_sums_sql()} "
    "from articles where embedding is not null"))
def i1(t):
    rows = filters.embedded(t.articles)
    return rows.select("id", "title", "weight", "create_time", *vector_sums(rows))


# Written times keep their microseconds.
MICROS = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _records(t):
    """The article view as posted records, with some fields left out."""
    return t.articles.select(
        "id",
        "title",
        "summary",
        F.col("full_text").alias("fullText"),
        F.when(F.col("source") != "src9", F.col("weight")).alias("weight"),
        "source",
        F.col("attr").alias("metadata"),
        F.when(F.col("is_shared"), True).alias("isShared"),
        F.col("create_time").alias("createTime"),
    )


INGESTED = f"""
select id, 1 system_id, is_shared::int is_shared, title, length(coalesce(summary, '')) summary_length,
       length(full_text) text_length, case when source = 'src9' then 1 else cast(weight as double) end weight,
       {CREATED} create_time, source, 0 is_deleted
from articles
"""


def _ingested(rows):
    return rows.select(
        "id",
        "system_id",
        "is_shared",
        "title",
        F.length(F.coalesce("summary", F.lit(""))).alias("summary_length"),
        F.length("full_text").alias("text_length"),
        "weight",
        "create_time",
        "source",
        "is_deleted",
    )


@query("i2_ingest_json", with_views(INGESTED))
def i2(t):
    path = scratch_path(t.spark, "records")
    _records(t).write.options(**MICROS).json(path)
    return _ingested(ingest.apply_defaults(ingest.read_records(t.spark, path), system_id=1))


@query("i3_batch_ingest", with_views(INGESTED))
def i3(t):
    """The same records posted as JSON arrays of up to a hundred."""
    path = scratch_path(t.spark, "arrays")
    records = _records(t)
    posts = records.select(
        F.floor(F.col("id") / 100).alias("post"), F.to_json(F.struct(*records.columns), MICROS).alias("r")
    ).groupBy("post")
    bodies = posts.agg(F.concat(F.lit("["), F.array_join(F.collect_list("r"), ","), F.lit("]")).alias("value"))
    bodies.select("value").write.text(path)
    return _ingested(ingest.apply_defaults(ingest.read_records(t.spark, path), system_id=1))


@query("i4_validate", with_views("""
select id, array_to_string(list_filter([
  case when title is null or not regexp_matches(title, '[^\x00-\x20]') then 'title: must not be blank' end,
  case when weight is null then 'weight: must not be null' end,
  case when weight <= 0 then 'weight: must be greater than 0' end,
  case when embedding is not null and len(embedding) <> 64 then 'embedding: must have 64 dimensions' end
], lambda x: x is not null), ';') errors
from (select id, case when source = 'src5' then '  ' when source = 'src4' then chr(9) || chr(10) else title end title,
             case when source = 'src6' then null else weight end weight, embedding from articles)
"""))
def i4(t):
    rows = t.articles.withColumns(
        {
            "title": F.when(F.col("source") == "src5", "  ")
            .when(F.col("source") == "src4", "\t\n")
            .otherwise(F.col("title")),
            "weight": F.when(F.col("source") != "src6", F.col("weight")),
        }
    )
    accepted, rejected = ingest.validate(rows, dimension=64)
    return accepted.select("id", F.lit("").alias("errors")).unionByName(
        rejected.select("id", F.array_join("errors", ";").alias("errors"))
    )


@query("i5_decode_metadata", with_views("""
select id, attr->>'$.author' author, attr->>'$.tags[0]' first_tag, json_array_length(attr, '$.tags') tags,
       cast(attr->>'$.viewCount' as int) view_count
from articles
"""))
def i5(t):
    m = scalars.decode_metadata(F.col("attr"))
    return t.articles.select("id", m.alias("m")).select(
        "id",
        F.col("m.author").alias("author"),
        F.col("m.tags")[0].alias("first_tag"),
        F.size("m.tags").alias("tags"),
        F.col("m.viewCount").alias("view_count"),
    )


@query("i6_read_text_export", with_views(f"""
select id, coalesce(system_id, -1) system_id, title, length(full_text) text_length,
       cast(weight as double) weight, {CREATED} create_time, coalesce(is_deleted::int, -1) is_deleted,
       coalesce(len(embedding), -1) dims, coalesce(round(list_sum(cast(embedding as double[])), 4), 0) total
from articles
"""))
def i6(t):
    path = scratch_path(t.spark, "export")
    ingest.write_export(t.articles, path)
    rows = ingest.read_export(t.spark, path)
    dims, total, _ = vector_sums(rows)
    return rows.select(
        "id",
        F.coalesce("system_id", F.lit(-1)).alias("system_id"),
        "title",
        F.length("full_text").alias("text_length"),
        "weight",
        "create_time",
        F.coalesce(F.col("is_deleted").cast("int"), F.lit(-1)).alias("is_deleted"),
        F.coalesce(F.when(F.col("embedding").isNotNull(), dims), F.lit(-1)).alias("dims"),
        F.coalesce(total, F.lit(0.0)).alias("total"),
    )


@query("i7_lookup_by_id", with_views(
    f"select {ARTICLE} from articles where id in (select doc_id from labels where quality = 1)"))
def i7(t):
    ids = t.raw("labels").filter("quality = 1").select(F.col("doc_id").alias("id"))
    return article(A.lookup(t.articles, ids))


# -- filters ---------------------------------------------------------------------------------


@query("p1_source", with_views(f"select {ARTICLE} from articles where source = 'src9'"))
def p1(t):
    return article(filters.article_filters(t.articles, source="src9"))


@query("p2_min_weight", with_views(f"select {ARTICLE} from articles where weight >= 50.5"))
def p2(t):
    return article(filters.article_filters(t.articles, min_weight="50.5"))


@query("p3_max_weight", with_views(f"select {ARTICLE} from articles where weight <= 50.5"))
def p3(t):
    return article(filters.article_filters(t.articles, max_weight="50.5"))


@query("p4_title_keyword", with_views(f"select {ARTICLE} from articles where contains(title, 'the')"))
def p4(t):
    return article(filters.article_filters(t.articles, keyword="the"))


@query("p5_combined_filters", with_views(
    f"select {ARTICLE} from articles where source = 'src9' and weight >= 10 and is_deleted = false"))
def p5(t):
    return article(filters.not_deleted(filters.article_filters(t.articles, source="src9", min_weight=10)))


@query("p6_not_deleted", with_views(f"select {ARTICLE} from articles where is_deleted = false"))
def p6(t):
    return article(filters.not_deleted(t.articles))


@query("p7_time_window", with_views(
    f"select {ARTICLE} from articles, clock where create_time >= clock.t - interval 168 hour"))
def p7(t):
    return article(filters.within_hours(t.articles, t.as_of, 168))


@query("p8_embedded", with_views(f"select {ARTICLE} from articles where embedding is not null"))
def p8(t):
    return article(filters.embedded(t.articles))


PENDING = """(embedding is null or embedding = [0]::float[]) and create_time > clock.t - interval 60 day"""


@query("p9_pending_embedding", with_views(f"select {ARTICLE} from articles, clock where {PENDING}"))
def p9(t):
    return article(filters.pending_embedding(t.articles, t.as_of))


@query("p10_visible_listing", with_views(
    f"select {ARTICLE} from articles where id in (select id from visible where system_id = 2)"))
def p10(t):
    return article(visibility.visible_to(t.articles, t.links, 2))


@query("p11_active_tenants", with_views("select system_id, system_code from active"))
def p11(t):
    return filters.active(t.systems).select("system_id", "system_code")


# -- visibility joins ------------------------------------------------------------------------


@query("j1_visible_one_tenant", with_views("""
select distinct a.id, coalesce(a.system_id, -1) owner
from articles a left join links l on a.id = l.article_id
where a.system_id = 1 or l.system_id = 1 or (a.is_shared and a.system_id is not null)
"""))
def j1(t):
    rows = visibility.visible_to(t.articles, t.links, 1)
    return rows.select("id", F.coalesce("system_id", F.lit(-1)).alias("owner"))


@query("j2_visible_all_tenants", with_views("select system_id, id from visible"))
def j2(t):
    rows = t.articles.select("id", "system_id", "is_shared")
    return visibility.visible_pairs(rows, t.links, t.active_systems)


@query("j3_visible_with_filters", with_views(f"""
select {ARTICLE} from articles
where id in (select id from visible where system_id = 3) and is_deleted = false
  and weight >= 5 and weight <= 200 and contains(title, 'a')
order by create_time desc, id limit 20 offset 20
"""))
def j3(t):
    rows = stats.listing(t.articles, t.links, 3, min_weight=5, max_weight=200, keyword="a")
    return article(filters.page(rows, 1, 20))


@query("j7_tenants_with_configs", with_views(
    "select system_id, system_code, default_hours, default_eps, default_min_samples from active join configs using (system_id)"))
def j7(t):
    return t.active_systems.join(t.configs, "system_id").select(
        "system_id", "system_code", "default_hours", "default_eps", "default_min_samples"
    )


@query("j9_tenant_articles_links", with_views("""
select s.system_id, coalesce(a.id, -1) id, (l.article_id is not null)::int linked
from systems s left join articles a on a.system_id = s.system_id
left join links l on l.article_id = a.id and l.system_id = s.system_id
"""))
def j9(t):
    links = t.links.select(F.col("article_id").alias("id"), "system_id", F.lit(1).alias("linked"))
    owned = t.articles.select("id", "system_id")
    return (
        t.systems.select("system_id")
        .join(owned, "system_id", "left")
        .join(links, ["id", "system_id"], "left")
        .select("system_id", F.coalesce("id", F.lit(-1)).alias("id"), F.coalesce("linked", F.lit(0)).alias("linked"))
    )


# Tenants in number: customers, those in debt inactive. Every fifth code asked for is wrong.
MANY = """
many as (select c_custkey + 1 system_id, lower(c_name) system_code, c_acctbal > 0 is_active from customer),
asked as (select case when c_custkey % 5 = 0 then 'no-' || lower(c_name) else lower(c_name) end system_code from customer)
"""


def many_tenants(t):
    return t.raw("customer").select(
        (F.col("c_custkey") + 1).alias("system_id"),
        F.lower("c_name").alias("system_code"),
        (F.col("c_acctbal") > 0).alias("is_active"),
    )


def asked_codes(t):
    name = F.lower("c_name")
    wrong = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("no-"), name))
    return t.raw("customer").select(F.coalesce(wrong, name).alias("system_code"))


@query("j10_codes_exist", with_views("""
select system_code, exists(select 1 from many m where m.system_code = asked.system_code and m.is_active)::int system_exists
from asked
""", MANY))
def j10(t):
    return visibility.codes_exist(asked_codes(t), many_tenants(t))


@query("j11_resolve_codes", with_views("""
select asked.system_code, coalesce(m.system_id, -1) system_id,
       case when m.system_id is null then 'tenant does not exist or is inactive' else '' end error
from asked left join many m on m.system_code = asked.system_code and m.is_active
""", MANY))
def j11(t):
    resolved, rejected = visibility.resolve_codes(asked_codes(t), many_tenants(t))
    good = resolved.select("system_code", "system_id", F.lit("").alias("error"))
    return good.unionByName(rejected.select("system_code", F.lit(-1).cast("long").alias("system_id"), "error"))


@query("j13_links_by_tenant_and_article", with_views("""
select 'tenant' side, article_id id from links where system_id = 2
union all select 'article', system_id from links where article_id = (select max(article_id) from links)
"""))
def j13(t):
    links = t.links
    top = links.agg(F.max("article_id")).first()[0]
    of_system = visibility.links_of_system(links, 2).select(F.lit("tenant").alias("side"), F.col("article_id").alias("id"))
    of_article = visibility.links_of_article(links, top).select(F.lit("article").alias("side"), F.col("system_id").alias("id"))
    return of_system.unionByName(of_article)


@query("d1s_distinct_articles", with_views("""
select distinct a.id, a.title from articles a left join links l on a.id = l.article_id where l.system_id in (1, 2, 3)
"""))
def d1s(t):
    linked = t.links.filter(F.col("system_id").isin(1, 2, 3)).select(F.col("article_id").alias("id"))
    return t.articles.select("id", "title").join(linked, "id").dropDuplicates(["id"])


# -- statistics ------------------------------------------------------------------------------


@query("a5_pending_count", with_views(f"select count(*) pending from articles, clock where {PENDING}"))
def a5(t):
    return stats.pending_count(t.articles, t.as_of)


def _stats_sql(rows):
    return with_views(f"""
select s.system_id, s.system_code, s.system_name, count(distinct a.id) total_articles,
       count(distinct case when a.embedding is not null then a.id end) embedded_articles,
       count(distinct case when a.is_shared then a.id end) shared_articles,
       count(distinct case when a.is_deleted = false then a.id end) active_articles,
       coalesce({TIME.format('max(a.create_time)')}, '') latest_article_time
from active s {rows} group by all
""")


def _latest_text(df):
    latest = F.date_format("latest_article_time", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return df.withColumn("latest_article_time", F.coalesce(latest, F.lit("")))


OWNED = "left join articles a on a.system_id = s.system_id"


@query("a6_owned_stats", _stats_sql(OWNED))
def a6(t):
    return _latest_text(stats.owned_stats(t.systems, t.articles))


@query("q9_tenant_article_stats", _stats_sql(OWNED))
def q9(t):
    return _latest_text(stats.owned_stats(t.systems, t.articles))


@query("a7_visible_stats", _stats_sql(
    "left join visible v on v.system_id = s.system_id left join articles a on a.id = v.id"))
def a7(t):
    return _latest_text(stats.visible_stats(t.systems, t.articles, t.links))


@query("a9_page_total", with_views(
    "select count(*) total from articles where source = 'src9' and weight >= 10 and is_deleted = false"))
def a9(t):
    return stats.listing(t.articles, source="src9", min_weight=10).agg(F.count("*").alias("total"))


@query("q10_article_listing", with_views(f"""
select 'tenant' scope, * from (select {ARTICLE} from articles
  where id in (select id from visible where system_id = 1) and is_deleted = false and weight >= 10
  order by articles.create_time desc, id limit 20)
union all
select 'global', * from (select {ARTICLE} from articles
  where is_deleted = false and source = 'src9' order by articles.create_time desc, id limit 20 offset 20)
"""))
def q10(t):
    tenant = filters.page(stats.listing(t.articles, t.links, 1, min_weight=10))
    everyone = filters.page(stats.listing(t.articles, source="src9"), 1)
    return article(tenant).withColumn("scope", F.lit("tenant")).unionByName(
        article(everyone).withColumn("scope", F.lit("global"))
    )


# -- limits and orders -----------------------------------------------------------------------


@query("l3_paging", with_views(
    f"select {ARTICLE} from articles order by articles.create_time desc, id limit 20 offset 60"))
def l3(t):
    return article(filters.page(t.articles, 3, 20))


@query("l4_embed_batch", with_views(
    f"select {ARTICLE} from articles, clock where {PENDING} order by articles.create_time desc, id limit 1500"))
def l4(t):
    return article(filters.embed_batch(filters.pending_embedding(t.articles, t.as_of)))


@query("l5_truncate", with_views("""
select 'seven' asked, id from (select id from articles order by weight desc, create_time desc, id limit 7)
union all select 'none', id from articles
"""))
def l5(t):
    cut = filters.heaviest_first(t.articles, 7).select(F.lit("seven").alias("asked"), "id")
    return cut.unionByName(filters.truncate(t.articles, 0).select(F.lit("none").alias("asked"), "id"))


@query("o2_heaviest_first", with_views(f"""
select row_number() over (order by weight desc, articles.create_time desc, id) place, {ARTICLE}
from articles where is_deleted = false order by articles.weight desc, articles.create_time desc, id limit 50
"""))
def o2(t):
    top = filters.heaviest_first(filters.not_deleted(t.articles), 50)
    return article(top).withColumn("place", (F.monotonically_increasing_id() + 1).cast("long"))


# -- scalar functions ------------------------------------------------------------------------


@query("f1_article_text", with_views(
    "select id, title || '。' || coalesce(summary, '') || '。' || coalesce(full_text, '') as text from articles"))
def f1(t):
    return t.articles.select("id", scalars.article_text().alias("text"))


@query("f2_coalesce_weight", with_views("""
select a.id, cast(coalesce(w.weight, 1) as double) weight
from articles a left join (select * from articles where source <> 'src9') w using (id)
"""))
def f2(t):
    given = t.articles.filter("source <> 'src9'").select("id", "weight")
    return t.articles.select("id").join(given, "id", "left").select("id", scalars.link_weight(F.col("weight")).alias("weight"))


@query("f3_hot_score", with_views(
    "select id, round(weight::double * pow(log2(1 + length(title)), 1.8), 6) score from articles"))
def f3(t):
    score = scalars.hot_score(F.col("weight"), F.length("title"))
    return t.articles.select("id", score.alias("score"))


@query("f4_round", with_views("select id, cast(round(weight, 2) as double) rounded from articles"))
def f4(t):
    return t.articles.select("id", F.round("weight", 2).alias("rounded"))


@query("f5_as_of", with_views(f"""
select id, ({CREATED.replace('create_time', 'clock.t')}) as_of, cast(epoch_us(clock.t) - epoch_us(create_time) as bigint) age
from articles, clock"""))
def f5(t):
    at = scalars.moment(t.as_of, t.articles)
    kind = t.articles.schema["create_time"].dataType
    age = scalars.age_micros(F.col("create_time"), kind) - scalars.age_micros(at, kind)
    return t.articles.select("id", at.alias("as_of"), age.alias("age"))


@query("f6_intervals", with_views(f"""
select id, {TIME.format('create_time - interval 24 hour')} day_before, {TIME.format('create_time - interval 60 day')} window_start
from articles"""))
def f6(t):
    return t.articles.select(
        "id",
        (F.col("create_time") - scalars.hours_interval(24)).alias("day_before"),
        (F.col("create_time") - F.make_dt_interval(F.lit(60))).alias("window_start"),
    )


@query("f7_join_first", with_views("""
select source, array_to_string(list(title order by create_time desc, id)[1:3], ' | ') titles
from (select *, row_number() over (partition by source order by create_time desc, id) rn from articles) where rn <= 5 group by source
"""))
def f7(t):
    from pyspark.sql import Window

    newest = Window.partitionBy("source").orderBy(*filters.newest_first())
    rows = t.articles.select("source", "title", F.row_number().over(newest).alias("rn")).filter("rn <= 5")
    listed = rows.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("rn", "title"))).alias("l"))
    return listed.select(
        "source", scalars.join_first(F.transform("l", lambda s: s["title"]), 3, " | ").alias("titles")
    )


@query("f8_parse_vector", f"select vec_id, {vector_sums_sql()} from embeddings")
def f8(t):
    as_text = F.col("embedding").cast("string")
    braces = F.when(F.col("label") == 1, F.translate(as_text, "[]", "{}")).otherwise(as_text)
    rows = t.raw("embeddings").select("vec_id", scalars.parse_vector(braces).alias("embedding"))
    return rows.select("vec_id", *vector_sums(rows))


SCALED = "select vec_id, list_transform(cast(embedding as double[]), lambda x: x * (vec_id + 1)) v from embeddings"


@query("f9_l2_normalize", f"""
select vec_id, {vector_sums_sql('u')} from (
  select vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) u from ({SCALED}))
""")
def f9(t):
    scaled = t.raw("embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") + 1)).alias("v")
    )
    rows = scaled.select("vec_id", scalars.l2_normalize(F.col("v")).alias("embedding"))
    return rows.select("vec_id", *vector_sums(rows))


@query("f10_cosine_distance", """
select a.vec_id, b.vec_id other, round(1 - list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])), 6) distance
from embeddings a join embeddings b on b.vec_id = a.vec_id + 1
""")
def f10(t):
    a = t.raw("embeddings").select("vec_id", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return a.join(b, "vec_id").select(
        "vec_id",
        (F.col("vec_id") + 1).alias("other"),
        F.round(scalars.cosine_distance(F.col("embedding"), F.col("next")), 6).alias("distance"),
    )


@query("f11_placeholder_vector", with_views("""
select id, coalesce(embedding = [0]::float[], true)::int pending
from (select id, case when source = 'src9' then [0]::float[] else embedding end embedding from articles)
"""))
def f11(t):
    zero = F.array(F.lit(0.0).cast("float"))
    rows = t.articles.select("id", F.when(F.col("source") == "src9", zero).otherwise(F.col("embedding")).alias("embedding"))
    return rows.select("id", scalars.is_pending(F.col("embedding")).alias("pending"))


@query("f12_conditional_weight", with_views(
    "select id, cast(case when coalesce(weight, 0) = 0 then 1 else weight end as double) weight from articles"))
def f12(t):
    return t.articles.select("id", scalars.cluster_weight(F.col("weight")).alias("weight"))


@query("f13_unnest", "select vec_id, unnest(range(64)) pos, round(cast(unnest(embedding) as double), 6) val from embeddings")
def f13(t):
    rows = t.raw("embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "val"))
    return rows.select("vec_id", F.col("pos").cast("long").alias("pos"), F.round(F.col("val").cast("double"), 6).alias("val"))
