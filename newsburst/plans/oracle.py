"""Shared SQL text of the checks: the views of ``plans/views.py`` and a recursive
formulation of density clustering that has nothing in common with the Spark one."""

from __future__ import annotations

TIME = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')"

BASE = """
systems as (
  select cast(r_regionkey + 1 as bigint) system_id, lower(r_name) system_code, r_name system_name,
         r_regionkey <> 4 is_active
  from region),
active as (select * from systems where is_active),
configs as (
  select cast(system_id as bigint) system_id, cast(hours as int) default_hours, cast(eps as double) default_eps,
         cast(ms as int) default_min_samples, cast(cap as int) max_articles_limit, cast(k as int) snapshot_limit
  from (values (1,720,0.65,3,80000,100), (2,720,0.6,2,80000,5), (3,480,0.65,2,120,100),
               (4,24,0.38,3,0,100), (5,720,0.6,3,80000,100)) as t(system_id,hours,eps,ms,cap,k)),
articles as materialized (
  select d.doc_id id,
    case when d.doc_id % 11 = 0 then null else d.doc_id % 5 + 1 end system_id,
    d.doc_id % 7 = 0 is_shared,
    split_part(d.text, chr(10), 1) title,
    case when d.doc_id % 3 = 0 then null else split_part(d.text, chr(10), 2) end summary,
    d.text full_text,
    case when d.doc_id % 97 = 0 then cast(0 as decimal(16,4)) else cast(v.value as decimal(16,4)) end weight,
    v.ts create_time, d.source source,
    concat('{"author":"', d.source, '","tags":["', d.lang, '"],"viewCount":', cast(d.n_chars as varchar), '}') attr,
    e.embedding embedding,
    case when d.doc_id % 101 = 0 then null else coalesce(l.toxic, 0) = 1 end is_deleted
  from documents d
  join events v on v.event_id = (d.doc_id * 7919) % (select count(*) from events)
  left join embeddings e on e.vec_id = d.doc_id
  left join labels l on l.doc_id = d.doc_id),
links as (
  select id article_id, (id * 3 + 1) % 5 + 1 system_id from articles where id % 4 = 0
  union
  select id article_id, (id + 2) % 5 + 1 system_id from articles where id % 6 = 0),
clock as (select max(create_time) t from articles),
visible as (
  select distinct s.system_id, a.id
  from articles a join active s on true
  left join links l on l.article_id = a.id and l.system_id = s.system_id
  where a.system_id = s.system_id or l.system_id is not null
     or (a.is_shared and a.system_id is not null))
"""

# Candidates per scope: k (scope number), id, create_time, eps, ms, cap, u.
GLOBAL = """
cand as materialized (
  select 0 k, id, create_time, {eps} eps, {ms} ms, {cap} cap, cast(embedding as double[]) u
  from articles, clock
  where embedding is not null and create_time >= clock.t - interval ({hours}) hour)
"""

PARAMS = """
params as (
  select system_id, {hours} as window_hours, {eps} eps, {ms} ms,
         nullif(max_articles_limit, 0) cap
  from active join configs using (system_id))
"""

TENANT = (
    PARAMS
    + """,
cand as materialized (
  select v.system_id k, a.id, a.create_time, p.eps, p.ms, p.cap, cast(a.embedding as double[]) u
  from visible v join articles a using (id) join params p on p.system_id = v.system_id, clock
  where a.embedding is not null and a.is_deleted = false
    and a.create_time >= clock.t - to_hours(p.window_hours))
"""
)

# Ticks some hours apart, the last at the newest article: scope number = tenant + 100 * tick.
TICKS = (
    PARAMS
    + """,
tick as (select n, t - to_hours({step} * ({ticks} - 1 - n)) as at_time from clock, range({ticks}) r(n)),
cand as materialized (
  select v.system_id + 100 * tick.n k, a.id, a.create_time, p.eps, p.ms, p.cap, cast(a.embedding as double[]) u
  from visible v join articles a using (id) join params p on p.system_id = v.system_id join tick on true
  where a.embedding is not null and a.is_deleted = false
    and a.create_time >= tick.at_time - to_hours(p.window_hours) and a.create_time <= tick.at_time)
"""
)

LABELS = """,
pts as materialized (
  select * from (
    select *, row_number() over (partition by k order by create_time desc, id) rn from cand)
  where rn <= cap or cap is null),
ed as materialized (
  select a.k, a.rn i, b.rn j, a.ms
  from pts a join pts b on a.k = b.k
  where a.rn = b.rn or 1 - list_cosine_similarity(a.u, b.u) <= a.eps),
co as materialized (select k, i, count(*) degree from ed group by k, i having count(*) >= max(ms)),
ce as materialized (
  select ed.k, ed.i, ed.j from ed
  join co a on a.k = ed.k and a.i = ed.i join co b on b.k = ed.k and b.i = ed.j),
cc(k, i, l) as (
  select k, i, i from co
  union
  select ce.k, ce.j, cc.l from cc join ce on ce.k = cc.k and ce.i = cc.i where cc.l < ce.j),
cid as materialized (
  select k, i, l, dense_rank() over (partition by k order by l) - 1 cid
  from (select k, i, min(l) l from cc group by k, i)),
lab as (
  select ed.k, ed.i, coalesce(max(case when ed.i = ed.j then cid.cid end), min(cid.cid)) cid
  from ed join cid on cid.k = ed.k and cid.i = ed.j group by ed.k, ed.i),
labels_ as materialized (
  select pts.k, pts.id, pts.create_time, pts.rn, coalesce(lab.cid, -1) cluster_id, co.i is not null is_core
  from pts left join lab on lab.k = pts.k and lab.i = pts.rn
  left join co on co.k = pts.k and co.i = pts.rn)
"""

EVENTS = """,
clustered as (
  select l.k, l.cluster_id, l.id, l.rn, a.title, a.weight,
         row_number() over (partition by l.k, l.cluster_id order by l.rn) place
  from labels_ l join articles a using (id) where l.cluster_id >= 0),
scored as (
  select k, cluster_id, arg_min(title, place) title, count(*) article_count,
         cast(sum(case when coalesce(weight, 0) = 0 then 1 else weight end) as double) total_weight,
         string_agg(title, ' | ' order by place) filter (where place <= 4) sample_titles,
         string_agg(cast(id as varchar), ',' order by place) article_ids
  from clustered group by k, cluster_id),
ev as materialized (
  select *, row_number() over (partition by k order by hot_score desc, cluster_id) rank_no
  from (select *, round(total_weight * pow(log2(1 + article_count), 1.8), 6) hot_score from scored))
"""

# Stored snapshots: all tenants at the first tick, tenants 1 and 2 again at the second.
STORED = """,
snap as materialized (
  select ev.k % 100 system_id, tick.at_time snapshot_time, ev.rank_no, ev.cluster_id, ev.title, ev.article_count,
         ev.total_weight, ev.hot_score, ev.sample_titles, ev.article_ids, c.default_hours hours_window
  from ev join tick on tick.n = ev.k // 100 join configs c on c.system_id = ev.k % 100
  where ev.rank_no <= c.snapshot_limit and (tick.n = 0 or ev.k % 100 in (1, 2))),
snap_articles as materialized (
  select s.system_id, s.snapshot_time, s.rank_no, s.cluster_id, a.id article_id,
         cast(coalesce(a.weight, 1) as double) article_weight
  from (select *, unnest(string_split(article_ids, ','))::bigint member from snap) s
  join articles a on a.id = s.member)
"""

# Token-hash vectors of (id, text) rows in ``docs``.
HASHED = """,
tok as (
  select id, unnest(list_filter(regexp_split_to_array(text, '[ \\t\\r\\n。]+'), lambda x: x <> '')) token
  from docs),
cnt as (
  select id, cast(('0x' || substr(md5(token), 1, 8)) as bigint) % 64 slot, ln(1 + count(*)) v
  from tok group by all),
vec as materialized (
  select d.id, r.slot, coalesce(c.v, 0) / coalesce(nullif(sqrt(sum(coalesce(c.v * c.v, 0)) over (partition by d.id)), 0), 1) v
  from docs d join range(64) r(slot) on true left join cnt c on c.id = d.id and c.slot = r.slot)
"""


def with_views(select: str, *parts: str) -> str:
    return "with recursive " + BASE + "".join(f", {p.lstrip(',')}" for p in parts) + select


def global_sql(select, hours=720, eps=0.6, ms=3, cap="cast(null as bigint)", tail=LABELS + EVENTS) -> str:
    return with_views(select, GLOBAL.format(hours=hours, eps=eps, ms=ms, cap=cap) + tail)


def tenant_sql(select, hours="default_hours", eps="default_eps", ms="default_min_samples", tail=LABELS + EVENTS) -> str:
    return with_views(select, TENANT.format(hours=hours, eps=eps, ms=ms) + tail)


def ticks_sql(select, tail="", ticks=2, step=240) -> str:
    own = TICKS.format(hours="default_hours", eps="default_eps", ms="default_min_samples", ticks=ticks, step=step)
    return with_views(select, own + LABELS + EVENTS + tail)


def stored_sql(select) -> str:
    return ticks_sql(select, STORED)


def hashed_sql(docs: str, select: str) -> str:
    return with_views(select, f"docs as ({docs})" + HASHED)
