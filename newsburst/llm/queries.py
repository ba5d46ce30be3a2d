"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsburst.llm import chat, decontam, packing, partenum, pieces, quality, records, repair, repeats, reputation, surrogates, toxicity, trie
from newsburst.llm.common import table

QUERIES = {}
ORACLES = {}


def register(name: str):
    def keep(build):
        QUERIES[name] = build
        return build

    return keep


@register("op1_distribution_divergence")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    judged, verdict = quality.judge(docs, keep=["doc_id"])
    return judged.select("doc_id", f"{verdict}.*").drop("class_distance", "common_distance")


@register("op2_suffix_decontamination")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontam.contamination(docs, table(spark, folder, "benchmark"))
    n_hit, items = decontam.hit_words(F.col("matches")), decontam.hit_items(F.col("matches"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.size("matches") > 0).alias("contaminated"),
    )


@register("op3_debruijn_repeats")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: Key of the registered query; a real job takes its own from a secret store.
SURROGATE_KEY = "registered-query"


@register("op4_surrogates")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return surrogates.with_surrogates(docs, SURROGATE_KEY)[0]


@register("op5_host_reputation")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    labels = table(spark, folder, "labels")
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    return reputation.filter_urls(pages, labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")))


def model_file(name: str) -> bytes:
    """A public tokenizer's file, read on the driver; its size is that of the model."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()


@register("op6_binary_records")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    path = records.record_path(spark)
    docs = table(spark, folder, "documents").select("doc_id", "text")
    records.write_records(docs, model_file("word_bpe_49k.json").decode(), 2, path)
    index = records.write_index(spark, path)
    return index.select("doc_id", "start", "n_tokens", "ids_crc32", "offset", "length")


@register("op7_toxicity_chain")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = toxicity.category_labels(docs, table(spark, folder, "labels"))
    categories = [*toxicity.CATEGORY_WORDS, "toxic"]
    scored = toxicity.score(docs, *toxicity.train(docs, labels, categories), categories)
    return scored.withColumn("toxic", F.col("p_toxic") > 0.5)


@register("op8_chat_events")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(probe).alias("text"),
    )
    messages = chat.fold(chat.as_events(turns.unionByName(extra)))
    return chat.digest(chat.read_back(chat.render(messages)))


@register("op9_partenum_join")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return partenum.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"), words=3, percent=90)


@register("op10_sentencepiece_ids")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.add_ids(table(spark, folder, "documents").select("doc_id", "text"), model_file("piece_bpe_32k.model"))


@register("op11_boas_trie")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return trie.prefix_trie(*trie.rebuilt(turns))


@register("op12_streamed_repair")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    damaged = repair.damage(turns)
    found = repair.report(damaged, repair.plan(damaged))
    every = turns.select(F.col("conv_id").cast("long").alias("every")).distinct()
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return every.join(found, F.col("every").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("every").alias("conv_id"),
        *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


@register("op13_binary_packing")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    path = packing.sequence_path(spark)
    docs = table(spark, folder, "documents").select("doc_id", "text")
    packing.write_sequences(docs, model_file("word_bpe_49k.json").decode(), 2, path)
    return packing.sequences(spark, path).select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        F.lit(0).cast("long").alias("offset"),  # every piece is a sequence of its own
    )


ORACLES["op5_host_reputation"] = r"""
with parsed as (
  select page_id,
    translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
    regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's') path
  from pages),
outcomes as (
  select doc_id page_id, max(cast((quality = 0 or toxic = 1) as int)) bad from labels
  where doc_id is not null group by 1),
labelled as (
  select host, count(bad) n, coalesce(sum(bad), 0) bad from parsed left join outcomes using (page_id) group by 1),
named as (
  select *, regexp_extract(host, '([^.]*[.])?[^.]*$') last_two from labelled),
hosts as (
  select host, n, bad, last_two as "domain", regexp_extract(host, '[^.]*$') suffix from named),
domains as (select "domain", suffix, sum(n) n, sum(bad) bad from hosts group by all),
suffixes as (select suffix, sum(n) n, sum(bad) bad from domains group by 1),
overall as (select (1.0 + coalesce(sum(bad), 0)) / (10.0 + coalesce(sum(n), 0)) m from suffixes),
s0 as (select suffixes.*, m from suffixes, overall),
s1 as (
  select *, {strength} k from s0),
s2 as (select suffix, (m * k + bad) / (k + n) m from s1),
d0 as (select "domain", domains.suffix, n, bad, m from domains join s2 using (suffix)),
d1 as (select *, {strength} k from d0),
d2 as (select "domain", suffix, (m * k + bad) / (k + n) m from d1),
h0 as (select host, n, bad, m from hosts join d2 using ("domain", suffix)),
h1 as (select *, {strength} k from h0),
h2 as (select host, (m * k + bad) / (k + n) mean, k, n from h1),
known as (select host, mean - 1.645 * sqrt(mean * (1 - mean) / (k + 1 + n)) low from h2),
rules(rule_host, rule_path, verdict) as (
  values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
    ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fits as (
  select page_id, host, path, rule_host || rule_path as "rule", verdict
  from (select distinct page_id, host, path from parsed) join rules
    on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
  qualify row_number() over (partition by page_id, host, path order by length("rule") desc) = 1)
select parsed.page_id, parsed.host, parsed.path, fits."rule" as "rule",
  coalesce(fits.verdict, case when low > 0.2 then 'block' else 'allow' end) verdict
from parsed left join fits using (page_id, host, path) left join known on known.host = parsed.host
""".replace(
    "{strength}",
    """coalesce((select 1 / least(greatest(excess / nullif(scale, 0), 0.001), 0.9) - 1 from (
      select sum(n * (bad / n - m) * (bad / n - m) - m * (1 - m)) excess, sum(m * (1 - m) * (n - 1)) scale
      from {level} where n > 0)), 10.0)""",
)
for _level in ("s0", "d0", "h0"):
    ORACLES["op5_host_reputation"] = ORACLES["op5_host_reputation"].replace("{level}", _level, 1)

ORACLES["op8_chat_events"] = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
escaped as (
  select *, replace(replace(replace(role, '\', '\\'), '<', '\l'), chr(10), '\n') er,
    replace(replace(text, '\', '\\'), '<', '\l') et from turns)
select conv_id, count(*) n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) loss_sha256,
  cast(sum(18 + length(er) + length(et)) as bigint) formatted_chars
from escaped group by 1
"""


#: CRC-32 of an ASCII text {0}, bit by bit.
_CRC32 = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({0}, ''), lambda x: ascii(x)::bigint)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda v, i: xor(v >> 1, (v & 1) * 3988292384))), 4294967295)"""


ORACLES["op11_boas_trie"] = rf"""
with own as materialized (
  select conv_id, coalesce(role, '') role, coalesce(text, '') text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 place
  from conversations where conv_id is not null),
ids as (
  select conv_id, conv_id - conv_id % 100 base, {_CRC32.format("cast(conv_id as varchar)")} % 6 taken
  from (select distinct conv_id from own)),
lent as materialized (
  select ids.conv_id, base, taken, least(taken, count(own.conv_id)) lent
  from ids left join own on own.conv_id = base and place < taken group by ids.conv_id, base, taken),
turns as materialized (
  select lent.conv_id, place + 1 d, role, text from lent join own on own.conv_id = base and place < taken
  union all
  select conv_id, place - taken + lent + 1, role, text from own join lent using (conv_id) where place >= taken),
members as materialized (
  select conv_id, d, md5(string_agg(length(role) || ':' || role || length(text) || ':' || text, '')
    over (partition by conv_id order by d)) name, length(text) chars from turns
  union all select conv_id, 0, 'root', 0 from ids),
nodes as materialized (select name, d, min(conv_id) low, count(*) n, max(chars) chars from members group by name, d),
linked as materialized (
  select nodes.*, members.name parent from nodes left join members on members.conv_id = low and members.d = nodes.d - 1),
kids as (select parent name, count(*) n_children from linked where parent is not null group by 1),
own_totals as (
  select linked.*, coalesce(n_children, 0) n_children, cast(n_children is null as int) leaf, (n - 1) * chars saved
  from linked left join kids using (name)),
totals as (
  select members.name, sum(leaf) n_leaves, sum(saved) saved_tokens
  from own_totals y join members on members.conv_id = y.low and members.d <= y.d group by 1),
ends as (
  select name, string_agg(cast(conv_id as varchar), ',' order by conv_id) listed
  from (select * from members qualify d = max(d) over (partition by conv_id)) group by 1)
select x.low conv_id, cast(x.d as bigint) as depth, p.low parent_conv_id, x.n n_convs, x.n_children,
  cast(n_leaves as bigint) n_leaves, cast(saved_tokens as bigint) saved_tokens, sha256(coalesce(listed, '')) ends_sha256
from own_totals x left join nodes p on p.name = x.parent join totals on totals.name = x.name left join ends on ends.name = x.name
"""


def _repair_sql() -> str:
    key = "coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ')"
    line = "chr(10) || {0} || ':' || {1}"

    def option(cost: str, letter: str, behind: str, role: str = "", text: str = "''") -> str:
        said = line.format(role, text) + f" || {behind}.t" if role else f"{behind}.t"
        return f"{{'c': {cost} + {behind}.c, 's': '{letter}' || {behind}.s, 't': {said}}}"

    def best(state: str, after: str, role: str, kept: dict[str, str]) -> str:
        options = [option("3", "D", state), f"case when not must then {option('2 + short', 'R', after, repr(role), 'text')} end"]
        for letter, behind in {**kept, "": state}.items():
            options.append(f"case when not must and letter = '{letter}' then {option('short', 'K', behind, 'role', 'text')} end")
        return f"list_min([{', '.join(options)}])"

    user, assistant = "'user'", "'assistant'"
    return rf"""
with recursive coded as (
  select conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') text, {_CRC32.format(key)} % 20 as code from conversations),
damaged as (
  select conv_id, turn, case when code = 4 then 'user' else role end as role,
    case code when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(case when code = 3 then [0, 1] else [0] end) as twin
  from coded where code <> 0),
placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, md5(text), twin) i,
    left(role, 1) letter, regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) tail from damaged),
seen as (select *, row_number() over (partition by conv_id, role, text order by i) > 1 again,
  lag(letter) over (partition by conv_id order by i) || letter pair from placed),
judged as materialized (
  select conv_id, i, turn, role, text, letter, pair, case when tail = '' then 1 when again then 2 when tail not in ('.', '!', '?') then 3 else 0 end fault
  from seen),
rows_ as (select *, fault in (1, 2) must, cast(fault = 3 as int) short from judged),
walk as (
  select conv_id, max(i) + 1 i, {{'c': 0, 's': '', 't': ''}} f0,
    {{'c': 4, 's': 'II', 't': {line.format(user, "''")} || {line.format(assistant, "''")}}} fs,
    {{'c': 2, 's': 'I', 't': {line.format(assistant, "''")}}} fu, {{'c': 0, 's': '', 't': ''}} fa
  from judged group by conv_id
  union all
  select conv_id, i, least(b0, {option("2", "I", "gu", user)}), least(bs, {option("2", "I", "gu", user)}), gu, ga
  from (
    select *, least(bu, {option("2", "I", "ba", assistant)}) gu, least(ba, {option("2", "I", "bu", user)}) ga
    from (
      select r.conv_id, r.i, {best("f0", "fu", "user", {"s": "fs", "u": "fu"})} b0, {best("fs", "fu", "user", {"u": "fu"})} bs,
        {best("fu", "fa", "assistant", {"a": "fa"})} bu, {best("fa", "fu", "user", {"u": "fu"})} ba
      from walk join rows_ r on r.conv_id is not distinct from walk.conv_id and r.i = walk.i - 1))),
counted as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count(*) filter (where fault = 1) blank,
    count(*) filter (where fault = 2) duplicate, count(*) filter (where fault = 3) truncated,
    count(*) filter (where pair not in ('su', 'ua', 'au')) illegal
  from judged group by conv_id)
select every.conv_id, coalesce(gaps, 0) gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) duplicate,
  coalesce(truncated, 0) truncated, coalesce(illegal, 0) illegal, cast(coalesce(f0.c, 0) as bigint) as cost,
  coalesce(f0.s, '') audit, sha256(coalesce(substr(f0.t, 2), '')) repaired_sha256
from (select distinct conv_id from conversations) every
left join counted on counted.conv_id is not distinct from every.conv_id
left join walk on walk.conv_id is not distinct from every.conv_id and walk.i = 1
"""


ORACLES["op12_streamed_repair"] = _repair_sql()


_SPACED = r"""
words as materialized (
  select doc_id, regexp_extract_all(coalesce({text}, ''), '[^\x20\x09-\x0D]+') w from documents)"""
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_CLASS_SIGNS = (
    "a-z", r"\x20\x09-\x0D", "A-Z", "0-9", """.,;:!?''"()\\-""", "#*$%&|<>", r"+/=@\[\\\]\^_`{}~\x00-\x08\x0E-\x1F\x7F",
    r"\x{80}-\x{10FFFF}",
)


def _quality_sql() -> str:
    classes = ", ".join(f"len(regexp_replace(t, '[^{signs}]', '', 'g'))" for signs in _CLASS_SIGNS)
    common = " ".join(
        f"when lang = '{lang}' then [{', '.join(f'len(list_filter(w, lambda x: x = {word!r}))' for word in listed)}]"
        for lang, listed in quality.COMMON_WORDS.items()
    )
    n_common = len(quality.COMMON_WORDS["en"])
    sums = ", ".join(f"sum(c[{i + 1}])" for i in range(len(_CLASS_SIGNS)))
    word_sums = ", ".join(f"sum(m[{i + 1}])" for i in range(n_common))

    def distance(mine: str, theirs: str) -> str:
        part = "case when {0} > 0 then {0} * log2(2 * {0} / ({0} + {1})) else 0 end"
        both = f"{part.format('z[1]', 'z[2]')} + {part.format('z[2]', 'z[1]')}"
        return f"sqrt(greatest(list_sum(list_transform(list_zip({mine}, {theirs}), lambda z: {both})), 0) / 2)"

    limits = quality.Limits()
    return rf"""
with docs as materialized (select doc_id, lang, coalesce(text, '') t from documents),
words as materialized (select doc_id, lang, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') w from docs),
windows as (
  select doc_id, s, array_to_string(w[s:s + 4], ' ') g
  from (select doc_id, w, unnest(range(1, len(w) - 3)) s from words where len(w) >= 5)),
twice as (select doc_id, s, count(*) over (partition by doc_id, g) n from windows),
repeated as (
  select doc_id, count(distinct place) n_repeat_words
  from (select doc_id, unnest(range(s, s + 5)) place from twice where n > 1) group by 1),
lines as (
  select doc_id, count(*) - count(distinct line) n_dup_lines
  from (select doc_id, unnest(string_split(t, chr(10))) line from docs)
  where regexp_matches(line, '[^\x20\x09-\x0D]') group by 1),
counted as materialized (
  select doc_id, lang, cast(len(w) as bigint) n_words, [{classes}] c, case {common} end m from words),
refs as (
  select lang, list_transform(cs, lambda x: x / list_sum(cs)) rc,
    list_transform(list_append(ms, n - list_sum(ms)), lambda x: x / n) rm
  from (select lang, [{sums}] cs, [{word_sums}] ms, sum(n_words) n from counted where m is not null group by lang)
  where n > 0),
judged as (
  select counted.*, coalesce(n_dup_lines, 0) n_dup_lines, coalesce(n_repeat_words, 0) n_repeat_words,
    case when n_words >= {limits.class_words} and rc is not null
      then {distance("list_transform(c, lambda x: x / list_sum(c))", "rc")} end class_distance,
    case when n_words >= {limits.common_words} and rc is not null
      then {distance("list_transform(list_append(m, n_words - list_sum(m)), lambda x: x / n_words)", "rm")} end common_distance
  from counted left join refs using (lang) left join lines using (doc_id) left join repeated using (doc_id))
select doc_id, n_words, cast(list_sum(c) - c[2] as bigint) word_chars, cast(c[6] as bigint) n_symbols, n_dup_lines,
  n_repeat_words, n_words < {limits.least_words} or 100 * n_repeat_words > {limits.most_repeated} * n_words base_failed,
  not base_failed and coalesce(class_distance, 0) <= {limits.class_distance}
    and coalesce(common_distance, 0) <= {limits.common_distance} kept
from judged
"""


ORACLES["op1_distribution_divergence"] = _quality_sql()

ORACLES["op2_suffix_decontamination"] = rf"""
with items as (
  select cast(item_id as varchar) item, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
  from benchmark where text is not null),
sized as (select item, w, least(10, len(w)) n from items where len(w) > 0),
item_windows as (
  select distinct item, n, array_to_string(w[s:s + n - 1], ' ') g
  from (select *, unnest(range(1, len(w) - n + 2)) s from sized)),
docs as materialized (
  select doc_id, regexp_extract_all(coalesce({_LOWERED}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
doc_windows as (
  select doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') g
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) s
        from docs, (select distinct n from sized) where len(w) >= n)),
hits as materialized (
  select distinct doc_id, n, s, item from doc_windows join item_windows using (n, g)),
covered as (
  select doc_id, count(distinct place) n_hit
  from (select doc_id, unnest(range(s, s + n)) place from hits) group by 1),
named as (
  select doc_id, count(*) n_items, string_agg(item, ',' order by item) listed
  from (select distinct doc_id, item from hits) group by 1)
select doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
  sha256(coalesce(listed, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from docs left join covered using (doc_id) left join named using (doc_id)
"""

ORACLES["op3_debruijn_repeats"] = rf"""
with {_SPACED.format(text="text")},
windows as materialized (
  select doc_id, s, array_to_string(w[s:s + 12], ' ') g
  from (select doc_id, w, unnest(range(1, len(w) - 11)) s from words where len(w) >= 13)),
firsts as (select g, min(doc_id) first_doc from windows group by g),
gone as (
  select distinct doc_id, unnest(range(s, s + 13)) place
  from windows join firsts using (g) where first_doc < doc_id),
placed as (select doc_id, unnest(w) word, generate_subscripts(w, 1) place from words),
kept as (
  select doc_id, string_agg(word, ' ' order by place) text, count(*) n
  from placed anti join gone using (doc_id, place) group by 1)
select doc_id, cast(len(w) as bigint) n_words, cast(len(w) - coalesce(n, 0) as bigint) n_removed,
  sha256(coalesce(text, '')) kept_sha256
from words left join kept using (doc_id)
"""

ORACLES["op9_partenum_join"] = rf"""
with recursive {_SPACED.format(text=_LOWERED)},
shingles as materialized (
  select distinct doc_id, array_to_string(w[s:s + 2], ' ') g
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) s from words where len(w) > 0)),
sizes as materialized (select doc_id, count(*) n from shingles group by 1),
links as materialized (
  select a.doc_id a, b.doc_id b
  from shingles a join shingles b on a.g = b.g and a.doc_id < b.doc_id
    join sizes x on x.doc_id = a.doc_id join sizes y on y.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, x.n, y.n having 100 * count(*) >= 90 * (x.n + y.n - count(*))),
sides as materialized (select a, b from links union select b, a from links),
walk(d, r) as (select doc_id, doc_id from words union select b, r from walk join sides on a = d where r < b)
select words.doc_id, coalesce(n, 0) n_shingles, component_id
from words left join sizes using (doc_id) join (select d doc_id, min(r) component_id from walk group by d) using (doc_id)
"""


def callables():
    return {name: partial(build) for name, build in QUERIES.items()}
