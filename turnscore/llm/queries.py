"""The registered queries of the package and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnscore.llm import (
    bpe, chat_format, decontamination, embedding_dedup, filter_audit, language_id, line_templates, ngram_join, personal_data, secret_scan,
    substring_dedup, url_filter, vector_codes,
)
from turnscore.session import ship_package

QUERIES = {}
ORACLE = {}


def query(name: str, sql: str | None = None):
    def put(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return f(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


MARKED = "</s>[INST] ok [/INST]"


_OP1 = r"""
with t as (
  select conv_id, turn, role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
p as (
  select *, coalesce(role, '') as said, coalesce(role = 'assistant', false) as reply,
         row_number() over w as i, count(*) over (partition by conv_id) as n,
         length(regexp_replace(text, '([\[\]<\\])', '\1_', 'g'))
         + case when role is null or role in ('user', 'assistant') then 22 when role = 'system' then 24
                else 23 + length(regexp_replace(role, '([\[\]<\\])', '\1_', 'g')) end as piece
  from t window w as (partition by conv_id order by turn nulls first, role nulls first, text)),
q as (select *, sum(piece) over (partition by conv_id order by i) as upto from p)
select conv_id, count(*) as n_turns,
       sha256(string_agg(said || chr(10) || text || chr(10), '' order by i)) as turns_sha256,
       cast(coalesce(sum(case when reply then length(text) end), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(case when reply then text end, '' order by i), '')) as loss_sha256,
       cast(sum(case when reply or i = n then upto end) as bigint) as formatted_chars
from q group by conv_id
"""


@query("op1_chat_formatting", _OP1)
def op1_chat_formatting(spark, sf_dir):
    probe = spark.createDataFrame(
        [(-7, 0, "user", MARKED), (-7, 1, "assistant", MARKED)], "conv_id long, turn long, role string, text string"
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat_format.digests(chat_format.prefix_targets(turns))


@query("op6_secret_scan")
def op6_secret_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secret_scan.find_secrets(docs, secret_scan.fit(docs), ["doc_id"])


#: Rules of the url query: (host, path).
BLOCK_RULES = [("net", "/"), ("example.com", "/de/")]
ALLOW_RULES = [("example.net", "/en/"), ("org", "/fr/")]


@query("op7_url_filters", r"""
with parts as (
  select page_id, url,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path
  from pages),
listed as (
  select host from parts group by host
  having count(*) >= 2 and host <> ''
     and min(case when regexp_matches(url, '[?&](utm_[a-z]+|ref)=') then 1 else 0 end) = 1),
rules(rhost, rpath, verdict) as (
  values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits as (
  select p.page_id, p.host, p.path, r.rhost || r.rpath as rule, r.verdict,
         row_number() over (partition by p.page_id order by length(r.rhost || r.rpath) desc) as n
  from parts p join rules r
    on (p.host = r.rhost or ends_with(p.host, '.' || r.rhost)) and starts_with(p.path, r.rpath))
select p.page_id, p.host, p.path, f.rule,
       coalesce(f.verdict, case when p.host in (select host from listed) then 'block' else 'allow' end) as verdict
from parts p left join (select * from fits where n = 1) f on p.page_id = f.page_id
""")
def op7_url_filters(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge_urls(pages, BLOCK_RULES, ALLOW_RULES, url_filter.tracking_hosts(pages))


@query("op2_embedding_near_dedup")
def op2_embedding_near_dedup(spark, sf_dir):
    return embedding_dedup.dedup(table(spark, sf_dir, "embeddings"))


@query("op3_ngram_jaccard_join")
def op3_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), ["doc_id"])


@query("op4_language_id")
def op4_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = language_id.identify(docs, ["doc_id"])
    return out.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("op5_substring_dedup")
def op5_substring_dedup(spark, sf_dir):
    return substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"), ["doc_id"])


@query("op8_line_dedup")
def op8_line_dedup(spark, sf_dir):
    out = line_templates.drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return out.select("doc_id", "n_lines", "n_dropped", kept.alias("kept_sha256"))


def tokenizer_path() -> str:
    """The word-level BPE file among the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op9_bpe_encoding")
def op9_bpe_encoding(spark, sf_dir):
    return bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path(), ["doc_id"], output="digest")


@query("op10_benchmark_decontamination")
def op10_benchmark_decontamination(spark, sf_dir):
    out = decontamination.decontaminate(
        table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), ["doc_id"]
    )
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_OP11_ROUND = """
near{i} as (
  select id, p, arg_min(e, d * 64 + e) as e, min(d) as d
  from (select x.id, x.p, c.e, sum((x.v - c.v) * (x.v - c.v)) as d from x join book{i} c on x.p = c.p and x.j = c.j group by all) group by id, p)"""
_OP11_BOOK = """
book{n} as (
  select c.p, c.e, c.j, coalesce(s.v, c.v) as v from book{i} c
  left join (select x.p, near.e, x.j, cast(floor(sum(x.v) / count(*)) as bigint) as v
             from x join near{i} near on x.id = near.id and x.p = near.p group by all) s
    on c.p = s.p and c.e = s.e and c.j = s.j)"""
_OP11 = (
    """
with k as (
  select row_number() over (order by vec_id nulls last) as id, vec_id, label, embedding as v, len(embedding) // 16 as d from embeddings
  where embedding is not null and len([y for y in embedding if y is not null and isfinite(y)]) = len(embedding)),
x as (
  select id, (i - 1) // d as p, (i - 1) % d as j, cast(floor(256 * cast(y as double)) as bigint) as v
  from (select id, d, unnest(v) as y, generate_subscripts(v, 1) as i from k)),
book0 as (select p, id - 1 as e, j, v from x where id <= 64),"""
    + ",".join([_OP11_ROUND.format(i=0), _OP11_BOOK.format(i=0, n=1), _OP11_ROUND.format(i=1), _OP11_BOOK.format(i=1, n=2), _OP11_ROUND.format(i=2)])
    + """,
coded as (select id, string_agg(printf('%02x', e), '' order by p) as code, cast(sum(d) as bigint) as error from near2 group by id)
select k.vec_id, coded.code, coded.error, cast(sum(error) over (partition by label) as bigint) as label_error,
       (select sha256(string_agg(cast(v as varchar), ',' order by p, e, j)) from book2) as codebooks_sha256
from k join coded on k.id = coded.id
"""
)


@query("op11_vector_codes", _OP11)
def op11_vector_codes(spark, sf_dir):
    out, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.codebooks_digest(books)).alias("codebooks_sha256"))


@query("op12_filter_audit", r"""
with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
w as (select *, [x for x in string_split_regex(t, '[\x20\x09-\x0D]+') if x <> ''] as words from d),
m as (
  select doc_id, part, cast(len(words) < 100 as int) + 2 * cast(100 * len(list_distinct(words)) < 80 * len(words) as int)
         + 4 * cast(100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 10 * length(t) as int) + 8 * cast(regexp_matches(t, '[#$%&*|]') as int)
         + 16 * cast(coalesce(doc_id > min(doc_id) over (partition by t), false) as int) as mask
  from w),
l as (select doc_id, max(quality = 1) as good, max(toxic = 1) as toxic from labels group by doc_id),
c as (
  select part, mask, coalesce(good, false) as good, coalesce(toxic, false) as toxic, count(*) as n, bit_count(mask) as fails
  from m left join l on m.doc_id = l.doc_id group by all),
letters(c, bit) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders as (
  select v.c || w.c || x.c || y.c || z.c as filter_order, [v.bit, w.bit, x.bit, y.bit, z.bit] as bits
  from letters v join letters w on w.c <> v.c join letters x on x.c not in (v.c, w.c)
  join letters y on y.c not in (v.c, w.c, x.c) join letters z on z.c not in (v.c, w.c, x.c, y.c)),
s as (
  select filter_order, step, bits[step] as bit, coalesce(list_sum(bits[1:step - 1]), 0) as before
  from orders, (select unnest([1, 2, 3, 4, 5]) as step)),
r as (select s.*, c.*, (mask & bit) <> 0 as fail, (mask & cast(before as int)) <> 0 as earlier from s, c),
a as (
  select part, filter_order, step, bit,
         cast(sum(case when not fail and not earlier then n else 0 end) as bigint) as kept,
         cast(sum(case when fail and not earlier then n else 0 end) as bigint) as removed,
         cast(sum(case when fail and earlier then n else 0 end) as bigint) as redundant,
         cast(sum(case when mask = bit then n else 0 end) as bigint) as unique_fails,
         cast(sum(case when fail and not earlier and good then n else 0 end) as bigint) as good_lost,
         cast(sum(case when fail and not earlier and toxic then n else 0 end) as bigint) as toxic_lost
  from r group by all)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       cast(sum(removed) over (partition by part, bit) as bigint) as shapley
from a
""")
def op12_filter_audit(spark, sf_dir):
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op13_personal_data")
def op13_personal_data(spark, sf_dir):
    out = personal_data.find_personal(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    counts = [personal_data.count_of(F.col("base"), k).alias(f"n_{k}") for k in personal_data.KINDS]
    base = F.sha2(personal_data.listed(F.col("base")).cast("binary"), 256)
    return out.select("doc_id", *counts, base.alias("base_sha256"), personal_data.listed(F.col("found")).alias("spans"))
