"""The registered queries of the training-text operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import ship, table


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyframe.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents")).drop("n_chunks", "fp")


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyframe.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "position", F.get("positions", F.lit(1)).alias("second_position"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyframe.llm.url_filter import filter_urls, rules_table

    return filter_urls(table(spark, sf_dir, "pages"), rules_table(spark))


def op7_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyframe.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyframe.llm.licenses import scan

    return scan(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyframe.llm.toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyframe.llm.language_id import identify

    return identify(table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyframe.llm.html_extract import extract

    return extract(table(spark, sf_dir, "pages"))


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyframe.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyframe.llm.near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=90).select("doc_id", "n_shingles", "component_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _shipped(query):
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries():
    return {name: _shipped(query) for name, query in _all().items()}


def _all():
    return {
        "pipeline": pipeline,
        "op9_jaccard_join": op9_jaccard_join,
        "op1_exact_topk": op1_exact_topk,
        "op6_html_extraction": op6_html_extraction,
        "op4_language_id": op4_language_id,
        "op2_toxicity": op2_toxicity,
        "op3_license_scan": op3_license_scan,
        "op7_pack_sequences": op7_pack_sequences,
        "op5_url_filters": op5_url_filters,
        "op8_mix_sources": op8_mix_sources,
        "op10_exact_dedup": op10_exact_dedup,
    }


LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


MIX_SQL = r"""
with d as (
  select doc_id, coalesce(source, chr(1114111)) as source, md5(cast(doc_id as varchar)) as h,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::bigint as size
  from documents),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source) as r from d group by source),
w as (select *, [3, 1, 2][(r - 1) % 3 + 1] as weight, [-0.5::double, 0.0::double, 0.5::double][(r - 1) % 3 + 1] as slope from s),
l as (select *, (sum(source_size) over () * 1.5::double
                 - coalesce(sum(source_size * 2) over (order by source_size * 2.0::double / weight, r rows between unbounded preceding and 1 preceding), 0)::double)
                / sum(weight) over (order by source_size * 2.0::double / weight, r rows between current row and unbounded following) as level from w),
t as (select source, source_size, slope, least(weight * max(level) over (), source_size * 2.0::double) as target from l),
p as (select doc_id, size, source_size, slope, target,
             (sum(size) over (partition by source order by h, doc_id rows between unbounded preceding and current row) - size)::bigint as start
      from d join t using (source)),
q as (select *, (greatest(0, least(size, floor(target)::bigint - start)) + greatest(0, least(size, floor(target)::bigint - source_size - start)))::bigint as taken from p)
select doc_id, size, source_size, target, taken, case when taken > 0 then @(start) end as position,
       case when size > 0 and start + source_size < floor(target) then @(start + source_size) end as second_position
from q"""
for _offset in ("start", "start + source_size"):  # the inverse of the integral
    MIX_SQL = MIX_SQL.replace(f"@({_offset})", f"case when slope = 0 then ({_offset}) / target else (sqrt((1 - slope) * (1 - slope) + 4 * slope * (({_offset}) / target)) - (1 - slope)) / (2 * slope) end")


URL_SQL = r"""
with a as (select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
p as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from a),
r(verdict, r_host, r_path) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
h as (select page_id, arg_max(r_host || r_path, length(r_host || r_path)) as rule, arg_max(verdict, length(r_host || r_path)) as verdict
      from p join r on (host = r_host or ends_with(host, '.' || r_host)) and starts_with(path, r_path) group by page_id)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from p left join h using (page_id)"""


def license_sql() -> str:
    """Every block against every template, without any filter."""
    from tallyframe.llm.licenses import BLOCK, PHRASES, TEMPLATES, THRESHOLD, needed

    not_word = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    split = f"list_filter(regexp_split_to_array(%s, '{not_word}'), lambda x: x <> '')"
    starts = []
    for label, phrase in PHRASES:
        parts = phrase.split()
        test = " and ".join(f"w[i + {k}] = '{p}'" for k, p in enumerate(parts, 1))
        starts.append(f"select row, '{label}' as label, unnest(list_filter(range(0, len(w)), lambda i: {test})) as i from d")
    values = ", ".join(f"({t}, '{label}', {sorted(set(text.split()))}, {needed(len(set(text.split())), THRESHOLD)})" for t, (label, text) in enumerate(TEMPLATES))
    return f"""
with d as (select row_number() over () as row, doc_id, {LOWER_SQL} as t, {split % LOWER_SQL} as w from documents),
p as ({" union all ".join(starts)}),
b as (select row, count(*) as n_base, min(i) as first_word, max(i) as last_word, list_sort(list_distinct(list(label))) as base from p group by row),
l as (select row, {split % "line"} as x from (select row, unnest(string_split(t, chr(10))) as line from d)),
k as (select row, unnest(case when len(x) <= {BLOCK} then [x] else list_transform(range(0, len(x) - {BLOCK // 2}, {BLOCK // 2}), lambda i: x[i + 1 : i + {BLOCK}]) end) as x from l),
t(id, label, members, need) as (values {values}),
m as (select row, label, len(list_intersect(list_distinct(x), members)) as n, len(members) as size, need from k, t),
f as (select row, list_distinct(list(label)) as more, max(n / size) as best from m where n >= need group by row)
select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
       coalesce(array_to_string(base, ','), '') as base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ','), '') as labels,
       case when n_base > 0 then 1.0::double else coalesce(best, 0.0)::double end as score
from d left join b using (row) left join f using (row)"""


TOPK_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as v from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score from v q join v c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 10"""


JACCARD_SQL = f"""
with recursive d as (select doc_id, list_filter(regexp_split_to_array({LOWER_SQL}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
s as (select doc_id, case when len(w) = 0 then []::varchar[] when len(w) < 3 then [array_to_string(w, ' ')]
                     else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as x from d),
e as (select doc_id, len(x)::bigint as n, unnest(x) as g from s),
o as (select a.doc_id as a, b.doc_id as b, a.n as na, b.n as nb, count(*) as i from e a join e b on a.g = b.g and a.doc_id <> b.doc_id group by all),
l as (select a, b from o where 100 * i >= 90 * (na + nb - i)),
r(doc_id, c) as (select doc_id, doc_id from d union select r.doc_id, l.b from r join l on r.c = l.a)
select s.doc_id, len(x)::bigint as n_shingles, component_id from s join (select doc_id, min(c) as component_id from r group by doc_id) using (doc_id)"""


def oracle_sql():
    return {
        "op9_jaccard_join": JACCARD_SQL,
        "op1_exact_topk": TOPK_SQL,
        "op3_license_scan": license_sql(),
        "op5_url_filters": URL_SQL,
        "op8_mix_sources": MIX_SQL,
        # n_chunks depends on the rolling hash, so the query leaves it out
        "op10_exact_dedup": f"""
with d as (select doc_id, {LOWER_SQL} as t from documents)
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from d""",
    }
