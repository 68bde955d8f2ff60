"""The queries of the training-data operators, by name. Each takes (spark, sf_dir) and covers its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: DuckDB SQL with the same rows, where SQL can express them.
ORACLE_SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def tokenizer(name: str) -> str:
    """Path of a public tokenizer file; the files lie outside this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op1_token_counts(spark, sf_dir):
    from tessera.llm.token_counts import count_tokens

    return count_tokens(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))


@query
def op10_bpe_codec(spark, sf_dir):
    from tessera.llm.encoding import digests

    return digests(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))


@query
def op6_suffix_dedup(spark, sf_dir):
    from tessera.llm.suffix_dedup import digests

    return digests(documents(spark, sf_dir))


@query
def op9_cover_dedup(spark, sf_dir):
    from tessera.llm.cover_dedup import digests

    return digests(documents(spark, sf_dir))


@query
def op3_simhash(spark, sf_dir):
    from tessera.llm.simhash import digests

    return digests(documents(spark, sf_dir))


@query
def op7_quality_rules(spark, sf_dir):
    from tessera.llm.quality import judge, train

    docs = documents(spark, sf_dir)
    return judge(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@query
def op2_secret_scan(spark, sf_dir):
    from tessera.llm.secrets import digests

    return digests(documents(spark, sf_dir))


@query
def op5_language_id(spark, sf_dir):
    from tessera.llm.language import identify, learn

    docs = documents(spark, sf_dir)
    return identify(docs, learn(docs))


@query
def op8_spotsigs(spark, sf_dir):
    from tessera.llm.spotsigs import fingerprints

    return fingerprints(documents(spark, sf_dir))


@query
def op4_best_fit_packing(spark, sf_dir):
    from tessera.llm.packing import pack

    return pack(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))


@query
def op11_conversation_repair(spark, sf_dir):
    from tessera.llm.conversations import digests

    return digests(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


@query
def op12_language_model(spark, sf_dir):
    from tessera.llm.language_model import score

    return score(documents(spark, sf_dir))


@query
def op13_filter_audit(spark, sf_dir):
    from tessera.llm.filter_audit import audit

    return audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE_SQL["op13_filter_audit"] = r"""
with d as (select row_number() over () as r, doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
w as (select r, unnest(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) as word from d),
c as (select r, count(*) as n, count(distinct word) as k from w group by r),
l as (select doc_id, max(quality) as q, max(toxic) as x from labels group by doc_id),
f as (select part, coalesce(q = 1, false) as good, coalesce(x = 1, false) as toxic, [coalesce(n, 0) < 200, 100 * coalesce(k, 0) < 50 * coalesce(n, 0),
    100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(d.doc_id > min(d.doc_id) over (partition by t), false)] as fails
  from d left join c using (r) left join l on l.doc_id = d.doc_id),
a as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
o as (select p.x || q.x || s.x || u.x || v.x as filter_order from a p join a q on q.x <> p.x join a s on s.x not in (p.x, q.x) join a u on u.x not in (p.x, q.x, s.x) join a v on v.x not in (p.x, q.x, s.x, u.x)),
s as (select filter_order, step::int as step, list_transform(range(1, step), lambda i: instr('ABCDE', filter_order[i])) as prior, instr('ABCDE', filter_order[step]) as own from o, range(1, 6) t(step)),
g as (select part, fails, count(*) as n, count(*) filter (where good) as g, count(*) filter (where toxic) as x from f group by all),
e as (select part, filter_order, step, own, fails[own] as hit, len(list_filter(prior, lambda i: fails[i])) > 0 as gone, len(list_filter(fails, lambda y: y)) = 1 as alone, n, g, x from g, s),
r as (select part, filter_order, step, own, sum(case when not hit and not gone then n else 0 end)::bigint as kept, sum(case when hit and not gone then n else 0 end)::bigint as removed,
    sum(case when hit and gone then n else 0 end)::bigint as redundant, sum(case when hit and alone then n else 0 end)::bigint as unique_fails,
    sum(case when hit and not gone then g else 0 end)::bigint as good_lost, sum(case when hit and not gone then x else 0 end)::bigint as toxic_lost
  from e group by all)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) over (partition by part, own)::bigint as shapley from r"""

ORACLE_SQL["op9_cover_dedup"] = r"""
with w as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
x as (select r, doc_id, unnest(list_transform(range(1, len(ws) - 48), lambda i: {'i': i, 'h': sha256(array_to_string(ws[i:i + 49], ' '))})) as x from w where len(ws) >= 50),
m as (select x.h as h, min(doc_id) as d from x group by 1),
c as (select r, list(distinct x.i + k) as cov from x join m on x.x.h = m.h, range(0, 50) t(k) where m.d < x.doc_id group by r)
select doc_id, len(ws)::bigint as n_words, coalesce(len(cov), 0)::bigint as n_removed,
  sha256(array_to_string(case when cov is null then ws else list_filter(ws, lambda v, j: not list_contains(cov, j)) end, ' ')) as kept_sha256
from w left join c on w.r = c.r"""
