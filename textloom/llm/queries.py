"""The registered queries of this subpackage, with production parameters.

Each takes (spark, sf_dir), runs its operator over the whole table and derives
the result columns from what the operator returns.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import hmm, mixing, neighbours, ngram_join, packing, pii, quality, token_counts, toxicity, warc
from .common import table


def op1_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_texts(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("error")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_similar(table(spark, sf_dir, "documents"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_hmm, op2_mixing, op3_quality, op4_pii, op5_warc, op6_ngram_join, op7_neighbours, op8_token_counts, op9_packing, op10_toxicity)}


_WARC = """with p as (select page_id, strlen(coalesce(html, '')) as n, sha1(coalesce(html, '')) as h from pages),
l as (select h, max(page_id) as lead from p where n >= 1000 group by h)
select page_id, n::bigint as payload_bytes, h as payload_digest, case when n >= 1000 and page_id <> lead then 'revisit' else 'response' end as record_type,
case when n >= 1000 and page_id <> lead then lead end as refers_to from p left join l using (h)"""

_JOIN = r"""with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as l from documents),
s as (select distinct doc_id, array_to_string(l[i:i + 4], ' ') as g from w, unnest(range(1, greatest(len(l) - 4, 1) + 1)) as u(i) where len(l) > 0),
n as (select doc_id, count(*) as n from s group by 1),
o as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b using (g) where a.doc_id <> b.doc_id group by 1, 2),
k as (select a, b from o join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
r as (select doc_id as a, doc_id as b from documents union select r.a, k.b from r join k on k.a = r.b)
select doc_id, coalesce(n.n, 0)::bigint as n_shingles, m.least as component_id from documents join (select a, min(b) as least from r group by 1) m on m.a = doc_id left join n using (doc_id)"""

_NEAR = """with v as (select vec_id, row_number() over () as n, embedding::double[] as e from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
d as (select q.n, q.vec_id as query_id, c.vec_id, sqrt(list_sum(list_transform(list_zip(q.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) as score from v q, v c where q.vec_id % 100 = 0 and c.n <> q.n),
r as (select *, row_number() over (partition by n order by score, vec_id)::int as rank from d)
select query_id, rank, vec_id, score from r where rank <= 10"""


def oracle_sql() -> dict[str, str]:
    return {"op5_warc": _WARC, "op6_ngram_join": _JOIN, "op7_neighbours": _NEAR}
