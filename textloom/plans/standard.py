"""The registered queries: each operator over the standard tables, with the
DuckDB text that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import metadata as md
from textloom.functions import text as tx
from textloom.operators import chunking, feedback, metrics, records, rerank, retrieval
from textloom.session import spread
from textloom.sources import catalogs

from .catalog import register

Spark = SparkSession


def read(spark: Spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: Spark, sf_dir: str) -> DataFrame:
    return spread(read(spark, sf_dir, "documents"))


# ---- chunks


def chunk_sql(size: int, overlap: int) -> str:
    step = size - overlap
    return f"select doc_id, i::int as paragraph_index, substring(text, (i * {step} + 1)::bigint, {size}) as chunk from documents, unnest(range(0, ((length(text) + {step - 1}) // {step})::bigint)) as u(i)"


@register("chunk_fixed", chunk_sql(500, 80))
def chunk_fixed(spark: Spark, sf_dir: str) -> DataFrame:
    return chunking.chunk_pages(docs(spark, sf_dir).select("doc_id", "text"), "text")


@register("chunk_default_1000_100", chunk_sql(1000, 100))
def chunk_default(spark: Spark, sf_dir: str) -> DataFrame:
    return chunking.chunk_pages(docs(spark, sf_dir).select("doc_id", "text"), "text", chunking.HELPER_SIZE, chunking.HELPER_OVERLAP)


@register("chunk_stats", f"select d.doc_id, count(c.chunk)::bigint as chunk_count, coalesce(sum(length(c.chunk)), 0)::bigint as chunk_chars from documents d left join ({chunk_sql(500, 80)}) c using (doc_id) group by 1")
def chunk_stats(spark: Spark, sf_dir: str) -> DataFrame:
    return chunking.chunk_stats(docs(spark, sf_dir), "doc_id", "text")


@register("chunk_overlap_inflation", f"with c as ({chunk_sql(500, 80)}) select (select count(*) from c)::bigint as chunks, round((select sum(length(chunk)) from c)::double / (select sum(length(text)) from documents)::double, 6) as inflation")
def chunk_inflation(spark: Spark, sf_dir: str) -> DataFrame:
    stats = chunking.chunk_stats(docs(spark, sf_dir), "doc_id", "text")
    size = docs(spark, sf_dir).agg(F.sum(F.length("text")).alias("n"))
    total = stats.agg(F.sum("chunk_count").alias("chunks"), F.sum("chunk_chars").alias("chars"))
    return total.join(F.broadcast(size)).select("chunks", F.round(F.col("chars") / F.col("n"), 6).alias("inflation"))


# ---- pages and paragraphs: pages are made of the documents, with blank lines,
# other line ends and broken words in turn

PAGES = """(select doc_id, case doc_id % 3 when 0 then replace(text, chr(10), chr(10) || chr(10)) when 1 then replace(text, chr(10), chr(13) || chr(10)) else replace(text, ', ', '-' || chr(10)) end as page_text from documents)"""


def pages(spark: Spark, sf_dir: str) -> DataFrame:
    t, nl = F.col("text"), F.lit("\n")
    kind = F.col("doc_id") % 3
    text = F.when(kind == 0, F.replace(t, nl, F.lit("\n\n"))).when(kind == 1, F.replace(t, nl, F.lit("\r\n"))).otherwise(F.replace(t, F.lit(", "), F.lit("-\n")))
    return docs(spark, sf_dir).select("doc_id", text.alias("page_text"))


def strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def clean_sql(x: str) -> str:
    t = f"replace({x}, chr(13), chr(10))"
    t = rf"regexp_replace({t}, '([\p{{L}}\p{{N}}_])-\n([\p{{L}}\p{{N}}_])', '\1\2', 'g')"
    t = rf"regexp_replace({t}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    t = f"replace(replace(replace({t}, chr(10) || chr(10), chr(1)), chr(10), ' '), chr(1), chr(10) || chr(10))"
    return strip_sql(rf"regexp_replace({t}, '[ \t]+', ' ', 'g')")


def parts_sql(x: str) -> str:
    return rf"list_filter(list_transform(string_split_regex({x}, '\n\s*\n'), lambda p: {strip_sql('p')}), lambda p: p <> '')"


def sentences_sql(x: str) -> str:
    return rf"string_split(regexp_replace({x}, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1))"


def rows_sql(array: str, source: str, name: str, key: str = "doc_id") -> str:
    """Rows (key, pos, value) of an array."""
    return f"select {key}, (i - 1)::int as pos, l[i] as {name} from (select {key}, {array} as l from {source}) x, unnest(range(1, len(l) + 1)) as u(i)"


def exploded(df: DataFrame, array: Column, name: str) -> DataFrame:
    return df.select("doc_id", F.posexplode(array).alias("pos", name))


def groups_sql(source: str, text: str) -> str:
    """Greedy sentence groups (doc_id, l: the groups) of ``text`` in ``source``."""
    keep = "case when length(b) >= 80 then list_append(g, b) else g end"
    some = f"list_filter(list_transform({sentences_sql(text)}, lambda s: {strip_sql('s')}), lambda s: s <> '')"
    return f"""(with recursive s as (select doc_id, {some} as l from {source}),
r as (select doc_id, 0::bigint as i, '' as b, []::varchar[] as g, l from s
union all select doc_id, i + 1, case when length(nb) + 1 >= 600 then '' else nb end, case when length(nb) + 1 >= 600 and length(nb) >= 80 then list_append(g, nb) else g end, l
from (select *, case when b = '' then l[i + 1] else b || ' ' || l[i + 1] end as nb from r where i < len(l)) t)
select doc_id, {keep} as l from r where i = len(l))"""


@register("normalize_whitespace", f"select doc_id, {strip_sql(rf'''regexp_replace(page_text, '[ \t]+', ' ', 'g')''')} as t from {PAGES} p")
def normalize_whitespace(spark: Spark, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("doc_id", tx.collapse_blanks("page_text").alias("t"))


@register("clean_page", f"select doc_id, {clean_sql('page_text')} as t from {PAGES} p")
def clean_page(spark: Spark, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("doc_id", tx.clean_page("page_text").alias("t"))


@register("paragraph_blank_split", rows_sql(parts_sql("page_text"), f"{PAGES} p", "paragraph"))
def paragraph_blank_split(spark: Spark, sf_dir: str) -> DataFrame:
    return exploded(pages(spark, sf_dir), tx.blank_line_parts("page_text"), "paragraph")


@register("sentence_split", rows_sql(sentences_sql("text"), "documents", "sentence"))
def sentence_split(spark: Spark, sf_dir: str) -> DataFrame:
    return exploded(docs(spark, sf_dir), tx.sentences("text"), "sentence")


@register("sentence_group", rows_sql("l", groups_sql("documents", "text"), "paragraph"))
def sentence_group(spark: Spark, sf_dir: str) -> DataFrame:
    return exploded(docs(spark, sf_dir), tx.sentence_groups("text"), "paragraph")


@register(
    "extract_paragraphs",
    f"""with p as (select * from {PAGES} q), b as (select doc_id, list_filter({parts_sql(clean_sql('page_text'))}, lambda x: length(x) >= 80) as l from p where contains(page_text, chr(10) || chr(10))),
g as (select * from {groups_sql("(select doc_id, " + clean_sql("page_text") + " as t from " + PAGES + " z where not contains(page_text, chr(10) || chr(10))) y", "t")} k)
{rows_sql("l", "(select * from b union all select * from g) w", "paragraph")}""",
)
def extract_paragraphs(spark: Spark, sf_dir: str) -> DataFrame:
    return exploded(pages(spark, sf_dir), tx.paragraphs("page_text"), "paragraph")


_LINE = rf"""{strip_sql(r"regexp_replace(array_to_string(list_filter(list_transform(string_split(p, chr(10)), lambda x: " + strip_sql(r"regexp_replace(x, '[ \t]+', ' ', 'g')") + r"), lambda x: x <> ''), ' '), '[ \t]+', ' ', 'g')")}"""


@register(
    "paragraphize",
    rf"""with c as (select doc_id, list_filter(list_transform(string_split_regex(replace(page_text, chr(13), ''), '\n\s*\n+'), lambda p: {_LINE}), lambda p: p <> '') as l from {PAGES} q),
f as (select doc_id, i, l[i] as x from c, unnest(range(1, len(l) + 1)) as u(i)),
k as (select doc_id, i, x, sum(case when i = 1 or length(x) >= 20 then 1 else 0 end) over (partition by doc_id order by i) as island from f)
select doc_id, (island - 1)::int as pos, string_agg(x, ' ' order by i) as paragraph from k group by doc_id, island""",
)
def paragraphize(spark: Spark, sf_dir: str) -> DataFrame:
    return exploded(pages(spark, sf_dir), tx.merged_paragraphs("page_text"), "paragraph")


# ---- metadata


def info(spark: Spark, sf_dir: str) -> DataFrame:
    """Document information as a map, with blanks, a null and colliding keys."""
    pairs = [("/Title", F.concat(F.lit("  "), F.substring("text", 1, 20), F.lit(" \t"))), ("/Author", F.col("source")), ("/Producer", F.lit(None).cast("string")), ("/Keywords", F.lit("")), ("/CreationDate", F.concat(F.lit("D:2024"), F.col("doc_id").cast("string")))]
    return docs(spark, sf_dir).select("doc_id", "lang", F.create_map(*(x for k, v in pairs for x in (F.lit(k), v))).alias("info"))


@register(
    "metadata_extract",
    f"select doc_id, {strip_sql('substring(text, 1, 20)')} as title, source as author, '' as producer, '' as creator, 'D:2024' || doc_id as creation_date, '' as modification_date, '' as keywords, '' as rgid, 0::int as n_apple_keywords from documents",
)
def metadata_extract(spark: Spark, sf_dir: str) -> DataFrame:
    out = info(spark, sf_dir).select("doc_id", md.extract_metadata(F.col("info")).alias("m"))
    return out.select("doc_id", *(f"m.{name}" for name in md.INFO_KEYS), F.size("m.apple_keywords").alias("n_apple_keywords"))


@register("metadata_normalize", "select doc_id, 'later' as a, trim(lang) as b, null::varchar as c from documents")
def metadata_normalize(spark: Spark, sf_dir: str) -> DataFrame:
    m = F.create_map(F.lit("A"), F.lit("first"), F.lit("B"), F.concat(F.lit(" "), F.col("lang"), F.lit("  ")), F.lit("a"), F.lit(" later "), F.lit("C"), F.lit(None).cast("string"))
    out = docs(spark, sf_dir).select("doc_id", md.normalize_map(m).alias("m"))
    return out.select("doc_id", *(F.try_element_at("m", F.lit(k)).alias(k) for k in ("a", "b", "c")))


_DATES = "case doc_id % 4 when 0 then '2024-01-' || lpad(cast(1 + doc_id % 28 as varchar), 2, '0') when 1 then '2024-1-' || (1 + doc_id % 28) when 2 then '2023-02-30' else 'D:20240101' end"


def dates() -> Column:
    d = (1 + F.col("doc_id") % 28).cast("string")
    kind = F.col("doc_id") % 4
    return F.when(kind == 0, F.concat(F.lit("2024-01-"), F.lpad(d, 2, "0"))).when(kind == 1, F.concat(F.lit("2024-1-"), d)).when(kind == 2, F.lit("2023-02-30")).otherwise(F.lit("D:20240101"))


_DATE_SQL = r"case when doc_id % 4 in (0, 1) then strftime(strptime(d, '%Y-%m-%d'), '%Y-%m-%dT%H:%M:%S') else d end"


@register("date_normalize", f"select doc_id, {_DATE_SQL} as d from (select doc_id, {_DATES} as d from documents) t")
def date_normalize(spark: Spark, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", md.normalize_date(dates()).alias("d"))


@register("normalize_document", f"select doc_id, {_DATE_SQL} as creation_date, source as author from (select doc_id, source, {_DATES} as d from documents) t")
def normalize_document(spark: Spark, sf_dir: str) -> DataFrame:
    m = F.create_map(F.lit("Author"), F.concat(F.col("source"), F.lit(" ")))
    out = docs(spark, sf_dir).select("doc_id", md.normalize_document({"creation_date": dates()}, {"info": m}).alias("d"))
    return out.select("doc_id", "d.creation_date", F.col("d.info")["author"].alias("author"))


@register("metadata_flatten", "select event_id, 'meta_k' as key, json_extract_string(props, '$.k') as value from events where json_extract_string(props, '$.k') is not null union all select event_id, 'meta_type', '\"' || event_type || '\"' from events union all select event_id, 'meta_list', '[\"' || event_type || '\",\"2\"]' from events")
def metadata_flatten(spark: Spark, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    text = F.concat(F.lit('{"type":"'), F.col("event_type"), F.lit('","none":null,"empty":"","el":[],"eo":{},"list":["'), F.col("event_type"), F.lit('",null,"",2],'), F.substring("props", 2, 1 << 20))
    return events.select("event_id", F.explode(md.flatten_metadata(F.parse_json(text))).alias("key", "value"))


@register("label_scrub", "select event_id, 1::int as n, event_type as status from events")
def label_scrub(spark: Spark, sf_dir: str) -> DataFrame:
    attrs = F.create_map(F.lit("service.name"), F.lit("svc"), F.lit("status"), F.col("event_type"), F.lit("deployment.environment"), F.lit("dev"))
    return read(spark, sf_dir, "events").select("event_id", md.scrub_labels(attrs).alias("a")).select("event_id", F.size("a").alias("n"), F.col("a")["status"].alias("status"))


# ---- records

_ID = "sha256(doc_id || chr(31) || paragraph_index)"
KEY = ("doc_id", "paragraph_index")


def chunks(spark: Spark, sf_dir: str) -> DataFrame:
    """Chunks, with the last of each document blanked to show the two rules."""
    return chunk_fixed(spark, sf_dir).withColumn("chunk", F.when(F.length("chunk") < 80, F.lit("  ")).otherwise(F.col("chunk")))


_CHUNKS = f"(select doc_id, paragraph_index, case when length(chunk) < 80 then '  ' else chunk end as chunk from ({chunk_sql(500, 80)}) c0)"


@register("dense_records", f"select {_ID} as id, chunk as chunk_text, doc_id, paragraph_index from {_CHUNKS} c")
def dense_records(spark: Spark, sf_dir: str) -> DataFrame:
    return records.dense_records(chunks(spark, sf_dir), KEY)


@register("sparse_records", f"select {_ID} as id, {strip_sql('chunk')} as chunk_text, doc_id, paragraph_index from {_CHUNKS} c where {strip_sql('chunk')} <> ''")
def sparse_records(spark: Spark, sf_dir: str) -> DataFrame:
    return records.sparse_records(chunks(spark, sf_dir), KEY)


@register("upsert_batches", "select source, doc_id, ((row_number() over (partition by source order by doc_id) - 1) // 90)::bigint as batch from documents")
def upsert_batches(spark: Spark, sf_dir: str) -> DataFrame:
    return records.upsert_batches(docs(spark, sf_dir).select("source", "doc_id"), "source", "doc_id")


@register("sequential_ids", "select 'id_' || row_number() over (order by doc_id) as id, doc_id from documents")
def sequential_ids(spark: Spark, sf_dir: str) -> DataFrame:
    return records.sequential_ids(docs(spark, sf_dir).select("doc_id"), "doc_id")


@register("index_stats", "select lang, source, count(*) as record_count from documents group by all")
def index_stats(spark: Spark, sf_dir: str) -> DataFrame:
    return records.index_stats(docs(spark, sf_dir), "lang", "source")


@register("page_stats", "select lang, count(*) as pages, count(*) filter (where coalesce(t, '') = '') as empty_pages, sum(length(coalesce(t, '')))::bigint as chars from (select lang, case when doc_id % 7 = 0 then null when doc_id % 11 = 0 then '' else text end as t from documents) d group by 1")
def page_stats(spark: Spark, sf_dir: str) -> DataFrame:
    t = F.when(F.col("doc_id") % 7 == 0, F.lit(None)).when(F.col("doc_id") % 11 == 0, F.lit("")).otherwise(F.col("text"))
    text = F.coalesce("t", F.lit(""))
    return docs(spark, sf_dir).select("lang", t.alias("t")).groupBy("lang").agg(F.count(F.lit(1)).alias("pages"), F.count_if(text == "").alias("empty_pages"), F.sum(F.length(text)).cast("long").alias("chars"))


# ---- retrieval

def asked(spark: Spark, sf_dir: str) -> DataFrame:
    """The stated query set: every benchmark item."""
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))


_ASKED = "(select item_id as query_id, text as q from benchmark)"
_CUT = r"string_split_regex(lower({}), '[^\p{{L}}\p{{N}}]+')"


def term_rows(key: str, text: str, source: str) -> str:
    return f"(select {key}, t as term from (select {key}, unnest({_CUT.format(text)}) as t from {source}) w where t <> '')"


def bm25_cte(where: str = "true") -> str:
    return f"""qt as (select distinct query_id, term from {term_rows('query_id', 'q', _ASKED + ' a')} x),
dt as (select doc_id as id, term, count(*) as tf from {term_rows('doc_id', 'text', f'(select * from documents where {where}) d')} x group by all),
dl as (select id, sum(tf) as dl from dt group by 1), st as (select count(*) as n, avg(dl) as avgdl from dl),
df as (select term, count(*) as df from dt group by 1),
bm as (select query_id, dt.id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) as score from qt join dt using (term) join df using (term) join dl on dl.id = dt.id, st group by all),
sparse as (select query_id, rank, id, score from (select *, row_number() over (partition by query_id order by score desc, id)::int as rank from bm) x)"""


def hashed_cte() -> str:
    slot = "(('0x' || substring(md5(term), 1, 6))::bigint % 64)"

    def weights(name: str, key: str, rows: str) -> str:
        return f"{name}0 as (select {key}, {slot} as slot, count(*) as n from {rows} x group by all), {name} as (select {key}, slot, n / sqrt(sum(n * n) over (partition by {key})::double) as w from {name}0)"

    return f"""{weights('qw', 'query_id', term_rows('query_id', 'q', _ASKED + ' a'))}, {weights('dw', 'doc_id', term_rows('doc_id', 'text', 'documents'))},
hd as (select query_id, doc_id as id, round(sum(qw.w * dw.w), 6) as score from qw join dw using (slot) group by all),
dense as (select query_id, rank, id, score from (select *, row_number() over (partition by query_id order by score desc, id)::int as rank from hd) x)"""


@register(
    "dense_topk",
    "with q as (select vec_id as query_id, embedding as q from embeddings where vec_id % 50 = 0), s as (select query_id, vec_id as id, round(list_sum(list_transform(list_zip(q, embedding), lambda p: p[1]::double * p[2]::double)), 6) as score from q, embeddings), r as (select *, row_number() over (partition by query_id order by score desc, id)::int as rank from s) select query_id, rank, id, score from r where rank <= 20",
)
def dense_topk(spark: Spark, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return retrieval.dense_topk(e.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "vector"), e)


@register("sparse_topk", f"with {bm25_cte()} select * from sparse where rank <= 10")
def sparse_topk(spark: Spark, sf_dir: str) -> DataFrame:
    return retrieval.sparse_topk(asked(spark, sf_dir), docs(spark, sf_dir), 10, "doc_id", "text")


_LANG = "lang = 'en'"


@register("sparse_topk_filtered", f"with {bm25_cte(_LANG)} select * from sparse where rank <= 10")
def sparse_topk_filtered(spark: Spark, sf_dir: str) -> DataFrame:
    return retrieval.sparse_topk(asked(spark, sf_dir), docs(spark, sf_dir), 10, "doc_id", "text", F.col("lang") == "en")


_HYBRID = f"with {bm25_cte()}, {hashed_cte()}, hy as (select query_id, 'dense' as channel, 0::int as channel_ord, rank, id, score from dense where rank <= 20 union all select query_id, 'sparse', 1::int, rank, id, score from sparse where rank <= 5)"


@register("hybrid_search", f"{_HYBRID} select * from hy")
def hybrid_search(spark: Spark, sf_dir: str) -> DataFrame:
    return retrieval.hybrid_search(asked(spark, sf_dir), docs(spark, sf_dir), 5, "doc_id", "text")


def hits_with_text(spark: Spark, sf_dir: str) -> DataFrame:
    """Hybrid hits with their text and query."""
    text = docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text", "source")
    return text.join(hybrid_search(spark, sf_dir), "id").join(asked(spark, sf_dir), "query_id")


_LEX = f"round(len(list_intersect(list_distinct(list_filter({_CUT.format('q')}, lambda t: t <> '')), list_filter({_CUT.format('text')}, lambda t: t <> '')))::double / greatest(len(list_distinct(list_filter({_CUT.format('q')}, lambda t: t <> ''))), 1), 6)"
_RERANKED = f"{_HYBRID}, rr as (select query_id, id, score, rank, {_LEX} as rerank_score, text, q from hy join documents on doc_id = id join {_ASKED} a using (query_id) where channel = 'dense'), rn as (select *, row_number() over (partition by query_id order by rerank_score desc, rank)::int as new_rank from rr)"


def reranked(spark: Spark, sf_dir: str) -> DataFrame:
    dense = hits_with_text(spark, sf_dir).filter("channel = 'dense'")
    return rerank.rerank(dense, rerank.lexical_score(F.col("q"), F.col("text")))


@register("rerank_topn", f"{_RERANKED} select query_id, new_rank, id, score, rerank_score from rn where new_rank <= 5")
def rerank_topn(spark: Spark, sf_dir: str) -> DataFrame:
    return reranked(spark, sf_dir).select("query_id", "new_rank", "id", "score", "rerank_score")


@register("rerank_lookup", f"{_HYBRID}, rs as (select query_id, (o + 1)::int as ordinal, round(1.0 / (o + 1), 6)::double as rerank_score from {_ASKED} a, unnest(range(0, 30, 3)) u(o)) select query_id, ordinal, rerank_score, coalesce(id::varchar, (ordinal - 1)::varchar) as id, coalesce(score, rerank_score)::double as score from rs left join (select query_id as q2, rank, id, score from hy where channel = 'dense') h on q2 = query_id and rank = ordinal")
def rerank_lookup(spark: Spark, sf_dir: str) -> DataFrame:
    results = asked(spark, sf_dir).select("query_id", F.explode(F.sequence(F.lit(1), F.lit(28), F.lit(3))).alias("ordinal")).withColumn("rerank_score", F.round(1 / F.col("ordinal"), 6))
    hits = hybrid_search(spark, sf_dir).filter("channel = 'dense'").select("query_id", F.col("rank").alias("ordinal"), F.col("id").cast("string").alias("id"), "score")
    return rerank.rerank_lookup(results, hits)


_CONTEXT = f"""{_RERANKED}, ch as (select query_id, 0 as channel_ord, new_rank as rank, text from rn where new_rank <= 5 union all select query_id, 1, rank, text from hy join documents on doc_id = id where channel = 'sparse'),
nu as (select *, row_number() over (partition by query_id order by channel_ord, rank) as ordinal from ch),
se as (select query_id, ordinal, chr(10) || '--- Chunk ' || ordinal || ' ---' || chr(10) || case when length(text) <= 500 then text else substring(text, 1, 500) || '...' end as section from nu),
cu as (select *, sum(length(section)) over (partition by query_id order by ordinal) as total from se),
cx as (select query_id, string_agg(section, chr(10) order by ordinal) as context from cu where total <= 8000 group by 1)"""


def contexts(spark: Spark, sf_dir: str) -> DataFrame:
    """The reranked dense hits and then the sparse ones, from one search."""
    hits = hits_with_text(spark, sf_dir)
    dense = F.col("channel") == "dense"
    score = F.when(dense, rerank.lexical_score(F.col("q"), F.col("text"))).otherwise(0.0)
    w = Window.partitionBy("query_id", "channel_ord").orderBy(F.desc("rerank_score"), "rank")
    ranked = hits.withColumn("rerank_score", score).withColumn("new_rank", F.row_number().over(w))
    kept = ranked.filter(~dense | (F.col("new_rank") <= rerank.TOP_N))
    return rerank.build_context(kept.select("query_id", "channel_ord", F.col("new_rank").alias("rank"), "text"))


@register("context_build", f"{_CONTEXT} select query_id, context from cx")
def context_build(spark: Spark, sf_dir: str) -> DataFrame:
    return contexts(spark, sf_dir)


_PROMPT = f"'Answer the question from the context alone. If the context does not hold the answer, say that it does not.' || chr(10) || chr(10) || 'Question: ' || {strip_sql('q')} || chr(10) || chr(10) || 'Context:' || chr(10) || {strip_sql('context')} || chr(10) || chr(10) || 'Answer:'"


@register("prompt_build", f"{_CONTEXT} select query_id, {_PROMPT} as prompt from cx join {_ASKED} a using (query_id)")
def prompt_build(spark: Spark, sf_dir: str) -> DataFrame:
    return contexts(spark, sf_dir).join(asked(spark, sf_dir), "query_id").select("query_id", rerank.build_prompt(F.col("q"), F.col("context")).alias("prompt"))


_FIRST = strip_sql(r"string_split_regex(context, '\n--- Chunk [0-9]+ ---\n')[2]")


@register("rag_flagship", f"{_CONTEXT} select query_id, q, length(context)::int as context_chars, context, case when {strip_sql('q')} = '' then null else {_FIRST} end as answer from cx join {_ASKED} a using (query_id)")
def rag_flagship(spark: Spark, sf_dir: str) -> DataFrame:
    found = contexts(spark, sf_dir).join(asked(spark, sf_dir), "query_id")
    said = F.when(tx.trim_ws("q") != "", rerank.extractive_answer(F.col("context")))
    return found.select("query_id", "q", F.length("context").alias("context_chars"), "context", said.alias("answer"))


@register("hit_normalize", "select vec_id::varchar as id, (embedding[1]::double) as score, 'vector ' || vec_id as text, 1::int as n_metadata, label::int as page_number, null::int as paragraph_index, null::varchar as source_file, 'T' || label as title from embeddings")
def hit_normalize(spark: Spark, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    fields = F.create_map(F.lit("chunk_text"), F.lit(""), F.lit("text"), F.concat(F.lit("vector "), F.col("vec_id")), F.lit("meta_title"), F.concat(F.lit("T"), F.col("label")), F.lit("page_number"), F.concat(F.col("label").cast("string"), F.lit(".0")))
    hits = e.select(F.col("vec_id").cast("string").alias("_id"), F.col("embedding")[0].cast("double").alias("_score"), fields.alias("fields"))
    out = retrieval.normalize_hits(hits)
    return out.select("id", "score", "text", F.size("metadata").alias("n_metadata"), "page_number", "paragraph_index", "source_file", "title")


@register("query_params", "select conv_id * 1000 + turn as query_id, trim(text) as q, greatest(coalesce(try_cast(case turn % 3 when 0 then '7' when 1 then 'x' else '-2' end as int), 5), 1)::int as k, case when turn % 2 = 0 then 'llama-text-embed-v2' else 'multilingual-e5-large' end as dense_model, 'cross-encoder/ms-marco-MiniLM-L-12-v2' as reranker_model from conversations where trim(coalesce(text, '')) <> ''")
def query_params(spark: Spark, sf_dir: str) -> DataFrame:
    kind = F.col("turn") % 3
    raw = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.concat(F.lit(" "), F.col("text")).alias("q"), F.when(kind == 0, "7").when(kind == 1, "x").otherwise("-2").alias("k"), F.when(F.col("turn") % 2 == 0, F.lit(" ")).otherwise(F.lit(catalogs.DENSE_MODELS[1])).alias("dense_model"), F.lit(None).cast("string").alias("reranker_model"))
    return retrieval.query_params(raw)


@register("model_catalog", "select * from (values ('dense', 'llama-text-embed-v2', true), ('dense', 'multilingual-e5-large', false), ('reranker', 'cross-encoder/ms-marco-MiniLM-L-12-v2', true), ('reranker', 'bge-reranker-v2-m3', false), ('reranker', 'pinecone-rerank-v0', false), ('sparse', 'pinecone-sparse-english-v0', true)) t(kind, model, is_default)")
def model_catalog(spark: Spark, sf_dir: str) -> DataFrame:
    return catalogs.model_catalog(spark)


_MARK = "regexp_replace({}, regexp_escape('{}'), '<mark>\\0</mark>', 'gi')"


@register("highlight", f"select doc_id, {_MARK.format(_MARK.format('text', 'the'), 'tion.')} as marked from documents")
def highlight(spark: Spark, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", tx.highlight("text", F.lit(" the of  tion. a")).alias("marked"))


@register("truncate", "select doc_id, case when length(text) <= 500 then text else substring(text, 1, 500) || '...' end as t from documents")
def truncate(spark: Spark, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", tx.truncate("text").alias("t"))


@register("result_view", f"{_HYBRID} select query_id, rank, printf('%.4f', score) as shown_score, (id % 9)::varchar as page, '?' as paragraph from hy where channel = 'dense'")
def result_view(spark: Spark, sf_dir: str) -> DataFrame:
    hits = hybrid_search(spark, sf_dir).filter("channel = 'dense'")
    return rerank.result_view(hits.withColumn("page_number", (F.col("id") % 9).cast("string")).withColumn("paragraph_index", F.lit("x")))


# ---- feedback: labels stand for judgements, models by id

_FEEDBACK = "(select doc_id as position, quality as feedback, doc_id::varchar as chunk_id, case doc_id % 3 when 0 then 'm1' when 1 then 'm2' end as dense_model, case doc_id % 4 when 1 then 'none' when 2 then 'r1' when 3 then 'r2' end as rerank_model from labels)"
_GROUPS = f"(select coalesce(dense_model, 'unknown') as dense_model, rerank_model, avg(feedback) as precision, max(case when feedback <> 0 then 1.0 else 0.0 end)::double as hit_rate, count(*) as n from {_FEEDBACK} f group by 1, 2)"


def judged(spark: Spark, sf_dir: str) -> DataFrame:
    d, r = F.col("doc_id") % 3, F.col("doc_id") % 4
    return read(spark, sf_dir, "labels").select(F.col("doc_id").alias("position"), F.col("quality").alias("feedback"), F.col("doc_id").cast("string").alias("chunk_id"), F.when(d == 0, "m1").when(d == 1, "m2").alias("dense_model"), F.when(r == 1, "none").when(r == 2, "r1").when(r == 3, "r2").alias("rerank_model"))


@register("feedback_scan", f"select chunk_id, feedback, dense_model, rerank_model from {_FEEDBACK} f")
def feedback_scan(spark: Spark, sf_dir: str) -> DataFrame:
    from textloom.sources.feedback_log import FEEDBACK_SCHEMA

    lines = judged(spark, sf_dir).select(F.to_json(F.struct("chunk_id", "feedback", "dense_model", "rerank_model")).alias("line"))
    return lines.select(F.from_json("line", FEEDBACK_SCHEMA, {"mode": "FAILFAST"}).alias("f")).select("f.chunk_id", "f.feedback", "f.dense_model", "f.rerank_model")


@register("feedback_group_metrics", f"select dense_model, rerank_model, round(precision, 9) as precision, hit_rate, n from {_GROUPS} g")
def feedback_group_metrics(spark: Spark, sf_dir: str) -> DataFrame:
    return feedback.group_metrics(judged(spark, sf_dir)).withColumn("precision", F.round("precision", 9))


@register("feedback_metric_tags", f"select 'precision_at_5_' || dense_model || '_' || coalesce(rerank_model, 'none') as key, round(precision, 9) as value from {_GROUPS} g union all select 'hit_rate_at_5_' || dense_model || '_' || coalesce(rerank_model, 'none'), hit_rate from {_GROUPS} g")
def feedback_metric_tags(spark: Spark, sf_dir: str) -> DataFrame:
    return feedback.metric_tags(feedback.group_metrics(judged(spark, sf_dir))).withColumn("value", F.round("value", 9))


_PLAIN, _WITH = "coalesce(rerank_model, '') in ('', 'none')", "coalesce(rerank_model, '') not in ('', 'none')"


@register("dense_model_compare", f"select dense_model, round(avg(precision), 9) as avg_precision from {_GROUPS} g where {_PLAIN} group by 1")
def dense_model_compare(spark: Spark, sf_dir: str) -> DataFrame:
    return feedback.macro_average(feedback.group_metrics(judged(spark, sf_dir)), "dense_model").withColumn("avg_precision", F.round("avg_precision", 9))


@register("reranker_compare", f"select rerank_model, round(avg(precision), 9) as avg_precision from {_GROUPS} g where {_WITH} group by 1")
def reranker_compare(spark: Spark, sf_dir: str) -> DataFrame:
    return feedback.macro_average(feedback.group_metrics(judged(spark, sf_dir)), "rerank_model").withColumn("avg_precision", F.round("avg_precision", 9))


def _best(by: str, cond: str, family: str) -> str:
    key = "coalesce(dense_model, 'unknown')" if by == "dense_model" else by
    return f"(select '{family}' as family, m as model, round(a, 9) as avg_precision from (select {by} as m, avg(precision) as a from {_GROUPS} g where {cond} group by 1) x join (select {key} as m, min(position) as p from {_FEEDBACK} f where {cond} group by 1) y using (m) order by a desc, p limit 1)"


@register("best_model", f"select * from {_best('dense_model', _PLAIN, 'dense_model')} a union all select * from {_best('rerank_model', _WITH, 'rerank_model')} b")
def best_model(spark: Spark, sf_dir: str) -> DataFrame:
    f = judged(spark, sf_dir)
    both = feedback.best_model(f, "dense_model", "position").unionByName(feedback.best_model(f, "rerank_model", "position"))
    return both.withColumn("avg_precision", F.round("avg_precision", 9))


@register("precision_at_k_per_query", f"{_HYBRID} select query_id, round(sum(coalesce(quality, 0)) / 5.0, 9)::double as precision from hy left join labels on doc_id = id where channel = 'sparse' group by 1")
def precision_per_query(spark: Spark, sf_dir: str) -> DataFrame:
    hits = hybrid_search(spark, sf_dir).filter("channel = 'sparse'").withColumn("id", F.col("id").cast("string"))
    return feedback.precision_at_k(hits, judged(spark, sf_dir)).withColumn("precision", F.round("precision", 9))


# ---- metrics: events stand for points


def points(spark: Spark, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "user_id", (F.col("value") / 60).alias("seconds"), F.lit(1.0).alias("value"))


def window_sql(by: str = "") -> str:
    key = f", {by}" if by else ""
    return f"select time_bucket(interval '5 minutes', ts)::timestamp as window_start{key}, count(*)::double as increase, round(count(*) / 300.0, 9)::double as per_second, round(count(*) / 5.0, 9)::double as per_minute from events group by 1{key}"


def _rates(spark: Spark, sf_dir: str, *by: str) -> DataFrame:
    out = metrics.rate(points(spark, sf_dir), 300, *by)
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).withColumn("per_second", F.round("per_second", 9)).withColumn("per_minute", F.round("per_minute", 9))


@register("metric_rate", window_sql())
def metric_rate(spark: Spark, sf_dir: str) -> DataFrame:
    return _rates(spark, sf_dir)


@register("rate_by_label", window_sql("event_type"))
def rate_by_label(spark: Spark, sf_dir: str) -> DataFrame:
    return _rates(spark, sf_dir, "event_type")


@register("trailing_rate", "select event_id, round(count(*) over (partition by event_type order by epoch_ms(date_trunc('second', ts)) // 1000 range between 299 preceding and current row) / 300.0, 9)::double as per_second from events")
def trailing_rate(spark: Spark, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", F.lit(1.0).alias("value"))
    return metrics.trailing_rate(e, 300, "event_type").select("event_id", F.round("per_second", 9).alias("per_second"))


@register("error_ratio", "select user_id % 20 as shard, round(100.0 * count(*) filter (where event_type = 'error') / count(*), 6)::double as error_percent from events group by 1")
def error_ratio(spark: Spark, sf_dir: str) -> DataFrame:
    e = points(spark, sf_dir).groupBy((F.col("user_id") % 20).alias("shard"))
    return e.agg(F.round(100 * metrics.ratio(F.count_if(F.col("event_type") == "error"), F.count(F.lit(1))), 6).alias("error_percent"))


@register("query_outcomes", f"{_HYBRID} select q.query_id, count(h.id) as n_results, count(h.id) > 0 as any_result, max(h.score) as top_score from (select item_id as query_id from benchmark) q left join (select query_id, id, score from hy where channel = 'sparse') h using (query_id) group by 1")
def query_outcomes(spark: Spark, sf_dir: str) -> DataFrame:
    all_ = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    return metrics.query_outcomes(all_, hybrid_search(spark, sf_dir).filter("channel = 'sparse'"))


@register("no_result_ratio", f"{_HYBRID}, o as (select q.query_id, count(h.id) as n from (select item_id as query_id from benchmark) q left join (select query_id, id from hy where channel = 'sparse') h using (query_id) group by 1) select round(avg(n), 9)::double as results_per_query, round(avg(case when n = 0 then 1.0 else 0.0 end), 9)::double as no_result_ratio from o")
def no_result_ratio(spark: Spark, sf_dir: str) -> DataFrame:
    o = query_outcomes(spark, sf_dir)
    n = F.count(F.lit(1))
    return o.agg(F.round(metrics.ratio(F.sum("n_results"), n), 9).alias("results_per_query"), F.round(metrics.ratio(F.count_if(~F.col("any_result")), n), 9).alias("no_result_ratio"))


_EDGES = "(select unnest([0.01, 0.05, 0.1, 0.2, 0.5, 1.0, 2.0, 5.0, 'infinity'::double]) as le)"
_BUCKETS = f"(select event_type, le, count(*) filter (where value / 60 <= le)::bigint as cum from events, {_EDGES} e group by all)"


@register("histogram_buckets", f"select * from {_BUCKETS} b where le < 'infinity'::double union all select event_type, -1.0, cum from {_BUCKETS} b where le = 'infinity'::double")
def histogram_buckets(spark: Spark, sf_dir: str) -> DataFrame:
    out = metrics.histogram(points(spark, sf_dir), "event_type", value="seconds")
    return out.withColumn("le", F.when(F.col("le") == float("inf"), -1.0).otherwise(F.col("le")))


def quantile_sql(phi: float) -> str:
    return f"select event_type, {phi}::double as phi, round(case when le = 'infinity'::double then low else low + (le - low) * ({phi} * total - before) / (cum - before) end, 6) as q from (select *, coalesce(lag(le) over w, 0.0) as low, coalesce(lag(cum) over w, 0) as before, max(cum) over (partition by event_type) as total from {_BUCKETS} b window w as (partition by event_type order by le)) x where cum >= {phi} * total and before < {phi} * total"


@register("histogram_quantile", " union all ".join(quantile_sql(p) for p in (0.5, 0.95, 0.99)))
def histogram_quantile(spark: Spark, sf_dir: str) -> DataFrame:
    b = metrics.histogram(points(spark, sf_dir), "event_type", value="seconds")
    out = metrics.quantiles(b, [0.5, 0.95, 0.99], "event_type")
    return out.select("event_type", "phi", F.round("quantile", 6).alias("q"))


@register("topscore_quantile", "select label, round(quantile_cont(embedding[1]::double, 0.95), 6) as p95 from embeddings group by 1")
def topscore_quantile(spark: Spark, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").groupBy("label").agg(F.round(F.percentile(F.col("embedding")[0].cast("double"), 0.95), 6).alias("p95"))


@register("query_counts_by_topk", "select (user_id % 20 + 1)::int as top_k, case when event_type = 'error' then 'error' else 'ok' end as status, count(*) as queries, round(avg(value), 6) as mean_seconds from events group by 1, 2")
def query_counts(spark: Spark, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "error").otherwise("ok")
    return e.groupBy((F.col("user_id") % 20 + 1).cast("int").alias("top_k"), status.alias("status")).agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("value"), 6).alias("mean_seconds"))


@register("ingest_outcomes", "select case when length(text) = 0 or lang = 'es' then 'error' else 'success' end as status, case when lang = 'es' then 'UnicodeError' end as error_type, count(*) as documents, sum(n_chars)::bigint as chars from documents group by 1, 2")
def ingest_outcomes(spark: Spark, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    bad = F.col("lang") == "es"
    return d.groupBy(F.when(bad | (F.length("text") == 0), "error").otherwise("success").alias("status"), F.when(bad, "UnicodeError").alias("error_type")).agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars"))


@register("upsert_stats", "select source as index_name, count(*) as records, (max(b) + 1)::bigint as batches from (select source, ((row_number() over (partition by source order by doc_id) - 1) // 90) as b from documents) x group by 1")
def upsert_stats(spark: Spark, sf_dir: str) -> DataFrame:
    b = upsert_batches(spark, sf_dir)
    return b.groupBy(F.col("source").alias("index_name")).agg(F.count(F.lit(1)).alias("records"), (F.max("batch") + 1).alias("batches"))


@register("health", "select 'ok' as status")
def health(spark: Spark, sf_dir: str) -> DataFrame:
    return spark.sql("select 'ok' as status")
