"""Reranking with pluggable models, context assembly, prompts and answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import terms, trim_ws, truncate

#: Reranked rows, characters of a context and of a chunk in it.
TOP_N, CONTEXT_CHARS, CHUNK_CHARS = 5, 8000, 500

#: A scorer is given batches of (query, text) and gives their scores.
Scorer = Callable[[pd.Series, pd.Series], pd.Series]
_SCORERS: dict[str, Callable[[], Scorer]] = {}


def register_scorer(name: str, load: Callable[[], Scorer]) -> None:
    """``load`` is called once per Python worker and gives the scorer."""
    _SCORERS[name] = load


def lexical_score(query: Column, text: Column) -> Column:
    """Share of the query's different terms that the text has."""
    q, t = F.array_distinct(terms(query)), terms(text)
    return F.round(F.size(F.array_intersect(q, t)) / F.greatest(F.size(q), F.lit(1)), 6)


def model_score(name: str, query: Column, text: Column, most_chars: int | None = None) -> Column:
    """Scores of a registered model, in Arrow batches, loaded once a worker."""
    load = _SCORERS[name]

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        scorer = load()
        for q, t in batches:
            yield scorer(q, t)

    return run(query, F.substring(text, 1, most_chars) if most_chars else text)


def rerank(hits: DataFrame, score: Column, top_n: int = TOP_N, prior: str = "rank") -> DataFrame:
    """Best ``top_n`` of each query; of equal scores the earlier hit is first."""
    scored = hits.withColumn("rerank_score", score)
    w = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), F.asc(prior))
    return scored.withColumn("new_rank", F.row_number().over(w)).filter(F.col("new_rank") <= top_n)


def rerank_lookup(results: DataFrame, hits: DataFrame) -> DataFrame:
    """Results (query_id, ordinal, rerank_score) with the hit at that ordinal,
    where there is one; a result without a hit has its own index (from 0) as id
    and its rerank score as score."""
    right = hits.select(F.col("query_id").alias("q"), F.col("ordinal").alias("o"), "id", "score")
    joined = results.join(right, (F.col("query_id") == F.col("q")) & (F.col("ordinal") == F.col("o")), "left")
    return joined.select("query_id", "ordinal", "rerank_score", F.coalesce("id", (F.col("ordinal") - 1).cast("string")).alias("id"), F.coalesce("score", "rerank_score").alias("score"))


def context_sections(hits: DataFrame, budget: int = CONTEXT_CHARS) -> DataFrame:
    """query_id, ordinal, section: numbered sections in (channel_ord, rank)
    order, up to the first that would run over the budget."""
    w = Window.partitionBy("query_id").orderBy("channel_ord", "rank")
    rows = hits.withColumn("ordinal", F.row_number().over(w))
    section = F.concat(F.lit("\n--- Chunk "), F.col("ordinal"), F.lit(" ---\n"), truncate(F.coalesce("text", F.lit("")), CHUNK_CHARS))
    cut = rows.withColumn("section", section)
    total = F.sum(F.length("section")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumn("total", total).filter(F.col("total") <= budget).select("query_id", "ordinal", "section", "total")


def build_context(hits: DataFrame, budget: int = CONTEXT_CHARS) -> DataFrame:
    """query_id, context: at most ``budget`` characters of sections a query."""
    parts = F.array_sort(F.collect_list(F.struct("ordinal", "section")))
    return context_sections(hits, budget).groupBy("query_id").agg(F.array_join(F.transform(parts, lambda p: p["section"]), "\n").alias("context"))


def build_prompt(query: Column, context: Column) -> Column:
    intro = "Answer the question from the context alone. If the context does not hold the answer, say that it does not."
    return F.concat(F.lit(f"{intro}\n\nQuestion: "), trim_ws(query), F.lit("\n\nContext:\n"), trim_ws(context), F.lit("\n\nAnswer:"))


def extractive_answer(context: Column) -> Column:
    """The first section of a context: the default instead of a model."""
    return F.coalesce(trim_ws(F.try_element_at(F.split(context, "\n--- Chunk [0-9]+ ---\n"), F.lit(2))), F.lit(""))


#: A generator is given a batch of prompts and gives the answers.
Generator = Callable[[pd.Series], pd.Series]


def answer(contexts: DataFrame, generator: Generator | None = None) -> DataFrame:
    """query_id, answer, error of (query_id, q, context).

    A blank query is an error row.  Without a generator the answer is the
    first section of the context.
    """
    blank = trim_ws(F.coalesce("q", F.lit(""))) == ""
    if generator is None:
        made = extractive_answer(F.col("context"))
    else:

        @F.pandas_udf("string")
        def run(prompts: pd.Series) -> pd.Series:
            return generator(prompts)

        made = run(build_prompt(F.col("q"), F.col("context")))
    return contexts.select("query_id", F.when(~blank, made).alias("answer"), F.when(blank, F.lit("query is empty")).alias("error"))


def result_view(hits: DataFrame) -> DataFrame:
    """query_id, rank, shown_score, page, paragraph as a result page shows them."""

    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).try_cast("int").cast("string"), F.lit("?"))

    return hits.select("query_id", "rank", F.call_function("format_number", F.col("score"), F.lit("0.0000")).alias("shown_score"), shown("page_number").alias("page"), shown("paragraph_index").alias("paragraph"))
