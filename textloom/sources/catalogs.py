"""Static relations: the models that a query may name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Model names that stored rows and queries carry.
DENSE_MODELS = ("llama-text-embed-v2", "multilingual-e5-large")
RERANKERS = ("cross-encoder/ms-marco-MiniLM-L-12-v2", "bge-reranker-v2-m3", "pinecone-rerank-v0")
SPARSE_MODELS = ("pinecone-sparse-english-v0",)
DEFAULT_DENSE, DEFAULT_RERANKER = DENSE_MODELS[0], RERANKERS[0]

INDEX_BASE = "documents"


def model_catalog(spark: SparkSession) -> DataFrame:
    """kind, model, is_default."""
    rows = [(kind, m, m == names[0]) for kind, names in (("dense", DENSE_MODELS), ("reranker", RERANKERS), ("sparse", SPARSE_MODELS)) for m in names]
    values = ", ".join(f"('{kind}', '{m}', {str(d).lower()})" for kind, m, d in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(kind, model, is_default)")


def index_name(model: str | None = None, base: str = INDEX_BASE) -> str:
    """A dense index has its model in its name; a missing model means the default."""
    return f"{base}-{model or DEFAULT_DENSE}"


def sparse_index_name(base: str = INDEX_BASE) -> str:
    return f"{base}-sparse"
