"""The corpus pipeline: stages over ``documents``, each written and read again.

toxicity     documents scored as toxic go
near copies  of each group of similar documents the one with the smallest id stays
pii          personal data in the texts is replaced
mixing       the rows are written in the order of the source mix
packing      texts are tokenised, laid end to end in that order, and cut

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last
return the columns of their input.  Their input may have any further columns,
whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import mixing, ngram_join, packing, pii, toxicity
from textloom.llm.common import fresh_path, table
from textloom.session import ship

TOXIC_AT = 0.7

#: Bytes of texts that pass between the JVM and a Python worker at a time.
BATCH_BYTES = 4 << 20


def ready(spark: SparkSession) -> SparkSession:
    """The session with workers that find the package and take small batches."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return ship(spark)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores below the threshold.

    Each row is judged by its whole text alone: null and empty texts have no
    evidence and stay, repeated rows and rows without an id are judged like
    any other, equal texts alike; an empty table gives none.
    """
    ready(spark)
    scorer = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.filter(toxicity.score_column(scorer) < TOXIC_AT)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of similar texts.

    It is the one with the smallest id (rows without an id come last; of rows
    that repeat an id, the one with the smaller hash of its text).  Of rows
    with the same id and the same text one stays.  Texts without a word are
    similar to nothing, so each stays; an empty table gives none.
    """
    ready(spark)
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("text"))
    found = ngram_join.join_similar(docs.select(key.alias("key"), "text"), id_col="key")
    kept = found.filter("key = component_id").select("key").distinct()
    rows = docs.select(key.alias("key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return rows.join(kept, "key").groupBy("key").agg(F.first("row").alias("row")).select("row.*")


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data replaced by its kind.

    Whole texts; null texts stay null, empty and repeated ones stay as they
    are; ``n_chars`` follows the text; an empty table gives none.
    """
    ready(spark)
    return pii.redact_texts(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, in the order of the source mix.

    A null source is one of its own, a null text has no length; rows without
    an id and repeated rows stay; an empty table gives none.
    """
    ready(spark)
    return mixing.mixed(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a packed sequence.

    Documents follow each other as they were written.  A null or empty text is
    its separator alone; rows without an id and repeated rows are packed each;
    an empty table gives no pieces.
    """
    ready(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("pii", redact_pii),
    ("mixing", mix_sources),
    ("packing", pack_tokens),
]

#: Decoding, learned models and tokenising have no SQL form; tests/llm/test_pipeline.py
#: compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written as Parquet and read by the next."""
    docs = table(ready(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        out = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return STAGES[-1][1](spark, docs, sf_dir)
