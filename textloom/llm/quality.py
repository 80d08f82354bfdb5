"""Quality by hashed n-gram log-likelihood ratio, with DataFrame functions only.

Words and pairs of neighbouring words are hashed into ``buckets`` classes.
Two multinomials are estimated over them: the raw corpus (all documents) and
the trusted target (a bounded sample of documents labelled good).  A document's
score is its log-likelihood ratio divided by its number of n-grams; all that
reach ``threshold`` are kept, unless a base rule rejects them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, stage


def words_column(text: Column) -> Column:
    """Words of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK), "")


def repeated_words(tri: Column) -> Column:
    """How many word positions lie in a window whose hash occurs twice or more.

    ``tri`` holds the hashes of the 3-word windows in order.  Windows are
    sorted by hash, so equal ones are neighbours: n log n for any text.
    """
    ordered = F.array_sort(F.transform(tri, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def covered(s: Column) -> Column:
        def places(x: Column, j: Column) -> Column:
            twin = (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"])
            return F.when(twin, F.array(x["i"], x["i"] + 1, x["i"] + 2)).otherwise(F.array().cast("array<int>"))

        return F.size(F.array_distinct(F.flatten(F.transform(s, places))))

    # the one-element array binds the sorted windows to a variable: sorted once
    return F.when(F.size(F.array_distinct(tri)) == F.size(tri), F.lit(0)).otherwise(F.get(F.transform(F.array(ordered), covered), F.lit(0)))


def base_features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, words, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("words", words_column(F.col("text")))
    n = F.size("words")
    inner = F.greatest(n - 2, F.lit(0))
    windows = F.arrays_zip(F.slice("words", F.lit(1), inner).alias("a"), F.slice("words", F.lit(2), inner).alias("b"), F.slice("words", F.lit(3), inner).alias("c"))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    step = words.select(
        "id",
        "words",
        n.cast("long").alias("n_words"),
        F.length(F.concat_ws("", "words")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.transform(windows, lambda x: F.xxhash64(x["a"], x["b"], x["c"])).alias("tri"),
    )
    return step.select("id", "words", "n_words", "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), repeated_words(F.col("tri")).cast("long").alias("n_repeat_words"))


def grams(rows: DataFrame, buckets: int, *carried: str) -> DataFrame:
    """One row per n-gram (words and pairs): the carried columns and its bucket;
    a row without words stays, with a null bucket."""
    pairs = F.arrays_zip(F.col("words").alias("a"), F.slice("words", F.lit(2), F.greatest(F.size("words") - 1, F.lit(0))).alias("b"))
    each = rows.select(*carried, F.explode_outer(pairs).alias("g"))
    one = F.pmod(F.xxhash64("g.a"), F.lit(buckets)).cast("int")
    two = F.when(F.col("g.b").isNotNull(), F.pmod(F.xxhash64("g.a", "g.b"), F.lit(buckets)).cast("int"))
    both = each.select(*carried, F.explode(F.array(F.when(F.col("g.a").isNotNull(), one), two)).alias("bucket"))
    return both


def trusted_ids(labels: DataFrame, most: int, id_col: str, label_col: str) -> DataFrame:
    """At most ``most`` ids labelled good, chosen by a hash of the id."""
    good = labels.filter(F.col(label_col) == 1).select(F.col(id_col).alias("trusted")).filter("trusted is not null").distinct()
    return good.orderBy(F.xxhash64("trusted"), "trusted").limit(most)


def bucket_weights(docs: DataFrame, trusted: DataFrame, buckets: int, id_col: str, text_col: str) -> DataFrame:
    """(bucket, weight): log of the target's over the corpus's smoothed share."""
    words = docs.select(F.col(id_col).alias("id"), words_column(F.col(text_col)).alias("words"))
    # the sample is bounded, so its ids can be broadcast
    marked = words.join(F.broadcast(trusted), F.col("id") == F.col("trusted"), "left").withColumn("good", F.col("trusted").isNotNull().cast("int"))
    counts = grams(marked, buckets, "good").filter("bucket is not null").groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("good").alias("good"))
    totals = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("all_raw"), F.coalesce(F.sum("good"), F.lit(0)).alias("all_good"))  # one row
    weight = F.log((F.col("good") + 1) / (F.col("all_good") + buckets)) - F.log((F.col("raw") + 1) / (F.col("all_raw") + buckets))
    return counts.join(F.broadcast(totals)).select("bucket", F.when(F.col("all_good") > 0, weight).otherwise(0.0).alias("weight"))


def rate_quality(docs: DataFrame, labels: DataFrame, buckets: int = 10_000, threshold: float = -0.05, most_trusted: int = 20_000, least_words: int = 50, most_repeated: int = 50, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per row of ``docs``: id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, score, kept.

    A null or empty text has no words, fails the base rule and scores 0; null
    ids and repeated rows stay; without trusted documents all scores are 0; an
    empty table gives none; extra columns are not read.  The corpus is read
    twice: for the ``buckets`` counts, and to score; only bucket counts and one
    row per document are shuffled.
    """
    weights = stage(bucket_weights(docs, trusted_ids(labels, most_trusted, id_col, label_col), buckets, id_col, text_col), "quality-weights")
    kept_cols = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rows = base_features(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    # `buckets` rows are broadcast; all rows of a document stay in its task until they are summed
    scored = grams(rows, buckets, "row", *kept_cols).join(F.broadcast(weights), "bucket", "left")
    firsts = [F.first(c).alias(c) for c in kept_cols]
    by_doc = scored.groupBy("row").agg(*firsts, F.sum(F.coalesce("weight", F.lit(0.0))).alias("llr"), F.count("bucket").alias("n_grams"))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    score = F.round(F.col("llr") / F.greatest(F.col("n_grams"), F.lit(1)), 9)
    return by_doc.select(F.col("id").alias(id_col), *kept_cols[1:], failed.alias("base_failed"), score.alias("score"), (~failed & (score >= threshold)).alias("kept"))
