"""Small tables with every odd case, shared by the operators' tests."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, id string, node long"


def docs(spark, rows):
    """``documents`` with extra columns whose names clash with internal ones."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), 1.0, "x", 7) for i, t, s in rows], DOCS)


ODD = [(1, None, "a"), (2, "", "a"), (3, " \t\n ", None), (4, "One two", "b"), (4, "One two", "b"), (None, "null id text of six words", "b"), (5, "word " * 5000, "c"), (6, "x" * 30000, "c"), (7, "tie tie tie", "a"), (8, "tie tie tie", "a")]
