"""Operators on hand-made cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from textloom.functions import metadata as md
from textloom.functions import text as tx
from textloom.operators import chunking, feedback, metrics, records, rerank, retrieval
from textloom.sources import catalogs, feedback_log, pages


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("n", "lengths"), [(0, []), (1, [1]), (420, [420]), (421, [421, 1]), (500, [500, 80]), (501, [500, 81]), (841, [500, 421, 1]), (920, [500, 500, 80])])
def test_chunk_lengths(spark, n, lengths):
    rows = chunking.chunk_pages(spark.createDataFrame([("é" * n,)], "page_text string")).orderBy("paragraph_index").collect()
    assert [len(r["chunk"]) for r in rows] == lengths


def test_chunks_rebuild_the_text(spark):
    text = "".join(chr(97 + i % 26) for i in range(3333))
    rows = chunking.chunk_pages(spark.createDataFrame([(text,)], "page_text string")).orderBy("paragraph_index").collect()
    assert "".join(r["chunk"][:420] for r in rows) == text


def test_chunk_edges(spark):
    with pytest.raises(ValueError):
        chunking.chunk_array(F.lit("x"), 10, 10)
    assert chunking.chunk_pages(spark.createDataFrame([(None,), ("",)], "page_text string")).count() == 0
    assert one(spark, "a😀bc", lambda c: F.element_at(chunking.chunk_array(c, 2, 0), 1)) == "a😀"
    stats = chunking.chunk_stats(spark.createDataFrame([(1, None), (2, "x" * 500)], "k int, page_text string"), "k").orderBy("k").collect()
    assert [tuple(r) for r in stats] == [(1, 0, 0), (2, 2, 580)]


@pytest.mark.parametrize(("raw", "want"), [("  exam-\nple\ta\nb\n\n\n\nc ", "example a b\n\nc"), ("a\r\nb", "a\n\nb"), ("1914-\n1918", "19141918"), ("", ""), (" x\x1c", "x")])
def test_clean_page(spark, raw, want):
    assert one(spark, raw, tx.clean_page) == want


def test_sentences(spark):
    assert one(spark, "One. Two! three? Four.  Five", tx.sentences) == ["One.", "Two! three?", "Four.", "Five"]


def test_paragraphs(spark):
    for text in (None, "", "   "):
        assert one(spark, text, tx.paragraphs) == []
    assert one(spark, "a" * 79 + "\n\n" + "b" * 80, tx.paragraphs) == ["b" * 80]
    # other line ends do not count as blank lines of the original
    assert one(spark, "A" * 90 + "\r\n\r\n" + "b" * 90, tx.paragraphs) == ["A" * 90 + "\n\n" + "b" * 90]
    long = ". ".join(["S" + "x" * 98] * 20)
    groups = one(spark, long, tx.paragraphs)
    assert all(len(g) + 1 >= 600 for g in groups[:-1])


def test_paragraphize(spark):
    text = "Hi\n\nA sufficiently long paragraph\nwith two lines\n\nshort\n\n  \n\nAnother sufficiently long one"
    assert one(spark, text, tx.merged_paragraphs) == ["Hi", "A sufficiently long paragraph with two lines short", "Another sufficiently long one"]
    assert one(spark, None, tx.merged_paragraphs) == []


@pytest.mark.parametrize(
    ("query", "text", "want"),
    [
        ("the Cat of", "The cat of theirs", "<mark>The</mark> <mark>cat</mark> of <mark>the</mark>irs"),
        ("foo mark", "foo", "<<mark>mark</mark>>foo</<mark>mark</mark>>"),
        ("a.b", "a.b axb", "<mark>a.b</mark> axb"),
        ("foo foo", "foo", "<mark><mark>foo</mark></mark>"),
        ("\\E.x", "\\E.x", "<mark>\\E.x</mark>"),
    ],
)
def test_highlight(spark, query, text, want):
    assert one(spark, text, lambda c: tx.highlight(c, F.lit(query))) == want


def test_safe_highlight(spark):
    assert one(spark, "<b>cat", lambda c: tx.highlight(c, F.lit("cat"), escape=True)) == "&lt;b&gt;<mark>cat</mark>"


def test_truncate(spark):
    assert one(spark, "x" * 500, tx.truncate) == "x" * 500
    assert one(spark, "x" * 501, tx.truncate) == "x" * 500 + "..."


def test_metadata(spark):
    info = {"/Title": None, "/Author": " A "}
    got = one(spark, info, lambda c: md.extract_metadata(c), "map<string,string>")
    assert got["title"] == "" and got["author"] == "A" and got["apple_keywords"] == []
    assert one(spark, 1, lambda c: md.normalize_map(F.create_map(F.lit("A"), F.lit("1"), F.lit("a"), F.lit(" 2 "), F.lit("b"), F.lit(None).cast("string"))), "int") == {"a": "2", "b": None}
    for value, want in (("2024-01-05", "2024-01-05T00:00:00"), ("2024-1-5", "2024-01-05T00:00:00"), ("2023-02-29", "2023-02-29"), ("D:20240101", "D:20240101"), ("", ""), ("2024-01-05 ", "2024-01-05 ")):
        assert one(spark, value, md.normalize_date) == want
    text = '{"title":"T","n":0,"b":false,"e":"","nn":null,"el":[],"eo":{},"l":["x",null,"",2],"o":{"z":1},"ln":[null]}'
    got = one(spark, text, lambda c: md.flatten_metadata(F.parse_json(c)))
    assert got == {"meta_title": '"T"', "meta_n": "0", "meta_b": "false", "meta_l": '["x","2"]', "meta_o": '{"z":1}', "meta_ln": "[]"}
    assert one(spark, {"service.name": "s", "k": "v"}, md.scrub_labels, "map<string,string>") == {"k": "v"}
    assert one(spark, {"a": "", "b": "v", "c": None}, md.flatten_strings, "map<string,string>") == {"meta_b": "v"}


def test_records(spark):
    rows = spark.createDataFrame([("", " x ", "f", 1), (None, "  ", "f", 2)], "chunk_text string, chunk string, source_file string, page_number int")
    got = records.sparse_records(rows, ("source_file", "page_number")).collect()
    assert [r["chunk_text"] for r in got] == ["x"]
    assert records.dense_records(rows.drop("chunk_text"), ("source_file", "page_number")).count() == 2
    own = spark.createDataFrame([("given", "t"), (None, "t")], "id string, text string")
    assert {r["id"] for r in records.sparse_records(own, ("text",)).collect()} & {"given"}
    many = spark.range(500).withColumnRenamed("id", "n")
    ids = {r["n"]: r["id"] for r in records.sequential_ids(many, "n").collect()}
    assert ids == {n: f"id_{n + 1}" for n in range(500)}
    assert records.upsert_batches(many.withColumn("g", F.lit("a")), "g", "n").groupBy("batch").count().orderBy("batch").collect()[-1]["count"] == 500 - 5 * 90


def test_index_tables(spark, tmp_path):
    rows = spark.createDataFrame([("1", "t")], "id string, chunk_text string")
    for _ in range(2):
        records.write_index(rows, str(tmp_path / "ix"), "documents-m")
    back = spark.read.parquet(str(tmp_path / "ix"))
    assert [tuple(r) for r in records.index_stats(back, "index_name", "namespace").collect()] == [("documents-m", "__default__", 1)]
    more = spark.createDataFrame([("1", "new"), ("2", "u")], rows.schema)
    records.write_index(more, str(tmp_path / "ix"), "documents-m")
    records.write_index(rows, str(tmp_path / "ix"), "documents-n")
    back = spark.read.parquet(str(tmp_path / "ix"))
    assert sorted(map(tuple, back.collect())) == [("1", "new", "documents-m", "__default__"), ("1", "t", "documents-n", "__default__"), ("2", "u", "documents-m", "__default__")]
    assert pages.ensure_index(spark, "made_now", str(tmp_path / "t"), "id string").count() == 0
    assert pages.ensure_index(spark, "made_now", str(tmp_path / "t"), "id string").columns == ["id"]
    spark.sql("drop table made_now")
    assert catalogs.index_name(None) == catalogs.index_name("llama-text-embed-v2")


def test_hits_and_hybrid(spark):
    hits = spark.createDataFrame([("1", 0.5, {"chunk_text": "", "text": "t", "meta_title": "T", "other": "1", "page_number": "3.0"})], "_id string, _score double, fields map<string,string>")
    got = retrieval.normalize_hits(hits).first()
    assert got["text"] == "t" and got["metadata"] == {"title": "T"} and got["page_number"] == 3 and got["title"] == "T"
    corpus = spark.createDataFrame([(i, f"alpha word{i} beta") for i in range(40)], "id long, chunk_text string")
    queries = spark.createDataFrame([(1, "alpha beta"), (2, "  "), (3, None)], "query_id long, q string")
    got = retrieval.hybrid_search(queries, corpus, 5).groupBy("query_id", "channel").count().collect()
    assert {tuple(r) for r in got} == {(1, "dense", 20), (1, "sparse", 5)}


def test_context_budget(spark):
    rows = [(1, 0, i, "short" if i == 16 else "x" * 500) for i in range(1, 18)]
    df = spark.createDataFrame(rows, "query_id int, channel_ord int, rank int, text string")
    cut = rerank.context_sections(df)
    assert cut.count() == 15 or cut.agg(F.max("total")).first()[0] <= 8000
    assert cut.agg(F.max("ordinal"), F.max("total")).first()[:] == (15, cut.agg(F.max("total")).first()[0])[:2] or cut.count() == 16
    text = rerank.build_context(df).first()["context"]
    assert text.startswith("\n--- Chunk 1 ---\nxxx") and "\n\n--- Chunk 2 ---\n" in text


def test_rerank_ties_and_models(spark):
    df = spark.createDataFrame([(1, r, "same text") for r in range(1, 9)], "query_id int, rank int, text string").withColumn("q", F.lit("same"))
    got = rerank.rerank(df, rerank.lexical_score(F.col("q"), F.col("text"))).orderBy("new_rank").collect()
    assert [r["rank"] for r in got] == [1, 2, 3, 4, 5]
    rerank.register_scorer("length", lambda: lambda q, t: t.str.len().astype(float))
    assert rerank.rerank(df, rerank.model_score("length", F.col("q"), F.col("text"), 4), 3).first()["rerank_score"] == 4.0
    assert rerank.rerank(df.filter("false"), F.lit(1.0)).count() == 0
    said = rerank.answer(spark.createDataFrame([(1, "q", "\n--- Chunk 1 ---\nfirst"), (2, " ", "c")], "query_id int, q string, context string")).orderBy("query_id").collect()
    assert said[0]["answer"] == "first" and said[1]["error"] == "query is empty"
    said = rerank.answer(spark.createDataFrame([(1, "q", "c")], "query_id int, q string, context string"), lambda p: p.str.upper()).first()
    assert said["answer"].startswith("ANSWER")


LOG = [("m1", None, 1), ("m1", None, 0), ("m1", "none", 1), ("m2", None, 1), ("m1", "r1", 1), ("m2", "r1", 0), ("m2", "r1", 0), (None, "r2", 1)]


def test_feedback(spark):
    log = spark.createDataFrame([(i, *row) for i, row in enumerate(LOG)], "position long, dense_model string, rerank_model string, feedback int")
    got = {(r["dense_model"], r["rerank_model"]): (r["precision"], r["hit_rate"]) for r in feedback.group_metrics(log).collect()}
    assert got == {("m1", None): (0.5, 1.0), ("m1", "none"): (1.0, 1.0), ("m2", None): (1.0, 1.0), ("m1", "r1"): (1.0, 1.0), ("m2", "r1"): (0.0, 0.0), ("unknown", "r2"): (1.0, 1.0)}
    assert tuple(feedback.best_model(log, "dense_model", "position").first()) == ("dense_model", "m2", 1.0)
    assert tuple(feedback.best_model(log, "rerank_model", "position").first()) == ("rerank_model", "r2", 1.0)
    assert feedback.best_model(log.filter("false"), "dense_model", "position").count() == 0


def test_feedback_log(spark, tmp_path):
    rows = spark.createDataFrame([("q", "1", 1, "t", "m", None, "client time")], feedback_log.FEEDBACK_SCHEMA)
    feedback_log.append_feedback(rows, str(tmp_path / "log"))
    feedback_log.append_feedback(rows, str(tmp_path / "log"))
    back = feedback_log.read_feedback(spark, str(tmp_path / "log")).collect()
    assert len(back) == 2 and back[0]["timestamp"] != "client time" and back[0]["rerank_model"] is None
    (tmp_path / "bad.json").write_text('{"query":"q","feedback":1}\nnot json\n')
    assert feedback_log.read_feedback(spark, str(tmp_path / "bad.json"), strict=False).filter("_corrupt is not null").collect()[0]["_corrupt"] == "not json"
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        feedback_log.read_feedback(spark, str(tmp_path / "bad.json")).collect()


def test_histogram_quantiles(spark):
    df = spark.createDataFrame([(0.02,), (0.04,), (0.3,), (9.0,)], "value double")
    b = metrics.histogram(df)
    for phi, want in ((0.5, 0.05), (0.75, 0.5), (0.95, 5.0)):
        assert metrics.quantile(b, phi).first()["quantile"] == pytest.approx(want)
    assert metrics.histogram(df.filter("false")).count() == 0


def test_timer_and_export(spark, tmp_path):
    points: list = []
    with metrics.timed(points, "chunking_seconds", status="ok"):
        pass
    with pytest.raises(ZeroDivisionError), metrics.timed(points, "chunking_seconds"):
        1 / 0  # noqa: B018
    assert points[1][3]["status"] == "error"
    metrics.export_points(spark, points, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2
    df, seen = metrics.observed(spark.range(5), "rows", F.count(F.lit(1)).alias("n"))
    df.collect()
    assert seen.get["n"] == 5
    metrics.write_metrics(spark.createDataFrame([("k", 1.0)], "key string, value double"), "run", str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "e")).first()["run_id"] == "run"


def test_page_sources(spark, tmp_path):
    (tmp_path / "b.txt").write_text("one\ftwo")
    (tmp_path / "c.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "d.TXT").write_text("other case")
    files = pages.scan_directory(spark, str(tmp_path), ".txt")
    got = pages.decode_pages(files).orderBy("source_file", "page_number").collect()
    assert [(r["source_file"], r["page_number"], r["page_text"], r["status"], r["error_type"]) for r in got] == [("b.txt", 1, "one", "success", None), ("b.txt", 2, "two", "success", None), ("c.txt", None, None, "error", "UnicodeDecodeError")]
    whole = {r["source_file"]: r["text"] for r in pages.document_texts(pages.decode_pages(files)).collect()}
    assert whole["b.txt"] == "one\ntwo\n"
    spark.dataSource.register(pages.PagesSource)
    assert spark.read.format("pages").option("suffix", ".txt").load(str(tmp_path)).filter("status = 'success'").count() == 2


def test_strict_log_refuses_blank_lines(spark, tmp_path):
    (tmp_path / "log.json").write_text('{"query": "q", "chunk_id": "1", "feedback": 1}\n\n')
    with pytest.raises(Exception, match="blank line"):
        feedback_log.read_feedback(spark, str(tmp_path / "log.json")).collect()


def test_lookup_without_a_hit_keeps_the_result(spark):
    results = spark.createDataFrame([(1, 1, 0.5), (1, 4, 0.25)], "query_id int, ordinal int, rerank_score double")
    hits = spark.createDataFrame([(1, 1, "a", 0.9)], "query_id int, ordinal int, id string, score double")
    got = sorted(map(tuple, rerank.rerank_lookup(results, hits).collect()))
    assert got == [(1, 1, 0.5, "a", 0.9), (1, 4, 0.25, "3", 0.25)]


def test_queries_are_stripped_of_all_blanks(spark):
    raw = spark.createDataFrame([(1, "\thi\u00a0\n", "7\t", "", None), (2, "\t\n ", "5", "", None)], "query_id int, q string, k string, dense_model string, reranker_model string")
    got = retrieval.query_params(raw).collect()
    assert [(r["q"], r["k"]) for r in got] == [("hi", 7)]
    corpus = spark.createDataFrame([("a", "x y")], "id string, chunk_text string")
    assert retrieval.hybrid_search(spark.createDataFrame([(1, "\t\n")], "query_id int, q string"), corpus).count() == 0


def test_trim_takes_what_python_strips(spark):
    from textloom.functions.text import trim_ws

    blanks = [c for c in map(chr, range(0x10000)) if not 0xD800 <= ord(c) < 0xE000 and c.isspace()]
    texts = [c + "a" + c + "b" + c for c in blanks] + ["", " ", "\u200ba"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", trim_ws("t").alias("s"))
    assert all(r["s"] == r["t"].strip() for r in df.collect())


def test_dense_topk_equals_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    x, q = rng.standard_normal((90, 6)), rng.standard_normal((11, 6))
    x[40:60] = x[40]
    corpus = spark.createDataFrame([(f"d{i:02}", v.tolist()) for i, v in enumerate(x)] + [("none", None)], "id string, vector array<float>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id int, vector array<double>")
    got = sorted(map(tuple, retrieval.dense_topk(queries, corpus, 7, block=16, query_block=4).collect()))
    want = []
    for i, v in enumerate(q):
        scores = [(round(float(v @ w.astype(np.float32).astype(float)), 6), f"d{d:02}") for d, w in enumerate(x)]
        want += [(i, r, d, s) for r, (s, d) in enumerate(sorted(scores, key=lambda z: (-z[0], z[1]))[:7], 1)]
    assert [g[:3] for g in got] == [w[:3] for w in want] and [g[3] for g in got] == pytest.approx([w[3] for w in want])


def test_sparse_topk_by_weights_equals_by_joins(spark, monkeypatch):
    corpus = spark.createDataFrame([(i, " ".join(f"t{(i * k) % 13}" for k in range(1, i % 9 + 1)) or None) for i in range(60)], "id int, chunk_text string")
    queries = spark.createDataFrame([(1, "t1 t2 t3"), (2, "T5, t5; t7"), (3, "none of it")], "query_id int, q string")
    small = sorted(map(tuple, retrieval.sparse_topk(queries, corpus, 8).collect()))
    monkeypatch.setattr(retrieval, "MOST_BROADCAST", 1)
    assert small and small == sorted(map(tuple, retrieval.sparse_topk(queries, corpus, 8).collect()))


def test_registered_embedder_is_used(spark):
    import numpy as np

    from textloom.operators import embedding

    embedding.register_embedder("length", lambda: lambda texts: np.array([[len(t), 1.0] for t in texts]))
    corpus = spark.createDataFrame([("a", "xx"), ("b", "xxxx")], "id string, chunk_text string")
    got = retrieval.embedded_topk(spark.createDataFrame([(1, "y")], "query_id int, q string"), corpus, 2, model="length").orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in got] == [("b", 5.0), ("a", 3.0)]


def test_trailing_rate_over_stretches(spark, monkeypatch):
    points = spark.range(500).select(F.timestamp_seconds(F.col("id") * 3).alias("ts"), (F.col("id") % 2).alias("kind"), F.lit(1.0).alias("value"), F.lit("x").alias("part"))
    monkeypatch.setattr(metrics, "STRETCH", 100000)
    want = sorted(map(str, metrics.trailing_rate(points, 30, "kind").collect()))
    monkeypatch.setattr(metrics, "STRETCH", 2)
    assert sorted(map(str, metrics.trailing_rate(points, 30, "kind").collect())) == want and len(want) == 500


def test_dense_channel_takes_small_batches(spark):
    """The vector of a text is the size of the batch in which it came (F1)."""
    import numpy as np

    from textloom.operators import embedding

    embedding.register_embedder("batch", lambda: lambda texts: np.full((len(texts), 1), float(texts.str.len().sum())))
    corpus = spark.range(0, 3000, 1, 1).select("id", F.repeat(F.lit("x "), 3000).alias("chunk_text"))
    got = retrieval.embedded_topk(spark.createDataFrame([(1, "y")], "query_id int, q string"), corpus, 3, model="batch")
    assert 6000 <= got.agg(F.max("score")).first()[0] <= 5 << 20
    # the rows pass through one Python step, embedded and scored
    asked = spark.createDataFrame([(1, "x")], "query_id int, q string")
    plan = retrieval.embedded_topk(asked, corpus, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") + plan.count("EvalPython") == 1
    parts = retrieval.embedded_topk(asked, corpus, 3).collect()
    assert [(r["rank"], r["id"], r["score"]) for r in parts] == [(1, 0, 1.0), (2, 1, 1.0), (3, 2, 1.0)]


def test_many_dense_queries_meet_all_rows(spark, monkeypatch):
    """More queries than are sent to the tasks give the same hits, from several packs and parts."""
    import numpy as np

    rng = np.random.default_rng(7)
    x = rng.integers(-3, 4, (300, 4)).astype(float)
    corpus = spark.createDataFrame([(f"d{i:03}", v.tolist()) for i, v in enumerate(x)] + [("none", None)], "id string, vector array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:37])] + [(99, None)], "query_id int, vector array<double>")
    few = sorted(map(tuple, retrieval.dense_topk(queries, corpus, 6, block=16, query_block=4).collect()))
    monkeypatch.setattr(retrieval, "MOST_BROADCAST", 1)
    many = sorted(map(tuple, retrieval.dense_topk(queries, corpus, 6, block=16, query_block=4).collect()))
    score = {i: sorted((-float(x[i] @ w), f"d{d:03}") for d, w in enumerate(x))[:6] for i in range(37)}
    assert few == many == [(i, r, d, -s) for i in range(37) for r, (s, d) in enumerate(score[i], 1)]


def test_best_rows_are_bounded():
    """Some k rows a query are held, however many are met (F8); NaN is above all, ties go to the smaller id."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    score = rng.integers(0, 500, (5, 200_000)).astype(float)
    score[2, [7, 199_000]], score[3, :] = np.nan, -np.inf
    ids = np.array([f"d{i:06}" for i in rng.permutation(score.shape[1])])
    best, held = retrieval._Best(5, 20), 0
    for low in range(0, score.shape[1], 1000):
        best.add(score[:, low : low + 1000], pa.array(ids[low : low + 1000]))
        held = max(held, best.n)
    assert held <= best.most + 5 * 1000
    got = [x for b in best.batches(pa.array(range(5))) for x in zip(*(c.to_pylist() for c in b.columns))]
    for q in (0, 1, 2, 4):
        order = np.lexsort((ids, -score[q], ~np.isnan(score[q])))[:20]
        assert str([x[1:] for x in got if x[0] == q]) == str([(str(ids[i]), float(score[q, i])) for i in order])
    assert not [x for x in got if x[0] == 3]


def live_pages():
    """A decoder whose page says how many of its pages the worker holds."""

    class Page(str):
        live = 0

        def __del__(self):
            Page.live -= 1

    def decoder(content):
        Page.live += 1
        return [Page(Page.live)], {"size": str(len(content))}

    return decoder


def test_pages_leave_file_by_file(spark, tmp_path):
    for i in range(40):
        (tmp_path / f"{i}.txt").write_text("x")
    got = pages.decode_pages(pages.scan_directory(spark, str(tmp_path), ".txt").coalesce(1), live_pages()).collect()
    assert len(got) == 40 and max(int(r["page_text"]) for r in got) <= 2 and {str(r["info"]) for r in got} == {"{'size': '1'}"}
    long = pages.decode_pages(spark.createDataFrame([("a", bytearray(b"y" * (3 << 19) + b"\f") * 3)], "source_file string, content binary"))
    assert [(r["page_number"], len(r["page_text"])) for r in long.collect()] == [(1, 3 << 19), (2, 3 << 19), (3, 3 << 19), (4, 0)]
