"""Each stage of the corpus pipeline against a brute-force version, on odd rows
with columns of clashing names."""

from __future__ import annotations

import collections
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipe
from textloom.llm import mixing, pii, toxicity

from .helpers import ODD
from .test_set_operators import brute_components

NAMES = ["toxicity", "_kept", "_n", "_mix_id", "_mix_at", "_metadata", "id", "node", "key", "row", "hash", "slot", "before", "at"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in NAMES)


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), *NAMES) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    words = [f"w{k}" for k in range(200)]
    base = [rng.choice(words) for _ in range(80)]
    out = [*ODD, (3, "again " * 9 + "three", "a"), (5, "again " * 9 + "three", "a"), (5, "a text of its own with id five", "b"), (None, "again " * 9 + "three", "a"), (None, "alone without an id of any kind", None)]
    for k in range(20):
        words_ = list(base)
        words_[rng.randrange(80)] = "x"
        out.append((100 - k, " ".join(words_), rng.choice(["a", "b", None])))
    return [*out, (200, "write to jane@example.org or call +1 555 123 4567", "a"), (201, "ip 10.0.0.1", "\\N")]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """``labels`` and ``documents`` of the smallest tables, for the classifier."""
    return "/root/testdata/sf0.001"


def plain(df):
    return sorted(map(str, df.collect()))


def test_drop_toxic(spark, rows, sf_dir):
    docs = table(spark, rows)
    got = pipe.drop_toxic(spark, docs, sf_dir)
    assert got.columns == docs.columns
    scorer = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    want = [r for r in rows if scorer.score(r[1] or "") < pipe.TOXIC_AT]
    assert plain(got) == plain(table(spark, want))
    assert pipe.drop_toxic(spark, docs.limit(0), sf_dir).count() == 0


def test_drop_near_copies(spark, rows, sf_dir):
    docs = table(spark, rows)
    got = pipe.drop_near_copies(spark, docs, sf_dir)
    assert got.columns == docs.columns
    # numbers stand for (no id, id, text), in the order that decides who stays
    distinct = sorted({(i is None, i or 0, t is not None, t or "") for i, t, _ in rows})
    number = {k: n for n, k in enumerate(distinct)}
    named = [(number[i is None, i or 0, t is not None, t or ""], t) for i, t, _ in rows]
    groups = collections.defaultdict(set)
    for n, _, c in brute_components(named):
        groups[c].add(n)
    found = collections.Counter(number[r["doc_id"] is None, r["doc_id"] or 0, r["text"] is not None, r["text"] or ""] for r in got.collect())
    assert set(found.values()) == {1}
    for members in groups.values():
        kept = [n for n in members if n in found]
        assert len(kept) == 1 and distinct[kept[0]][:2] == distinct[min(members)][:2]
    assert sum(found.values()) == len(groups)
    assert pipe.drop_near_copies(spark, docs.limit(0), sf_dir).count() == 0


def test_no_text_is_lost_where_ids_repeat(spark, sf_dir):
    copy, own = "one text that occurs twice in here", "another text which has no copy at all"
    got = pipe.drop_near_copies(spark, table(spark, [(3, copy, "a"), (5, copy, "a"), (5, own, "a")]), sf_dir)
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == [(3, copy), (5, own)]


def test_redact_pii(spark, rows, sf_dir):
    docs = table(spark, rows)
    got = pipe.redact_pii(spark, docs, sf_dir)
    assert got.columns == docs.columns
    want = [(i, None if t is None else pii.redact(t), s) for i, t, s in rows]
    assert plain(got) == plain(table(spark, want))
    texts = {r["doc_id"]: r["text"] for r in got.collect()}
    assert texts[200] == "write to <email> or call <phone>" and texts[201] == "ip <ip>"


def test_mix_sources(spark, rows, sf_dir, monkeypatch):
    docs = table(spark, rows)
    got = pipe.mix_sources(spark, docs, sf_dir)
    assert got.columns == docs.columns and plain(got) == plain(docs)
    slots = {(r["source"]) for r in mixing.mix(docs).collect()}
    assert {None, "\\N", "a", "b"} <= slots
    assert pipe.mix_sources(spark, docs.limit(0), sf_dir).count() == 0


def test_pack_tokens(spark, rows, sf_dir, tmp_path):
    docs = table(spark, rows)
    docs.write.parquet(str(tmp_path / "d"))
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sizes = collections.Counter((i, len(library.encode(t or "", add_special_tokens=False).ids) + 1) for i, t, _ in rows)
    got = pipe.pack_tokens(spark, spark.read.parquet(str(tmp_path / "d")), sf_dir).collect()
    assert collections.Counter((r["doc_id"], r["doc_tokens"]) for r in got if r["start"] == 0) == sizes
    at = 0
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["sequence_id"] * 2048 + r["offset"] == at
        at += r["length"]
    assert at == sum(n * k for (_, n), k in sizes.items())


def test_run_is_its_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(pipe.STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(pipe.STAGES) - 1:
            assert out.columns == docs.columns
            out.write.parquet(str(tmp_path / str(k)))
            docs = spark.read.parquet(str(tmp_path / str(k)))
    total = out.groupBy().sum("length").first()[0]
    assert pipe.run(spark, sf_dir).groupBy().sum("length").first()[0] == total
