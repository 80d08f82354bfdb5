"""Token counts, packing, PII and toxicity against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from textloom.llm import packing, pii, token_counts, toxicity

from .helpers import DOCS, ODD, docs

MODEL = public_tokenizers.path("piece_bpe_32k.model")
JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def texts_like(alphabet: str, n: int, most: int) -> list[str]:
    rng = random.Random(n)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, most))) for _ in range(n)]


# ---- token counts


def test_merges_equal_the_library():
    counter = token_counts.PieceCounter(MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert counter.free_units
    for text in texts_like(" ab e\n\t▁<s></s>日本😀é \x00zthe  in", 3000, 40):
        assert counter.count(text) == len(library.encode(text)), repr(text)
        whole = token_counts.MARK + text.replace(" ", token_counts.MARK)
        assert not text or counter.unit(whole) == counter.count(text)


def test_count_tokens_odd_rows(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = sorted(map(tuple, token_counts.count_tokens(docs(spark, ODD), MODEL).collect()), key=str)
    want = sorted([(i, len((t or "").encode()), n := len(library.encode(t or "")), n > 4096) for i, t, _ in ODD], key=str)
    assert got == want
    assert token_counts.count_tokens(spark.createDataFrame([], DOCS), MODEL).count() == 0


# ---- packing


def test_ids_equal_the_library():
    ids = packing.ids_for(JSON, RANKS)
    for text in texts_like(" ab e\n\té\r'S1 23<|endoftext|>the  inüÑ.!!日 ", 2000, 40):
        assert ids.ids(text) == ids.exact.encode(text, add_special_tokens=False).ids, repr(text)


def test_both_libraries_agree_on_the_whole_table():
    """The shorter way is taken only where it gives the library's ids."""
    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column(0).to_pylist()
    ids = packing.ids_for(JSON, RANKS)
    sure = [t for t in texts if t and ids.sure(t)]
    assert len(sure) > len(texts) / 2
    for k in range(0, len(sure), 500):
        for text, found in zip(sure[k : k + 500], ids.exact.encode_batch(sure[k : k + 500], add_special_tokens=False)):
            assert ids.fast.encode_ordinary(text) == found.ids


def test_packing_with_a_column_named_like_the_files(spark, tmp_path):
    rows = [(i, "same text", ("f", 3)) for i in range(4)]
    table = spark.createDataFrame(rows, "doc_id long, text string, _metadata struct<file_path: string, row_index: long>")
    table.coalesce(1).write.parquet(str(tmp_path / "d"))
    for df in (table, spark.read.parquet(str(tmp_path / "d"))):
        got = packing.pack(df, JSON, RANKS, 2048).collect()
        assert len({(r["sequence_id"], r["offset"]) for r in got}) == 4


@pytest.mark.parametrize("window", [7, 2048])
def test_packing_loses_nothing(spark, window):
    library = Tokenizer.from_file(JSON)
    table = docs(spark, ODD)
    rows = packing.pack(table, JSON, RANKS, window).collect()
    stream = sorted(rows, key=lambda r: (r["sequence_id"], r["offset"]))
    at = 0
    for r in stream:  # gapless, in full windows
        assert r["sequence_id"] * window + r["offset"] == at
        assert r["offset"] + r["length"] <= window
        at += r["length"]
    ids = {t: [*library.encode(t or "", add_special_tokens=False).ids, 1] for _, t, _ in ODD}
    assert at == sum(len(ids[t]) for _, t, _ in ODD)
    pieces = sorted((str(r["doc_id"]), r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows)
    crc = {str(i): ids[t] for i, t, _ in ODD}
    for i, start, length, value, total in pieces:
        assert total == len(crc[i])
        assert value == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in crc[i][start : start + length]))
    assert packing.pack(spark.createDataFrame([], DOCS), JSON, RANKS).count() == 0


def test_packing_follows_files(spark, tmp_path):
    rows = [(i, f"text number {i} " * (i % 5), "a") for i in range(200)]
    docs(spark, rows).repartitionByRange(5, "doc_id").sortWithinPartitions("doc_id").write.parquet(str(tmp_path / "d"))
    got = packing.pack(spark.read.parquet(str(tmp_path / "d")), JSON, RANKS, 64).orderBy("sequence_id", "offset").collect()
    order = [r["doc_id"] for r in got if r["start"] == 0]
    assert order == list(range(200))


# ---- PII

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def test_plain_spans_equal_the_patterns():
    for text in texts_like("a1.@-+_ 2%5.@", 20000, 30):
        assert pii.emails(text) == [m.span() for m in EMAIL.finditer(text)]
        assert pii.ips(text) == [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]


CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def doubled(digits: str) -> int:
    """The check sum of a card number, from its definition."""
    return sum(sum(divmod(int(d) * (2 if k % 2 else 1), 10)) for k, d in enumerate(digits[::-1])) % 10


def test_cards_and_phones_equal_the_patterns():
    digits = lambda t: re.sub("[^0-9]", "", t)
    seen = 0
    for text in [*texts_like("0123456789" * 3 + " -+x", 20000, 40), *texts_like("0123456789 -+(). x", 20000, 40)]:
        cards = [m.span() for m in CARD.finditer(text) if 13 <= len(digits(m[0])) <= 19 and doubled(digits(m[0])) == 0]
        seen += len(cards)
        assert pii.cards(text) == cards
        assert pii.phones(text) == [m.span() for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    assert seen > 100


@pytest.mark.parametrize(
    ("text", "kind", "shown"),
    [
        ("mail john.doe [at] example (dot) com now", "email", "john.doe [at] example (dot) com"),
        ("write jane at mail dot example dot org please", "email", "jane at mail dot example dot org"),
        ("x jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
        ("call plus one five five five one two three four five six seven", "phone", "plus one five five five one two three four five six seven"),
        ("ip one nine two dot one six eight dot one dot two five", "ip", "one nine two dot one six eight dot one dot two five"),
        ("４１１１ １１１１ １１１１ １１１１", "card", "４１１１ １１１１ １１１１ １１１１"),
        ("escribe a juan arroba ejemplo punto es ya", "email", "juan arroba ejemplo punto es"),
        ("escribe a juan arroba ejemplo.es ya", "email", "juan arroba ejemplo.es"),
        ("an max.muster (ät) beispiel punkt de bitte", "email", "max.muster (ät) beispiel punkt de"),
        ("to jane [a t] example [d o t] org", "email", "jane [a t] example [d o t] org"),
        ("to jane_doe_at_example_dot_org", "email", "jane_doe_at_example_dot_org"),
        ("to jane&#64;example&#46;org or", "email", "jane&#64;example&#46;org"),
        ("to jane&commat;example.org or", "email", "jane&commat;example.org"),
        ("llame al más cinco cinco cinco uno dos tres cuatro cinco seis siete", "phone", "más cinco cinco cinco uno dos tres cuatro cinco seis siete"),
        ("unter plus vier neun drei null eins zwei drei vier fünf sechs", "phone", "plus vier neun drei null eins zwei drei vier fünf sechs"),
        ("au plus trois trois un deux trois quatre cinq six sept huit", "phone", "plus trois trois un deux trois quatre cinq six sept huit"),
        ("emoji 😀 j​ane@example.org", "email", "j​ane@example.org"),
    ],
)
def test_disguised_spans_map_back(text, kind, shown):
    base, more = pii.find(text)
    found = [(k, text[a:b]) for k, a, b in more] + [(k, text[a:b]) for k in base for a, b in base[k]]
    assert (kind, shown) in found
    assert shown not in pii.redact(text)


@pytest.mark.parametrize("text", ["meet at example.com today", "five or six of them at two dots", "read one two three", "a.b.c.d 1.2.3", "4111 1111 1111 1112", "", "@", "+", "1.2.3.999", "uno dos tres", "eins zwei drei", "look at that point in time", "un deux trois un deux", "zwei punkt eins"])
def test_clean_texts_stay(text):
    base, more = pii.find(text)
    assert not more and not any(base.values()) and pii.redact(text) == text


def test_long_texts_take_linear_time():
    for text in ("a" * 300000 + "@", "1" * 300000, "one " * 50000, "a dot " * 50000, "a@" * 100000, "x [at] " * 30000, "1." * 100000, "_at_" * 50000, "a_" * 100000 + "@", "uno dos " * 40000, "&#64;" * 50000, "a punto " * 50000):
        pii.find(text)


def test_find_pii_odd_rows(spark):
    rows = [*ODD, (9, "a@b.co 10.0.0.1 x 4111 1111 1111 1111 y +1 (115) 555-9688", "a")]
    got = {r["doc_id"]: r for r in pii.find_pii(docs(spark, rows)).collect()}
    assert got[1]["spans"] == "" and got[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    nine = got[9]
    assert (nine["n_email"], nine["n_ip"], nine["n_card"], nine["n_phone"]) == (1, 1, 1, 1)
    assert nine["spans"].startswith("email:0:6,ip:7:15,card:")
    assert nine["base_sha256"] == hashlib.sha256(nine["spans"].encode()).hexdigest()
    assert pii.find_pii(docs(spark, rows)).count() == len(rows)
    assert pii.find_pii(spark.createDataFrame([], DOCS)).count() == 0
    table = docs(spark, rows)
    clean = pii.redact_texts(table)
    assert clean.columns == table.columns
    texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in clean.collect()}
    assert texts[9] == ("<email> <ip> x <card> y <phone>", 31) and texts[1] == (None, None)


# ---- toxicity


@pytest.fixture(scope="module")
def scorer():
    rng = random.Random(4)
    syllables = ["er", "an", "the", "on", "re", "he", "in", "ed", "nd", "ha"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    rows = []
    for k in range(600):
        words = [word() for _ in range(rng.randint(10, 60))]
        toxic = k % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "moron", "stupid", "trash"]))
        rows.append((" ".join(words), int(toxic)))
    return toxicity.learn(rows)


@pytest.mark.parametrize("word", ["idiot", "1d10t", "i d i o t", "IDIOOOOT", "m.o.r.o.n", "st*pid", "tr@sh!!", "$tupid", "id io t", "t r @ s h", "iddiott", "m..........o..........r..........o..........n", "st**id", "m o-r 0 n"])
def test_disguises_are_seen(scorer, word):
    assert scorer.score(f"the on {word} er an {word} he") >= 0.7


@pytest.mark.parametrize("text", ["", "the on er an he", "on%%% he&&& the###", "call 10.0.0.1 or 4111", "token b44e15e09fd3", "a b c d e f", "is it on or in an of", "hee**hee an the"])
def test_clean_texts_score_low(scorer, text):
    assert scorer.score(text) < 0.3


def test_decode_equals_brute_force(scorer):
    model = scorer.model
    for word in ("1d1ot", "m0r*n", "tra$h", "heeee", "m**on", "id io t", "moor* n", "s**p 1d", "é**ñ", "aa b"):
        places = toxicity.lattice(word)
        best = None
        paths = [("", 0.0)]
        for choices in places:
            paths = [(t + c, s + cost) for t, s in paths for c, cost in choices]
        for text, cost in paths:
            parts = ["^^" + part + "$" for part in text.split(" ")]
            total = cost + sum(model.log(p[k - 2], p[k - 1], p[k]) for p in parts for k in range(2, len(p)))
            best = max(best or (total, text), (total, text))
        assert toxicity.decode(word, model) == best[1]
        assert model.dense(places) == best[1]


def test_long_disguises_decode_like_short_ones(scorer, monkeypatch):
    monkeypatch.setattr(toxicity, "STRETCH", 4)
    for word in ("m" + "*" * 9 + "n", "i*d**i o*t" * 2):
        places = toxicity.lattice(word)
        small = scorer.model.dense(places)
        monkeypatch.setattr(toxicity, "STRETCH", 1000)
        assert scorer.model.dense(places) == small
        monkeypatch.setattr(toxicity, "STRETCH", 4)
    for word in ("1d" * 20000, "a" + "-" * 50000 + "b", "a " * 30000, "x*" * 2000, "a" + "*" * 2000):
        scorer.score(word)


def test_toxicity_odd_rows(spark):
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(1, 9)] + [(None, 1, "x"), (7, None, "x")], "doc_id long, toxic int, text string")
    for rows in (ODD, []):
        out = toxicity.toxicity(docs(spark, rows), labels).collect()
        assert len(out) == len(rows)
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out)
        assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    kept = toxicity.training_rows(docs(spark, [*ODD, (7, "another text", "a")]), labels, 1, 3, 10, 10, 20, "doc_id", "text", "toxic")
    assert len(kept) <= 8 and sum(len((t or "").encode()) for t, _ in kept) <= 20  # a repeated id counts once
    named = docs(spark, ODD).withColumn("toxicity", toxicity.score_column(toxicity.learn([])))
    assert named.count() == len(ODD)
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.toxicity(docs(spark, ODD), empty).filter("predicted = 0").count() == len(ODD)


def test_all_labelled_texts_are_learned(spark):
    """2,100 toxic rows; those that come last by the hash of their id have a word of their own."""
    rng = random.Random(7)
    ids = [i for i in range(9000) if zlib.crc32(str(i).encode()) % 3 != 1][:4200]
    marked = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "doc_id long, toxic int")
    order = marked.filter("toxic = 1").selectExpr("doc_id", "xxhash64(doc_id) as h").orderBy("h").collect()
    late = {r["doc_id"] for r in order[2000:]}
    assert len(late) == 100
    words = ["".join(rng.choice("aeiou") + rng.choice("bdlmnrst") for _ in range(3)) for _ in range(300)]
    rows = []
    for k, i in enumerate(ids):
        mark = "" if k % 2 == 0 else " zorgblat" if i in late else " vexquim"
        rows.append((i, " ".join(rng.choice(words) for _ in range(12)) + mark, "a"))
    table = docs(spark, rows)
    scorer = toxicity.fit(table, marked)
    assert scorer.score("zorgblat") >= 0.7 and scorer.score("vexquim") >= 0.7 and scorer.score(words[0]) < 0.3


def test_fit_equals_learning_in_memory(spark, monkeypatch):
    """Families larger than a task's share, halves and sums as in memory."""
    monkeypatch.setattr(toxicity, "UNIT", 2)
    rng = random.Random(9)
    words = ["".join(rng.choice("aeiou") + rng.choice("bdlmnrst") for _ in range(3)) for _ in range(200)]
    rows, marks = [], []
    copied = [rng.choice(words) for _ in range(60)]
    for i in range(600):
        own = list(copied) if i % 9 == 0 else [rng.choice(words) for _ in range(rng.randint(0, 30))]
        if i % 9 == 0:
            own[rng.randrange(60)] = rng.choice(words)
        if i % 4 == 0:
            own.insert(rng.randrange(len(own) + 1), rng.choice(["1d10t", "idiot", "m.o.r.o.n", "moron"]))
        rows.append((i, " ".join(own) if i != 7 else None, "a"))
        marks.append((i, int(i % 4 == 0)))
    rows += [(1000 + i, rows[4][1], "a") for i in range(5)]  # copies
    marks += [(1000 + i, 1) for i in range(5)]
    label = dict(marks)
    used = [(t, label[i]) for i, t, _ in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    there, here = toxicity.fit(docs(spark, rows), spark.createDataFrame(marks, "doc_id long, toxic int")), toxicity.learn(used)
    assert there.model.tri == here.model.tri
    assert there.weights == here.weights and here.weights
    assert there.beta == pytest.approx(here.beta, abs=1e-6)


def test_only_what_may_carry_weight_is_decoded(scorer, monkeypatch):
    """Words none of whose readings has a weight are not decoded, all others as before."""
    mine = toxicity.Scorer(scorer.model, {**scorer.weights, "^anno": 3.0, "heen$": 3.0, "=aan": 4.0}, scorer.beta)
    rng = random.Random(11)
    parts = ["id", "iot", "i", "d", "o", "t", "m", "oo", "ron", "st", "uu", "pid", "tr", "a", "sh", "an", "nn", "hee", "en", "0", "1", "-", ".", "*", "%", "\u00b2", "e\u0301", "(", "\u00e9"]
    tokens = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 6))) for _ in range(4000)]
    tokens += ["iidiiot", "trashh", "mooooron", "aann", "annnooxx", "xxhheeen", "annxx", "", "a\u00b2\u00b2n"]
    runs = [" ".join(rng.choice(["i", "di", "ot", "d", "o", "t", "m.", "r", "on", "a", "-n", "aa", "1", "%", "'", "st", "u", "*"]) for _ in range(rng.randint(2, 7))) for _ in range(2000)]
    plain = [max((mine.weights.get(s, 0.0) for w in toxicity.restore(t, mine.model) for s in toxicity.shapes(w)), default=0.0) for t in tokens + runs]
    assert [mine.weigh(t) for t in tokens + runs] == plain and sum(map(bool, plain)) > 10
    decoded = []
    whole = toxicity.decode
    monkeypatch.setattr(toxicity, "decode", lambda word, model: decoded.append(word) or whole(word, model))
    text = "hee annd therre onn, reedd inn th he on ed an"
    assert toxicity.Scorer(scorer.model, scorer.weights, scorer.beta).score(text) < 0.3 and not decoded
    assert toxicity.Scorer(scorer.model, scorer.weights, scorer.beta).score("hee idiiot") >= 0.7 and decoded == ["idiiot"]


def test_shapes_that_fail_early_are_not_counted_on(spark, monkeypatch):
    """Of some thousand shapes all clean families are asked for those that can still pass; the weights stay."""
    marked = []
    count = toxicity.count_shapes

    def spy(texts, model, wanted, *more):
        marked.append(None if wanted is None else int(np.unpackbits(wanted).sum()))
        return count(texts, model, wanted, *more)

    monkeypatch.setattr(toxicity, "count_shapes", spy)
    rng = random.Random(12)
    words = ["".join(rng.choice("aeiou") + rng.choice("bdlmnrst") for _ in range(3)) for _ in range(300)]
    rows = [" ".join([rng.choice(words) for _ in range(80)] + (["moron", "iddiot"][k % 20 // 10 : k % 20 // 10 + 1] if k % 10 == 0 else [])) for k in range(2500)]
    marks = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(2500)], "doc_id long, toxic int")
    there = toxicity.fit(docs(spark, [(i, t, "a") for i, t in enumerate(rows)]), marks)
    here = toxicity.learn([(t, int(i % 10 == 0)) for i, t in enumerate(rows) if zlib.crc32(str(i).encode()) % 3 != 1])
    assert there.weights == here.weights and here.weights and there.beta == pytest.approx(here.beta, abs=1e-6)
    assert marked[1] > 1000 and marked[-1] < marked[1] / 5


def test_held_out_accuracy(spark):
    base = "/root/testdata/sf0.1"
    table, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    out = toxicity.toxicity(table, labels).join(labels, "doc_id").filter("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in out}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.75
    assert n.get((0, 1), 0) / n[0, 0] < 0.01
