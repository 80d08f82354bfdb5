"""WARC, neighbours, similarity join, mixing, quality, language model."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from textloom.llm import hmm, mixing, neighbours, ngram_join, quality, warc

from .helpers import DOCS, ODD, docs

# ---- WARC


def test_framing_round_trips():
    rng = random.Random(1)
    for n in (0, 1, 15, 16, 17, 4096, 4097, 20000):
        payload = rng.randbytes(n)
        assert warc.unchunked(warc.chunked(payload, 16)) == payload
        assert warc.http_payload(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc.chunked(payload)) == payload
    assert warc.unchunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    for broken in (b"", b"5\r\nabc", b"zz\r\n", b"3\r\nabcd\r\n0\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(broken)


def test_segments_are_put_in_order_and_verified():
    assert warc.whole([(3, 9, b"ghi"), (1, None, b"abc"), (2, None, b"def"), (2, None, b"def")]) == b"abcdefghi"
    for broken in ([(1, None, b"a"), (3, 3, b"c")], [(1, None, b"a"), (2, 5, b"b")], [(2, 2, b"b")]):
        with pytest.raises(ValueError):
            warc.whole(broken)


def test_round_trip(spark):
    big = "<p>é\r\n\r\nWARC/1.1\r\n</p>" * 3000
    rows = [(1, "http://a/", big, 0), (2, "http://b/\r\nX: y", big, 0), (3, None, big, 0), (3, None, big, 0), (4, "u", None, 0), (5, "u", "", 0), (6, "u", "short", 0), (7, "u", "short", 0), (None, "u", "n" * 2000, 0), (9, "u", "n" * 2000, 0)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    want = []
    for p, _, html, _ in rows:
        raw = (html or "").encode()
        same = [q for q, _, h, _ in rows if (h or "") == (html or "") and len(raw) >= 1000 and q is not None]
        lead = max(same) if same else p
        again = len(raw) >= 1000 and p != lead
        want.append((p, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", lead if again else None))
    key = lambda r: tuple(map(str, r))
    assert sorted(want, key=key) == sorted((tuple(r) for r in warc.round_trip(table, segment_bytes=4000).drop("error").collect()), key=key)
    assert warc.round_trip(table, segment_bytes=4000).filter("error is not null").count() == 0
    assert warc.round_trip(spark.createDataFrame([], table.schema)).count() == 0


# ---- neighbours


def brute_nearest(ids, x, every, k):
    out = []
    for i in [j for j in range(len(ids)) if ids[j] % every == 0]:
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != ids[i]][:k]
        out += [(int(ids[i]), r, int(ids[j]), float(d[j])) for r, j in enumerate(order, 1)]
    return sorted(out)


@pytest.mark.parametrize("dim", [3, 64, 70])
def test_search_recall(spark, dim):
    rng = np.random.default_rng(dim)
    x = rng.standard_normal((900, dim)).astype(np.float32).astype(float)
    x[100:400] = x[100]  # one very common vector
    rows = [(i, v.tolist(), "c") for i, v in enumerate(x)]
    got = sorted(map(tuple, neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string"), every=50, block=256, query_block=7).collect()))
    want = brute_nearest(np.arange(900), x, 50, 10)
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want])
    assert len({g[:3] for g in got} & {w[:3] for w in want}) / len(want) >= 0.99


def test_search_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, None]), (7, [1.0]), (None, [1.0, 1.0]), (100, [1.0, 0.0]), (8, [1.0, 0.0]), (8, [1.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, neighbours.search(table).collect()))
    assert [g[:3] for g in got] == [(0, 1, 8), (0, 2, 8), (0, 3, 100), (0, 4, 1), (100, 1, 0), (100, 2, 8), (100, 3, 8), (100, 4, 1)]
    # a repeated id: each of its rows is a query, and a candidate of the other
    again = table.unionByName(spark.createDataFrame([(100, [0.0, 1.0])], table.schema))
    got = sorted(map(tuple, neighbours.search(again, k=3).filter("query_id = 100").collect()))
    assert got == [(100, 1, 0, 0.0), (100, 1, 1, 0.0), (100, 2, 0, math.sqrt(2)), (100, 2, 8, 0.0), (100, 3, 8, 0.0), (100, 3, 8, math.sqrt(2))]
    assert neighbours.search(table.filter("vec_id is null")).count() == 0
    assert neighbours.search(table.filter("false")).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((2000, 64))
    mean, turn = x.mean(axis=0), neighbours.rotation(64)
    codes, length, own = neighbours.encode(x, mean, turn)
    ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
    broken = 0
    for q in x[:50]:
        estimate, least = neighbours.Query.of(q, mean, turn).bounds(codes, ones, length, own)
        true = ((x - q) ** 2).sum(axis=1)
        broken += int((least > true + 1e-9).sum())
        assert abs((estimate - true).mean()) < 3
    assert broken / (50 * 2000) < 0.01


# ---- similarity join


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset() if not w else frozenset([tuple(w)]) if len(w) < 5 else frozenset(zip(w, w[1:], w[2:], w[3:], w[4:])))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(sets[i]), (least.get(root(i)) if sets[i] else d)) for i, (d, _) in enumerate(rows)), key=str)


def test_differing_bits_bound_the_difference():
    rng = np.random.default_rng(9)
    for _ in range(300):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 400), dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.random()], rng.integers(0, 2**63, rng.integers(0, 200), dtype=np.uint64)]))
        if len(b):
            true = len(np.setxor1d(a, b))
            found = ngram_join.differing(ngram_join.parities(a), ngram_join.parities(b))
            assert found <= true and (found - true) % 2 == 0
            assert ngram_join.differing(ngram_join.parities(b), ngram_join.parities(a)) == found


def test_links_exactly_on_the_bound(spark):
    """Sets of n share 6/7 of their shingles where 100 * common = 75 * union."""
    rows = []
    for k, (n, common) in enumerate([(28, 24), (7, 6), (14, 12), (140, 120), (140, 119), (14, 11), (350, 300), (350, 299)]):
        words = [f"a{k}x{i}" for i in range(n + 4)]
        rows.append((2 * k, " ".join(words)))  # n shingles; the other set has `common` of them
        rows.append((2 * k + 1, " ".join(words[: common + 4] + [f"b{k}x{i}" for i in range(n - common)])))
    assert sorted(map(tuple, ngram_join.join_similar(docs(spark, [(i, t, "s") for i, t in rows])).collect()), key=str) == brute_components(rows)
    linked = {c for _, _, c in brute_components(rows) if [c2 for _, _, c2 in brute_components(rows)].count(c) > 1}
    assert linked == {0, 2, 4, 6, 12}


@pytest.mark.parametrize("seed", [1, 2])
def test_join_equals_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(ngram_join, "GROUP_SETS", 16)
    if seed == 2:  # most tokens go the way of frequent and of hot ones
        monkeypatch.setattr(ngram_join, "SMALL_BUCKET", 3)
        monkeypatch.setattr(ngram_join, "HOT_TOKEN", 8)
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(10):
        base = [rng.choice(words) for _ in range(rng.choice([6, 30, 80, 200]))]
        for _ in range(rng.choice([1, 3, 40, 90])):
            b = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 5])):
                b[rng.randrange(len(b))] = rng.choice(words)
            rows.append((len(rows), " ".join(b)))
    passage = " ".join(rng.choice(words) for _ in range(60))
    rows += [(1000 + k, passage + " " + " ".join(rng.choice(words) for _ in range(rng.choice([5, 15, 30, 120])))) for k in range(60)]
    rows += [(2000, ""), (2001, None), (2002, "A b c"), (2003, "a B c"), (2004, "a b d"), (2004, "a b d"), (None, "a b d"), (None, "only here")]
    table = docs(spark, [(i, t, "s") for i, t in rows])
    got = sorted(map(tuple, ngram_join.join_similar(table).collect()), key=str)
    assert got == brute_components(rows)


def test_join_odd_rows(spark):
    got = sorted(map(tuple, ngram_join.join_similar(docs(spark, ODD)).collect()), key=str)
    assert got == brute_components([(i, t) for i, t, _ in ODD])
    assert ngram_join.join_similar(spark.createDataFrame([], DOCS)).count() == 0


def test_contract_finds_long_paths(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r["node"]: r["root"] for r in ngram_join.contract(spark.createDataFrame(path, "a long, b long"), "t").collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


# ---- mixing


def slots_of(rows, period):
    return {p["start"] + k // p["quanta"] * period + p["slots"][k % p["quanta"]]: (p["source"], p["first"] + k, p) for p in rows for k in range(p["next"] - p["first"])}


def test_plan_equals_simulated_schedule():
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randint(1, 8)
        weights, blocks = {f"s{i}": rng.random() for i in range(n)}, {f"s{i}": rng.randint(0, 60) for i in range(n)}
        period = rng.choice([20, 50, 100])
        rows = mixing.plan(weights, blocks, period)
        seen = slots_of(rows, period)
        assert sorted(seen) == list(range(sum(blocks.values())))
        for s in blocks:
            assert [k for _, (x, k, _) in sorted(seen.items()) if x == s] == list(range(blocks[s]))
        for t, (_, k, p) in sorted(seen.items()):
            rest = k - p["first"]
            assert p["start"] + rest * period // p["quanta"] <= t < p["start"] + -(-(rest + 1) * period // p["quanta"])
        for phase in {p["phase"] for p in rows}:
            own = [p for p in rows if p["phase"] == phase]
            start, length = own[0]["start"], sum(p["next"] - p["first"] for p in own)
            count: collections.Counter = collections.Counter()
            for t in range(length):
                count[seen[start + t][0]] += 1
                assert all(abs(count[p["source"]] - (t + 1) * p["quanta"] / period) < 1 for p in own)


def slot_by_slot(weights, blocks, period):
    """The schedule as the definition has it: in each slot, of the blocks that
    are released, the one that is due first."""
    left, done, out, start = {s: n for s, n in blocks.items() if n}, dict.fromkeys(blocks, 0), [], 0
    while left:
        live = {s: weights[s] for s in left if weights[s] > 0} or dict.fromkeys(left, 1.0)
        parts = mixing.quanta(live, period)
        k, t = dict.fromkeys(live, 0), 0
        while all(left.get(s, 0) for s in live):
            ready = [(-(-(k[s] + 1) * period // parts[s]), s) for s in live if k[s] * period // parts[s] <= t]
            _, s = min(ready)
            out.append((s, done[s]))
            k[s], done[s], left[s], t = k[s] + 1, done[s] + 1, left[s] - 1, t + 1
        start += t
        left = {s: n for s, n in left.items() if n}
    return out


def test_plan_equals_the_slot_by_slot_schedule():
    rng = random.Random(6)
    for _ in range(60):
        n = rng.randint(1, 7)
        weights, blocks = {f"s{i}": rng.choice([0.0, rng.random()]) for i in range(n)}, {f"s{i}": rng.randint(0, 70) for i in range(n)}
        seen = slots_of(mixing.plan(weights, blocks, 40), 40)
        assert [seen[t][:2] for t in sorted(seen)] == slot_by_slot(weights, blocks, 40)


def test_quanta():
    assert mixing.quanta({"a": 1.0, "b": 3.0}, 100) == {"a": 25, "b": 75}
    assert mixing.quanta({"a": 0.0, "b": 1.0}, 10) == {"a": 1, "b": 9}
    with pytest.raises(ValueError):
        mixing.quanta({"a": -1.0, "b": 3.0}, 10)


def test_mix_keeps_all_rows(spark):
    rows = [*ODD, *((100 + i, "t" * (i % 50), f"s{i % 7 and 0}") for i in range(300))]
    table = docs(spark, rows)
    out = mixing.mix(table, block_bytes=500, period=40).collect()
    assert len(out) == len(rows)
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in out)
    by = collections.defaultdict(list)
    for r in out:
        by[r["source"]].append((r["before"], r["size"], r["block"]))
    for parts in by.values():  # prefix sums without gaps
        at = 0
        for before, size, block in sorted(parts):
            assert before == at and block == before // 500
            at += size
    again = mixing.mixed(table, block_bytes=500, period=40)
    assert again.columns == table.columns
    assert sorted(map(str, again.collect())) == sorted(map(str, table.collect()))
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0


def test_mixed_rows_lie_by_slot(spark):
    rows = [(i, "t" * 99, f"s{i % 3}") for i in range(300)]
    table = docs(spark, rows)
    slot = {r["doc_id"]: (r["slot"], r["before"]) for r in mixing.mix(table, block_bytes=1000, period=30).collect()}
    order = [slot[r["doc_id"]] for r in mixing.mixed(table, block_bytes=1000, period=30).collect()]
    assert order == sorted(order)


# ---- quality


def brute_quality(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    tri = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {k + d for k in range(len(w) - 2) if tri[w[k], w[k + 1], w[k + 2]] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_features_and_likelihood(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    rows = [*ODD, (20, "a\nb\na\n \n \na", "s"), (21, "#x $y z | <b>\u000b😀", "s")]
    rows += [(100 + i, " ".join(rng.choice(words) for _ in range(80)), "s") for i in range(40)]
    rows += [(200 + i, " ".join(rng.choice(words) + "%%%" for _ in range(80)), "s") for i in range(10)]
    labels = spark.createDataFrame([(100 + i, 1, "x") for i in range(30)] + [(None, 1, "x"), (200, 0, "x"), (201, None, "x")], "doc_id long, quality int, text string")
    table = docs(spark, rows)
    out = quality.rate_quality(table, labels).collect()
    want = collections.Counter((i, *brute_quality(t)) for i, t, _ in rows)
    assert collections.Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in out) == want
    for r in out:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and r["score"] >= -0.05)
    by = {r["doc_id"]: r for r in out}
    assert all(by[100 + i]["kept"] for i in range(40)) and not any(by[200 + i]["kept"] for i in range(10))
    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        return [*((x, None) for x in w), *zip(w, w[1:])]

    named = spark.createDataFrame(list({g for _, t, _ in rows for g in grams(t)}), "a string, b string")
    slot = {(r["a"], r["b"]): r["s"] for r in named.selectExpr("a", "b", "pmod(if(b is null, xxhash64(a), xxhash64(a, b)), 10000) as s").collect()}
    raw = collections.Counter(slot[g] for _, t, _ in rows for g in grams(t))
    good = collections.Counter(slot[g] for i, t, _ in rows if i is not None and 100 <= i < 130 for g in grams(t))
    for i, t, _ in rows:
        if own := [slot[g] for g in grams(t)]:
            score = sum(math.log((good[g] + 1) / (good.total() + 10000)) - math.log((raw[g] + 1) / (raw.total() + 10000)) for g in own) / len(own)
            assert by[i]["score"] == pytest.approx(score, abs=1e-6)
    assert quality.rate_quality(spark.createDataFrame([], DOCS), labels).count() == 0


# ---- language model


def test_forward_equals_sum_over_paths():
    rng = np.random.default_rng(1)
    states, symbols = 3, 5
    start, move, emit = rng.dirichlet(np.ones(states)), rng.dirichlet(np.ones(states), states), rng.dirichlet(np.ones(symbols), states).T
    seqs = [rng.integers(0, symbols, n) for n in (1, 4, 2, 6, 3)]
    got = hmm.forward(np.concatenate(seqs), np.array([len(s) for s in seqs]), start, move, emit)
    for s, value in zip(seqs, got):
        total = 0.0
        for path in np.ndindex(*[states] * len(s)):
            p = start[path[0]] * emit[s[0], path[0]]
            for k in range(1, len(s)):
                p *= move[path[k - 1], path[k]] * emit[s[k], path[k]]
            total += p
        assert value == pytest.approx(math.log(total))


@pytest.mark.parametrize("stretch", [1, 2, 3, 512])
def test_expected_counts_equal_brute_force(monkeypatch, stretch):
    monkeypatch.setattr(hmm, "STRETCH", stretch)
    monkeypatch.setattr(hmm, "WHOLE", 0 if stretch < 512 else 1000)
    rng = np.random.default_rng(2)
    states, symbols = 2, 4
    start, move, emit = rng.dirichlet(np.ones(states)), rng.dirichlet(np.ones(states), states), rng.dirichlet(np.ones(symbols), states).T
    seqs = [rng.integers(0, symbols, n) for n in (5, 1, 3, 7, 6)]
    total = hmm.Expected(states, symbols)
    held = hmm.Held(lambda flat, lens: total.add(flat, lens, start, move, emit))
    for x in seqs:
        held.put(x)
    held.end()
    s_, m_, e_ = np.zeros(states), np.zeros((states, states)), np.zeros((symbols, states))
    for s in seqs:
        paths = {}
        for path in np.ndindex(*[states] * len(s)):
            p = start[path[0]] * emit[s[0], path[0]]
            for k in range(1, len(s)):
                p *= move[path[k - 1], path[k]] * emit[s[k], path[k]]
            paths[path] = p
        z = sum(paths.values())
        for path, p in paths.items():
            s_[path[0]] += p / z
            for k, state in enumerate(path):
                e_[s[k], state] += p / z
                if k:
                    m_[path[k - 1], state] += p / z
    assert np.allclose(total.start, s_, atol=1e-5) and np.allclose(total.move, m_, atol=1e-5) and np.allclose(total.emit, e_, atol=1e-5)


def test_base_score_and_model(spark):
    rng = random.Random(3)
    kinds = [[f"{c}{i}" for i in range(40)] for c in "ab"]
    rows = [*ODD, *((100 + k, " ".join(rng.choice(kinds[k % 2]) for _ in range(60)), "s") for k in range(300))]
    out = hmm.score_texts(docs(spark, rows), top_words=60, tail_classes=16).collect()
    assert len(out) == len(rows)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    count: collections.Counter = collections.Counter()
    for i, t, _ in rows:
        if not held(i):
            count.update((t or "").encode().lower().split())
            count[hmm.END] += 1
    n, v = count.total(), len(count)
    want = collections.Counter()
    for i, t, _ in rows:
        tokens = [*(t or "").encode().lower().split(), hmm.END]
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens)
        want[i, held(i), len(tokens), sum(count[w] > 0 for w in tokens), n, round(base, 6)] += 1
    assert collections.Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out) == want
    test = [r for r in out if r["held_out"]]
    assert sum(r["score"] for r in test) > sum(r["base_score"] for r in test)  # two latent kinds are found
    assert hmm.score_texts(spark.createDataFrame([], DOCS)).count() == 0


def test_model_is_a_distribution():
    """Emissions and the shares within a class add up to one."""
    model = hmm.Model(np.array([5.0, 3.0, 2.0]), 3)
    model.update(np.ones(3), np.ones((3, 3)), np.array([[4.0, 1, 0], [2, 2, 0], [1, 0, 0]]))
    assert np.allclose(model.emit.sum(axis=0), 1) and np.allclose(model.move.sum(axis=1), 1)
    assert model.start.sum() == pytest.approx(1)
    counts, discount = np.array([7, 2, 1]), 0.6
    assert ((counts - discount).sum() + discount * len(counts)) / counts.sum() == pytest.approx(1)
