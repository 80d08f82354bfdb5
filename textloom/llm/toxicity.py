"""Toxicity with noisy-channel deobfuscation.

A word that may be disguised becomes a lattice: look-alike symbols offer the
letters they stand for, separators may vanish, masks are any letter or none,
repeated letters shrink, and a blank next to a fragment of a word either
vanishes or ends a word.  Exact Viterbi decoding under a character trigram
model (with what each disguise costs) restores the words.
The restored words are scored: word shapes (whole words, beginnings, endings)
that labelled toxic documents show and clean ones do not carry weights, and a
logistic model of a document's evidence gives its probability.

All labelled texts are learned from, whole, but those whose id's remainder is
the held-out one.  Executors count trigrams and word shapes and sum what the
logistic model needs; the driver gets the trigram table and the shapes that
pass both tests, never texts.  Scores depend on texts alone.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, id_residue, narrow, stage
from .ngram_join import contract

#: What a symbol may stand for within a word.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¢": "c", "#": "h"}
SEPARATORS = frozenset(".-_*~'`^,:;/\\")
_NO_SEPARATOR = str.maketrans("", "", "".join(SEPARATORS - {"*"}))
ANY = "abcdefghijklmnopqrstuvwxyz"
#: Log costs of the channel: a look-alike, a vanished separator, a masked
#: letter, a shortened run, a doubled letter, a vanished blank.
LOOK, SEP, MASK, RUN, TWICE, GAP = -0.7, -0.3, -2.5, -0.4, -3.0, -0.7
#: A fragment has at most so many characters; a blank can vanish between two.
FRAGMENT = 2
BLANK = " "
#: Places whose trail is held at once.
STRETCH = 256
#: What is kept of decoded words: so many, each of so many characters at most.
CACHE_WORDS, CACHE_CHARS = 400_000, 40
#: A larger alphabet gets decoding tables of a word's own letters only.
MOST_LETTERS = 80

_EDGE = re.compile(r"^[^\w@$!|+(<*#€£¢]+|[^\w]+$")
_STOPS = frozenset(".,;:!?)")
_TWICE = re.compile(r"(.)\1")
_RUN = re.compile(r"(.)\1+")
_BESIDE = re.compile(b"\x01\x01+")
_MIXED = re.compile(r"[^\W\d_][^\W_]*[^a-zß-ÿœ]|[0-9@$!|+(<*#€£¢][^\W\d_]|(.)\1")
_PURE = re.compile(r"[^\W\d_]+")
_LETTERS = re.compile(r"[^\W\d_]+")


def shapes(word: str) -> list[str]:
    """What of a word may carry weight."""
    out = ["=" + word]
    out += ["^" + word[:k] for k in range(4, min(len(word), 9))]
    out += [word[-k:] + "$" for k in range(4, min(len(word), 8))]
    return out


def wider_shapes(shape: str) -> list[str]:
    """Shapes of every word that has ``shape``."""
    if shape[0] == "=":
        return shapes(shape[1:])[1:]
    if shape[0] == "^":
        return [shape[:k] for k in range(5, len(shape))]
    return [shape[k:] for k in range(1, len(shape) - 4)]


def squeezed(word: str) -> str:
    """Every run of a letter as one."""
    return _RUN.sub(r"\1", word)


def trigrams(words: dict[str, int]) -> Counter:
    """Counts of the character trigrams of padded words."""
    tri: Counter = Counter()
    for word, n in words.items():
        padded = "^^" + word + "$"
        for k in range(2, len(padded)):
            tri[padded[k - 2 : k + 1]] += n
    return tri


class CharModel:
    """Character trigrams within words, by absolute counts with add-one back-off."""

    def __init__(self, tri: dict[str, int]):
        bi: Counter = Counter()
        uni: Counter = Counter()
        for t, n in tri.items():
            bi[t[1:]] += n
            uni[t[2]] += n
        self.total = sum(uni.values()) + 1000
        self.uni = {c: (n + 1) / self.total for c, n in uni.items()}
        before: Counter = Counter()
        for pair, n in bi.items():
            before[pair[0]] += n
        self.bi = {p: (n + 20 * self.uni[p[1]]) / (before[p[0]] + 20) for p, n in bi.items()}
        first: Counter = Counter()
        for t, n in tri.items():
            first[t[:2]] += n
        self.first = dict(first)
        self.before = dict(before)
        self.tri = {t: math.log((n + 10 * self.bi[t[1:]]) / (first[t[:2]] + 10)) for t, n in tri.items() if n > 1}
        #: Letters of the tables; all others are alike.
        self.letters = sorted({c for c in self.uni if c != "$"} | set(ANY))
        self.tables: tuple[np.ndarray, np.ndarray] | None = None

    def log(self, a: str, b: str, c: str) -> float:
        got = self.tri.get(a + b + c)
        if got is not None:
            return got
        two = self.bi.get(b + c)
        if two is None:
            two = 20 * self.uni.get(c, 1 / self.total) / (self.before.get(b, 0) + 20)
        return math.log(10 * two / (self.first.get(a + b, 0) + 10))

    def dense(self, places: list[list[tuple[str, float]]]) -> str:
        """The likeliest path by tables over all pairs of letters: the same
        time for each choice of a place, however many states there are."""
        letters = self.letters
        if len(letters) > MOST_LETTERS:
            own = {c for choices in places for some, _ in choices for c in some if c != BLANK}
            letters = sorted(own.intersection(letters))
        names = ["^", *letters, "\0"]
        tables = self.tables if letters is self.letters else None
        if tables is None:  # the log of each letter after each pair, made once a process
            step = np.array([[[self.log(a, b, c) for c in names] for b in names] for a in names])
            tables = step, np.array([[self.log(a, b, "$") for b in names] for a in names])
            if letters is self.letters:
                self.tables = tables
        step, end = tables
        size, place = len(names), {c: i for i, c in enumerate(names)}
        other = size - 1

        def walk(score: np.ndarray, some: list[list[tuple[str, float]]]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
            trail = []
            for choices in some:
                best = np.full((size, size), -np.inf)
                took, came = np.zeros((size, size), dtype=np.uint8), np.zeros((size, size), dtype=np.int32)
                for k, (letters, cost) in enumerate(choices):
                    now, back = score + cost, np.arange(size * size).reshape(size, size)
                    if letters == BLANK:
                        at = int((now + end).argmax())
                        top, now = (now + end).flat[at], np.full((size, size), -np.inf)
                        now[0, 0], back = top, np.full((size, size), at)
                    else:
                        for c in letters:
                            i = place.get(c, other)
                            reach = now + step[:, :, i]
                            a = reach.argmax(axis=0)
                            after, before = np.full((size, size), -np.inf), np.zeros((size, size), dtype=np.int64)
                            after[:, i], before[:, i] = reach[a, np.arange(size)], back[a, np.arange(size)]
                            now, back = after, before
                    better = now > best
                    best[better], took[better], came[better] = now[better], k, back[better]
                trail.append((took, came))
                score = best
            return score, trail

        # the scores before each stretch are kept, its trail is made again on the way back
        first = np.full((size, size), -np.inf)
        first[0, 0] = 0.0
        begins = [first]
        for k in range(0, len(places), STRETCH):
            score, trail = walk(begins[-1], places[k : k + STRETCH])
            begins.append(score)
        at, out = int((begins[-1] + end).argmax()), []
        for k in range(len(begins) - 2, -1, -1):
            some = places[k * STRETCH : (k + 1) * STRETCH]
            if k < len(begins) - 2:
                _, trail = walk(begins[k], some)
            for choices, (took, came) in zip(reversed(some), reversed(trail)):
                out.append(choices[took.flat[at]][0])
                at = int(came.flat[at])
        return "".join(reversed(out))


def lattice(word: str) -> list[list[tuple[str, float]]] | None:
    """Choices (letters, log cost) of each place; None if nothing is disguised.

    A blank is a place too: it vanishes, or stays and ends a word.
    """
    out: list[list[tuple[str, float]]] = []
    hidden = False
    k, size = 0, len(word)
    while k < size:
        c = word[k]
        run = 1
        while k + run < size and word[k + run] == c:
            run += 1
        if c == BLANK:
            out.append([("", GAP), (BLANK, 0.0)])
            hidden = True
        elif c.isalpha():
            if run >= 3:
                out.append([(c, RUN), (c + c, RUN)])
            elif run == 2:
                out.append([(c + c, 0.0), (c, TWICE)])
            else:
                out.append([(c, 0.0)])
            hidden |= run > 1
        elif c == "*":
            out += [[("", SEP)] + [(x, MASK) for x in ANY]] * run
            hidden = True
        elif c in SEPARATORS:
            out.append([("", SEP)])
            hidden = True
        elif c in LEET:
            same = [(x, LOOK) for x in LEET[c]]
            out += [same] * run if run < 3 else [same, same + [("", RUN)]]
            hidden = True
        else:
            out.append([("", MASK)])
        k += run
    return out if hidden else None


def decode(word: str, model: CharModel) -> str:
    """The likeliest letters behind ``word`` (the word itself if nothing is
    hidden).  Exact: all states (the last two letters) are kept, and a run of
    masks, which reaches all of them, goes by tables."""
    places = lattice(word)
    if places is None:
        return word
    if "**" in word:
        return model.dense(places)
    log, tri = model.log, model.tri.get
    states: dict[str, tuple[float, tuple]] = {"^^": (0.0, ())}  # the best path to each, as a linked list
    for choices in places:
        new: dict[str, tuple[float, tuple]] = {}
        for state, (score, path) in states.items():
            for letters, cost in choices:
                s, now = score + cost, state
                if letters == BLANK:
                    s, now = s + log(now[0], now[1], "$"), "^^"
                else:
                    for c in letters:
                        known = tri(now + c)
                        s += log(now[0], now[1], c) if known is None else known
                        now = now[1] + c
                if now not in new or s > new[now][0]:
                    new[now] = (s, (path, letters))
        states = new
    _, path = max(((s + log(st[0], st[1], "$"), p) for st, (s, p) in states.items()), key=lambda x: x[0])
    out = []
    while path:
        path, letters = path
        out.append(letters)
    return "".join(reversed(out))


def is_fragment(token: str) -> bool:
    # a token that begins with more letters than a fragment has is none
    return len(token) <= FRAGMENT or not token[: FRAGMENT + 1].isalpha() and 0 < len(token.translate(_NO_SEPARATOR)) <= FRAGMENT


def runs(tokens: list[str], pieces: set[str]) -> list[str]:
    """Runs of two or more neighbouring tokens out of ``pieces``, joined by blanks."""
    if not pieces:
        return []
    return [BLANK.join(tokens[m.start() : m.end()]) for m in _BESIDE.finditer(bytes(map(pieces.__contains__, tokens)))]


def fragments(tokens: list[str]) -> list[str]:
    """Runs of two or more neighbouring fragments, joined by blanks."""
    return runs(tokens, set(filter(is_fragment, set(tokens))))


def bare(token: str) -> str:
    """What of a token ``restore`` looks at."""
    if token.isalpha() or BLANK in token:
        return token
    return token[:-1] if token[-1:] in _STOPS and token[:-1].isalpha() else _EDGE.sub("", token)


def restore(token: str, model: CharModel) -> list[str]:
    """Words of one lower-cased token, or of a run of fragments: plain ones as
    they are, and what decoding makes of disguised ones."""
    if BLANK in token:
        whole = decode(token, model).split(BLANK)
        return [w for w in whole if len(w) > FRAGMENT]
    token = bare(token)
    if not token:
        return []
    if _PURE.fullmatch(token):
        whole = decode(token, model) if _TWICE.search(token) else token
        return [token] if whole == token else [token, whole]
    words = _LETTERS.findall(token)
    if words and not token.isdigit() and _MIXED.search(token):
        whole = decode(token, model)
        if whole not in words:
            words.append(whole)
    return words


class Restorer:
    """``restore`` with a bounded memory."""

    def __init__(self, model: CharModel):
        self.model = model
        self.cache: dict[str, list[str]] = {}

    def __call__(self, token: str) -> list[str]:
        token = bare(token)
        found = self.cache.get(token)
        if found is None:
            found = restore(token, self.model)
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            if len(token) <= CACHE_CHARS:
                self.cache[token] = found
        return found


class Scorer:
    """Weights of word shapes, the character model and the logistic model."""

    def __init__(self, model: CharModel, weights: dict[str, float], beta: tuple[float, ...], restored: Restorer | None = None):
        self.model, self.weights, self.beta, self.restored = model, weights, beta, restored
        self.cache: dict[str, float] = {}
        self.plain: set[str] = set()  # tokens without weight that are no fragments
        # no word needs its longer shapes looked up if none begins or ends so
        self.heads = {s[1:5] for s in weights if s[0] == "^"}
        self.tails = {s[-5:-1] for s in weights if s[0] not in "=^"}
        # the same of words squeezed, for what decoding may make of a word
        self.once = {squeezed(s[1:]) for s in weights if s[0] == "="}
        self.once_heads, self.once_tails = set(map(squeezed, self.heads)), set(map(squeezed, self.tails))
        self.begins = {squeezed(s.strip("=^$"))[:3] for s in weights}

    def forget(self) -> None:
        self.cache.clear()
        self.plain.clear()

    def word(self, word: str) -> float:
        if word[:4] in self.heads or word[-4:] in self.tails:
            get = self.weights.get
            return max((get(s, 0.0) for s in shapes(word)), default=0.0)
        return self.weights.get("=" + word, 0.0)

    def may_hide(self, word: str) -> bool:
        """Whether a reading of a word of letters alone may have a weight: all
        of them differ in the lengths of runs only."""
        once = squeezed(word)
        if once in self.once:
            return True
        heads, tails = self.once_heads, self.once_tails
        return any(once[:k] in heads or once[-k:] in tails for k in (1, 2, 3, 4))

    def may_join(self, run: str) -> bool:
        """Whether a run of fragments may hide a weight: the letters of a shape
        follow each other in it, but for the lengths of runs."""
        letters = run.replace(BLANK, "").translate(_NO_SEPARATOR)
        if not letters.isalpha():
            return bool(letters)
        once, begins = squeezed(letters), self.begins
        return any(once[k : k + n] in begins for k in range(len(once)) for n in (1, 2, 3))

    def weigh(self, token: str) -> float:
        """The strongest weight of a token's words, or of a run's."""
        token = bare(token)
        if BLANK in token:
            if not self.may_join(token):
                return 0.0
        elif token.isalpha() and not (_TWICE.search(token) and self.may_hide(token)):
            return self.word(token)
        words = restore(token, self.model) if self.restored is None else self.restored(token)
        return max(map(self.word, words), default=0.0)

    def evidence(self, text: str) -> tuple[float, float, float]:
        """(strongest weight, log of evident words, log of their weight)."""
        tokens = text.lower().split()
        if len(self.plain) >= CACHE_WORDS:
            self.plain.clear()
        if len(self.cache) >= CACHE_WORDS:
            self.cache.clear()
        get, cache, plain = self.cache.get, self.cache, self.plain
        n, total, most = 0, 0.0, 0.0
        known, pieces = {}, set()
        for t in set(tokens) - plain:
            w, piece = get(t), is_fragment(t)
            if piece:
                pieces.add(t)
            if w is None:
                w = self.weigh(t)
                if len(t) <= CACHE_CHARS:
                    if w or piece:
                        cache[t] = w
                    else:
                        plain.add(t)
            if w:
                known[t] = w
        if known:
            for t in tokens:
                if t in known:
                    n += 1
                    total += known[t]
            most = max(known.values())
        for run in runs(tokens, pieces):
            w = get(run)
            if w is None:
                w = self.weigh(run)
                if len(run) <= CACHE_CHARS:
                    cache[run] = w
            if w:
                n, total, most = n + 1, total + w, max(most, w)
        return most, math.log1p(n), math.log1p(total)

    def score(self, text: str) -> float:
        z = self.beta[0] + sum(b * x for b, x in zip(self.beta[1:], self.evidence(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


# ---- learning


#: Bands of a text's signature, and hashes of a band.
BANDS, BAND = 8, 4
_SALTS = (np.arange(1, BANDS * BAND + 1, dtype=np.uint64) * np.uint64(7919 * 2654435761)) & np.uint64(0xFFFFFFFF)
_BAND_SALTS = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def node_of(text: str) -> int:
    """What Spark's ``xxhash64`` gives for a text."""
    n = xxhash.xxh64_intdigest(text.encode(), seed=42)
    return n - (1 << 64) if n >> 63 else n


def band_keys(text: str) -> np.ndarray:
    """Keys of which near copies share one.  A key holds several minima of the
    hashed passages of three words, so that texts which share only a passage
    do not chain a large table into one family."""
    words = text.lower().split()
    if len(words) < 3:
        return np.zeros(0, dtype=np.int64)
    hashes = np.fromiter({crc32(" ".join(words[k : k + 3]).encode()) for k in range(len(words) - 2)}, dtype=np.uint64)
    # a salt turns the ring of hashes, so its least one is the next after a point
    ring = np.sort((hashes * np.uint64(2654435761)) & np.uint64(0xFFFFFFFF))
    least = (ring[np.searchsorted(ring, -_SALTS & np.uint64(0xFFFFFFFF)) % len(ring)] + _SALTS) & np.uint64(0xFFFFFFFF)
    key = _BAND_SALTS.copy()
    for column in least.reshape(BANDS, BAND).T:
        key = (key ^ column) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def families(texts: list[str]) -> list[int]:
    """A family number per text (the least node in it); copies and near copies
    share one, so that a text that was copied often does not make its words
    evidence."""
    nodes = [node_of(text) for text in texts]
    parent = {n: n for n in nodes}

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    seen: dict[int, int] = {}
    for node, text in zip(nodes, texts):
        for key in band_keys(text).tolist():
            a, b = root(node), root(seen.setdefault(key, node))
            parent[max(a, b)] = min(a, b)
    return [root(n) for n in nodes]


#: A shape needs so many toxic families, such a weight and such a G statistic;
#: for the halves, which see fewer families, a smaller one.
LEAST, WEIGHT_LEAST, G_LEAST, G_HALF = 3, 2.5, 20.0, 14.0
#: Slots of the table that counts shapes by hash before any is kept by name.
SLOTS = 1 << 23
#: One in so many clean families is counted first, to see which shapes already fail.
PART = 8


def _slot(shape: str) -> int:
    return crc32(shape.encode()) % SLOTS


def by_family(found: list[tuple[int, np.ndarray]]) -> list[np.ndarray]:
    """Distinct word numbers of each family."""
    parts: dict[int, list[np.ndarray]] = defaultdict(list)
    for family, words in found:
        parts[family].append(words)
    return [np.unique(np.concatenate(p)) for p in parts.values()]


def choose(counts: dict[str, tuple[int, int]], tp: int, tn: int, least: int = LEAST, g_least: float = G_LEAST) -> dict[str, float]:
    """Weights from the families of toxic and of clean texts that show a shape.

    ``counts`` may leave out shapes that fail: a shape has no more clean
    families than its wider ones, so where a wider one with equal support
    passes, the more specific one passes too.
    """
    kept = {s: p for s, (p, _) in counts.items() if p >= least}
    wide = {w for s, p in kept.items() for w in wider_shapes(s) if kept.get(w) == p}
    out = {}
    share = tp / (tp + tn)
    for s, p in sorted(kept.items()):
        if s in wide:  # of shapes with equal support only the most specific stays
            continue
        n = counts[s][1]
        weight = math.log((p + 0.5) / (tp + 1)) - math.log((n + 0.5) / (tn + 1))
        g = 2 * (p * math.log(p / ((p + n) * share)) + (n * math.log(n / ((p + n) * (1 - share))) if n else 0.0))
        if weight >= WEIGHT_LEAST and g >= g_least:
            out[s] = round(min(weight, 8.0), 4)
    return out


def select(toxic: list[tuple[int, np.ndarray]], clean: list[tuple[int, np.ndarray]], names: list[str], least: int = LEAST, g_least: float = G_LEAST) -> dict[str, float]:
    """Shapes that families of toxic texts show far more often than clean ones,
    with their log odds; both lists hold (family, word numbers) of each text."""
    tox, cln = by_family(toxic), by_family(clean)
    tp, tn = len(tox), len(cln)
    if not tp or not tn:
        return {}
    seen = np.zeros(SLOTS, dtype=np.uint16)
    for words in tox:
        seen[list({_slot(s) for w in words for s in shapes(names[w])})] += 1
    kept: Counter = Counter()
    for words in tox:
        kept.update({s for w in words for s in shapes(names[w]) if seen[_slot(s)] >= least})
    del seen
    kept = Counter({s: n for s, n in kept.items() if n >= least})
    neg: Counter = Counter()
    hits: dict[int, list[str]] = {}
    for words in cln:
        own = set()
        for w in words.tolist():
            found = hits.get(w)
            if found is None:
                found = hits[w] = [s for s in shapes(names[w]) if s in kept]
            own.update(found)
        neg.update(own)
    return choose({s: (p, neg[s]) for s, p in kept.items()}, tp, tn, least, g_least)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, ...]:
    """Ridge-penalised logistic regression by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def base_rate(model: CharModel, toxic: int, rows: int) -> Scorer:
    rate = min(max(toxic / rows, 0.001), 0.999) if rows else 0.0001
    return Scorer(model, {}, (math.log(rate / (1 - rate)), 0.0, 0.0, 0.0))


def learn(rows: Iterable[tuple[str, int]]) -> Scorer:
    """A scorer from (text, label) rows in memory, all of them used; without
    both labels it gives the base rate.  ``fit`` gives the same for tables."""
    rows = sorted((t or "", int(y)) for t, y in rows)
    counts: Counter = Counter()
    for text, _ in rows:
        counts.update(_LETTERS.findall(text.lower()))
    model = CharModel(trigrams(counts))
    del counts
    y = np.array([label for _, label in rows], dtype=float)
    if not len(y) or y.min() == y.max():
        return base_rate(model, int(y.sum()), len(y))
    number: dict[str, int] = {}
    restored: dict[str, list[int]] = {}

    def words(text: str) -> np.ndarray:
        tokens = text.lower().split()
        out: set[int] = set()
        for t in {*tokens, *fragments(tokens)}:
            if t not in restored:
                restored[t] = [number.setdefault(w, len(number)) for w in restore(t, model)]
            out.update(restored[t])
        return np.fromiter(out, dtype=np.int32, count=len(out))

    family = families([t for t, _ in rows])
    found = [(f, words(text)) for (text, _), f in zip(rows, family)]
    del restored
    names = list(number)
    half = [f % 2 for f in family]

    def parts(label: int, skip: int) -> list[tuple[int, np.ndarray]]:
        return [x for x, (_, own), h in zip(found, rows, half) if own == label and h != skip]

    # evidence for the logistic model comes from weights of the other half
    x = np.zeros((len(rows), 3))
    for skip in (0, 1):
        other = Scorer(model, select(parts(1, skip), parts(0, skip), names, g_least=G_HALF), (0.0,))
        for i, (text, _) in enumerate(rows):
            if half[i] == skip:
                x[i] = other.evidence(text)
        del other
    return Scorer(model, select(parts(1, 2), parts(0, 2), names), logistic(x, y))


def training_rows(docs: DataFrame, labels: DataFrame, held_out: int, mod: int, max_toxic: int, max_clean: int, max_bytes: int, id_col: str, text_col: str, label_col: str) -> list[tuple[str, int]]:
    """A bounded sample of labelled texts in memory, chosen by a hash of the id,
    for trials; ``fit`` and ``toxicity`` learn from all and do not call this.

    Of rows that repeat an id the text that comes first counts; ids are taken
    in the order of their hash while their texts have room in ``max_bytes``.
    """
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).filter(F.col("id").isNotNull() & F.col("label").isin(0, 1) & (id_residue(F.col("id"), mod) != held_out)).groupBy("id").agg(F.max("label").alias("label"))
    order = [F.xxhash64("id"), F.col("id")]
    few = marked.filter("label = 1").orderBy(*order).limit(max_toxic).unionByName(marked.filter("label = 0").orderBy(*order).limit(max_clean))
    few = stage(few, "tox-sample")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # at most max_toxic + max_clean ids are broadcast, and as many sizes collected
    found = texts.join(F.broadcast(few), "id")
    sizes = found.groupBy("id").agg(F.max(F.octet_length("text")).alias("size")).orderBy(*order).collect()
    room, kept = max_bytes, []
    for r in sizes:
        if (r["size"] or 0) <= room:
            room -= r["size"] or 0
            kept.append((r["id"],))
    if not kept:
        return []
    wanted = docs.sparkSession.createDataFrame(kept, f"id {docs.schema[id_col].dataType.simpleString()}")
    once = found.join(F.broadcast(wanted), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    return [(r["text"], r["label"]) for r in once.select("text", "label").collect()]


def score_column(scorer: Scorer, text_col: str = "text") -> Column:
    """The score of each text (null and empty ones get that of a text without
    evidence) as a column, so that no name can clash."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        mine = scorer.score
        for texts in batches:
            yield texts.map(lambda t: mine(t or ""))
        scorer.forget()
        give_back()

    return run(F.col(text_col))


#: Texts of a family that one task joins; a larger family is dealt to several.
UNIT = 64
#: Counts a task holds before it sends them.
MOST_COUNTS = 400_000
#: Sums of the logistic model are taken in whole units, so that no order of rows changes them.
FINE = float(1 << 40)


def labelled(docs: DataFrame, labels: DataFrame, held_out: int, mod: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """Staged: id, text, label and the text's hash as ``node``, of every row
    that may be learned from.

    Of rows that repeat an id the text that comes first counts, and label 1
    before 0; a null text counts as empty.
    """
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).filter(F.col("id").isNotNull() & F.col("label").isin(0, 1) & (id_residue(F.col("id"), mod) != held_out))
    marked = stage(marked.groupBy("id").agg(F.max("label").cast("int").alias("label")), "tox-labels")
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    once = texts.join(narrow(marked), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    return stage(once.withColumn("node", F.xxhash64("text")), "tox-texts")


def count_trigrams(texts: DataFrame) -> dict[str, int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            tri = trigrams(words)
            words.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(tri), pa.string()), pa.array(list(tri.values()), pa.int64())], ["tri", "n"])

        words: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words.update(_LETTERS.findall(text.lower()))
                if len(words) >= MOST_COUNTS:
                    yield out()
        yield out()
        give_back()

    counts = texts.select("text").mapInArrow(run, "tri string, n long").groupBy("tri").agg(F.sum("n").alias("n"))
    return {r["tri"]: r["n"] for r in counts.collect()}


def family_roots(texts: DataFrame) -> DataFrame:
    """(node, root) of the nodes that have a near copy; ``families`` of tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [band_keys(t) for t in batch.column(1).to_pylist()]
            nodes = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(k) for k in keys])
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(np.concatenate(keys) if keys else [], pa.int64())], ["node", "key"])

    keys = stage(texts.select("node", "text").mapInArrow(run, "node long, key long"), "tox-keys")
    shared = keys.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least < most").select("key", "least")
    edges = keys.join(narrow(stage(shared, "tox-shared")), "key").select(F.col("node").alias("a"), F.col("least").alias("b"))
    return contract(edges, "tox-families")


def with_families(texts: DataFrame) -> DataFrame:
    """Staged: each distinct (text, label) once, with the number of its rows,
    the root and half of its family, and in how many parts that is dealt (null:
    it is alone)."""
    one = texts.groupBy("node", "label").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("rows"))
    one = stage(one.join(narrow(family_roots(texts)), "node", "left"), "tox-nodes")
    parts = one.filter("root is not null").groupBy("root", "label").agg(F.ceil(F.count(F.lit(1)) / UNIT).cast("int").alias("parts"))
    one = one.join(narrow(stage(parts, "tox-parts")), ["root", "label"], "left").withColumn("root", F.coalesce("root", "node"))
    one = stage(one.withColumn("half", F.pmod("root", F.lit(2)).cast("int")), "tox-families")
    return stage(texts.select("id", "text").join(narrow(one), "id").drop("id"), "tox-rows")


def marks(found: DataFrame) -> np.ndarray:
    """Bits by slot of shapes."""
    slot = F.crc32("shape") % SLOTS
    marked = found.select(slot.alias("slot")).groupBy(F.expr("cast(slot div 8 as int)").alias("byte")).agg(F.expr("bit_or(shiftright(128, cast(slot % 8 as int)))").alias("bits")).toPandas()
    out = np.zeros(SLOTS // 8, dtype=np.uint8)
    out[marked["byte"].to_numpy()] = marked["bits"].to_numpy()
    return out


def count_shapes(texts: DataFrame, model: CharModel, wanted: np.ndarray | None) -> DataFrame:
    """(shape, f0, f1): families of either half that show a shape; with
    ``wanted``, bits by slot, only shapes of marked slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restored = Restorer(model)
        known: dict[str, list[str]] = {}
        tokens_known: dict[str, list[str]] = {}
        dull: set[str] = set()  # tokens without a shape that are no fragments
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        slots = None if wanted is None else np.unpackbits(wanted).tobytes()

        def of_word(word: str) -> list[str]:
            found = known.get(word)
            if found is None:
                found = shapes(word)
                if slots is not None:
                    found = [s for s in found if slots[crc32(s.encode()) % SLOTS]]
                if len(known) >= CACHE_WORDS // 2:
                    known.clear()
                if len(word) <= CACHE_CHARS:
                    known[word] = found
            return found

        def of(token: str) -> list[str]:
            key = bare(token)
            if key.isalpha() and not _TWICE.search(key):
                return of_word(key)
            lists = [of_word(w) for w in restored(key)]
            return lists[0] if len(lists) == 1 else [s for some in lists for s in some]

        def batch_of(names: list[str], half: int, n: list[int], unit: int | None) -> pa.RecordBatch:
            size = len(names)
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([half] * size, pa.int32()), pa.array(n, pa.int64()), pa.array([unit] * size, pa.int64())], ["shape", "half", "n", "unit"])

        def flush() -> Iterator[pa.RecordBatch]:
            for half in (0, 1):
                yield batch_of(list(counts[half]), half, list(counts[half].values()), None)
                counts[half].clear()

        def close(found: set[str], root: int, half: int, whole: bool) -> Iterator[pa.RecordBatch]:
            if whole:
                counts[half].update(found)
                if len(counts[0]) + len(counts[1]) >= MOST_COUNTS:
                    yield from flush()
            else:
                yield batch_of(list(found), half, [1] * len(found), root)

        last, seen = None, set()
        get = tokens_known.get
        for batch in batches:
            for text, *now in zip(*(c.to_pylist() for c in batch.columns)):
                if last is not None and now != last:
                    yield from close(seen, last[0], last[1], last[2] == 1)
                    seen = set()
                last = now
                tokens = text.lower().split()
                if len(tokens_known) >= CACHE_WORDS // 2:
                    tokens_known.clear()
                if len(dull) >= CACHE_WORDS // 2:
                    dull.clear()
                pieces = set()
                for t in set(tokens) - dull:
                    found, piece = get(t), is_fragment(t)
                    if piece:
                        pieces.add(t)
                    if found is None:
                        found = of(t)
                        if len(t) <= CACHE_CHARS:
                            if found or piece:
                                tokens_known[t] = found
                            else:
                                dull.add(t)
                    if found:
                        seen.update(found)
                for t in set(runs(tokens, pieces)):
                    found = get(t)
                    if found is None:
                        found = of(t)
                        if len(t) <= CACHE_CHARS:
                            tokens_known[t] = found
                    if found:
                        seen.update(found)
        if last is not None:
            yield from close(seen, last[0], last[1], last[2] == 1)
        yield from flush()
        del restored, known, tokens_known, dull, get, counts
        give_back()

    columns = ["text", "root", "half", "parts", "part"]
    alone = texts.filter("parts is null").withColumn("parts", F.lit(1)).withColumn("part", F.lit(0))
    part = F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int")
    near = texts.filter("parts is not null").withColumn("part", part).repartition("root", "part").sortWithinPartitions("root", "part")
    found = alone.select(columns).mapInArrow(run, "shape string, half int, n long, unit long").unionByName(near.select(columns).mapInArrow(run, "shape string, half int, n long, unit long"))
    # the parts of a family show a shape once
    once = found.groupBy("shape", "half", "unit").agg(F.sum("n").alias("n")).withColumn("n", F.when(F.col("unit").isNull(), F.col("n")).otherwise(1))
    return once.groupBy("shape").agg(*(F.sum(F.when(F.col("half") == h, F.col("n")).otherwise(0)).alias(f"f{h}") for h in (0, 1)))


def weights_of(texts: DataFrame, model: CharModel) -> list[dict[str, float]]:
    """Weights without the first half, without the second, and of all families."""
    sizes = {(r["label"], r["half"]): r["n"] for r in texts.select("root", "label", "half").distinct().groupBy("label", "half").agg(F.count(F.lit(1)).alias("n")).collect()}
    totals = [[sum(sizes.get((label, h), 0) for h in (0, 1) if h != skip) for label in (1, 0)] for skip in (0, 1, 2)]

    # the driver takes what passes for one of the three; ``choose`` decides
    def passes(skip: int) -> Column:
        tp, tn = totals[skip]
        if not tp or not tn:
            return F.lit(False)
        p, n = (sum((F.col(f"{c}{h}") for h in (0, 1) if h != skip), F.lit(0)).cast("double") for c in "fc")
        share = tp / (tp + tn)
        weight = F.log((p + 0.5) / (tp + 1)) - F.log((n + 0.5) / (tn + 1))
        g = 2 * (p * F.log(p / ((p + n) * share)) + F.when(n > 0, n * F.log(n / ((p + n) * (1 - share)))).otherwise(0.0))
        return (p >= LEAST) & (weight >= WEIGHT_LEAST - 0.001) & (g >= (G_LEAST if skip == 2 else G_HALF) - 0.001)

    def with_clean(clean: DataFrame) -> DataFrame:
        both = toxic.join(clean.select("shape", F.col("f0").alias("c0"), F.col("f1").alias("c1")), "shape", "left").fillna(0, ["c0", "c1"])
        return both.filter(passes(0) | passes(1) | passes(2))

    toxic = count_shapes(texts.filter("label = 1"), model, None)
    toxic = stage(toxic.filter(F.col("f0") + F.col("f1") >= LEAST), "tox-shapes")
    # more clean families only lower a weight and its G statistic, so what fails
    # without any, or with those of a part, need not be counted in all
    toxic = stage(with_clean(toxic.limit(0)).drop("c0", "c1"), "tox-able")
    clean = texts.filter("label = 0")
    some = clean.filter(F.pmod(F.xxhash64("root", F.lit(2)), F.lit(PART)) == 0)
    toxic = stage(with_clean(count_shapes(some, model, marks(toxic))).drop("c0", "c1"), "tox-able")
    rows = with_clean(count_shapes(clean, model, marks(toxic))).collect()
    out = []
    for skip, (tp, tn) in enumerate(totals):
        use = [h for h in (0, 1) if h != skip]
        counts = {r["shape"]: (sum(r[f"f{h}"] for h in use), sum(r[f"c{h}"] for h in use)) for r in rows}
        out.append(choose(counts, tp, tn, g_least=G_LEAST if skip == 2 else G_HALF) if tp and tn else {})
    return out


def fit_logistic(texts: DataFrame, model: CharModel, halves: list[dict[str, float]], ridge: float = 0.05) -> tuple[float, ...]:
    """``logistic`` of tables: evidence under the other half's weights, and
    Newton steps whose sums Spark takes over the distinct evidence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restored = Restorer(model)
        scorers = [Scorer(model, w, (0.0,), restored) for w in halves]
        for batch in batches:
            found = [scorers[h].evidence(t) for t, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            # weights have four decimals, so these are whole numbers
            most, hits, total = ([round(v) for v in c] for c in zip(*((m * 1e4, math.expm1(a), math.expm1(b) * 1e4) for m, a, b in found))) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(most, pa.int64()), pa.array(hits, pa.int64()), pa.array(total, pa.int64()), batch.column(2), batch.column(3)], ["most", "hits", "total", "label", "rows"])
        del scorers, restored
        give_back()

    seen = texts.select("text", "half", "label", "rows").mapInArrow(run, "most long, hits long, total long, label int, rows long")
    seen = stage(seen.groupBy("most", "hits", "total", "label").agg(F.sum("rows").alias("rows")), "tox-evidence")
    x = [F.lit(1.0), F.col("most") / 1e4, F.log1p(F.col("hits").cast("double")), F.log1p(F.col("total") / 1e4)]
    size = len(x)
    beta, penalty = np.zeros(size), np.diag([1e-6] + [ridge] * (size - 1))

    def whole(value: Column) -> Column:
        return F.sum(F.rint(value * FINE).cast("decimal(20,0)") * F.col("rows").cast("decimal(17,0)"))

    for _ in range(50):
        z = sum((float(b) * c for b, c in zip(beta, x)), F.lit(0.0))
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
        table = seen.select(*(c.alias(f"x{k}") for k, c in enumerate(x)), p.alias("p"), "label", "rows")
        pairs = [(i, j) for i in range(size) for j in range(i, size)]
        sums = [whole(F.col(f"x{i}") * (F.col("label") - F.col("p"))).alias(f"g{i}") for i in range(size)]
        sums += [whole(F.col(f"x{i}") * F.col(f"x{j}") * F.col("p") * (1 - F.col("p"))).alias(f"h{i}{j}") for i, j in pairs]
        got = table.agg(*sums).first()
        gradient = np.array([float(got[f"g{i}"]) / FINE for i in range(size)])
        hessian = np.zeros((size, size))
        for i, j in pairs:
            hessian[i, j] = hessian[j, i] = float(got[f"h{i}{j}"]) / FINE
        step = np.linalg.solve(hessian + penalty, gradient - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def fit(docs: DataFrame, labels: DataFrame, held_out: int = 1, mod: int = 3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Scorer:
    """A scorer from all labelled rows that are not held out; ``learn`` of tables."""
    texts = labelled(docs, labels, held_out, mod, id_col, text_col, label_col)
    rows = {r["label"]: r["count"] for r in texts.groupBy("label").count().collect()}
    model = CharModel(count_trigrams(texts))
    if len(rows) < 2:
        return base_rate(model, rows.get(1, 0), sum(rows.values()))
    placed = with_families(texts)
    first, second, every = weights_of(placed, model)
    return Scorer(model, every, fit_logistic(placed, model, [first, second]))


def toxicity(docs: DataFrame, labels: DataFrame, held_out: int = 1, mod: int = 3, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted.

    Scoring is a narrow map over whole texts.  Null and empty texts get the
    score of a text without evidence; a null id counts as remainder 0 and
    stays null; repeated rows are scored each; an empty table gives none;
    extra columns are not read.  Without labels of both kinds every text gets
    the base rate.
    """
    scorer = fit(docs, labels, held_out, mod, id_col, text_col, label_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([scorer.score(t or "") for t in batch.column(1).to_pylist()], pa.float64())], ["id", "score"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double")
    return out.select(F.col("id").alias(id_col), (id_residue(F.col("id"), mod) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
