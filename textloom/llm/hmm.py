"""A hidden Markov language model over words.

Latent states emit symbols: each of the most frequent training words
(``top_words`` at most) is one, all other words fall into ``tail_classes`` classes by their
ending, and the text's end is one.  Within a class, a word's share is its
discounted training count, and the discounted mass is that of an unknown word
of the class; this factor is the same in all states, so it is joined to the
texts once, outside the recursion.  Hence the model is a proper distribution
over sequences of training words and one unknown word per class, its tables
have a fixed size, and the words' counts never leave the cluster.

Training: Baum-Welch.  Expected counts of states, transitions and emissions
are computed per partition and added up by symbol, over all training texts and
the whole of each: a text's recursions run through it in stretches of
``STRETCH`` words, with the forward belief kept at the borders and the backward
one carried over them.  The first tables come from one pass over all training
texts as well: each symbol's neighbours, counted in hashed slots, are grouped
into the states.  Scoring: the scaled forward recursion over the whole text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_residue, most_frequent, stage

END = b"\n"
#: Texts of more words wait apart from shorter ones.  An E step over more
#: tokens than ``WHOLE`` goes by stretches of so many words.
STRETCH, WHOLE = 512, 1_250_000
CHUNK_TOKENS = 250_000
#: Slots of the neighbours on one side, and how much of a symbol goes to its group at first.
SLOTS, OWN = 12, 0.7
FLUSH_WORDS = 300_000
#: Weight, in words, of the overall shares within each state's emissions.
PRIOR = 200.0


def words_of(raw: bytes) -> list[bytes]:
    """Words of a UTF-8 text with A-Z in lower case."""
    return raw.lower().split()


def tail_class(word: bytes, classes: int) -> int:
    return crc32(word[-3:]) % classes


# ---- recursion on packed sequences


def packing(lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by length, begins of the time steps, place of each element): the
    elements of all sequences laid out step by step, longest sequence first."""
    order = np.argsort(-lens, kind="stable")
    by = lens[order]
    steps = int(by[0]) if len(by) else 0
    alive = np.searchsorted(-by, -np.arange(steps), side="left")
    begin = np.concatenate([[0], np.cumsum(alive)])
    rank = np.empty(len(lens), dtype=np.int64)
    rank[order] = np.arange(len(lens))
    at = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
    return order, begin, begin[at] + np.repeat(rank, lens)


def forward(flat: np.ndarray, lens: np.ndarray, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """Natural log of each sequence's probability; emit is symbols by states."""
    order, begin, place = packing(lens)
    packed = np.empty(len(flat), dtype=np.int64)
    packed[place] = flat
    total = np.zeros(len(lens))
    belief = None
    for t in range(len(begin) - 1):
        symbols = packed[begin[t] : begin[t + 1]]
        n = len(symbols)
        belief = (start if belief is None else belief[:n] @ move) * emit[symbols]
        scale = belief.sum(axis=1)
        belief /= scale[:, None]
        total[:n] += np.log(scale)
    out = np.empty(len(lens))
    out[order] = total
    return out


class Expected:
    """Expected counts: starts, moves, emissions, and the log likelihood."""

    def __init__(self, states: int, symbols: int):
        self.start = np.zeros(states)
        self.move = np.zeros((states, states))
        self.emit = np.zeros((symbols, states))
        self.log = self.tokens = 0.0

    def add(self, flat: np.ndarray, lens: np.ndarray, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        """One E step over whole sequences; of more than ``WHOLE`` tokens a
        stretch of each is in memory at a time."""
        order, begin, place = packing(lens)
        states, steps = len(start), len(begin) - 1
        packed = np.empty(len(flat), dtype=np.int64)
        packed[place] = flat
        table, move32, back = emit.astype(np.float32), move.astype(np.float32), move.T.astype(np.float32)
        first = np.broadcast_to(start.astype(np.float32), (len(lens), states))

        def ahead(now: np.ndarray, t: int, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            now = (now if t == 0 else now[: len(seen)] @ move32) * seen
            scale = now.sum(axis=1)
            now /= scale[:, None]
            return now, scale

        # the belief before each stretch; those within are made again on the way back
        borders = [*range(0, steps, STRETCH if len(flat) > WHOLE else steps), steps]
        carried = [first]
        for t0, t1 in zip(borders[:-2], borders[1:]):
            now = carried[-1]
            for t in range(t0, t1):
                now, _ = ahead(now, t, table[packed[begin[t] : begin[t + 1]]])
            carried.append(now)
        later = None  # scaled emissions and later evidence of the next stretch's first step
        for t0, t1, now in reversed(list(zip(borders, borders[1:], carried))):
            low, high = begin[t0], begin[t1]
            at = begin[t0 : t1 + 1] - low
            seen = table[packed[low:high]]
            alpha, scale = np.empty_like(seen), np.empty(high - low, dtype=np.float32)
            for k in range(t1 - t0):
                now, scale[at[k] : at[k + 1]] = ahead(now, t0 + k, seen[at[k] : at[k + 1]])
                alpha[at[k] : at[k + 1]] = now
            beta = np.ones_like(alpha)
            if later is not None:
                end = at[-2]
                beta[end : end + len(later)] = later @ back
                self.move += move * (alpha[end : end + len(later)].T @ later).astype(np.float64)
            seen /= scale[:, None]
            for k in range(t1 - t0 - 1, -1, -1):
                a, b = at[k], at[k + 1]
                seen[a:b] *= beta[a:b]
                if k:
                    beta[at[k - 1] : at[k - 1] + b - a] = seen[a:b] @ back
            inner = np.arange(at[1], high - low)
            step = np.searchsorted(at, inner, side="right") - 1
            before = at[step - 1] + inner - at[step]
            self.move += move * (alpha[before].T @ seen[inner]).astype(np.float64)
            later = seen[: at[1]].copy()
            gamma = alpha * beta
            gamma /= gamma.sum(axis=1, keepdims=True)
            if t0 == 0:
                self.start += gamma[: at[1]].sum(axis=0)
            for k in range(states):
                self.emit[:, k] += np.bincount(packed[low:high], weights=gamma[:, k], minlength=len(self.emit))
            self.log += float(np.log(scale.astype(np.float64)).sum())
            self.tokens += high - low


class Held:
    """Texts that wait for a full chunk, long ones apart from short ones, so
    that the steps of a chunk are wide."""

    def __init__(self, action) -> None:  # noqa: ANN001
        self.action = action
        self.lists: dict[bool, list[np.ndarray]] = {False: [], True: []}
        self.sizes = {False: 0, True: 0}

    def put(self, ids: np.ndarray) -> None:
        long = len(ids) > STRETCH
        self.lists[long].append(ids)
        self.sizes[long] += len(ids)
        if self.sizes[long] >= CHUNK_TOKENS * (4 if long else 1):
            self.flush(long)

    def flush(self, long: bool) -> None:
        if self.lists[long]:
            self.action(np.concatenate(self.lists[long]), np.array([len(x) for x in self.lists[long]], dtype=np.int64))
        self.lists[long], self.sizes[long] = [], 0

    def end(self) -> None:
        self.flush(False)
        self.flush(True)


class Model:
    """Tables of fixed size: start, moves, and emissions by symbol."""

    def __init__(self, shares: np.ndarray, states: int, group: np.ndarray | None = None):
        """Even tables, or emissions that lean to each symbol's group."""
        self.shares = shares / shares.sum()
        self.start = np.full(states, 1 / states)
        self.move = np.full((states, states), 0.5 / max(states - 1, 1))
        np.fill_diagonal(self.move, 0.5 if states > 1 else 1.0)
        lean = np.full((len(shares), states), 1 / states)
        if group is not None and states > 1:
            lean[:] = (1 - OWN) / (states - 1)
            lean[np.arange(len(shares)), group] = OWN
        self.emit = self.shares[:, None] * lean
        self.emit /= self.emit.sum(axis=0)

    def update(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        """The M step, with each state's emissions drawn to the overall shares."""
        self.start = (start + 1) / (start.sum() + len(start))
        self.move = (move + 0.1) / (move + 0.1).sum(axis=1, keepdims=True)
        self.emit = (emit + PRIOR * self.shares[:, None]) / (emit.sum(axis=0) + PRIOR)


def groups(near: np.ndarray, shares: np.ndarray, states: int, rounds: int = 25) -> np.ndarray:
    """A group of each symbol by its neighbours' slots (k-means weighted by the
    symbols' shares, on square roots of the slots' shares; begun from the
    symbols that lie farthest apart)."""
    rows = np.sqrt((near + near.sum(axis=0) / max(near.sum(), 1)) / (near.sum(axis=1, keepdims=True) + 1))
    weight = shares / shares.sum()
    heavy = np.argsort(-weight, kind="stable")[: 64 * states]
    picked = [heavy[0]]
    for _ in range(1, states):
        far = ((rows[heavy, None, :] - rows[picked][None, :, :]) ** 2).sum(axis=2).min(axis=1)
        picked.append(heavy[int((far * weight[heavy]).argmax())])
    centre = rows[picked]
    for _ in range(rounds):
        own = ((rows**2).sum(axis=1)[:, None] - 2 * rows @ centre.T + (centre**2).sum(axis=1)).argmin(axis=1)
        for k in range(states):
            mass = weight[own == k]
            if mass.sum() > 0:
                centre[k] = mass @ rows[own == k] / mass.sum()
    return own


# ---- the distributed steps


def count_words(docs: DataFrame, id_col: str, text_col: str, keep) -> DataFrame:  # noqa: ANN001
    """(word, c) over the rows where ``keep`` holds; the end counts as a word.

    Words are pre-counted per task in bounded tables, then added up by word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])

        seen: Counter = Counter()
        for batch in batches:
            for raw in batch.column(0):
                seen.update(words_of(raw.as_buffer().to_pybytes()))
                seen[END] += 1
                if len(seen) > FLUSH_WORDS:
                    yield out()
                    seen = Counter()
        if seen:
            yield out()

    texts = docs.filter(keep).select(F.encode(F.coalesce(text_col, F.lit("")), "UTF-8").alias("raw"))
    return texts.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """Symbols: the most frequent words, the classes of all others, the end."""

    def __init__(self, counts: DataFrame, top_words: int, classes: int):
        row = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"), F.sum((F.col("c") == 1).cast("long")).alias("n1"), F.sum((F.col("c") == 2).cast("long")).alias("n2"), F.sum(F.when(F.col("word") == F.lit(END), F.col("c"))).alias("end")).first()
        self.tokens, self.types, self.ends = row["n"] or 0, row["v"], row["end"] or 0
        ones, twos = row["n1"] or 0, row["n2"] or 0
        self.discount = min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones and twos else 0.5
        words = counts.filter(F.col("word") != F.lit(END))
        best = sorted(((int(r["c"]), bytes(r["word"])) for r in most_frequent(words, "c", top_words).collect()), key=lambda x: (-x[0], x[1]))  # top_words rows at most
        self.index = {word: i for i, (_, word) in enumerate(best)}
        self.counts = np.array([c for c, _ in best], dtype=np.int64)
        self.classes, self.top = classes, len(best)
        self.end = self.top + classes
        #: tail words of the counts, with their class
        self.tail = (words.filter(F.col("c") < best[-1][0]) if best else words).withColumn("class", self.class_of(F.col("word")))
        self.mass, self.kinds = np.zeros(classes, dtype=np.int64), np.zeros(classes, dtype=np.int64)
        for r in self.tail.groupBy("class").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():  # a row a class at most
            self.mass[r["class"]], self.kinds[r["class"]] = r["n"], r["v"]

    def class_of(self, word):  # noqa: ANN001, ANN201
        return (F.crc32(F.substring(word, -3, 3)) % self.classes).cast("int")

    @property
    def shares(self) -> np.ndarray:
        return np.concatenate([self.counts, self.mass, [self.ends]]) + 1.0


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str, text_col: str, train) -> DataFrame:  # noqa: ANN001
    """Staged: key, id, train, ids (32-bit symbols, the end last), tail words
    (blank-separated), n_tokens, and what the top words and the end give to
    n_known and to the sum of log10(c + 1)."""
    index, classes, top, end = vocabulary.index, vocabulary.classes, vocabulary.top, vocabulary.end
    logs = np.log10(np.concatenate([vocabulary.counts, np.zeros(classes), [vocabulary.ends]]) + 1.0)
    end_known = int(vocabulary.ends > 0)
    names = ["key", "id", "train", "ids", "tail", "n_tokens", "known", "logs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId() << 33, 0
        get = index.get
        kind: dict[bytes, int] = {}
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                some = batch.slice(k, 1024)
                ids, tails, sizes, known, sums = [], [], [], [], []
                for raw in some.column(2):
                    tokens = words_of(raw.as_buffer().to_pybytes())
                    row = list(map(get, tokens, repeat(-1)))
                    tail = [t for t, s in zip(tokens, row) if s < 0]
                    x = np.array([*row, end], dtype=np.int32)
                    if tail:
                        ends = []
                        for t in tail:
                            e = t[-3:]
                            s = kind.get(e)
                            if s is None:
                                s = kind[e] = top + crc32(e) % classes
                                if len(kind) > FLUSH_WORDS:
                                    kind.clear()
                            ends.append(s)
                        x[x < 0] = ends
                    ids.append(x.tobytes())
                    tails.append(b" ".join(tail))
                    sizes.append(len(x))
                    known.append(len(tokens) - len(tail) + end_known)
                    sums.append(float(logs[x].sum()))
                keys = pa.array(range(part + n, part + n + some.num_rows), pa.int64())
                n += some.num_rows
                yield pa.RecordBatch.from_arrays([keys, some.column(0), some.column(1), pa.array(ids, pa.binary()), pa.array(tails, pa.binary()), pa.array(sizes, pa.int64()), pa.array(known, pa.int64()), pa.array(sums, pa.float64())], names)

    kind_ = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.col(id_col).alias("id"), train.alias("train"), F.encode(F.coalesce(text_col, F.lit("")), "UTF-8").alias("raw"))
    return stage(read.mapInArrow(run, f"key long, id {kind_}, train boolean, ids binary, tail binary, n_tokens long, known long, logs double"), "lm-encoded", "zstd")


def by_symbol(encoded: DataFrame, columns: int, table) -> DataFrame:  # noqa: ANN001
    """(symbol, e0, e1, ...) of the tables that ``table`` makes of the texts of
    each task, added up."""
    names = ["symbol", *(f"e{k}" for k in range(columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = table(np.frombuffer(raw.as_buffer(), dtype=np.int32) for batch in batches for raw in batch.column(0))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), *(pa.array(rows[:, k].astype(np.float32)) for k in range(columns))], names)

    rows = encoded.select("ids").mapInArrow(run, "symbol int, " + ", ".join(f"{c} float" for c in names[1:]))
    return rows.groupBy("symbol").agg(*(F.sum(c).alias(c) for c in names[1:]))


def neighbour_counts(encoded: DataFrame, symbols: int) -> DataFrame:
    """How often each symbol has neighbours of each slot before and behind it.

    A frequent symbol's slot follows from a mix of its number, so the most
    frequent ones are spread over the slots.
    """

    def table(texts: Iterator[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        near = np.zeros(symbols * 2 * SLOTS)
        held, size = [], 0

        def count() -> None:
            flat = np.concatenate(held).astype(np.int64)
            last = np.cumsum([len(x) for x in held])[:-1] - 1
            slot = flat % SLOTS
            pair = np.ones(len(flat) - 1, dtype=bool)
            pair[last] = False  # the end of a text and the next one's begin
            a, b = flat[:-1][pair], flat[1:][pair]
            np.add(near, np.bincount(np.concatenate([b * 2 * SLOTS + slot[:-1][pair], a * 2 * SLOTS + SLOTS + slot[1:][pair]]), minlength=len(near)), out=near)

        for x in texts:
            held.append(x)
            size += len(x)
            if size >= 4 * CHUNK_TOKENS:
                count()
                held, size = [], 0
        if held:
            count()
        rows = near.reshape(symbols, -1)
        used = np.flatnonzero(rows.any(axis=1))
        return used, rows[used]

    return by_symbol(encoded, 2 * SLOTS, table)


def expected_counts(encoded: DataFrame, model: Model) -> DataFrame:
    """(symbol, e0, e1, ...) added up over all rows; symbol -1 holds the
    starts, -2 and below the moves from each state."""
    states, symbols = len(model.start), len(model.shares)

    def table(texts: Iterator[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        total = Expected(states, symbols)
        held = Held(lambda flat, lens: total.add(flat, lens, model.start, model.move, model.emit))
        for x in texts:
            held.put(x)
        held.end()
        used = np.flatnonzero(total.emit.sum(axis=1) > 0)
        return np.concatenate([[-1], -2 - np.arange(states), used]), np.vstack([total.start, total.move, total.emit[used]])

    return by_symbol(encoded, states, table)


def gathered(counts: DataFrame, label: str) -> np.ndarray:
    """A table by symbol on the driver: symbols by columns, a fixed size."""
    return stage(counts, label).toPandas().to_numpy(dtype=np.float64)


def train(encoded: DataFrame, shares: np.ndarray, states: int, iterations: int) -> Model:
    learn = encoded.filter("train")
    found = gathered(neighbour_counts(learn, len(shares)), "lm-neighbours")
    if not len(found):
        return Model(shares, states)
    near = np.zeros((len(shares), 2 * SLOTS))
    near[found[:, 0].astype(np.int64)] = found[:, 1:]
    model = Model(shares, states, groups(near, shares, states))
    for _ in range(iterations):
        start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros((len(shares), states))
        table = gathered(expected_counts(learn, model), "lm-expected")
        ids = table[:, 0].astype(np.int64)
        start[:] = table[ids == -1, 1:].sum(axis=0)
        move[-2 - ids[ids < -1]] = table[ids < -1, 1:]
        emit[ids[ids >= 0]] = table[ids >= 0, 1:]
        model.update(start, move, emit)
    return model


def score_texts(
    docs: DataFrame, held_out: int = 2, mod: int = 7, states: int = 8, top_words: int = 65536, tail_classes: int = 4096, iterations: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: id, held_out, n_tokens, n_known,
    train_tokens, base_score, score (log10).

    Learns from the rows whose id's crc32 remainder is not ``held_out``.  A
    null text is empty and has the end only; a null id counts as remainder 0
    and stays null; repeated rows are counted and scored each; an empty table
    gives none.  Without training rows the base is 0 and the tables are even.
    Extra columns are not read.
    """
    train_row = id_residue(F.col(id_col), mod) != held_out
    counts = stage(count_words(docs, id_col, text_col, train_row), "lm-counts")
    vocabulary = Vocabulary(counts, top_words, tail_classes)
    encoded = encode(docs, vocabulary, id_col, text_col, train_row)
    model = train(encoded, vocabulary.shares, states, iterations)

    kept = ["key", "id", "train", "n_tokens", "known", "logs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(raw.as_buffer(), dtype=np.int32) for raw in batch.column("ids")]
            log = forward(np.concatenate(ids), np.array([len(x) for x in ids], dtype=np.int64), model.start, model.move, model.emit) / np.log(10) if ids else []
            yield batch.select(kept).append_column("hmm", pa.array(log, pa.float64()))

    # the words behind the classes, joined by word: exact counts, no table to broadcast
    mass = [(k, float(np.log10(n)), float(np.log10(vocabulary.discount * v))) for k, (n, v) in enumerate(zip(vocabulary.mass.tolist(), vocabulary.kinds.tolist())) if n]
    spark = docs.sparkSession
    classes = F.broadcast(spark.createDataFrame(mass, "class int, log_mass double, log_unknown double"))  # tail_classes rows at most
    tail = encoded.filter(F.length("tail") > 0).select("key", F.explode(F.split(F.col("tail").cast("string"), " ")).alias("word")).withColumn("word", F.encode("word", "UTF-8"))
    found = tail.join(vocabulary.tail.select("word", "c"), "word", "left").withColumn("class", vocabulary.class_of(F.col("word"))).join(classes, "class", "left")
    share = F.when(F.col("c").isNotNull(), F.log10(F.col("c") - F.lit(vocabulary.discount)) - F.col("log_mass")).otherwise(F.coalesce(F.col("log_unknown") - F.col("log_mass"), F.lit(0.0)))
    rare = found.groupBy("key").agg(F.count("c").alias("rare_known"), F.sum(F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("rare_logs"), F.sum(share).alias("rare_share"))
    id_kind = docs.schema[id_col].dataType.simpleString()
    exact = encoded.select(*kept, "ids").mapInArrow(run, f"key long, id {id_kind}, train boolean, n_tokens long, known long, logs double, hmm double")
    total, size = vocabulary.tokens, float(np.log10(vocabulary.tokens + vocabulary.types + 1))
    rows = exact.join(rare, "key", "left")
    zero = F.lit(0.0)
    return rows.select(
        F.col("id").alias(id_col),
        (~F.col("train")).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("rare_logs", zero) - F.col("n_tokens") * F.lit(size)).alias("base_score"),
        (F.col("hmm") + F.coalesce("rare_share", zero)).alias("score"),
    )
