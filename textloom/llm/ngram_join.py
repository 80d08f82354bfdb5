"""N-gram Jaccard join by a token-group matrix.

Documents are sets of word shingles.  Equal sets are one class from the start.
Two sets that reach the similarity share a token of their prefixes (the
rarest quarter of each under one global order), so only sets with a shared
prefix token can link.  Those are partitioned into groups of similar sets (the
same lowest neighbour), cut to a bounded size; a group stores the union of its
members' tokens as the rows of a token-by-member matrix.

1. Pairs that share a token few others have are bounded twice without loss: by
   the places of their common prefix tokens, and by the parity bits of their
   tokens (bits that differ are tokens that differ).
2. Within each group, the matrix counts all overlaps at once; only a spanning
   forest of the links leaves the task.  The lowest neighbour and, where a
   neighbourhood fills several groups, a few pivots of it are guests in each
   and tie them together.
3. Where sets with a shared prefix token still lie in different components,
   each such set queries the other's group: if its overlap with the union
   cannot reach the bound the group stays closed, else it is opened and the
   members' overlaps are counted exactly.

Every linking pair shares a prefix token, so it is in one group, or is
connected already, or is queried in step 3: no link between components is
lost, and no step lists all pairs of a group.  (Pairs are listed only of sets
that share a token with few others.)

No task gathers the sets of a frequent token or of a large neighbourhood: their
rows are summed up before the shuffle, and the sums, a row a token or
neighbourhood, go back to them.

Tokens and sets are named by 64-bit hashes; for 10^9 different sets the odds
that any two are taken for one are below 3 %.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import most_frequent, narrow, stage

#: Multipliers of the rolling mix, odd.
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]
COUNT_TOKENS = 3_000_000
#: Tokens that the order puts last because they are frequent: at most so many, seen in so many texts.
MOST_HEAVY, LEAST_HEAVY = 400_000, 6
#: Pairs are formed within buckets of so many sets.
SMALL_BUCKET = 64
#: Tokens seen in more texts are summed up before they are shuffled.
HOT_TOKEN = 1024
GROUP_SETS, GROUP_TOKENS, PIVOTS = 256, 2_000_000, 8
#: A root's rows are spread over so many tasks when its least id is joined to them.
SALTS = 32
QUERY_SETS = 512
BITMAP_BITS = 25


def shingles(raw: bytes, width: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes of a UTF-8 text, A-Z in lower case."""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = len(h) - width + 1
    x = h[:n] * _MIX[0]
    for k in range(1, width):
        x ^= x >> np.uint64(29)
        x *= _MIX[k % len(_MIX)]
        x += h[k : k + n]
    x ^= x >> np.uint64(32)
    x *= _MIX[0]
    x ^= x >> np.uint64(29)
    return np.unique(x)


def needed(n: int, percent: int) -> int:
    """Least overlap of a set of n with any set that links with it."""
    return -(-percent * n // 100)


def prefix(tokens: np.ndarray, percent: int, heavy: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, int]:
    """The first n - needed(n) + 1 tokens: unlisted ones by hash, then listed
    ones by frequency; and how many of them come before the hot ones."""
    n = len(tokens)
    size = n - needed(n, percent) + 1
    if not len(heavy):
        return tokens[:size], size
    at = np.minimum(np.searchsorted(heavy, tokens), len(heavy) - 1)
    df = np.where(heavy[at] == tokens, weight[at], 0)
    if not df.any():
        return tokens[:size], size
    order = np.lexsort((tokens, df))[:size]
    return tokens[order], int(np.searchsorted(df[order], HOT_TOKEN, side="right"))


def parities(tokens: np.ndarray) -> bytes:
    """Whether the tokens of each slot are odd in number; two to four slots a token."""
    slots = 1 << max(6, (2 * len(tokens) - 1).bit_length())
    odd = np.bincount((tokens & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differing(a: bytes, b: bytes) -> int:
    """At least how many tokens are in one set only, by the parities of both.

    Slots are the low bits of a token, so the longer row folds to the shorter.
    """
    x, y = (np.frombuffer(r, dtype=np.uint64) for r in (a, b))
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


class Group:
    """Token union of some sets, with the members that hold each token."""

    def __init__(self, sets: list[np.ndarray]):
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        self.sizes = np.array([len(s) for s in sets])
        self.members = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.union, self.begin = np.unique(flat[order], return_index=True)
        self.begin = np.append(self.begin, len(flat))

    def rows(self, query: np.ndarray) -> np.ndarray:
        """Rows of the matrix whose token the query holds."""
        at = np.minimum(np.searchsorted(self.union, query), len(self.union) - 1)
        return at[self.union[at] == query]

    def links(self, query: np.ndarray, percent: int) -> np.ndarray:
        """Members that link with ``query``; none if the union's bound fails."""
        rows = self.rows(query)
        if len(rows) < needed(len(query), percent):
            return rows[:0]
        lens = self.begin[rows + 1] - self.begin[rows]
        flat = np.arange(int(lens.sum())) + np.repeat(self.begin[rows] - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens)
        overlap = np.bincount(self.members[flat], minlength=len(self.sizes))
        return np.flatnonzero(100 * overlap >= percent * (len(query) + self.sizes - overlap))


def forest(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Spanning forest of the links among ``sets``."""
    group = Group(sets)
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i, query in enumerate(sets):
        for j in group.links(query, percent):
            a, b = root(i), root(int(j))
            if a != b:
                parent[a] = b
                out.append((i, int(j)))
    return out


# ---- distributed steps


def _raw(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.encode(F.coalesce(text_col, F.lit("")), "UTF-8").alias("raw"))


def heavy_tokens(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A bounded list of frequent tokens and their counts.

    Each task counts its own tokens and reports those it saw twice or more; the sums over tasks rank them.  The list only sets the order of
    tokens: any list gives the same links, a good one fewer candidates.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            token, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= 2
            return pa.RecordBatch.from_arrays([pa.array(token[often].view(np.int64)), pa.array(n[often].astype(np.int64))], ["token", "n"])

        held, size = [], 0
        for batch in batches:
            for raw in batch.column(0):
                held.append(shingles(raw.as_buffer().to_pybytes(), width))
                size += len(held[-1])
                if size >= COUNT_TOKENS:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    counts = docs.select("raw").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    best = most_frequent(stage(counts.filter(F.col("n") >= LEAST_HEAVY), "join-heavy"), "n", MOST_HEAVY).toArrow()
    token, n = best.column(0).to_numpy().view(np.uint64), best.column(1).to_numpy()
    order = np.argsort(token)
    return token[order], n[order]


def prefixes(docs: DataFrame, width: int, percent: int, kind: str) -> DataFrame:
    """Staged: id, node (hash of the set, null if empty), n, and the prefix
    with its number of tokens that are not hot, and the parities (null where
    the task has given those of an equal set)."""
    heavy, weight = heavy_tokens(docs, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()
        for batch in batches:
            nodes, sizes, fronts, cold, odd = [], [], [], [], []
            for raw in batch.column(1):
                s = shingles(raw.as_buffer().to_pybytes(), width)
                node = int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64)) if len(s) else None
                front, before, bits = None, None, None
                if node is not None and node not in given:
                    given.add(node)
                    if len(given) > COUNT_TOKENS:
                        given.clear()
                    tokens, before = prefix(s, percent, heavy, weight)
                    front, bits = tokens.view(np.int64), parities(s)
                for column, value in zip((nodes, sizes, fronts, cold, odd), (node, len(s), front, before, bits)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(fronts, pa.list_(pa.int64())), pa.array(cold, pa.int32()), pa.array(odd, pa.binary())], ["id", "node", "n", "prefix", "cold", "odd"])

    return stage(docs.mapInArrow(run, f"id {kind}, node long, n long, prefix array<long>, cold int, odd binary"), "join-prefix")


def contract(edges: DataFrame, label: str) -> DataFrame:
    """(node, root): the smallest node reachable over ``edges`` (a, b).

    Each round maps every node to its smallest neighbour and contracts the
    edges; the rounds' maps are chained at the end.  Rounds grow with the
    logarithm of the longest path; each is staged.
    """
    maps: list[DataFrame] = []
    live = stage(edges.filter("a <> b").distinct(), f"{label}-edges")
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("to")), f"{label}-map")
        maps.append(step)
        moved = live.join(step.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a").join(step.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
        live = stage(moved.select(F.col("ta").alias("a"), F.col("tb").alias("b")).filter("a <> b").distinct(), f"{label}-edges")
    if not maps:
        return edges.sparkSession.createDataFrame([], "node long, root long")
    out = maps[0].select("node", F.col("to").alias("root"))
    for step in maps[1:]:
        out = out.join(step.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return stage(out, f"{label}-roots")


def _sets(column: pd.Series) -> list[np.ndarray]:
    return [np.frombuffer(b, dtype=np.uint64) for b in column]


def shared_tokens(fronts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Staged: the prefix tokens that sets have in common.  (token, node, n,
    pos) of those that at most ``SMALL_BUCKET`` sets share, and (token, node,
    n, low: the token's least node) of the others.

    A token that is not hot is in about ``HOT_TOKEN`` prefixes at most, so its
    rows meet in one task.  The rows of hot ones are not gathered.
    """
    given = fronts.filter("prefix is not null")
    by_token = Window.partitionBy("token")
    # one shuffle: what follows is grouped by the token as well
    cold = given.select("node", "n", F.posexplode(F.slice("prefix", F.lit(1), F.col("cold"))).alias("pos", "token")).repartition("token")
    cold = cold.groupBy("token", "node", "n").agg(F.min("pos").alias("pos"))
    met = stage(cold.withColumn("sets", F.count(F.lit(1)).over(by_token)).withColumn("low", F.min("node").over(by_token)).filter("sets > 1"), "join-met")

    hot = given.select("node", "n", F.explode(F.slice("prefix", F.col("cold") + 1, F.size("prefix"))).alias("token")).distinct()
    hot = stage(hot, "join-hot")
    lows = hot.groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high").drop("high")
    often = met.filter(F.col("sets") > SMALL_BUCKET).select("token", "node", "n", "low").unionByName(hot.join(narrow(stage(lows, "join-lows")), "token").select("token", "node", "n", "low"))
    return met.filter(F.col("sets") <= SMALL_BUCKET).select("token", "node", "n", "pos"), stage(often, "join-often")


def close_pairs(rare: DataFrame, fronts: DataFrame, percent: int) -> DataFrame:
    """Staged (x, y, nx, ny): the pairs of sets that share a rare token and
    that neither bound rules out.

    Two sets have their c common prefix tokens in common and at most what
    follows the last of those in either.  And as they link only where at most
    (100 - percent) / (100 + percent) of both sizes differ, parities that
    differ in more places rule them out.  Pairs are formed only where at most
    ``SMALL_BUCKET`` sets share a token, so their number grows with the input.
    Two sets that also share a more frequent token are candidates by that one.
    """
    left, right = (rare.select("token", F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("pos").alias(f"p{c}")) for c in "xy")
    fits = (F.col("x") < F.col("y")) & (100 * F.col("nx") >= percent * F.col("ny")) & (100 * F.col("ny") >= percent * F.col("nx"))
    pairs = left.join(right, "token").filter(fits).groupBy("x", "y", "nx", "ny").agg(F.count(F.lit(1)).alias("c"), F.max("px").alias("px"), F.max("py").alias("py"))
    most = F.col("c") + F.least(F.col("nx") - F.col("px") - 1, F.col("ny") - F.col("py") - 1)
    placed = stage(pairs.filter((100 + percent) * most >= percent * (F.col("nx") + F.col("ny"))).select("x", "y", "nx", "ny"), "join-placed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nx, ny, ox, oy = (batch.column(k).to_pylist() for k in (2, 3, 4, 5))
            keep = [(100 + percent) * differing(a, b) <= (100 - percent) * (p + q) for p, q, a, b in zip(nx, ny, ox, oy)]
            yield batch.select(["x", "y", "nx", "ny"]).filter(pa.array(keep, pa.bool_()))

    asked = placed.select(F.col("x").alias("node")).unionByName(placed.select(F.col("y").alias("node"))).distinct()
    bits = fronts.filter("odd is not null").select("node", "odd").join(narrow(stage(asked, "join-paired")), "node").groupBy("node").agg(F.first("odd").alias("odd"))
    bits = stage(bits, "join-parities")
    both = placed.join(bits.select(F.col("node").alias("x"), F.col("odd").alias("ox")), "x").join(bits.select(F.col("node").alias("y"), F.col("odd").alias("oy")), "y")
    return stage(both.select("x", "y", "nx", "ny", "ox", "oy").mapInArrow(run, "x long, y long, nx long, ny long"), "join-close")


def grouped(close: DataFrame, often: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Staged: nodes (node, n, gid) and the guests (gid, node) of the groups.

    A group is a neighbourhood: the sets with the same lowest neighbour.  One
    that is too large is cut by classes of size and, within a class, by hash.
    """
    low = F.col("x").alias("low")
    neighbours = close.select(F.col("x").alias("node"), F.col("nx").alias("n"), low).unionByName(close.select(F.col("y").alias("node"), F.col("ny").alias("n"), low)).unionByName(often.select("node", "n", "low"))
    rung = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent))).cast("int") if percent < 100 else F.col("n")
    led = stage(neighbours.groupBy("node", "n").agg(F.min("low").alias("leader")).withColumn("rung", rung), "join-led")
    pivot = [F.min(F.when(F.pmod(F.xxhash64("node"), F.lit(PIVOTS)) == k, F.col("node"))).alias(f"p{k}") for k in range(PIVOTS)]
    count, load = F.count(F.lit(1)), F.sum("n")
    large = led.groupBy("leader").agg(count.alias("sets"), load.alias("load"), *pivot).filter((F.col("sets") > GROUP_SETS) | (F.col("load") > GROUP_TOKENS))
    large = stage(large.select("leader", F.array_compact(F.array(*(f"p{k}" for k in range(PIVOTS)))).alias("pivots")), "join-large")
    cut = led.join(narrow(large.select("leader")), "leader").groupBy("leader", "rung").agg(F.greatest(F.ceil(count / GROUP_SETS), F.ceil(load / GROUP_TOKENS)).cast("long").alias("parts"))
    cut = stage(cut, "join-cut")
    placed = led.join(narrow(cut), ["leader", "rung"], "left")
    piece = F.when(F.col("parts").isNull(), F.xxhash64("leader")).otherwise(F.xxhash64("leader", "rung", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts"))))
    nodes = stage(placed.select("node", "n", "leader", piece.alias("gid")), "join-nodes")
    groups = nodes.select("gid", "leader").distinct()
    wanted = groups.select("gid", F.col("leader").alias("node")).unionByName(groups.join(narrow(large), "leader").select("gid", F.explode("pivots").alias("node")))
    guests = wanted.join(nodes.select("node", F.col("gid").alias("home")), "node").filter("gid <> home").select("gid", "node").distinct()
    return nodes, stage(guests, "join-guests")


def link_components(spark: SparkSession, docs: DataFrame, fronts: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, root) of the nodes that link with another."""
    rare, often = shared_tokens(fronts)
    close = close_pairs(rare, fronts, percent)
    nodes, guests = grouped(close, often, percent)

    # the sets of those nodes: one document of each is read again, found by a bitmap of fixed size
    slot = F.expr(f"xxhash64(id) & {(1 << BITMAP_BITS) - 1}")
    firsts = fronts.filter("node is not null").groupBy("node").agg(F.min("id").alias("id")).join(nodes.select("node"), "node")
    bits = firsts.filter("id is not null").select(slot.alias("slot")).groupBy(F.expr("slot div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 as int)))").alias("mask"))
    marked = docs.withColumn("slot", slot).join(F.broadcast(stage(bits, "join-bits")), F.expr("slot div 64") == F.col("word"), "left")
    picked = marked.filter("id is null or shiftright(mask, cast(slot % 64 as int)) & 1 = 1").select("raw", "id")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, at = {}, []
            for k, raw in enumerate(batch.column(0)):
                s = shingles(raw.as_buffer().to_pybytes(), width).tobytes()
                node = int(np.uint64(xxhash.xxh3_64_intdigest(s)).view(np.int64))
                if s and node not in found:
                    found[node] = s
                    at.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), batch.column(1).take(pa.array(at, pa.int64())), pa.array(list(found.values()), pa.binary())], ["node", "id", "tokens"])

    # a set may come twice (equal texts in the bitmap); later steps take it once
    sets = picked.mapInArrow(again, f"node long, id {docs.schema['id'].dataType.simpleString()}, tokens binary")
    sets = stage(sets.join(narrow(nodes.select("node", "gid")), "node").select("node", "gid", "tokens"), "join-sets")

    # within the groups, with the pivots of the neighbourhood in each
    def inside(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates("node").sort_values("node")
        ids = frame["node"].to_numpy()
        pairs = forest(_sets(frame["tokens"]), percent) if len(ids) > 1 else []
        return pd.DataFrame({"a": [ids[i] for i, _ in pairs], "b": [ids[j] for _, j in pairs]}, dtype="int64")

    guests = narrow(guests)
    members = sets.select("gid", "node", "tokens").unionByName(sets.select("node", "tokens").join(guests, "node").select("gid", "node", "tokens"))
    first_edges = stage(members.groupBy("gid").applyInPandas(inside, "a long, b long"), "join-links")
    roots = contract(first_edges, "join-first")

    # across groups, where candidates still lie in different components:
    # pairs by themselves, sets with a frequent token in common by their groups
    home = nodes.select("node", "gid").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ends = [home.select(F.col("node").alias(c), F.col("gid").alias(f"gid{c}"), F.col("root").alias(f"root{c}")) for c in "xy"]
    apart = close.select("x", "y").join(ends[0], "x").join(ends[1], "y").filter("rootx <> rooty")
    apart = apart.select(F.col("x").alias("node"), F.col("rootx").alias("root"), F.col("gidy").alias("gid"))

    # the root with most sets of a token asks nobody: the others ask its groups
    placed = stage(often.select("token", "node", "n").join(home, "node"), "join-open")
    cells = placed.groupBy("token", "root").agg(F.count(F.lit(1)).alias("sets"))
    main = cells.groupBy("token").agg(F.max_by("root", F.struct("sets", "root")).alias("main"), F.count(F.lit(1)).alias("roots")).filter("roots > 1").select("token", "main")
    placed = placed.join(narrow(stage(main, "join-main")), "token")
    there = placed.groupBy("token", "gid").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("root").alias("low"), F.max("root").alias("high"), F.max(F.col("root") == F.col("main")).alias("has")).select("token", *(F.col(c).alias(f"g_{c}") for c in ("gid", "least", "most", "low", "high", "has")))
    other = (F.col("gid") != F.col("g_gid")) & (F.col("g_has") | (F.col("gid") < F.col("g_gid"))) & ~((F.col("g_low") == F.col("root")) & (F.col("g_high") == F.col("root")))
    fits = other & (100 * F.col("n") >= percent * F.col("g_least")) & (100 * F.col("g_most") >= percent * F.col("n"))
    wide = placed.filter("root <> main").join(there, "token").filter(fits).select("node", "root", F.col("g_gid").alias("gid"))
    ask = stage(apart.unionByName(wide).distinct(), "join-asked")

    load = ask.groupBy("gid").agg(F.ceil(F.count(F.lit(1)) / QUERY_SETS).cast("int").alias("parts"))
    questions = stage(ask.join(load, "gid").select("node", "root", "gid", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part")), "join-questions")
    asked = sets.select("node", "tokens").join(narrow(questions), "node")
    shelves = stage(home.join(load, "gid").select("node", "root", "gid", "parts"), "join-shelves")
    known = sets.select("node", "tokens").join(narrow(shelves), "node").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def across(queries: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(group):
            ids, root = group["g_node"].to_numpy(), group["g_root"].to_numpy()
            matrix = Group(_sets(group["g_tokens"]))
            for node, own, query in zip(queries["node"], queries["root"], _sets(queries["tokens"])):
                found = matrix.links(query, percent)
                seen = {own}
                for j in found:
                    if root[j] not in seen:  # one link for each component is enough
                        seen.add(root[j])
                        out.append((node, ids[j]))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    schema = "a long, b long"
    left = asked.select("gid", "part", "node", "root", "tokens")
    right = known.select(F.col("gid").alias("g"), F.col("part").alias("p"), *(F.col(c).alias(f"g_{c}") for c in ("node", "root", "tokens")))
    more = left.groupBy("gid", "part").cogroup(right.groupBy("g", "p")).applyInPandas(across, schema)
    more = stage(more, "join-more")
    if more.isEmpty():
        return roots
    return contract(first_edges.unionByName(more), "join-all")


def join_similar(docs: DataFrame, width: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (the smallest
    id that links reach, the row's own included).

    Sets link when 100 * intersection >= percent * union.  A null text and a
    text without words have an empty set, which links with nothing; fewer than
    ``width`` words are one shingle.  Rows that repeat an id and its text give
    a row each.  A null id stays null; its row counts for links, and its
    component is the smallest id that is not null, if there is one.  An empty
    table gives no rows; extra columns are not read.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    raw = _raw(docs, id_col, text_col)
    fronts = prefixes(raw, width, percent, kind)
    roots = link_components(spark, raw, fronts, width, percent)
    own = fronts.filter("node is not null").groupBy("node").agg(F.min("id").alias("id"))
    linked = stage(roots.join(own, "node"), "join-linked")
    # a row a root, times the salts: a root's nodes are not gathered
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")
    least = linked.groupBy("root").agg(F.min("id").alias("least")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = linked.withColumn("salt", salt).join(least, ["root", "salt"]).select("node", "least")
    alone = own.join(found, "node", "left_anti").select("node", F.col("id").alias("least"))
    out = fronts.select("id", "node", "n").join(found.unionByName(alone), "node", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"))
