"""Problem 4: groups of near copies, by a forest of signature trees.

Records of equal word multiset become one class. Every class carries a bitmap of its words and its size.
Classes are routed to coarse leaf groups, ``BANDS`` groups each, keyed by ``ROWS`` min-wise word hashes; a
pair of similarity 0.6 shares none of its groups with probability (1 - 0.6**3)**32 = 0.0004, one of 0.7
with 2e-6. Each group is a signature tree: leaves of ``LEAF`` classes under nodes with the OR of their
bitmaps and the range of their sizes. A dual traversal from the root opens a pair of nodes only if the most
words that they can have in common would still reach the threshold. What comes through is verified on
the words themselves, so no false pair comes out.

A single global tree cannot give the result: texts here share many frequent words, the OR of a few
thousand bitmaps is all ones, and the traversal becomes a comparison of all pairs. Hence the routing.

A group of over ``HOT`` classes is not held in one task: its members are split by size, in bins as wide as the sizes of a pair can differ, and
within a bin into blocks by hash; every pair of blocks of one bin or of two next to each other is a task of its own. Texts that are empty, null or without a word are in no group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words as T
from .common import cut

ROWS, BANDS, BITS64, LEAF, FAN, HOT = 3, 32, 4, 16, 8, 8192
SMALL = 32
CHUNK = 400_000
FIELDS = (("curated_cases", "curated_cases.transcript", "id", "transcript"), ("transcriber", "transcriber.interleaved_markdown", "transcript_id", "interleaved_markdown"))


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=-1, dtype=np.int32)


def may_match(common: np.ndarray, least_a: np.ndarray, least_b: np.ndarray, most_a: np.ndarray, most_b: np.ndarray, least: float) -> np.ndarray:
    """Whether ``common`` words in common at most can reach the similarity for sizes in these ranges."""
    o = np.minimum(common, np.minimum(most_a, most_b))
    # with o words in common neither size is under o
    a, b = np.maximum(least_a, o), np.maximum(least_b, o)
    return o >= least * (a + b - o) - 1e-9


class Tree:
    """Levels of (bitmap OR, least size, most size, most words beyond bits), leaves' records first."""

    def __init__(self, bits: np.ndarray, size: np.ndarray):
        self.order = np.lexsort((*bits.T, size))
        bits, size = bits[self.order], size[self.order]
        self.levels = [(bits, size, size, size - popcount(bits))]
        width = LEAF
        while len(self.levels[-1][0]) > 1:
            b, lo, hi, x = self.levels[-1]
            at = np.arange(0, len(b), width)
            self.levels.append((np.bitwise_or.reduceat(b, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(x, at)))
            width = FAN

    def open(self, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First child and number of children of nodes of a level."""
        width = LEAF if level == 1 else FAN
        first = node * width
        return first, np.minimum(width, len(self.levels[level - 1][0]) - first)


def _meet(s: Tree, t: Tree, ls: int, lt: int, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    ba, la, ha, xa = (x[a] for x in s.levels[ls])
    bb, lb, hb, xb = (x[b] for x in t.levels[lt])
    if ls == lt == 0:
        common = np.minimum(la - popcount(ba & ~bb), lb - popcount(bb & ~ba))
    else:
        common = popcount(ba & bb) + np.minimum(xa, xb)
    return may_match(common, la, lb, ha, hb, least)


def dual(s: Tree, t: Tree, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of record positions that the traversal of two trees leaves; of one tree with itself each pair once."""
    same = s is t
    zero = np.zeros(1, np.int64)
    stack = [(len(s.levels) - 1, len(t.levels) - 1, zero, zero)]
    while stack:
        ls, lt, a, b = stack.pop()
        keep = _meet(s, t, ls, lt, a, b, least)
        a, b = a[keep], b[keep]
        if not len(a):
            continue
        if ls == lt == 0:
            yield s.order[a], t.order[b]
            continue
        if len(a) > CHUNK // (LEAF * LEAF):
            h = len(a) // 2
            stack += [(ls, lt, a[:h], b[:h]), (ls, lt, a[h:], b[h:])]
            continue
        one = np.zeros(len(a), np.int64)
        (fa, na), (fb, nb) = s.open(ls, a) if ls else (a, one + 1), t.open(lt, b) if lt else (b, one + 1)
        n = na * nb
        at = np.repeat(np.arange(len(a)), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        ca, cb = fa[at] + k // nb[at], fb[at] + k % nb[at]
        ls, lt = max(ls - 1, 0), max(lt - 1, 0)
        if same:
            ok = ca < cb if ls == 0 else ca <= cb
            ca, cb = ca[ok], cb[ok]
        stack.append((ls, lt, ca, cb))


def small_groups(start: np.ndarray, n: np.ndarray, bits: np.ndarray, size: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same for many groups of one leaf or two, side by side."""
    for d in range(1, int(n.max(initial=0))):
        g = n > d
        m = n[g] - d
        a = np.repeat(start[g], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        b = a + d
        ok = np.minimum(size[a], size[b]) >= least * np.maximum(size[a], size[b])
        a, b = a[ok], b[ok]
        common = np.minimum(size[a] - popcount(bits[a] & ~bits[b]), size[b] - popcount(bits[b] & ~bits[a]))
        ok = may_match(common, size[a], size[b], size[a], size[b], least)
        yield a[ok], b[ok]


def _columns(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    get = lambda k: b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False)
    return get("key"), get("c"), get("n").astype(np.int32), np.stack([get(f"b{i}").view(np.uint64) for i in range(BITS64)], 1)


def _traverse(least: float, hot: int):
    """Groups of a partition sorted by key: pairs of classes, or of a group of over ``hot`` its key alone."""

    def flush(key, c, n, bits) -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        count = np.diff(np.append(at, len(key)))
        few = (count > 1) & (count <= SMALL)
        found = [(c[a], c[b]) for a, b in small_groups(at[few], count[few], bits, n, least)]
        for i in np.flatnonzero((count > SMALL) & (count <= hot)):
            s = slice(at[i], at[i] + count[i])
            t = Tree(bits[s], n[s])
            found += [(c[s][a], c[s][b]) for a, b in dual(t, t, least)]
        if found:
            yield batch(np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found]))
        if len(k := key[at[count > hot]]):
            yield batch(k, k, True)

    def batch(a, b, is_key=False) -> pa.RecordBatch:
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        cols = [pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1])), pa.array(np.full(len(both), is_key))]
        return pa.RecordBatch.from_arrays(cols, names=["a", "b", "hot"])

    def run(batches):
        held: list[tuple[np.ndarray, ...]] = []
        rows, passing = 0, None  # passing: the hot key whose further rows are not kept
        for b in batches:
            cols = _columns(b)
            if passing is not None:
                cols = tuple(x[cols[0] != passing] for x in cols)
            if not len(cols[0]):
                continue
            held.append(cols)
            rows += len(cols[0])
            if rows < CHUNK // 8:
                continue
            cols = tuple(np.concatenate(x) for x in zip(*held))
            last = int(np.searchsorted(cols[0], cols[0][-1]))
            if last:
                yield from flush(*(x[:last] for x in cols))
            held, rows = [tuple(x[last:] for x in cols)], len(cols[0]) - last
            if rows > hot:
                passing = held[0][0][-1]
                yield batch(held[0][0][:1], held[0][0][:1], True)
                held, rows = [], 0
        if held:
            yield from flush(*(np.concatenate(x) for x in zip(*held)))

    return run


def _blocks(least: float):
    """One pair of blocks of a hot group: the trees of both are traversed together."""

    def run(pdf):
        import pandas as pd

        bits = np.stack([pdf[f"b{i}"].to_numpy().view(np.uint64) for i in range(BITS64)], 1)
        c, n, mine = pdf["c"].to_numpy(), pdf["n"].to_numpy().astype(np.int32), pdf["own"].to_numpy()
        first, second = pdf["i"].iloc[0], pdf["j"].iloc[0]
        if first == second:
            t = Tree(bits, n)
            found = [(c[a], c[b]) for a, b in dual(t, t, least)]
        else:
            x, y = np.flatnonzero(mine == first), np.flatnonzero(mine == second)
            found = [(c[x][a], c[y][b]) for a, b in dual(Tree(bits[x], n[x]), Tree(bits[y], n[y]), least)] if len(x) and len(y) else []
        a = np.concatenate([p for p, _ in found]) if found else np.zeros(0, np.int64)
        b = np.concatenate([q for _, q in found]) if found else np.zeros(0, np.int64)
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def routed(cl: DataFrame) -> DataFrame:
    """(key, c, n, b0..b3): every class in each of its leaf groups."""
    how = T.seeds(ROWS * BANDS, 4)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            v, off = T.flat(b, "toks")
            keys = T.band_keys(T.min_hashes(v, off, how), ROWS)
            f = np.array([hash_field(x) for x in b.column(b.schema.get_field_index("field")).to_pylist()], np.uint64)
            bits = T.bitmaps(v, off, BITS64)
            c, n = b.column(b.schema.get_field_index("c")).to_numpy(), b.column(b.schema.get_field_index("n")).to_numpy()
            key = (keys ^ f[:, None]).reshape(-1).view(np.int64)
            cols = [pa.array(key), pa.array(np.repeat(c, BANDS)), pa.array(np.repeat(n, BANDS))]
            cols += [pa.array(np.repeat(bits[:, i], BANDS).view(np.int64)) for i in range(BITS64)]
            for k in range(0, len(key), 40_000):
                yield pa.RecordBatch.from_arrays([x.slice(k, 40_000) for x in cols], names=["key", "c", "n", *(f"b{i}" for i in range(BITS64))])

    return cl.select("field", "c", "n", "toks").mapInArrow(run, "key long, c long, n int, b0 long, b1 long, b2 long, b3 long")


def hash_field(x: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(x.encode())


def candidates(cl: DataFrame, least: float = T.THRESHOLD, hot: int = HOT) -> DataFrame:
    """Distinct class pairs (a < b) that some signature tree leaves."""
    rows = routed(cl)
    spark = cl.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = cut(rows.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_traverse(least, hot), "a long, b long, hot boolean").distinct())
    pairs = got.where("not hot").select("a", "b")
    if got.where("hot").isEmpty():
        return pairs
    found = rows.join(got.where("hot").select(F.col("a").alias("key")), "key", "left_semi")
    # sizes of a pair lie within ``least``, so they fall into one bin of that width or into two next to each other
    size = F.floor(F.log("n") * (1 - 1e-9) / -math.log(least)).cast("long")
    found = found.withColumn("bin", size)
    bins = found.groupBy("key", "bin").agg(F.ceil(F.count("*") / hot).cast("long").alias("blocks"))
    beside = lambda by, name: bins.select("key", (F.col("bin") + by).alias("bin"), F.col("blocks").alias(name))
    split = found.join(bins, ["key", "bin"]).join(beside(-1, "above"), ["key", "bin"], "left").join(beside(1, "below"), ["key", "bin"], "left")
    block = lambda bin_, k: bin_ * (1 << 24) + k
    k = F.pmod(F.xxhash64("c"), F.col("blocks"))
    split = split.withColumn("own", block(F.col("bin"), k))
    each = lambda n, f: F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col(n) - 1), f)).otherwise(F.array().cast("array<struct<i:bigint,j:bigint>>"))
    pair = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    meet = F.concat(
        each("blocks", lambda x: pair(F.least(F.col("own"), block(F.col("bin"), x)), F.greatest(F.col("own"), block(F.col("bin"), x)))),
        each("above", lambda x: pair(F.col("own"), block(F.col("bin") + 1, x))), each("below", lambda x: pair(block(F.col("bin") - 1, x), F.col("own"))),
    )
    split = split.withColumn("m", F.explode(meet)).select("key", "m.i", "m.j", "own", "c", "n", "b0", "b1", "b2", "b3")
    more = split.groupBy("key", "i", "j").applyInPandas(_blocks(least), "a long, b long")
    return pairs.unionByName(more).distinct()


def class_links(cl: DataFrame, least: float = T.THRESHOLD) -> DataFrame:
    """(field, a, b, similarity): classes (``cls``) of one field with different words whose similarity is ``least`` or more."""
    s = T.similarity(candidates(cl, least), *(cl.select("field", "c", "cls", "toks"),) * 2)
    return s.where((F.col("similarity") >= least - 1e-12) & (F.col("field_a") == F.col("field_b")) & (F.col("a") != F.col("b"))).select(F.col("field_a").alias("field"), "a", "b", "similarity")


def near_pairs(texts: DataFrame, least: float = T.THRESHOLD) -> DataFrame:
    """(field, id_a, id_b) with id_a < id_b: near copies, exact copies included."""
    sets = T.word_sets(texts)
    cl = cut(T.classes(sets))
    m = cut(sets.select("field", "id", "cls").distinct())
    links = class_links(cl, least).select("field", "a", "b")
    # a class of several records links to itself
    own = m.groupBy("field", "cls").agg(F.count("*").alias("k")).where("k > 1").select("field", F.col("cls").alias("a"), F.col("cls").alias("b"))
    x = links.unionByName(own).join(m.select("field", F.col("cls").alias("a"), F.col("id").alias("x")), ["field", "a"]).join(m.select("field", F.col("cls").alias("b"), F.col("id").alias("y")), ["field", "b"])
    return x.where("a <> b or x < y").select("field", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).where("id_a <> id_b").distinct()


def groups(texts: DataFrame, least: float = T.THRESHOLD) -> DataFrame:
    """One row per record with a word: its group, the least class (in hex) linked to it over any number of links, how many
    records the group has and how many classes of other words it is linked to itself. Alone, a record is its own group."""
    sets = T.word_sets(texts)
    cl = cut(T.classes(sets))
    node = F.concat(F.col("cls"), F.encode("field", "utf-8"))
    members = sets.select("field", "id", node.alias("node")).distinct()
    name = lambda x: F.concat(F.col(x), F.encode("field", "utf-8")).alias(x)
    links = cut(class_links(cl, least).select(name("a"), name("b")))
    degree = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n_links"))
    m = members.join(components(links), "node", "left").join(degree, "node", "left")
    m = m.select("field", "id", F.lower(F.hex(F.substring(F.coalesce("root", "node"), 1, 16))).alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    size = m.groupBy("field", "group_id").agg(F.count("*").alias("n_records"))
    return m.join(size, ["field", "group_id"]).select("field", "id", "group_id", "n_records", "n_links")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node with a link, by alternating large-star and small-star steps until nothing changes.
    Each step only regroups links and writes them to the checkpoint folder; none leaves the cluster."""
    e = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        e = cut(small.select("x.u", "x.v").where("u <> v").distinct())
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    roots = e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
