"""Problem 6: documents laid out into windows of fixed capacity, neighbours in content together.

Four passes, each linear in the corpus.

1. Every text becomes its tokens and its terms (hash, times).
2. Document frequencies over all documents, in ``2**DF_BITS`` buckets of the term's hash, so that what the driver and
   the executors hold is bounded; terms that share a bucket share their frequency, which can only be too high.
3. The inverted index is sharded by content: a tree of principal directions, fitted on about ``SAMPLE`` documents drawn
   by a hash (nodes of ``LEAST_NODE`` and more, ``DEPTH`` levels at most), routes a projection of each document's weighted terms to a leaf. A leaf
   of more than ``SHARD`` documents is cut along further bits of the projection, and where those are equal by a hash of the id, so no
   shard grows with the corpus, whatever the texts are.
4. Each shard is an index with the corpus's frequencies and mean length. The longest unused document seeds a window, the index returns the
   unused documents of the shard by BM25, and each in turn that still fits is put in; a window is left when nothing fits any more.

A document longer than the capacity first fills whole windows; only its rest is packed. Documents without a token
(null or empty text) are in no window; a repeated document counts once. The price of linear work is that a neighbour in another shard is not seen:
the rows carry ``bm25`` of a member for its window's seed and ``bm25_mean``, the seed's mean over its shard, so that the gain can be read off.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import cut
from .tokens import VOCABULARY, counter
from .words import mixed

SHARD = 4096
DF_BITS, SAMPLE, DEPTH, DIMS, CODE_BITS = 20, 8192, 12, 64, 8
#: Sampled documents that make a node worth splitting.
LEAST_NODE = 64
#: Terms in more than this share of a shard's documents are scored as a matrix product, the others by their postings.
DENSE = 0.1
K1, B = 1.2, 0.75
SCHEMA = "window_name string, window_id string, doc_id long, piece int, start_token long, n_tokens long, capacity_tokens long, bm25 double, bm25_mean double"
_SIGNS = np.uint64(0xC2B2AE3D27D4EB4F)


def terms(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, n_terms, data): tokens and terms of each document; ``data`` holds the terms' 32-bit hashes, then how often each stands."""

    def run(batches):
        import xxhash

        c, seen = counter(vocabulary), {}
        for b in batches:
            ids, tokens, sizes, data = [], [], [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                chunks, counts = c.parts(text)
                d: dict[int, int] = {}
                for x in chunks:
                    h = seen.get(x)
                    if h is None:
                        h = xxhash.xxh32_intdigest(x.strip().encode("utf-8", "surrogatepass"))
                        if len(seen) < 400_000:
                            seen[x] = h
                    d[h] = d.get(h, 0) + 1
                ids.append(i), tokens.append(sum(counts)), sizes.append(len(d))
                data.append(np.fromiter(d, np.uint32, len(d)).tobytes() + np.fromiter(d.values(), np.uint32, len(d)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tokens, pa.int64()), pa.array(sizes, pa.int32()), pa.array(data, pa.binary())], names=["doc_id", "n_tokens", "n_terms", "data"])

    rows = docs.where("doc_id is not null and text is not null and text <> ''").select("doc_id", "text")
    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_terms int, data binary").dropDuplicates(["doc_id"])


def unpacked(data, sizes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Term hashes, times and the row of each, of several documents."""
    sizes = np.asarray(sizes, np.int64)
    both = np.frombuffer(b"".join(data), np.uint32)
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(row)) + np.repeat(np.concatenate([[0], np.cumsum(sizes)])[:-1], sizes)
    return both[at], both[at + sizes[row]], row


def frequencies(rows: DataFrame) -> np.ndarray:
    """Documents per bucket of terms, over all documents. Partial counts are made where the rows are; the result has ``2**DF_BITS`` numbers."""
    mask = (1 << DF_BITS) - 1

    def run(batches):
        n = np.zeros(1 << DF_BITS, np.int64)
        for b in batches:
            t, _, _ = unpacked(b.column(0).to_pylist(), b.column(1).to_numpy())
            np.add.at(n, t & mask, 1)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["bucket", "df"])

    got = rows.select("data", "n_terms").mapInArrow(run, "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(1 << DF_BITS, np.int64)
    out[got.column("bucket").to_numpy()] = got.column("df").to_numpy()
    return out


def inverse(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.log(1 + np.maximum(n_docs - df + 0.5, 0.5) / (df + 0.5)).astype(np.float32)


def vectors(data, sizes, idf: np.ndarray) -> np.ndarray:
    """Documents x ``DIMS``, of length 1: random signs of the terms summed with their weights."""
    sizes = np.asarray(sizes, np.int64)
    out = np.zeros((len(sizes), DIMS), np.float32)
    step = 256
    for i in range(0, len(sizes), step):
        t, f, row = unpacked(data[i : i + step], sizes[i : i + step])
        signs = np.unpackbits(mixed(t.astype(np.uint64), _SIGNS).view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32) * 2 - 1
        w = idf[t & np.uint32(len(idf) - 1)] * (f * (K1 + 1) / (f + K1)).astype(np.float32)
        out[i : i + step] = np.add.reduceat(signs * w[:, None], np.concatenate([[0], np.cumsum(sizes[i : i + step])[:-1]]), axis=0)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


class Router:
    """Tree of principal directions: per node a direction, a limit and its children; leaves carry a number and their sample's mean.
    A node of ``enough`` sampled documents or fewer is a leaf."""

    def __init__(self, sample: np.ndarray, enough: float):
        self.direction, self.limit, self.child, self.means = [], [], [], []
        self.enough = max(enough, LEAST_NODE)
        self.root = self._grow(sample, DEPTH)

    @staticmethod
    def _limit(along: np.ndarray) -> float:
        """Where two groups along a line are parted best: the least sum of squares within them, a fifth of all on either side."""
        x = np.sort(along.astype(np.float64))
        n, k = len(x), np.arange(1, len(x))
        s = np.cumsum(x)
        between = s[:-1] ** 2 / k + (s[-1] - s[:-1]) ** 2 / (n - k)
        a = max(n // 5, 1)
        k = a + int(np.argmax(between[a - 1 : n - a]))
        return float((x[k - 1] + x[k]) / 2)

    def _grow(self, x: np.ndarray, depth: int) -> int:
        mean = x.mean(0) if len(x) else np.zeros(DIMS, np.float32)
        if depth and len(x) > self.enough:
            way = np.linalg.eigh(np.cov((x - mean).T))[1][:, -1].astype(np.float32)
            along = x @ way
            limit = self._limit(along)
            low = along <= limit
            if low.any() and not low.all():
                me = len(self.direction)
                self.direction.append(way), self.limit.append(limit), self.child.append(None)
                self.child[me] = (self._grow(x[low], depth - 1), self._grow(x[~low], depth - 1))
                return me
        self.means.append(mean)
        return -len(self.means)

    def route(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaf and further bits of each vector."""
        leaf, code = np.zeros(len(v), np.int32), np.zeros(len(v), np.int32)
        stack = [(self.root, np.arange(len(v)))]
        while stack:
            node, at = stack.pop()
            if not len(at):
                continue
            if node < 0:
                leaf[at] = -node - 1
                code[at] = ((v[at, :CODE_BITS] > self.means[-node - 1][:CODE_BITS]) << np.arange(CODE_BITS)).sum(1)
                continue
            low = v[at] @ self.direction[node] <= self.limit[node]
            stack += [(self.child[node][0], at[low]), (self.child[node][1], at[~low])]
        return leaf, code


def _uniform(h) -> Column:
    """A hash as a number from 0 up to 1."""
    return F.shiftrightunsigned(h, 11) / F.lit(float(1 << 53))


def dealt(rows: DataFrame, df: np.ndarray, n_docs: int, shard: int) -> DataFrame:
    """``rows`` with the shard (leaf, part) of each document; a shard has about ``shard`` documents at most."""
    sc = rows.sparkSession.sparkContext
    idf = sc.broadcast(inverse(df, n_docs))

    def sampled(batches):
        for b in batches:
            v = vectors(b.column(1).to_pylist(), b.column(2).to_numpy(), idf.value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, (len(v) + 1) * DIMS, DIMS, dtype=np.int32)), pa.array(v.reshape(-1)))], names=["h", "v"])

    x = np.zeros((0, DIMS), np.float32)
    if n_docs > shard:
        # about SAMPLE documents, by a hash of the id; in order of it, so that the tree does not depend on the partitions
        some = rows.select(F.xxhash64("doc_id").alias("h"), "data", "n_terms").where(_uniform(F.xxhash64(F.lit(5), "doc_id")) < SAMPLE / n_docs)
        got = some.mapInArrow(sampled, "h long, v array<float>").toArrow().sort_by("h")
        x = np.array(got.column("v").to_pylist(), np.float32).reshape(-1, DIMS)
    router = Router(x, shard * len(x) / max(n_docs, 1))

    def run(batches):
        for b in batches:
            leaf, code = router.route(vectors(b.column(3).to_pylist(), b.column(2).to_numpy(), idf.value))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf), pa.array(code)], names=[*b.schema.names, "leaf", "code"])

    placed = rows.mapInArrow(run, "doc_id long, n_tokens long, n_terms int, data binary, leaf int, code int")
    # at most SAMPLE / LEAST_NODE * 5 leaves of 2**CODE_BITS codes, whatever the corpus
    n = placed.groupBy("leaf", "code").agg(F.count("*").alias("n"))
    every, upto = W.partitionBy("leaf"), W.partitionBy("leaf").orderBy("code")
    size = F.sum("n").over(every)
    n = n.withColumn("before", F.sum("n").over(upto) - F.col("n")).withColumn("room", size / F.ceil(size / shard))
    part = F.floor((F.col("before") + F.floor(_uniform(F.xxhash64(F.lit(6), "doc_id")) * F.col("n"))) / F.col("room")).cast("int")
    return placed.join(F.broadcast(n), ["leaf", "code"]).select("doc_id", "n_tokens", "n_terms", "data", "leaf", part.alias("part"))


class Index:
    """BM25 inverted index of a shard. ``t``, ``f``, ``row``: a term, how often and in which document; ``idf`` by term and ``mean`` length are the corpus's."""

    def __init__(self, t: np.ndarray, f: np.ndarray, row: np.ndarray, lengths: np.ndarray, idf: np.ndarray, mean: float):
        self.n = len(lengths)
        here = np.bincount(t, minlength=len(idf))
        more = here[t] > 1  # a term of one document finds no neighbour
        t, f, row = t[more], f[more].astype(np.float64), row[more]
        norm = K1 * (1 - B + B * lengths / max(mean, 1e-9))
        order = np.argsort(t, kind="stable")
        self.rows = row[order]
        self.weights = (idf[t] * f * (K1 + 1) / (f + norm[row]))[order]
        self.first = np.searchsorted(t[order], np.arange(len(idf) + 1))
        self.terms = np.split(t, np.searchsorted(row, np.arange(1, self.n)))
        common = np.flatnonzero(here > max(DENSE * self.n, 1))
        self.place = np.full(len(idf), -1)
        self.place[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), self.n), np.float32)
        for k, c in enumerate(common):
            a, b = self.first[c], self.first[c + 1]
            self.dense[k, self.rows[a:b]] = self.weights[a:b]

    def scores(self, queries: list[np.ndarray]) -> np.ndarray:
        """A row per query (distinct terms), a column per document."""
        has = np.zeros((len(queries), len(self.dense)), np.float32)
        rest = []
        for k, q in enumerate(queries):
            p = self.place[q]
            has[k, p[p >= 0]] = 1
            rest.append(q[p < 0])
        out = has @ self.dense
        for k, q in enumerate(rest):
            a, b = self.first[q], self.first[q + 1]
            if (size := b - a).sum():
                at = np.repeat(a - np.cumsum(size) + size, size) + np.arange(size.sum())
                out[k] += np.bincount(self.rows[at], self.weights[at], self.n)
        return out

    def every(self) -> np.ndarray:
        """Scores of all documents (columns) for each (rows)."""
        return np.concatenate([self.scores(self.terms[i : i + 256]) for i in range(0, self.n, 256)])


def fill(near: np.ndarray, rest: np.ndarray, room: int) -> list[int]:
    """The documents of ``near``, in order, that fit one after the other."""
    need = rest[near]
    got: list[int] = []
    at = 0
    while room and at < len(near):
        fits = need[at:] <= room
        k = int(fits.argmax())
        if not fits[k]:
            break
        at += k
        got.append(int(near[at]))
        room -= int(need[at])
        at += 1
    return got


def windows(sizes: np.ndarray, capacity: int, score: np.ndarray) -> list[list[int]]:
    """Documents' rests laid out into windows, the seed of each first; then the unused documents by the seed's ``score``, equal ones in order."""
    rest = sizes % capacity
    unused = rest > 0
    out = []
    for seed in np.argsort(-rest, kind="stable").tolist():
        if unused[seed]:
            unused[seed] = False
            room = capacity - int(rest[seed])
            near = np.flatnonzero(unused & (rest <= room))
            got = fill(near[np.argsort(-score[seed, near], kind="stable")], rest, room)
            unused[got] = False
            out.append([seed, *got])
    return out


def laid_out(docs: DataFrame, sizes: DataFrame, vocabulary: str = VOCABULARY, shard: int = SHARD) -> DataFrame:
    """A row per document piece: window, place, tokens and score. ``sizes`` (a handful of rows) has the windows' names and capacities."""
    capacities = [(r.window_name, int(r.capacity_tokens)) for r in sizes.where("capacity_tokens > 0").select("window_name", "capacity_tokens").distinct().orderBy("window_name").collect()]
    rows = cut(terms(docs, vocabulary))
    n_docs, mean = rows.agg(F.count("*"), F.coalesce(F.avg("n_tokens"), F.lit(0.0))).first()
    df = frequencies(rows)
    idf = docs.sparkSession.sparkContext.broadcast(inverse(df, n_docs))

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("doc_id", kind="stable")
        ids, n = pdf["doc_id"].to_numpy(np.int64), pdf["n_tokens"].to_numpy(np.int64)
        t, f, row = unpacked(pdf["data"].tolist(), pdf["n_terms"].to_numpy())
        known, local = np.unique(t, return_inverse=True)
        score = Index(local, f, row, n, idf.value[known & np.uint32(len(idf.value) - 1)], mean).every()
        usual = (score.sum(1) - np.diagonal(score)) / max(len(ids) - 1, 1)
        name = f"{pdf['leaf'].iloc[0]}.{pdf['part'].iloc[0]}"
        out = []
        for size, capacity in capacities:
            for d, k in zip(ids[n >= capacity].tolist(), (n[n >= capacity] // capacity).tolist()):
                out += [(size, f"d{d}.{j}", d, j, j * capacity, capacity, capacity, None, None) for j in range(k)]
            for w, members in enumerate(windows(n, capacity, score)):
                for m in members:
                    full = int(n[m]) // capacity
                    own = m == members[0]
                    out.append((size, f"{name}.{w}", int(ids[m]), full, full * capacity, int(n[m]) - full * capacity, capacity, None if own else float(score[members[0], m]), float(usual[members[0]])))
        return pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return dealt(rows, df, n_docs, shard).groupBy("leaf", "part").applyInPandas(run, SCHEMA)


def report(docs: DataFrame, sizes: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per window size: windows, documents, tokens, share of room filled, fewest windows that could hold the tokens, and how much better
    than a document of the shard the members score for their window's seed."""
    w = laid_out(docs, sizes, vocabulary).groupBy("window_name", "capacity_tokens", "window_id").agg(
        F.sum("n_tokens").alias("used"), F.count_if(F.col("piece") == 0).alias("first_pieces"), F.sum("bm25").alias("bm25"), F.sum(F.when(F.col("bm25").isNotNull(), F.col("bm25_mean"))).alias("usual"),
    )
    return w.groupBy("window_name", "capacity_tokens").agg(
        F.count("*").alias("n_windows"), F.sum("first_pieces").alias("n_docs"), F.sum("used").alias("n_tokens"),
        (F.sum("used") / (F.count("*") * F.first("capacity_tokens"))).alias("filled"), F.ceil(F.sum("used") / F.first("capacity_tokens")).alias("least_windows"),
        F.try_divide(F.sum("bm25"), F.sum("usual")).alias("score_to_mean"),
    )
