"""Word multisets by look, min-wise signatures and bit fingerprints, for problems 2 and 4.

A text's words are its pieces between white space, folded by look (``looks.fold``), without punctuation
around them. The k-th standing of a word is an element of its own, ``hash(word) + k * step``, so a set of
elements is a multiset of words and overlap of elements counts each word as often as both texts have it.
"""

from __future__ import annotations

import unicodedata as ud

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .looks import fold

STEP = np.uint64(0x9E3779B97F4A7C15)
THRESHOLD = 0.6


def bare(word: str) -> str:
    """Without punctuation around it."""
    i, j = 0, len(word)
    while i < j and ud.category(word[i])[0] == "P":
        i += 1
    while j > i and ud.category(word[j - 1])[0] == "P":
        j -= 1
    return word[i:j]


def words(text: str) -> list[str]:
    return [w for w in (bare(fold(x)) for x in text.split()) if w]


def elements(text: str, seen: dict[str, int]) -> np.ndarray:
    """Sorted 64-bit elements of the word multiset."""
    hs = []
    for x in text.split():
        h = seen.get(x)
        if h is None:
            w = bare(fold(x))
            h = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) if w else 0
            if len(seen) < 500_000:
                seen[x] = h
        if h:
            hs.append(h)
    a = np.sort(np.array(hs, np.uint64))
    if len(a) > 1:
        new = np.concatenate(([True], a[1:] != a[:-1]))
        at = np.arange(len(a))
        a = np.sort(a + (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64) * STEP)
    return a


def word_sets(texts: DataFrame) -> DataFrame:
    """(field, id, cls, toks): the elements of each record's text and a 128-bit hash of them, the class of exact
    copies by look. Records without a word are left out."""

    def run(batches):
        seen: dict[str, int] = {}
        for b in batches:
            toks = [elements(x, seen) for x in b.column(2).to_pylist()]
            keep = [k for k, t in enumerate(toks) if len(t)]
            toks = [toks[k] for k in keep]
            cls = [xxhash.xxh3_128_digest(t.tobytes()) for t in toks]
            flat = np.concatenate(toks).view(np.int64) if toks else np.zeros(0, np.int64)
            off = np.concatenate(([0], np.cumsum([len(t) for t in toks]))).astype(np.int32)
            at = pa.array(keep, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at), pa.array(cls, pa.binary()), pa.ListArray.from_arrays(pa.array(off), pa.array(flat))], names=["field", "id", "cls", "toks"]
            )

    return texts.where("id is not null and text is not null").select("field", "id", "text").mapInArrow(run, "field string, id string, cls binary, toks array<long>")


def classes(sets: DataFrame) -> DataFrame:
    """One row per (field, cls) with a 64-bit class number ``c``, its size and its elements. ``c`` is what candidate search moves; classes that share
    one are told apart by ``cls`` when their words are compared."""
    one = sets.groupBy("field", "cls").agg(F.first("toks").alias("toks"))
    return one.select("field", F.xxhash64("field", "cls").alias("c"), "cls", F.size("toks").alias("n"), "toks")


def seeds(k: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, k, dtype=np.uint64) | np.uint64(1)


def mixed(x: np.ndarray, s: np.uint64) -> np.ndarray:
    """A hash of 64-bit elements for one seed, well spread in its high bits."""
    y = (x ^ (x >> np.uint64(31))) * s
    y ^= y >> np.uint64(29)
    y *= np.uint64(0xBF58476D1CE4E5B9)
    return y ^ (y >> np.uint64(32))


def flat(b: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column."""
    c = b.column(b.schema.get_field_index(name))
    off = c.offsets.to_numpy()
    return c.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]].view(np.uint64), (off - off[0]).astype(np.int64)


def min_hashes(v: np.ndarray, off: np.ndarray, how: np.ndarray) -> np.ndarray:
    """Rows x functions; every row has an element."""
    out = np.empty((len(off) - 1, len(how)), np.uint64)
    for j, s in enumerate(how):
        out[:, j] = np.minimum.reduceat(mixed(v, s), off[:-1])
    return out


def band_keys(m: np.ndarray, rows: int) -> np.ndarray:
    """Records x bands: a key of each band of ``rows`` min-wise hashes, other for each band."""
    n, k = m.shape
    key = np.zeros((n, k // rows), np.uint64)
    for r in range(rows):
        key = mixed(key ^ m[:, r::rows][:, : k // rows], STEP)
    return key + np.arange(k // rows, dtype=np.uint64)[None, :] * STEP


def bitmaps(v: np.ndarray, off: np.ndarray, words64: int) -> np.ndarray:
    """Records x ``words64``: a bit per element."""
    out = np.zeros((len(off) - 1, words64), np.uint64)
    h = mixed(v, np.uint64(0xD6E8FEB86659FD93))
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    np.bitwise_or.at(out, (row, (h % np.uint64(words64)).astype(np.int64)), np.uint64(1) << (h >> np.uint64(58)))
    return out


def lists(a: np.ndarray) -> pa.ListArray:
    """A list column of the rows of a matrix."""
    n, k = a.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * k, k, dtype=np.int32)), pa.array(np.ascontiguousarray(a).reshape(-1).view(np.int64)))


def similarity(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(field_a, a, field_b, b, similarity) of distinct pairs of class numbers, exact: common elements over all elements. ``a`` and ``b`` come out as
    ``cls``. ``left`` and ``right`` have field, c, cls, toks."""
    side = lambda x, n: x.select(F.col("c").alias(n), *(F.col(k).alias(f"{k}_{n}") for k in x.columns if k != "c"))
    p = pairs.join(side(left, "a"), "a").join(side(right, "b"), "b")
    common = F.size(F.array_intersect("toks_a", "toks_b"))
    return p.select("field_a", F.col("cls_a").alias("a"), "field_b", F.col("cls_b").alias("b"), (common / (F.size("toks_a") + F.size("toks_b") - common)).alias("similarity"))
