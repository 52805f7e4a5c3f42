"""Problem 2: records of the evaluation split that are also, exactly or almost, in the training split.

Every distinct word multiset of a split gets a fingerprint of ``HASHES * 8`` bits, a similarity hash: eight bits from each of as many min-wise hashes
of its words. The code is cut into ``HASHES / 4`` segments of 32 bits, and the splits are joined on segment and place; only class numbers move. Pairs
that meet go on if the lowest bits of their eights, ``HASHES`` bits of which about ``HASHES * (1 - s) / 2`` differ, lie within ``RADIUS``, and are
verified on their words. At similarity 0.6 no segment agrees with probability (1 - 0.6**4)**64 = 0.0001, and the distance exceeds the
radius, 4.5 standard deviations above its mean, with about 4e-6; both fall quickly above 0.6. Of two unrelated texts a segment agrees by chance
once in 2**32.

A segment that more than ``HOT`` training texts have is dealt to several tasks: its training texts are split, its held-out ones go to each part. Counts
by ``BUCKETS`` hashes of segments show whether there can be one.
Empty and null texts and texts without a word overlap with nothing. Copies within a split are one class and
meet the other split once. Extra columns of the tables are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words as T
from .common import cut

HASHES, RADIUS, HOT, BUCKETS = 256, 80, 8192, 1 << 16
LONGS = HASHES // 64


def coded(cl: DataFrame) -> DataFrame:
    """Classes with their fingerprint ``code`` and its lowest bits ``low``, as longs."""
    how = T.seeds(HASHES, 2)

    def run(batches):
        for b in batches:
            if b.num_rows:
                bits = (T.mixed(T.min_hashes(*T.flat(b, "toks"), how), T.STEP) >> np.uint64(40)).astype(np.uint8)
                low = np.packbits(bits & 1, axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, T.lists(bits.view(np.uint64)), T.lists(low.view(np.uint64))], names=[*b.schema.names, "code", "low"])

    return cl.select("field", "c", "cls", "toks").mapInArrow(run, "field string, c long, cls binary, toks array<long>, code array<long>, low array<long>")


def segments(cl: DataFrame, name: str) -> DataFrame:
    """(block, name): every class under each 32-bit segment of its code; the block is the segment's place and bits."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                code, _ = T.flat(b, "code")
                s = code.view(np.uint32).reshape(b.num_rows, -1).astype(np.uint64)
                s |= np.arange(s.shape[1], dtype=np.uint64)[None, :] << np.uint64(32)
                yield pa.RecordBatch.from_arrays([pa.array(s.reshape(-1).view(np.int64)), pa.array(np.repeat(b.column(0).to_numpy(), s.shape[1]))], names=["block", name])

    return cl.select("c", "code").mapInArrow(run, f"block long, {name} long")


def candidates(t: DataFrame, h: DataFrame, hot: int = HOT) -> DataFrame:
    """(a, b): classes of the two splits that agree in a segment."""
    a, b = segments(t, "a"), segments(h, "b")
    bucket = F.pmod(F.xxhash64("block"), F.lit(BUCKETS))
    full = a.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).where(F.col("n") > hot)
    many = a.withColumn("bucket", bucket).join(F.broadcast(cut(full)), "bucket", "left_semi").groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") > hot)
    many = cut(many.select("block", F.ceil(F.col("n") / hot).cast("int").alias("parts")))
    if many.isEmpty():
        return a.join(b, "block").select("a", "b").distinct()
    few = a.join(many, "block", "left_anti").join(b, "block").select("a", "b")
    part = F.pmod(F.xxhash64("a"), F.col("parts")).cast("int")
    split = a.join(many, "block").withColumn("part", part).join(b.join(many, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))), ["block", "part"]).select("a", "b")
    return few.unionByName(split).distinct()


def split_texts(df: DataFrame, split: str) -> DataFrame:
    return df.where(F.col("id").isNotNull() & F.col("transcript").isNotNull()).select(F.lit(split).alias("field"), "id", F.col("transcript").alias("text"))


def overlaps(train: DataFrame, held: DataFrame, least: float = T.THRESHOLD, hot: int = HOT) -> DataFrame:
    """(train_id, held_id, similarity) of all overlaps between two tables with id and transcript."""
    sets = T.word_sets(split_texts(train, "t").unionByName(split_texts(held, "h")))
    cl = cut(coded(T.classes(sets)))
    t, h = cl.where("field = 't'"), cl.where("field = 'h'")
    side = lambda x, n: x.select(F.col("c").alias(n), F.col("low").alias(f"{n}_low"))
    distance = sum((F.bit_count(F.col("a_low")[i].bitwiseXOR(F.col("b_low")[i])) for i in range(LONGS)), F.lit(0))
    near = candidates(t, h, hot).join(side(t, "a"), "a").join(side(h, "b"), "b").where(distance <= RADIUS).select("a", "b").distinct()
    words = lambda x: x.select("field", "c", "cls", "toks")
    links = T.similarity(near, words(t), words(h)).where(F.col("similarity") >= least - 1e-12)
    m = cut(sets.select("field", "id", "cls").distinct())
    x = links.join(m.where("field = 't'").select(F.col("cls").alias("a"), F.col("id").alias("train_id")), "a")
    return x.join(m.where("field = 'h'").select(F.col("cls").alias("b"), F.col("id").alias("held_id")), "b").groupBy("train_id", "held_id").agg(F.max("similarity").alias("similarity"))


def pairs(train: DataFrame, held: DataFrame) -> DataFrame:
    p = overlaps(train, held)
    return p.select(F.least("train_id", "held_id").alias("id_a"), F.greatest("train_id", "held_id").alias("id_b")).distinct()


def report(train: DataFrame, held: DataFrame) -> DataFrame:
    """Per held-out ``set`` and ``source``: records, overlapping records, exact ones, pairs. A null stays a group of its own."""
    p = overlaps(train, held).groupBy("held_id").agg(F.count("*").alias("k"), F.max("similarity").alias("best"))
    rows = held.select(F.col("id").alias("held_id"), F.col("set"), F.col("source")).distinct()
    return (
        rows.join(p, "held_id", "left").groupBy("set", "source")
        .agg(F.count("*").alias("n_records"), F.count("k").alias("n_overlapping"), F.count_if(F.col("best") > 1 - 1e-12).alias("n_exact"), F.coalesce(F.sum("k"), F.lit(0)).alias("n_pairs"))
    )
