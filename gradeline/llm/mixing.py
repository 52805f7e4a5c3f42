"""Problem 7: one mixture of sources in which each has its target share of the tokens.

The mixture is as large as the scarcest source allows: the least of ``max_repeats * tokens / share`` over the
sources. A source's budget in tokens is its share of that; the budget is some whole rounds over all its documents and a
rest. The documents of the rest are those whose hash lies under the source's threshold. Thresholds come from
sums of tokens by source and hash bucket: the bucket where the running sum passes the rest is found, and only
that bucket is summed again by the next bits of the hash (``LEVELS``). Nothing is sorted, and only sums move.

Documents whose source is null or has no target are not used. A source with a target and no token cannot reach it: the other
targets are scaled up to sum to 1 among themselves, and the report shows it with share 0. A repeated row of a document counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .common import cut
from .tokens import VOCABULARY, counted

#: Hash bits per level; 12 + 14 + 14 bits part a billion documents.
LEVELS = (12, 14, 14)


def hashed(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens, h): h is a non-negative hash of the id of as many bits as the levels have."""
    bits = sum(LEVELS)
    return counted(docs, vocabulary).where("source is not null").withColumn("h", F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - bits))


def budgets(d: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, size, budget, rounds, rest): one row per source that has a target."""
    t = targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    size = d.groupBy("source").agg(F.sum("tokens").alias("size"))
    b = t.join(size, "source", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    every = W.partitionBy(F.lit(1))  # a row per source of the targets
    b = b.withColumn("share", F.when(F.col("size") > 0, F.col("target_share") / F.sum(F.when(F.col("size") > 0, F.col("target_share"))).over(every)).otherwise(0.0))
    total = F.min(F.when(F.col("size") > 0, F.col("max_repeats") * F.col("size") / F.col("share"))).over(every)
    b = b.withColumn("budget", F.floor(F.coalesce(total * F.col("share"), F.lit(0.0)) + 1e-6))
    rounds = F.when(F.col("size") > 0, F.least(F.expr("budget div greatest(size, 1)"), F.col("max_repeats"))).otherwise(0).cast("int")
    return b.withColumn("rounds", rounds).withColumn("rest", F.when(F.col("rounds") < F.col("max_repeats"), F.col("budget") - F.col("rounds") * F.col("size")).otherwise(0))


def thresholds(d: DataFrame, b: DataFrame) -> DataFrame:
    """(source, threshold): documents with h under it fit into the rest together."""
    bits = sum(LEVELS)
    now = b.select("source", F.col("rest").alias("room"), F.lit(0).cast("long").alias("prefix"))
    done = 0
    for level in LEVELS:
        done += level
        inside = d.join(now, "source").where(F.shiftright("h", bits - done + level) == F.col("prefix")) if done > level else d.join(now, "source")
        sums = inside.groupBy("source", "room", "prefix", F.shiftright("h", bits - done).alias("bucket")).agg(F.sum("tokens").alias("n"))
        upto = W.partitionBy("source").orderBy("bucket")  # buckets of one prefix: bounded
        run = sums.withColumn("upto", F.sum("n").over(upto))
        over = run.groupBy("source", "room", "prefix").agg(
            F.min(F.when(F.col("upto") > F.col("room"), F.struct("bucket", (F.col("room") - F.col("upto") + F.col("n")).alias("left"), (F.col("upto") - F.col("room")).alias("above")))).alias("o")
        )
        if done == bits:  # the last bucket is in if that is nearer to the budget than without it
            over = over.withColumn("o", F.when(F.col("o.above") < F.col("o.left"), F.struct((F.col("o.bucket") + 1).alias("bucket"), F.col("o.left"), F.col("o.above"))).otherwise(F.col("o")))
        # no bucket passes: all of the prefix fits and the threshold is the prefix's end
        end = (F.shiftleft(F.col("prefix") + 1, level)).cast("long")
        got = over.select("source", F.coalesce("o.left", F.lit(0)).alias("room"), F.coalesce("o.bucket", end).alias("prefix"))
        # a source without documents under its prefix keeps it
        now = now.select("source", F.col("prefix").alias("p"), F.col("room").alias("r")).join(got, "source", "left").select(
            "source", F.coalesce("room", F.lit(0)).alias("room"), F.coalesce(F.col("prefix"), F.shiftleft("p", level)).cast("long").alias("prefix")
        )
        now = cut(now)
    return now.select("source", F.col("prefix").alias("threshold"))


def mixture(docs: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens, copies): the documents of the mixture and how often each is used."""
    d = cut(hashed(docs, vocabulary))
    b = cut(budgets(d, targets))
    t = b.select("source", "rounds").join(thresholds(d, b), "source")
    copies = F.col("rounds") + (F.col("h") < F.col("threshold")).cast("int")
    return d.join(t, "source").select("doc_id", "source", "tokens", copies.alias("copies")).where("copies > 0")


def report(docs: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per source with a target: tokens there are, tokens in the mixture, share reached, most copies of a document."""
    m = mixture(docs, targets, vocabulary).groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixture_tokens"), F.sum("tokens").alias("distinct_tokens"), F.max("copies").alias("most_copies"), F.count("*").alias("n_docs"))
    r = targets.select("source", "target_share", "max_repeats").join(m, "source", "left")
    every = W.partitionBy(F.lit(1))
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    share = F.coalesce(F.try_divide("mixture_tokens", F.sum("mixture_tokens").over(every)), F.lit(0.0))
    return r.select("source", "target_share", share.alias("actual_share"), "max_repeats", z("most_copies"), z("n_docs"), z("distinct_tokens"), z("mixture_tokens"))
