"""Versioned stores without updates: events are appended, the state is derived by windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import text as X


def latest(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """The row of each key that comes last in ``order``; equal rows count as one."""
    w = W.partitionBy(*keys).orderBy(*(F.col(o).desc() if isinstance(o, str) else o for o in order))
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def with_state(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds ``derived_status``: the last of each key is current, earlier ones are superseded and kept."""
    last = rows.groupBy(*keys).agg(F.max(order).alias("_last"))
    return rows.join(last, keys).withColumn("derived_status", F.when(F.col(order) == F.col("_last"), "current").otherwise("superseded")).drop("_last")


def upsert(first: DataFrame, second: DataFrame, keys: list[str], *order) -> DataFrame:
    """Union in which rows of ``second`` win over rows of ``first`` with the same keys; rows with an empty key are dropped."""
    both = first.withColumn("_src", F.lit(0)).unionByName(second.withColumn("_src", F.lit(1)))
    some = [F.col(k).isNotNull() & (F.col(k).cast("string") != "") for k in keys]
    for c in some:
        both = both.where(c)
    return latest(both, keys, "_src", *order).drop("_src")


def proposals(events: DataFrame, key: str, content: str, order: str, approvals: DataFrame | None = None) -> DataFrame:
    """(key, content, version, first, n): versions by idempotent proposal. Content that is already proposed or approved under its key keeps its version; content
    whose version was superseded, which only an approved one is, by the approval of other content, gets a new one.

    ``approvals`` has the same columns and names what was approved when. Without approvals nothing is superseded, and proposals are counted
    before anything is ordered; with them, the events of each content are put in order."""
    e = events.select(F.col(key), F.col(content), F.col(order).alias("_at"))
    if approvals is None:
        lives = e.groupBy(key, content).agg(F.min("_at").alias("first"), F.count("*").alias("n"))
    else:
        a = approvals.select(F.col(key), F.col(content), F.col(order).alias("_at")).distinct()
        before = F.lag(content).over(W.partitionBy(key).orderBy("_at"))
        fallen = a.withColumn("_old", before).where(F.col("_old").isNotNull() & (F.col("_old") != F.col(content))).select(key, F.col("_old").alias(content), "_at")
        kind = lambda df, n: df.withColumn("_kind", F.lit(n))
        w = W.partitionBy(key, content).orderBy("_at", "_kind")
        log = kind(e, 2).unionByName(kind(a, 1)).unionByName(kind(fallen, 0)).withColumn("_last", F.lag("_kind").over(w))
        new = (F.col("_kind") == 2) & (F.col("_last").isNull() | (F.col("_last") == 0))
        lives = log.withColumn("_life", F.sum(new.cast("int")).over(w)).where("_kind = 2").groupBy(key, content, "_life").agg(F.min("_at").alias("first"), F.count("*").alias("n")).drop("_life")
    return lives.withColumn("version", F.row_number().over(W.partitionBy(key).orderBy("first", content)).cast("long")).select(key, content, "version", "first", "n")


def stale(current: DataFrame, approved: DataFrame, keys: list[str]) -> DataFrame:
    """Current rows whose hash differs from the approved one of their key; without an approved one none is stale."""
    a = approved.select(*keys, F.col("hash").alias("approved_hash"))
    return current.join(a, keys).where(~F.col("hash").eqNullSafe(F.col("approved_hash")))


def _judged(log: DataFrame, versions: DataFrame, key: str, version: str, faulty: DataFrame | None) -> DataFrame:
    known = versions.select(key, version).distinct().withColumn("_known", F.lit(True))
    j = log.join(known, [key, version], "left")
    j = j.join(faulty.select(key, version).distinct().withColumn("_bad", F.lit(True)), [key, version], "left") if faulty is not None else j.withColumn("_bad", F.lit(None).cast("boolean"))
    return j.withColumn("error", F.when(F.col("_known").isNull(), "unknown version").when(F.col("_bad"), "not valid")).drop("_known", "_bad")


def approval_errors(log: DataFrame, versions: DataFrame, key: str, version: str, faulty: DataFrame | None = None) -> DataFrame:
    """Approvals that cannot be: of a version never proposed, or of one in ``faulty``. They change nothing."""
    return _judged(log, versions, key, version, faulty).where("error is not null")


def approvals(log: DataFrame, versions: DataFrame, key: str, version: str, order: str, by: str | None = None, faulty: DataFrame | None = None) -> DataFrame:
    """State of every proposed version after a log of approvals: the one approved last is approved, others approved before are
    superseded, the rest is proposed; with when, and by whom if ``by`` names a column, it was approved last."""
    ok = _judged(log, versions, key, version, faulty).where("error is null")
    last = ok.groupBy(key, version).agg(F.max(F.struct(F.col(order).alias("at"), *([F.col(by).alias("by")] if by else []))).alias("_a"))
    newest = last.groupBy(key).agg(F.max("_a.at").alias("_newest"))
    v = versions.select(key, version).distinct().join(last, [key, version], "left").join(newest, key, "left")
    status = F.when(F.col("_a").isNull(), "proposed").when(F.col("_a.at") == F.col("_newest"), "approved").otherwise("superseded")
    return v.select(key, version, status.alias("status"), F.col("_a.at").alias("approved_at"), *([F.col("_a.by").alias("approved_by")] if by else []))


def admitted(spend: DataFrame, key: str, order: list[str], cost: str, budget: float) -> DataFrame:
    """Adds ``spent_before`` and ``admitted``: a call is refused once what was spent before it has reached the budget,
    so the last one may pass it. Per key, in order."""
    w = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum(cost).over(w), F.lit(0.0))
    return spend.withColumn("spent_before", before).withColumn("admitted", F.col("spent_before") < budget)


def pseudonyms(people: DataFrame, existing: DataFrame, key: str, secret: str = "") -> DataFrame:
    """(key, pseudonym) of every person: the one given before where there is one, else a keyed hash. A new name that another person has, given before or new, is made longer."""
    kept = existing.select(key, "pseudonym").dropDuplicates([key])
    new = people.where(F.col(key).isNotNull()).select(key).distinct().join(kept, key, "left_anti").withColumn("_name", X.pseudonym(key, secret))
    taken = kept.select(F.col("pseudonym").alias("_name")).unionByName(new.select("_name")).groupBy("_name").agg(F.count("*").alias("_n"))
    longer = F.concat("_name", F.lit("_"), F.upper(F.substring(F.sha2(F.concat(F.lit(secret), F.lit("/"), F.col(key)), 256), 1, 12)))
    made = new.join(taken, "_name").select(key, F.when(F.col("_n") > 1, longer).otherwise(F.col("_name")).alias("pseudonym"))
    return people.where(F.col(key).isNotNull()).select(key).distinct().join(kept.unionByName(made), key)


def pending(jobs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Jobs that are not done yet, each once; a run that was broken off goes on with them."""
    return jobs.dropDuplicates(keys).join(done.select(*keys), keys, "left_anti")
