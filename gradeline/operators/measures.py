"""Agreement and quality measures. A measure over no rows is null, never 0."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import scores as S, text as X


def question_gate(pairs: DataFrame, *by: str) -> DataFrame:
    """(system, reference, max_points) to mean absolute error, share within 1 and mean difference on a scale of ten."""
    scale = 10 / F.coalesce(F.nullif(F.col("max_points"), F.lit(0.0)), F.lit(10.0))
    d = (F.col("system") - F.col("reference")) * scale
    rows = pairs.where(F.col("system").isNotNull() & F.col("reference").isNotNull()).withColumn("d", d)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.abs("d")).alias("mae"), F.avg((F.abs("d") <= 1 + 1e-9).cast("double")).alias("within1"), F.avg("d").alias("signed"))


def total_gate(pairs: DataFrame, *by: str) -> DataFrame:
    """(system, reference) totals to correlation, mean absolute error, mean difference and equal ones; null totals are left out."""
    d = F.col("system") - F.col("reference")
    rows = pairs.where(F.col("system").isNotNull() & F.col("reference").isNotNull())
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), S.pearson(F.col("system"), F.col("reference")).alias("pearson"), F.avg(F.abs(d)).alias("mae_total"), F.avg(d).alias("signed"), F.count_if(F.abs(d) < 1e-9).alias("exact"),
    )


def transcription_gate(results: DataFrame, *by: str) -> DataFrame:
    """Per model: rows, usable rows, parse rate, error rows, errors of overload that no retry handled, typical tokens of calls
    that were made, succeeded and used tokens."""
    failed = F.coalesce(F.size("errors"), F.lit(0)) > 0
    text = X.first_text("hebrew_text", "interleaved_markdown") != ""
    overload = F.size(F.filter(F.coalesce("errors", F.array().cast("array<string>")), lambda e: e.contains("503") & ~F.lower(e).contains("retry")))
    p, c = F.coalesce("prompt_tokens", F.lit(0)), F.coalesce("candidate_tokens", F.lit(0))
    paid = ~failed & ~F.coalesce("cache_hit", F.lit(False)) & (F.coalesce("ok", F.lit(False)) | text | (F.coalesce(F.size("math_latex"), F.lit(0)) > 0)) & ((p > 0) | (c > 0))
    rate = F.when((F.coalesce("latex_eval.total", F.lit(0)) > 0) & ~failed, F.coalesce("latex_eval.parse_rate", F.lit(0.0)))
    return results.groupBy(*by).agg(
        F.count("*").alias("n_results"), F.count_if(F.coalesce("ok", F.lit(False)) | (~failed & text)).alias("n_ok"), F.round(F.avg(rate), 4).alias("mean_parse_rate"),
        F.count_if(failed).alias("n_errors"), F.sum(F.greatest(overload, F.lit(0))).alias("n_unhandled_overload"),
        F.round(S.centre(F.when(paid, p)), 1).alias("typical_prompt_tokens"), F.round(S.centre(F.when(paid, c)), 1).alias("typical_candidate_tokens"), F.count_distinct("crop_id").alias("n_crops"),
    )


def agreed_truth(readings: DataFrame, reader: str, item: str, text: str, most_cer: float = 0.08, least_chars: int = 8) -> DataFrame:
    """(item, truth): provisional ground truth. Of the readings of an item by different readers, the two that differ least give the longer one, if their
    error rate is ``most_cer`` at most and one of them has ``least_chars`` characters of prose. ``readings`` has one row per item and reader."""
    r = readings.select(item, F.col(reader).alias("_r"), F.col(text).alias("_t"), X.prose(text).alias("_p"))
    pair = lambda n: r.select(item, *(F.col(c).alias(f"{c}{n}") for c in ("_r", "_t", "_p")))
    p = pair(1).join(pair(2), item).where("_r1 < _r2").withColumn("_cer", X.error_rate(F.col("_p1"), F.col("_p2")))
    p = p.where((F.col("_cer") <= most_cer) & (F.greatest(F.length("_p1"), F.length("_p2")) >= least_chars))
    longer = F.when(F.length("_p1") >= F.length("_p2"), F.col("_t1")).otherwise(F.col("_t2"))
    best = p.groupBy(item).agg(F.min(F.struct("_cer", "_r1", "_r2", longer.alias("truth"))).alias("_b"))
    return best.select(item, F.col("_b.truth").alias("truth"))


def truth_gate(results: DataFrame, truth: DataFrame, item: str, *by: str) -> DataFrame:
    """Per group: results of items in the ground truth without errors, and their mean character error rate; null where there is none."""
    t = results.where(F.coalesce(F.size("errors"), F.lit(0)) <= 0).join(truth, item)
    cer = X.error_rate(X.prose("truth"), X.prose(X.first_text("hebrew_text", "interleaved_markdown")))
    return t.groupBy(*by).agg(F.count("*").alias("n_with_truth"), F.round(F.avg(cer), 4).alias("mean_cer"))


#: What a model must reach to be used for transcription.
TRANSCRIPTION_LIMITS = {"mean_cer": ("<=", 0.08), "mean_parse_rate": (">=", 0.90), "n_unhandled_overload": ("<=", 0)}


def transcription_passes(results: DataFrame, truth: DataFrame, item: str, *by: str) -> DataFrame:
    """Transcription measures with ground truth and gates; without an error rate the whole does not pass."""
    m = transcription_gate(results, *by).join(truth_gate(results, truth, item, *by), list(by), "left").withColumn("n_with_truth", F.coalesce("n_with_truth", F.lit(0)))
    m = gates(m, TRANSCRIPTION_LIMITS)
    every = F.lit(True)
    for name in TRANSCRIPTION_LIMITS:
        every = every & F.col(f"{name}_pass")
    return m.withColumn("all_pass", every)


def gates(measures: DataFrame, limits: dict[str, tuple[str, float]]) -> DataFrame:
    """Adds a boolean per limit (``>=``, ``<=`` or ``abs<=``); a null measure does not pass."""
    for name, (op, limit) in limits.items():
        x = F.abs(name) if op == "abs<=" else F.col(name)
        measures = measures.withColumn(f"{name}_pass", F.coalesce(x >= limit if op == ">=" else x <= limit, F.lit(False)))
    return measures


def item_statistics(items: DataFrame, question: str, person: str, score: str, max_points: str) -> DataFrame:
    """Facility, correlation of the item with the person's other items, and top less bottom 27 % of persons by total. The percentiles are exact; Spark
    keeps them as counts per different total, of which an exam has few. (Planned by the specification, without a reference implementation.)"""
    x = items.where(F.col(score).isNotNull())
    x = x.join(x.groupBy(person).agg(F.sum(score).alias("_total")), person).withColumn("rest", F.col("_total") - F.col(score)).withColumn("share", F.try_divide(score, max_points))
    ends = x.groupBy(question).agg(F.percentile("rest", F.lit(0.27)).alias("_low"), F.percentile("rest", F.lit(0.73)).alias("_high"))
    return x.join(ends, question).groupBy(question).agg(
        F.count("*").alias("n"), F.avg("share").alias("facility"), S.pearson(F.col(score), F.col("rest")).alias("point_biserial"),
        (F.avg(F.when(F.col("rest") >= F.col("_high"), F.col("share"))) - F.avg(F.when(F.col("rest") <= F.col("_low"), F.col("share")))).alias("discrimination"),
    )
