"""Answer keys by majority, and answers against keys. Null score: not gradeable; 0: blank or wrong."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def majority(votes: DataFrame, keys: list[str], value: str, voters: DataFrame | None = None) -> DataFrame:
    """Per key the value most voted for with its support, or null where the top is tied. ``voters`` adds keys without a vote, unresolved.
    Votes are counted before they move, so a key with most of the votes is no burden."""
    n = votes.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("support"))
    top = n.groupBy(*keys).agg(F.max("support").alias("support"))
    best = n.join(top, [*keys, "support"]).groupBy(*keys, "support").agg(F.count("*").alias("_n"), F.min(value).alias(value))
    best = best.select(*keys, F.when(F.col("_n") == 1, F.col(value)).alias(value), F.when(F.col("_n") == 1, F.col("support")).alias("support"), F.when(F.col("_n") > 1, "tied").alias("unresolved"))
    if voters is None:
        return best
    out = voters.select(*keys).distinct().join(best.withColumn("_has", F.lit(True)), keys, "left")
    return out.withColumn("unresolved", F.when(F.col("_has").isNull(), "no votes").otherwise(F.col("unresolved"))).drop("_has")


def dissent(votes: DataFrame, key: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Votes against the resolved value of their key."""
    k = key.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("agreed"))
    return votes.join(k, keys).where(F.col(value).isNotNull() & (F.col(value) != F.col("agreed")))


def graded(answers: DataFrame, key: DataFrame, keys: list[str], answer: str, max_points: float) -> DataFrame:
    """Adds ``score``: null without a key, full points for the key's letter, 0 for another one or none."""
    k = key.select(*keys, F.col("letter").alias("key_letter"))
    a = answers.join(k, keys, "left")
    right = F.coalesce(F.col(answer) == F.col("key_letter"), F.lit(False))
    return a.withColumn("score", F.when(F.col("key_letter").isNotNull(), F.when(right, F.lit(float(max_points))).otherwise(0.0)))


def cross_checked(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Two readings per key. ``first`` has answer, status, low_margin; ``second`` an answer. Two blanks agree. An ambiguous
    reading takes the other's answer; any reason asks for review."""
    s = second.select(*keys, F.col("answer").alias("other"), F.lit(True).alias("_has"))
    j = first.join(s, keys, "left")
    ambiguous, missing = F.col("status") == "ambiguous", F.col("_has").isNull()
    reasons = F.filter(
        F.array(
            F.when(ambiguous, "ambiguous"), F.when(F.coalesce(F.col("low_margin"), F.lit(False)), "low margin"),
            F.when(missing, "no second reading").when(~F.col("answer").eqNullSafe(F.col("other")), "readings differ"),
        ),
        lambda x: x.isNotNull(),
    )
    final = F.when(ambiguous & F.col("other").isNotNull(), F.col("other")).otherwise(F.col("answer"))
    return j.select(*keys, F.col("answer").alias("first_answer"), "other", final.alias("final_answer"), F.array_join(reasons, "; ").alias("reasons"), (F.size(reasons) > 0).alias("needs_review"))


#: Excess ink of a mark, margin in which it is doubtful, gap of filling by which one of two marks is taken back.
MARK, MARGIN, SOLID = 0.027, 0.005, 0.08


def resolved_rows(cells: DataFrame, sheet: str, row: str) -> DataFrame:
    """Cells (sheet, row, letter, ink, core_fill) to one row each: the lower half of a sheet's inks gives the ink of an empty box;
    what is well above it is a mark. One mark is the answer; of two, one much more filled is taken back; else ambiguous."""
    # a sheet has as many cells as its form, so it is one row for a moment, and its rows need no second shuffle
    cell = F.struct(F.col(row).alias("row"), F.col("letter").alias("letter"), F.col("ink").cast("double").alias("ink"), F.col("core_fill").cast("double").alias("core_fill"))
    g = cells.groupBy(sheet).agg(F.collect_list(cell).alias("c")).withColumn("_s", F.array_sort(F.transform("c", lambda x: x["ink"])))
    low = F.floor(F.size("_s") / 2).cast("int")
    at = lambda k: F.get("_s", k.cast("int"))
    base = F.when(low > 0, (at(F.floor((low - 1) / 2)) + at(F.floor(low / 2))) / 2).otherwise(0.0)
    c = g.select(sheet, base.alias("_base"), F.explode("c").alias("x")).select(sheet, F.col("x.row").alias(row), F.col("x.letter").alias("letter"), F.col("x.core_fill").alias("core_fill"), (F.col("x.ink") - F.coalesce("_base", F.lit(0.0))).alias("excess"))
    marked = F.when(F.col("excess") >= MARK, F.struct((-F.col("core_fill")).alias("light"), F.col("letter").alias("letter")))
    r = c.groupBy(sheet, row).agg(F.array_sort(F.collect_list(marked)).alias("m"), F.bool_or(F.abs(F.col("excess") - MARK) < MARGIN).alias("low_margin"))
    n = F.size("m")
    gap = F.when(n == 2, F.col("m")[1]["light"] - F.col("m")[0]["light"])
    took_back = F.coalesce(gap >= SOLID, F.lit(False))
    return r.select(
        sheet, row, F.when(n == 0, "blank").when((n == 1) | took_back, "answered").otherwise("ambiguous").alias("status"),
        F.when(n == 1, F.col("m")[0]["letter"]).when(took_back, F.col("m")[1]["letter"]).alias("answer"),
        F.when(took_back, F.col("m")[0]["letter"]).alias("cancelled"), (F.col("low_margin") | (took_back & (gap < SOLID + MARGIN))).alias("low_margin"),
    )


def bijective(pairs: DataFrame, key: str, left: str, right: str, n: int) -> DataFrame:
    """Per key whether ``n`` left values and ``n`` right ones stand in exactly one pair each."""
    return pairs.distinct().groupBy(key).agg(((F.count("*") == n) & (F.count_distinct(left) == n) & (F.count_distinct(right) == n)).alias("bijective"))
