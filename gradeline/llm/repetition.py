"""Problem 8: the share of a document that says its own words again.

Words are the pieces between white space without punctuation around them, in lower case. A run of ``RUN``
words that already stood earlier in the document (overlapping itself or not) marks its words as repeated;
the share is marked words over all words. A document with fewer than ``RUN`` + 1 words, with empty text or
with null text has share 0 (null text: 0 words).

Shares are measured in one Arrow pass, document by document, in time linear in the words. Fixed cutoffs are
replaced by limits per language and source from mergeable quantile sketches of the shares: partial sketches
are built where the rows are, so a language and source with a third of all rows moves a few kilobytes.
"""

from __future__ import annotations

import unicodedata as ud

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut

RUN = 4
FOUND = 0.3
#: Sketch accuracy: rank error 1 / ACCURACY.
ACCURACY = 2000
UPPER, SPREAD = 0.75, 3.0


def bare(word: str) -> str:
    i, j = 0, len(word)
    while i < j and ud.category(word[i])[0] == "P":
        i += 1
    while j > i and ud.category(word[j - 1])[0] == "P":
        j -= 1
    return word[i:j].lower()


def repeated(ids: list[int], run: int = RUN) -> int:
    """Number of positions in a run of ``run`` ids that stood earlier."""
    seen: set[tuple[int, ...]] = set()
    covered = end = 0
    for i, gram in enumerate(zip(*(ids[k:] for k in range(run)))):
        if gram in seen:
            covered += i + run - max(end, i)
            end = i + run
        else:
            seen.add(gram)
    return covered


def shares(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, n_repeated, share); rows that are equal in all columns used come once."""

    def run(batches):
        for b in batches:
            ids: dict[str, int] = {}
            of: dict[str, int] = {"": -1}
            n, r = [], []
            for t in b.column(3).to_pylist():
                seq = []
                for w in (t or "").split():
                    k = ids.get(w)
                    if k is None:
                        x = bare(w)
                        k = ids[w] = of.setdefault(x, len(of))
                    if k >= 0:
                        seq.append(k)
                n.append(len(seq))
                r.append(repeated(seq) if len(seq) > RUN else 0)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(n, pa.int64()), pa.array(r, pa.int64())], names=["doc_id", "lang", "source", "n_words", "n_repeated"])

    out = docs.select("doc_id", "lang", "source", "text").mapInArrow(run, "doc_id long, lang string, source string, n_words long, n_repeated long")
    return out.distinct().withColumn("share", F.when(F.col("n_words") > 0, F.col("n_repeated") / F.col("n_words")).otherwise(F.lit(0.0)))


def limits(measured: DataFrame, most: float | None = None) -> DataFrame:
    """Per lang and source: the limit ``upper quartile + SPREAD * (upper quartile - median)``, at least one rank step
    above 0. With ``most``, no limit is above it, so a filter by the limits loses no share of ``most`` or more."""
    q = F.percentile_approx("share", F.array(F.lit(0.5), F.lit(UPPER)), F.lit(ACCURACY))
    out = measured.groupBy("lang", "source").agg(q.alias("q"), F.count("*").alias("n_docs"))
    limit = F.greatest(F.col("q")[1] + SPREAD * (F.col("q")[1] - F.col("q")[0]), F.lit(1.0 / ACCURACY))
    return out.select("lang", "source", "n_docs", (F.least(limit, F.lit(most)) if most is not None else limit).alias("limit"))


def with_limits(measured: DataFrame, most: float | None = None) -> DataFrame:
    """Adds ``limit`` to every document; null lang and source are groups of their own."""
    lim = limits(measured, most).select(F.col("lang").alias("l"), F.col("source").alias("s"), "limit")
    return measured.join(lim, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s"))).drop("l", "s")


def flagged(docs: DataFrame, most: float | None = None) -> DataFrame:
    """Documents at or above the limit of their lang and source."""
    return with_limits(cut(shares(docs)), most).where("share >= limit")


def found(docs: DataFrame) -> DataFrame:
    return flagged(docs, FOUND).where(F.col("share") >= FOUND).select("doc_id").distinct()


def report(docs: DataFrame) -> DataFrame:
    """Per lang and source: documents, words, repeated words, share of repeated words, the limit and documents beyond it."""
    return with_limits(cut(shares(docs))).groupBy("lang", "source").agg(
        F.count("*").alias("n_docs"), F.sum("n_words").alias("n_words"), F.sum("n_repeated").alias("n_repeated"),
        F.try_divide(F.sum("n_repeated"), F.sum("n_words")).alias("share"), F.first("limit").alias("limit"), F.count_if(F.col("share") >= F.col("limit")).alias("n_beyond"),
    )
