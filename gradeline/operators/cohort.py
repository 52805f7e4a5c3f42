"""Cohort operators that the specification plans without a reference implementation."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window as W, functions as F

#: Rows of a block; a task multiplies one block of queries with one of rows.
BLOCK = 1024


def _stacked(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(ids, unit): up to ``BLOCK`` vectors of length 1 a row, as binary; rows stay where they are. Null and zero vectors, and those with a null in them, are left out."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                ids, v = b.column(0).slice(at, BLOCK).to_pylist(), b.column(1).slice(at, BLOCK).to_pylist()
                kept = [(i, x) for i, x in zip(ids, v) if i is not None and x and None not in x and any(x)]
                for size in sorted({len(x) for _, x in kept}):
                    some = [(i, x) for i, x in kept if len(x) == size]
                    m = np.array([x for _, x in some], np.float64)
                    m /= np.linalg.norm(m, axis=1, keepdims=True)
                    yield pa.RecordBatch.from_arrays([pa.array([np.array([i for i, _ in some], np.int64).tobytes()]), pa.array([m.tobytes()])], names=["ids", "unit"])

    return rows.select(F.col(key).cast("long"), vector).mapInArrow(run, "ids binary, unit binary")


def cosine_neighbours(vectors: DataFrame, key: str, vector: str, least: float, every: int = 50) -> DataFrame:
    """Queries are the rows whose id is divisible by ``every``, against all rows: (query_id, id, cosine) of at least ``least``, rounded to four digits.

    Queries are dealt into blocks of about ``BLOCK``, as many as their number asks for; rows are stacked where they are, and each stack meets each
    block of queries once, in one matrix product. Only matches leave. Null or zero vectors match nothing."""
    q = vectors.where(F.col(key) % every == 0)
    blocks = max(1, math.ceil(q.count() / BLOCK))
    asked = _stacked(q.repartition(blocks, F.xxhash64(key)), key, vector).withColumn("block", F.pmod(F.xxhash64("ids"), F.lit(blocks))).select("block", F.col("ids").alias("q_ids"), F.col("unit").alias("q_unit"))
    each = _stacked(vectors, key, vector).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for ids, unit, q_ids, q_unit in zip(*(c.to_pylist() for c in b.columns)):
                i, j = np.frombuffer(ids, np.int64), np.frombuffer(q_ids, np.int64)
                size, wide = len(unit) // len(ids), len(q_unit) // len(q_ids)
                if size != wide:
                    continue
                c = np.frombuffer(q_unit).reshape(len(j), -1) @ np.frombuffer(unit).reshape(len(i), -1).T
                y, x = np.nonzero(c >= least - 1e-4)
                yield pa.RecordBatch.from_arrays([pa.array(j[y]), pa.array(i[x]), pa.array(c[y, x])], names=["query_id", key, "cosine"])

    m = each.join(asked, "block").select("ids", "unit", "q_ids", "q_unit").mapInArrow(run, f"query_id long, {key} long, cosine double")
    return m.withColumn("cosine", F.round("cosine", 4)).where((F.col("cosine") >= least) & (F.col("query_id") != F.col(key)))


def derivations(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Adds to pairs of texts, such as the near copies of a search, ``edits`` and ``common``: the edit distance and the longest common subsequence of their words, and ``kept``,
    the share of the longer text that the common part makes up. Null texts have no words. Pairs come from elsewhere; none are made here."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            got = [compared((x or "").split(), (y or "").split()) for x, y in zip(b.column(b.schema.get_field_index(left)).to_pylist(), b.column(b.schema.get_field_index(right)).to_pylist())]
            more = [pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, "edits", "common", "kept"])

    return pairs.mapInArrow(run, f"{fields}, edits int, common int, kept double")


def compared(a: list[str], b: list[str]) -> tuple[int, int, float]:
    """(edit distance, length of the longest common subsequence, its share of the longer one) of two word lists."""
    import numpy as np

    ids: dict[str, int] = {}
    x, y = (np.array([ids.setdefault(w, len(ids)) for w in t], np.int64) for t in (a, b))
    if not len(x) or not len(y):
        return max(len(x), len(y)), 0, 1.0 if not len(x) and not len(y) else 0.0
    edits, common, at = np.arange(len(y) + 1), np.zeros(len(y) + 1, np.int64), np.arange(len(y) + 1)
    for i, w in enumerate(x, 1):
        same = y == w
        down = np.concatenate(([i], np.minimum(edits[1:] + 1, edits[:-1] + ~same)))
        edits = np.minimum.accumulate(down - at) + at  # insertions run along the row
        common = np.maximum.accumulate(np.maximum(common, np.concatenate(([0], common[:-1] + same))))
    return int(edits[-1]), int(common[-1]), float(common[-1] / max(len(x), len(y)))


def shared_anomalies(pairs: DataFrame, answers: DataFrame, person: str, question: str, answer: str, key: DataFrame) -> DataFrame:
    """(a, b, n_shared, score) of given pairs of persons: their equal wrong answers, each weighted by how few give it (log of persons over those who do), so that a
    common mistake says little. ``key`` has question and the right answer; blank answers are not shared."""
    k = key.select(question, F.col(answer).alias("_right"))
    wrong = answers.select(person, question, answer).distinct().join(k, question).where(F.col(answer).isNotNull() & (F.col(answer) != F.col("_right"))).drop("_right")
    n = answers.where(F.col(answer).isNotNull()).groupBy(question).agg(F.count_distinct(person).alias("_n"))
    weight = wrong.groupBy(question, answer).agg(F.count_distinct(person).alias("_k")).join(n, question).select(question, answer, F.log(F.col("_n") / F.col("_k")).alias("_w"))
    side = lambda c: wrong.select(F.col(person).alias(c), question, answer)
    both = pairs.select("a", "b").distinct().join(side("a"), "a").join(side("b"), ["b", question, answer]).join(weight, [question, answer])
    return both.groupBy("a", "b").agg(F.count("*").alias("n_shared"), F.sum("_w").alias("score"))


def clustered(vectors: DataFrame, key: str, vector: str, k: int, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(key, cluster) of every vector by k-means over all of them, and (cluster, n, share). Null vectors are in no cluster."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = vectors.where(F.col(vector).isNotNull()).select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    c = KMeans(k=k, seed=seed).fit(v).transform(v).select(key, F.col("prediction").alias("cluster"))
    n = c.groupBy("cluster").agg(F.count("*").alias("n"))
    every = W.partitionBy(F.lit(1))  # a row per cluster
    return c, n.withColumn("share", F.col("n") / F.sum("n").over(every))


def enough_for_item_response(answers: DataFrame, exam: str, person: str, least: int = 100) -> DataFrame:
    """(exam, n_persons, enough): whether an exam has the examinees that an item-response model asks for."""
    return answers.groupBy(exam).agg(F.count_distinct(person).alias("n_persons")).withColumn("enough", F.col("n_persons") >= least)
