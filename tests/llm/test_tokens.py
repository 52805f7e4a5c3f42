import os

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from gradeline.llm import mixing, packing, repetition, tokens
from tests.llm import helpers as H

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary file")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=" \n\tab'sZ09.,$\\{}אבש\u05b8é²½\u00a0\u2009", max_size=40))
def test_counts_are_exact(text):
    c = tokens.counter()
    assert c.count(text) == len(c.encode(text))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "he", 5) for i, t, s in rows], "doc_id long, text string, source string, lang string, tokens int")


SIZES = [("short", 16), ("long", 64), ("short", 16), ("none", None), ("zero", 0)]


def test_packing(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    rows = [(k, " ".join(words[(k * 3 + j) % 8] for j in range(1 + k % 23)), "s") for k in range(200)] + [(900, "long " * 400, "s"), (901, None, "s"), (902, "", "s"), (None, "x", "s"), (5, " ".join(words[(15 + j) % 8] for j in range(6)), "s")]
    sizes = spark.createDataFrame(SIZES, "window_name string, capacity_tokens int")
    out = packing.laid_out(docs(spark, rows), sizes, shard=64).toPandas()
    c = tokens.counter()
    for name, capacity in (("short", 16), ("long", 64)):
        w = out[out.window_name == name]
        assert w.groupby("window_id").n_tokens.sum().max() <= capacity
        for i, t, _ in rows[:-1]:
            p = w[w.doc_id == i].sort_values("piece") if i is not None else w[:0]
            n = c.count(t) if t else 0
            if i is None or not n:
                assert i is None or p.empty
                continue
            assert p.n_tokens.sum() == n and (len(p) == 1 or n > capacity) and list(p.start_token) == [0, *p.n_tokens.cumsum()[:-1]]
    assert set(out.window_name) == {"short", "long"}
    fill = {r.window_name: r.filled for r in packing.report(docs(spark, rows), sizes).collect()}
    assert fill["long"] > 0.95
    assert packing.laid_out(docs(spark, rows).limit(0), sizes).count() == 0 and packing.laid_out(docs(spark, rows), sizes.limit(0)).count() == 0


def test_index_gives_bm25():
    docs = [{0: 1, 1: 1}, {0: 1, 2: 1}, {3: 2}, {3: 1, 1: 1}, {4: 3, 0: 2, 1: 1}]
    t, f, row = (np.array(x) for x in zip(*((k, n, i) for i, d in enumerate(docs) for k, n in d.items())))
    lengths, idf, mean = np.array([2, 2, 2, 2, 6]), np.array([0.5, 0.7, 2.0, 1.0, 3.0]), 3.0
    i = packing.Index(t, f, row, lengths, idf, mean)
    score = i.every()
    for a, x in enumerate(docs):
        for b, y in enumerate(docs):
            want = sum(idf[k] * y[k] * 2.2 / (y[k] + 1.2 * (0.25 + 0.75 * lengths[b] / mean)) for k in x if k in y)
            assert a == b or score[a, b] == pytest.approx(want, rel=1e-5)
    w = packing.windows(lengths, 8, score)
    assert w == [[4, max((0, 1, 2, 3), key=lambda d: score[4, d])], *w[1:]] and sorted(sum(w, [])) == list(range(5)) and len(w) == 2


def test_mixture(spark):
    rows = [(k, "word " * (5 + k % 50), "big" if k % 3 else "small") for k in range(600)] + [(1000, "x " * 99, None), (1001, None, "big"), (1002, "y " * 50, "other"), (0, "word " * 5, "small")]
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 2), ("absent", 0.2, 3), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    d = docs(spark, rows)
    m = mixing.mixture(d, targets).toPandas()
    assert set(m.source) <= {"big", "small"} and m.doc_id.is_unique
    assert m[m.source == "big"].copies.max() <= 1 and m[m.source == "small"].copies.max() <= 2
    r = {x.source: x for x in mixing.report(d, targets).collect()}
    assert abs(r["big"].actual_share - 0.5) < 0.01 and abs(r["small"].actual_share - 0.5) < 0.01 and r["absent"].actual_share == 0
    assert mixing.mixture(d.limit(0), targets).count() == 0
    one = mixing.mixture(docs(spark, [(1, "a b c", "big"), (2, "a b c", "small")]), targets)  # one document a source
    assert {x.copies for x in one.collect()} <= {1, 2}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=30))
def test_repeats_against_brute_force(ids):
    n = len(ids)
    want = H.repeated_share(" ".join(f"w{i}" for i in ids))
    assert (repetition.repeated(ids) / n if n else 0.0) == pytest.approx(want)


def test_repetition(spark):
    rows = [(1, "a b c d e f " * 20, "s"), (2, "a b c d e f g h", "s"), (3, None, "s"), (4, "", None), (5, "x, x! x. x x", "s"), (1, "a b c d e f " * 20, "s"), (6, " ".join(map(str, range(50))) + " 0 1 2 3", None)]
    d = docs(spark, rows)
    got = {r.doc_id: r.share for r in repetition.shares(d).collect()}
    assert got == {1: pytest.approx(114 / 120), 2: 0.0, 3: 0.0, 4: 0.0, 5: pytest.approx(4 / 5), 6: pytest.approx(4 / 54)}
    assert sorted(r.doc_id for r in repetition.found(d).collect()) == [1, 5]
    assert repetition.found(d.limit(0)).count() == 0
    rep = repetition.report(d)
    assert rep.where("source is null").first().n_docs == 2 and rep.agg(F.sum("n_docs")).first()[0] == 6


def test_shards_are_cut_by_content(spark):
    r = np.random.default_rng(3)
    rows = [(k, " ".join(f"topic{k % 8}word{w}" for w in r.integers(0, 30, 40)), "s") for k in range(1600)] + [(5000 + k, "the same text", "s") for k in range(700)]
    d = docs(spark, rows)
    terms = packing.cut(packing.terms(d))
    df = packing.frequencies(terms)
    n = terms.count()
    assert n == 2300 and df.max() == 700
    placed = packing.dealt(terms, df, n, 256).toPandas()
    assert len(placed) == n and placed.doc_id.is_unique
    size = placed.groupby(["leaf", "part"]).size()
    assert size.max() <= 1.4 * 256  # copies of one text, a third of all, are cut by a hash
    own = placed[placed.doc_id < 1600]
    most = own.assign(topic=own.doc_id % 8).groupby(["leaf", "part"]).topic.agg(lambda x: x.value_counts().iloc[0]).sum() / len(own)
    assert most > 0.8  # dealt by hash it is about an eighth
    sizes = spark.createDataFrame([("w", 2048)], "window_name string, capacity_tokens int")
    out = packing.laid_out(d, sizes, shard=256)
    assert out.select("doc_id").distinct().count() == n
    r = packing.report(d, sizes).first()
    assert r.n_docs == n and r.score_to_mean > 1
