import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeline.llm import near, overlap, words
from tests.llm import helpers as H


def frame(spark, rows, field="f"):
    return spark.createDataFrame([(field, i, t) for i, t in rows], "field string, id string, text string")


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_against_brute_force(spark, seed):
    rows = [(f"{k:03d}", t) for k, t in enumerate(H.texts_like(150, seed))]
    got = {(r.id_a, r.id_b) for r in near.near_pairs(frame(spark, rows)).collect()}
    want = H.near_pairs(rows)
    assert got <= want and len(got) >= 0.99 * len(want) and want


def test_edges(spark):
    rows = [("a", "x y z"), ("b", "z, y x!"), ("c", "x y z w"), ("d", None), ("e", ""), ("f", " ... "), ("g", "x y z"), ("g", "x y z"), ("h", "x x x"), ("i", "x")]
    got = {(r.id_a, r.id_b) for r in near.near_pairs(frame(spark, rows)).collect()}
    assert got == {("a", "b"), ("a", "c"), ("a", "g"), ("b", "c"), ("b", "g"), ("c", "g")}
    assert near.near_pairs(frame(spark, rows).limit(0)).count() == 0
    g = {r.id: (r.group_id, r.n_records, r.n_links) for r in near.groups(frame(spark, rows)).collect()}
    assert g["a"][0] == g["b"][0] == g["c"][0] == g["g"][0] and g["a"][1:] == (4, 1) and g["h"][1:] == (1, 0) and set(g) == set("abcghi")


def test_fields_do_not_mix(spark):
    both = frame(spark, [("a", "x y z")], "f").unionByName(frame(spark, [("b", "x y z")], "g"))
    assert near.near_pairs(both).count() == 0


def test_hot_group_goes_by_blocks(spark):
    rows = [(f"{k:04d}", "a b c d e f g h i j " + f"w{k}") for k in range(120)]
    cl = words.classes(words.word_sets(frame(spark, rows))).cache()
    assert near.candidates(cl, hot=25).count() == near.candidates(cl).count() == 120 * 119 // 2


def test_hot_group_of_many_sizes(spark):
    base = "a b c d e f g h i j".split()
    rows = [(f"{k:04d}", " ".join(base + [f"w{x}" for x in range(k % 40)] + [f"u{k}"])) for k in range(160)]
    cl = words.classes(words.word_sets(frame(spark, rows))).cache()
    pairs = lambda hot: {tuple(sorted((bytes(r.a), bytes(r.b)))) for r in links_of(cl, hot)}
    want = H.near_pairs(rows)
    assert len(pairs(7)) == len(pairs(8192)) == len(want)


def links_of(cl, hot):
    got = words.similarity(near.candidates(cl, hot=hot), *(cl.select("field", "c", "cls", "toks"),) * 2)
    return got.where("similarity >= 0.6 - 1e-12 and a <> b").collect()


def test_classes_that_share_a_number(spark):
    rows = [(f"{k:03d}", t) for k, t in enumerate(H.texts_like(40, 9))]
    cl = words.classes(words.word_sets(frame(spark, rows))).cache()
    pairs = lambda c: {tuple(sorted((bytes(r.a), bytes(r.b)))) for r in near.class_links(c).collect()}
    assert pairs(cl) and pairs(cl.withColumn("c", F.lit(7).cast("long"))) == pairs(cl)


def test_copies_make_one_class(spark):
    rows = spark.range(3000).selectExpr("'f' as field", "cast(id as string) as id", "'one two three four' as text")
    g = near.groups(rows)
    assert g.select("group_id").distinct().count() == 1 and g.first().n_records == 3000


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501)], "a long, b long")
    assert {(r.root, r["count"]) for r in near.components(links).groupBy("root").count().collect()} == {(0, 201), (500, 2)}
    assert near.components(links.limit(0)).count() == 0


def test_tree_loses_nothing():
    r = np.random.default_rng(3)
    sets = [set(r.choice(300, int(r.integers(5, 40)), replace=False).tolist()) for _ in range(150)]
    sets += [set(list(s)[: max(3, int(len(s) * 0.8))]) for s in sets[:60]]
    flat = np.concatenate([np.array(sorted(s), np.uint64) * np.uint64(2654435761) for s in sets])
    off = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    bits, size = words.bitmaps(flat, off, near.BITS64), np.array([len(s) for s in sets], np.int32)
    t = near.Tree(bits, size)
    got = {(min(a, b), max(a, b)) for x, y in near.dual(t, t, 0.6) for a, b in zip(x.tolist(), y.tolist())}
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if len(sets[i] & sets[j]) >= 0.6 * len(sets[i] | sets[j])}
    assert want and want <= got and len(got) < len(sets) ** 2 / 4
    left, right = near.Tree(bits[:100], size[:100]), near.Tree(bits[100:], size[100:])
    cross = {(a, b + 100) for x, y in near.dual(left, right, 0.6) for a, b in zip(x.tolist(), y.tolist())}
    assert {p for p in want if p[0] < 100 <= p[1]} <= cross


@pytest.mark.parametrize("seed", [5, 6])
def test_overlaps_against_brute_force(spark, seed):
    t = H.texts_like(160, seed)
    random.Random(seed).shuffle(t)
    train, held = [(f"A{k}", x) for k, x in enumerate(t[:100])], [(f"H-{k}", x) for k, x in enumerate(t[100:])]
    df = lambda rows: spark.createDataFrame([(i, x, "s", None, 1) for i, x in rows] + [("n", None, None, None, 1), (None, "x", None, None, 1)], "id string, transcript string, `set` string, source string, field int")
    got = {(r.id_a, r.id_b) for r in overlap.pairs(df(train), df(held)).collect()}
    want = {tuple(sorted((i, j))) for i, x in train for j, y in held if H.similarity(x, y) >= 0.6 - 1e-12}
    assert got <= want and len(got) >= 0.99 * len(want) and want
    rep = overlap.report(df(train), df(held))
    assert rep.agg(F.sum("n_pairs")).first()[0] == len(got) and rep.where("source is null").count() == 2
    assert overlap.pairs(df(train).limit(0), df(held)).count() == 0
    hot = {tuple(sorted((r.train_id, r.held_id))) for r in overlap.overlaps(df(train), df(held), hot=1).collect()}
    assert hot == got
