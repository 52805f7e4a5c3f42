"""Queries without SQL, against what must hold of them on the whole test tables."""

import os
from collections import Counter, defaultdict

import duckdb
import pytest

from gradeline.llm import markup, queries as Q, sql, tokens
from tests.test_registry import FOLDER

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER) or not os.path.exists(tokens.VOCABULARY), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return c


def run(spark, name):
    return Q.queries()[name](spark, FOLDER).collect()


def test_groups_are_the_components_of_the_pairs(spark, duck):
    got = defaultdict(set)
    for r in run(spark, "p4_groups"):
        got[r.field, r.group_id].add(r.id)
        assert r.n_records >= 1
    root = {(f, i): (f, i) for (f, _), ids in got.items() for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for f, a, b in duck.execute(sql.P4_FOUND).fetchall():
        root[find((f, a))] = find((f, b))
    want = defaultdict(set)
    for x in root:
        want[find(x)].add(x)
    assert sorted(sorted((f, i) for i in ids) for (f, _), ids in got.items()) == sorted(sorted(v) for v in want.values())


def test_look_classes_are_those_of_the_pairs(spark, duck):
    rows = run(spark, "p3_classes")
    of = {(r.field, r.id): r for r in rows}
    pairs = duck.execute(sql.P3_FOUND).fetchall()
    assert pairs and all(of[f, a].class_id == of[f, b].class_id for f, a, b in pairs)
    many = {(f, x) for f, a, b in pairs for x in (a, b)}
    assert many == {k for k, r in of.items() if r.n_spellings > 1}
    n = Counter((r.field, r.class_id) for r in rows)
    assert all(r.n_records == n[r.field, r.class_id] for r in rows) and any(r.n_mixed for r in rows)


def test_forms_are_equal_where_texts_look_equal(spark, duck):
    forms = {(r.field, r.id): r.canonical_text for r in run(spark, "p3_forms")}
    for f, a, b in duck.execute(sql.P3_FOUND).fetchall():
        assert forms[f, a].strip() == forms[f, b].strip()


def test_overlap_report_counts_the_pairs(spark, duck):
    assert sum(r.n_pairs for r in run(spark, "p2_report")) == len(duck.execute(sql.P2_FOUND).fetchall())


def test_clean_texts(spark):
    found = {(r.transcript_id, r.field) for r in run(spark, "p5_found")}
    before = {r.transcript_id: r for r in spark.read.parquet(f"{FOLDER}/transcriber.parquet").select("transcript_id", "interleaved_markdown", "math_latex").distinct().collect()}
    structure = {"heading", "item", "table", "bars", "fence", "rule", "emphasis"}
    for r in run(spark, "p5_clean"):
        was = before[r.transcript_id]
        if (r.transcript_id, "interleaved_markdown") not in found:
            assert r.clean_markdown == was.interleaved_markdown
        else:
            assert set(markup.kinds(r.clean_markdown)) <= structure and r.clean_markdown
            words = lambda t: Counter(w for w in t.replace("|", " ").split() if w.isalpha())
            gone = words(markup.FORMULA.sub(" ", was.interleaved_markdown)) - words(markup.FORMULA.sub(" ", r.clean_markdown))
            assert sum(gone.values()) <= 0.1 * sum(words(was.interleaved_markdown).values()) + 3
        if (r.transcript_id, "math_latex") not in found:
            assert r.clean_latex == was.math_latex
        else:
            assert not any(markup.formula_kinds(e) for e in r.clean_latex)
    assert sum(r.n_records for r in run(spark, "p5_report")) >= len({t for t, _ in found})


def test_windows(spark):
    counter = tokens.counter()
    want = {r.doc_id: counter.count(r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect() if r.text}
    sizes = {r.window_name: r.capacity_tokens for r in spark.read.parquet(f"{FOLDER}/window_sizes.parquet").collect()}
    got, used = defaultdict(int), defaultdict(int)
    rows = run(spark, "p6_windows")
    for r in rows:
        got[r.window_name, r.doc_id] += r.n_tokens
        used[r.window_name, r.window_id] += r.n_tokens
    assert got == {(w, d): n for w in sizes for d, n in want.items() if n}
    assert all(n <= sizes[w] for (w, _), n in used.items())
    pieces = Counter((r.window_name, r.doc_id) for r in rows)
    assert all(n == 1 or want[d] > sizes[w] for (w, d), n in pieces.items())
    for r in run(spark, "p6_fill"):
        assert r.n_windows == sum(w == r.window_name for w, _ in used) and r.n_tokens == sum(want.values()) and r.n_windows >= r.least_windows and r.filled > 0.9


def test_mixture(spark):
    targets = {r.source: r for r in spark.read.parquet(f"{FOLDER}/source_targets.parquet").collect()}
    size, docs = Counter(), Counter()
    for r in run(spark, "p7_mixture"):
        assert 1 <= r.copies <= targets[r.source].max_repeats
        size[r.source] += r.tokens * r.copies
        docs[r.source] += 1
    longest = Counter()
    counter = tokens.counter()
    for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("source", "text").collect():
        longest[r.source] = max(longest[r.source], counter.count(r.text or ""))
    total = sum(size.values())
    for r in run(spark, "p7_shares"):
        assert r.mixture_tokens == size[r.source] and r.n_docs == docs[r.source] and r.actual_share == pytest.approx(size[r.source] / total)
        assert abs(r.actual_share - r.target_share) <= (longest[r.source] + max(longest.values())) / total + 1e-6


def test_limits(spark):
    rows = run(spark, "p1_limits")
    assert {r.unit for r in rows} == {"chars", "bytes"} and all(r.at is None or r.p >= 0.5 and r.n_at > r.expected for r in rows)
