import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeline.functions import pages as P
from gradeline.operators import cohort, imaging, intake, layout, measures, scoring, store, votes

BOOKLET = "booklet_id string, source_file string, pages array<struct<index:int,path:string,width:int,height:int>>, errors array<string>, expected_pages int"


def pages(n):
    return [(i, f"p/page_{i:03d}.png", 10, 20) for i in range(n)]


def test_statuses(spark):
    rows = [("ok", "a.pdf", pages(3), [], 3), ("short", "b.pdf", pages(2), [], 3), ("extra", "c.PDF", pages(4), [], 3), ("twice", "d.png", pages(3), [], 3), ("twice", "e.png", pages(3), [], 3), ("bad", "f.x", pages(1), ["boom"], 3), ("any", "g.tif", pages(9), [], None), ("none", None, None, None, None)]
    s = intake.status(spark.createDataFrame(rows, BOOKLET))
    got = sorted((r.booklet_id, r.status) for r in s.collect())
    assert got == [("any", "ok"), ("bad", "rasterize_error"), ("extra", "extra_pages"), ("none", "ok"), ("ok", "ok"), ("short", "short_booklet"), ("twice", "duplicate_id"), ("twice", "duplicate_id")]
    r = intake.report(s).first()
    assert (r.n_booklets, r.n_ok, r.n_halted, r.all_ok) == (8, 3, 5, False)
    assert intake.report(s.limit(0)).first().all_ok is True
    left = intake.without_halted(spark.createDataFrame([("ok",), ("bad",), ("unknown",)], ["booklet_id"]), s)
    assert sorted(r.booklet_id for r in left.collect()) == ["ok", "unknown"]
    assert intake.pages(spark.createDataFrame(rows, BOOKLET)).where("booklet_id = 'ok'").count() == 3
    assert [r.k for r in spark.createDataFrame([("a.PDF",), ("b.jpeg",), ("c.txt",)], ["p"]).select(intake.kind("p").alias("k")).collect()] == ["pdf", "image", None]
    with pytest.raises(Exception, match="unsupported file c.txt"):
        spark.createDataFrame([("c.txt",)], ["p"]).select(intake.kind("p", strict=True)).collect()


def test_store(spark):
    rows = spark.createDataFrame([(1, "k", 1), (2, "k", 2), (3, "l", 3), (2, "k", 2)], "id int, key string, v int")
    assert sorted(tuple(r) for r in store.latest(rows, ["key"], "id").collect()) == [(2, "k", 2), (3, "l", 3)]
    assert {(r.id, r.derived_status) for r in store.with_state(rows, ["key"], "id").collect()} == {(1, "superseded"), (2, "current"), (3, "current")}
    new = spark.createDataFrame([(0, "k", 9), (5, "", 1), (6, None, 1)], "id int, key string, v int")
    assert sorted(r.v for r in store.upsert(rows, new, ["key"], "id").collect()) == [3, 9]
    log = spark.createDataFrame([("r", "a", 1), ("r", "a", 2), ("r", "b", 3), ("r", "a", 4)], "k string, h string, t int")
    assert {(r.h, r.version, r.first, r.n) for r in store.proposals(log, "k", "h", "t").collect()} == {("a", 1, 1, 3), ("b", 2, 3, 1)}  # a is still proposed when it comes again
    at = lambda *rows: spark.createDataFrame([("r", *x) for x in rows], "k string, h string, t int")
    more = log.unionByName(at(("a", 9), ("b", 9)))
    lives = lambda approved: {(r.h, r.version, r.n) for r in store.proposals(more, "k", "h", "t", approved).collect()}
    assert lives(at(("a", 5), ("b", 6))) == {("a", 1, 3), ("b", 2, 2), ("a", 3, 1)}  # a was superseded at 6, so 9 is a new version
    assert lives(at(("b", 5), ("b", 6))) == {("a", 1, 4), ("b", 2, 2)}  # a was never approved, so it is never superseded
    assert lives(at(("a", 5), ("b", 6), ("a", 7))) == {("a", 1, 4), ("b", 2, 1), ("b", 3, 1)}  # a approved again, b superseded
    versions = spark.createDataFrame([("r", 1), ("r", 2), ("r", 3), ("q", 1)], "k string, v int")
    said = spark.createDataFrame([("r", 1, 1, "x"), ("r", 2, 2, "y"), ("r", 9, 3, "z"), ("r", 3, 4, "z")], "k string, v int, t int, who string")
    st = store.approvals(said, versions, "k", "v", "t", "who", versions.where("k = 'r' and v = 3"))
    assert {(r.k, r.v, r.status, r.approved_at, r.approved_by) for r in st.collect()} == {("r", 1, "superseded", 1, "x"), ("r", 2, "approved", 2, "y"), ("r", 3, "proposed", None, None), ("q", 1, "proposed", None, None)}
    assert {(r.v, r.error) for r in store.approval_errors(said, versions, "k", "v", versions.where("v = 3")).collect()} == {(9, "unknown version"), (3, "not valid")}
    cur = spark.createDataFrame([("q", "x"), ("p", "x"), ("z", None)], "q string, hash string")
    ok = spark.createDataFrame([("q", "y"), ("p", "x"), ("z", None)], "q string, hash string")
    assert [r.q for r in store.stale(cur, ok, ["q"]).collect()] == ["q"]
    spend = spark.createDataFrame([("a", 1, 0.6), ("a", 2, 0.6), ("a", 3, 0.1)], "k string, t int, c double")
    assert [r.admitted for r in store.admitted(spend, "k", ["t"], "c", 1.0).orderBy("t").collect()] == [True, True, False]


def test_votes(spark):
    v = spark.createDataFrame([("h", 1, "a"), ("h", 1, "a"), ("h", 1, "b"), ("c", 1, "a"), ("c", 1, "b"), ("c", 2, None)], "suit string, q int, letter string")
    every = spark.createDataFrame([("h", 1), ("c", 1), ("c", 2)], "suit string, q int")
    k = votes.majority(v, ["suit", "q"], "letter", every)
    assert {(r.suit, r.q): (r.letter, r.support, r.unresolved) for r in k.collect()} == {("h", 1): ("a", 2, None), ("c", 1): (None, None, "tied"), ("c", 2): (None, None, "no votes")}
    assert votes.dissent(v, k, ["suit", "q"], "letter").count() == 1
    a = spark.createDataFrame([("h", 1, "a"), ("h", 1, "b"), ("h", 1, None), ("c", 1, "a"), ("x", 1, "a")], "suit string, q int, answer string")
    assert sorted(str(r.score) for r in votes.graded(a, k, ["suit", "q"], "answer", 5.0).collect()) == ["0.0", "0.0", "5.0", "None", "None"]
    first = spark.createDataFrame([(1, "a", "answered", False), (2, None, "blank", False), (3, None, "ambiguous", True), (4, "b", "answered", False)], "q int, answer string, status string, low_margin boolean")
    second = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "q int, answer string")
    got = {r.q: (r.final_answer, r.needs_review, r.reasons) for r in votes.cross_checked(first, second, ["q"]).collect()}
    assert got == {1: ("a", False, ""), 2: (None, False, ""), 3: ("c", True, "ambiguous; low margin; readings differ"), 4: ("b", True, "no second reading")}
    p = spark.createDataFrame([("x", "a", "1"), ("x", "b", "2"), ("y", "a", "1"), ("y", "b", "1")], "k string, l string, r string")
    assert {(r.k, r.bijective) for r in votes.bijective(p, "k", "l", "r", 2).collect()} == {("x", True), ("y", False)}


def test_grid(spark):
    empty = [("s", 9, x, 0.01, 0.1) for x in "abcdefgh"]
    cells = [("s", 1, "a", 0.5, 0.3), ("s", 1, "b", 0.01, 0.1), ("s", 2, "a", 0.5, 0.9), ("s", 2, "b", 0.5, 0.3), ("s", 3, "a", 0.5, 0.31), ("s", 3, "b", 0.5, 0.3)]
    got = {r.q: (r.status, r.answer, r.cancelled) for r in votes.resolved_rows(spark.createDataFrame(empty + cells, "s string, q int, letter string, ink double, core_fill double"), "s", "q").collect()}
    assert got == {9: ("blank", None, None), 1: ("answered", "a", None), 2: ("answered", "b", "a"), 3: ("ambiguous", None, None)}


def test_verdicts(spark):
    rows = [
        ("a", "alternative", True, None, None, 10.0, 10.0, [], False, True), ("b", "alternative", False, None, None, 10.0, 10.0, [], False, False), ("c", "alternative", False, None, None, 10.0, 10.0, [], True, True),
        ("d", "consequential", None, "m1", 7.0, 10.0, 7.0, ["m1"], False, True), ("e", "consequential", None, "m1", 7.0, 10.0, 7.0, ["m1", "m2"], False, False), ("f", "consequential", None, "m1", None, 10.0, 7.0, ["m1"], False, False),
        ("g", "control", None, None, None, 10.0, 10.0, [], False, False), ("h", "control", None, None, None, 10.0, 9.0, None, None, True), ("i", "control", None, None, None, 10.0, None, None, None, False),
    ]
    df = spark.createDataFrame(rows, "id string, `set` string, declared boolean, slip string, expected_score double, max_points double, score double, deductions array<string>, needs_review boolean, want boolean")
    v = scoring.verdicts(df)
    assert all(r.passed == r.want for r in v.collect())
    for r in v.where("score is not null").collect():  # the same rule as for one answer
        assert scoring.verdict(r["set"], r.declared, r.slip, r.expected_score, r.max_points, {"score": r.score, "deductions": r.deductions, "needs_review": r.needs_review}) == r.passed
    assert {r["set"]: (r.n, r.n_passed, r.gate) for r in scoring.pass_rates(v).collect()} == {"alternative": (3, 2, False), "consequential": (3, 1, False), "control": (3, 1, False)}
    assert scoring.pass_rates(v.limit(0)).count() == 0


def test_measures(spark):
    p = spark.createDataFrame([(4.0, 5.0, 5.0), (10.0, 10.0, 10.0), (None, 1.0, 10.0)], "system double, reference double, max_points double")
    r = measures.question_gate(p).first()
    assert (r.n, r.mae, r.within1, r.signed) == (2, 1.0, 0.5, -1.0)
    r = measures.total_gate(spark.createDataFrame([(50.0, 50.0), (60.0, 70.0), (70.0, 70.0), (None, 1.0)], "system double, reference double")).first()
    assert r.exact == 2 and r.n == 3 and r.pearson == pytest.approx(0.866, abs=1e-3)
    r = measures.total_gate(p.limit(0)).first()
    assert r.n == 0 and r.mae_total is None and r.pearson is None
    g = measures.gates(spark.createDataFrame([(None, 0.9)], "mae double, within1 double"), {"mae": ("<=", 1.0), "within1": (">=", 0.85)}).first()
    assert (g.mae_pass, g.within1_pass) == (False, True)


def test_transcription_gate(spark):
    schema = "crop_id string, m string, hebrew_text string, interleaved_markdown string, math_latex array<string>, latex_eval struct<total:int,parse_rate:double>, prompt_tokens int, candidate_tokens int, cache_hit boolean, errors array<string>, ok boolean"
    rows = [(f"c{i}", "m", "א", "", [], (1, 1.0), 10, 150, False, [], True) for i in range(9)] + [("c9", "m", "א", "", [], (1, 1.0), 10, 200000, False, [], True), ("ca", "m", None, None, None, None, None, None, None, ["503 x"], False)]
    r = measures.transcription_gate(spark.createDataFrame(rows, schema), "m").first()
    assert r.typical_candidate_tokens == 150.0 and r.n_unhandled_overload == 1 and r.n_errors == 1 and r.n_ok == 10


def test_layout(spark):
    e = spark.createDataFrame([("b", "1"), ("b", "2"), ("b", "3")], ["booklet_id", "q"])
    f = spark.createDataFrame([("b", "1", "answered"), ("b", "1", "blank"), ("b", "2", "blank")], ["booklet_id", "q", "state"])
    assert {(r.q, r.coverage) for r in layout.coverage(e, f, ["booklet_id", "q"]).collect()} == {("1", "answered"), ("2", "blank"), ("3", "not_found")}
    pts = spark.createDataFrame([(5,), (15,), (99,), (10,)], "x int")
    assert [r.band for r in layout.band_of(pts, "x", [(0, 10), (10, 20)]).collect()] == [0, 1, 0, 0]
    regions = spark.createDataFrame([("p", 5), ("p", 50), ("p", 99), ("q", 5)], "page string, c int")
    cols = spark.createDataFrame([("p", 0, 40, 60), ("p", 1, 0, 50)], "page string, pos int, x0 int, x1 int")
    assert sorted((r.page, r.c, r.column_index) for r in layout.column_of(regions, cols, "page", "c").collect()) == [("p", 5, 1), ("p", 50, 0), ("p", 99, 0), ("q", 5, 0)]
    labels = spark.createDataFrame([("p", "a", 90, 10), ("p", "b", 50, 12)], "page string, label string, lx int, ly int")
    spans = spark.createDataFrame([("p", "s1", 70, 11), ("p", "s2", 30, 15), ("p", "s3", 70, 30), ("p", "s4", 95, 10)], "page string, text string, x int, y int")
    assert sorted((r.label, r.text) for r in layout.band_rows(spans, labels, "page").collect()) == [("a", "s1"), ("b", "s2")]
    cov = spark.createDataFrame([("b", "1", "answered"), ("b", "2", "not_found"), ("c", "1", "blank")], "b string, q string, coverage string")
    assert {(r.b, r.halted, r.reasons) for r in layout.halting(cov, "b", "q").collect()} == {("b", True, "question 2 not found"), ("c", False, "")}
    rng = np.random.default_rng(1)
    L = [("k" if i % 3 else "h", int(t), i) for i, t in enumerate(rng.integers(0, 100, 60))]
    R = [("k" if i % 3 else "h", int(t), i) for i, t in enumerate(rng.integers(0, 100, 25))]
    got = layout.backward_asof(spark.createDataFrame(L, "k string, t int, i int"), spark.createDataFrame(R, "k string, t int, v int"), "k", "t", "v", lambda t: F.floor(t / 10))
    want = {i: max(((u, v) for q, u, v in R if q == k and u <= t), default=(0, None))[1] for k, t, i in L}
    assert {r.i: r.last_value for r in got.collect()} == want
    near = layout.within(spark.createDataFrame(L, "k string, l_t int, i int"), spark.createDataFrame(R, "k string, r_t int, j int"), "k", "t", 7)
    assert {(r.i, r.j) for r in near.collect()} == {(i, j) for k, t, i in L for q, u, j in R if q == k and abs(t - u) <= 7}


def test_white_point():
    a = np.full((800, 600), 252, np.uint8)
    for y, v in ((80, 40), (200, 165), (320, 239), (440, 246)):
        a[y : y + 60, 40:560] = v
    b, changed = P.clamp_white(a)
    assert [b[y + 5, 100] for y in (80, 200, 320, 440)] == [40, 165, 255, 255] and changed > 0
    assert P.clamp_white(a, on=False)[0] is a
    colour = np.stack([a, a, np.minimum(a, 250)], 2)
    assert P.lightness(np.array([[[255, 255, 255], [0, 0, 0], [128, 128, 128]]], np.uint8)).tolist() == [[255, 0, 137]] and (P.clamp_white(colour)[0][300] == 255).all()
    dark = np.full((50, 50), 200, np.uint8)
    assert (P.clamp_white(dark)[0] == dark).all()


def test_deskew_and_columns():
    a = np.full((600, 800), 255, np.uint8)
    a[60:540, 60:740][np.arange(480) % 20 < 6] = 30
    tilted = P.rotate(a, 3.0)
    straight, angle = P.deskew(tilted)
    assert abs(abs(angle) - 3) < 0.3 and abs(P.skew(straight)) < 0.5
    assert P.deskew(a)[0] is a and P.skew(np.full((40, 40), 255, np.uint8)) == 0
    a[:, 380:420] = 255
    assert [c[0] > 300 for c in P.columns(a)] == [True, False]
    assert P.columns(np.full((100, 100), 255, np.uint8)) == [(0, 100)] and P.blocks(np.full((100, 100), 255, np.uint8)) == []
    assert P.equalise(a).shape == a.shape and P.crop_border(np.pad(np.full((50, 50), 255, np.uint8), 10)).shape == (50, 50)
    ring = np.full((40, 40), 255, np.uint8)
    ring[5:35, 5:35], ring[12:28, 12:28] = 0, 255
    assert P.glyph(ring)["holes"] == 1.0 and P.glyph(255 - ring[12:28, 12:28] * 0)["ink_ratio"] >= 0


def grid_page(rows, cols, marked):
    """A page with a ruled grid; ``marked`` boxes are filled."""
    a = np.full((600, 500), 255, np.uint8)
    ys, xs = np.linspace(150, 450, rows + 1).astype(int), np.linspace(100, 400, cols + 1).astype(int)
    for y in ys:
        a[y : y + 2, 100:402] = 0
    for x in xs:
        a[150:452, x : x + 2] = 0
    for r, c in marked:
        cy, cx = (ys[r] + ys[r + 1]) // 2, (xs[c] + xs[c + 1]) // 2
        a[cy - 10 : cy + 10, cx - 10 : cx + 10] = 20
    return a


@pytest.mark.parametrize("tilt", [0.0, 2.0, -3.0])
def test_grid_is_made_upright(tilt):
    marked = [(0, 1), (2, 3), (5, 0)]
    a = P.rotate(grid_page(6, 4, marked), tilt)
    table, ys, xs = P.rectified_grid(a, 6, 4)
    assert len(ys) == 7 and len(xs) == 5 and max(np.diff(ys)) - min(np.diff(ys)) <= 6
    inked = {(r, c) for r, c, ink, _ in P.cells(table, xs, ys) if ink > 0.2}
    assert inked == set(marked)
    assert P.rectified_grid(a, 9, 4) is None and P.rectified_grid(np.full((50, 50), 255, np.uint8), 2, 2) is None


def test_lattice():
    assert P.lattice([0, 10, 13, 20, 31, 40, 77], 5) == [0, 10, 20, 31, 40] and P.lattice([0, 10], 3) is None and P.lattice([0, 3, 20], 3) is None


def test_sheet_on_a_dark_ground():
    sheet = np.full((400, 300), 250, np.uint8)
    sheet[100:120, 50:250] = 30
    ground = np.full((500, 420), 40, np.uint8)
    ground[40:440, 60:360] = sheet
    b, changed = P.upright_page(ground)
    assert changed and b.shape == (400, 300) and (b[105, 100:200] < 50).all()
    # a sheet that leans: its corners become those of the page
    lean = P.warp(ground, np.array([(-30, 0), (419, 10), (419, 499), (0, 499)]), 420, 500)
    lean[lean == 255] = 40
    b, changed = P.upright_page(lean)
    assert changed and (P.grey(b)[3:-3, 3:-3] > 200).mean() > 0.9
    assert P.upright_page(sheet)[1] is False and P.upright_page(np.zeros((9, 9), np.uint8))[1] is False
    m = np.zeros((5, 9), bool)
    m[1:4, 1:3] = m[0, 5:8] = m[2, 6] = True
    assert P.largest(m).sum() == 6 and not P.largest(m)[0].any()


def test_pages(spark):
    drawn = imaging.drawn(spark.range(4)).cache()
    assert imaging.measured(drawn).count() == 4
    n = {r.path: r["count"] for r in imaging.regions(drawn).groupBy("path").count().collect()}
    assert n["2"] == 2 and n["1"] == 1
    rows = votes.resolved_rows(imaging.grid_cells(drawn), "path", "row").collect()
    assert len(rows) == 10 and all(r.status == "answered" for r in rows)
    assert {(r.path, r.reading_order) for r in imaging.columns(drawn).collect()} == {("0", 0), ("1", 0), ("2", 0), ("2", 1), ("3", 0)}  # the grid of 0 crosses its gutter
    sure = {r.path: r.gutter_confidence for r in imaging.columns(drawn).collect()}
    assert sure["1"] == sure["3"] == 1.0 and 0.9 < sure["2"] < 1.0 and 0 < sure["0"] < sure["2"]  # lines of the grid run through the gutter of 0
    made = grid_page(5, 4, [(1, 2)])
    one = spark.createDataFrame([("g", *made.shape, 1, made.tobytes()), ("n", 10, 10, 1, bytes([255]) * 100)], "path string, height int, width int, channels int, data binary")
    cells = imaging.grid_cells(one, 5, 4)
    assert {(r.path, r.row, r.letter) for r in cells.where("ink > 0.2").collect()} == {("g", 1, "2")} and [tuple(r) for r in imaging.without_grid(one, cells).collect()] == [("n", "answer grid not found")]
    t = imaging.grid_crops(one, 5, 4).collect()
    assert [r.path for r in t] == ["g"] and abs(t[0].width - 302) <= 4 and len(t[0].data) == t[0].width * t[0].height
    assert {(r.path, r.changed) for r in imaging.upright(one).collect()} == {("g", False), ("n", False)}
    assert imaging.masked(drawn).select(F.length("data").alias("n")).first().n == 120000
    c = imaging.crops(drawn, spark.createDataFrame([("1", 290, 395, 50, 50)], "path string, x int, y int, w int, h int")).first()
    assert (c.w, c.h, len(c.data)) == (10, 5, 50)
    bad = drawn.limit(1).withColumn("data", F.lit(None).cast("binary"))
    assert imaging.unreadable(bad).count() == 1 and imaging.measured(bad).count() == 0


def test_cosine(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0])], "id long, v array<float>")
    assert [tuple(r) for r in cohort.cosine_neighbours(v, "id", "v", 0.5).collect()] == [(0, 1, 1.0)]


def slow(a, b):
    """Edit distance and longest common subsequence by their definitions."""
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1)}
    c = dict.fromkeys(d, 0)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            same = a[i - 1] == b[j - 1]
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (not same))
            c[i, j] = c[i - 1, j - 1] + 1 if same else max(c[i - 1, j], c[i, j - 1])
    return d[len(a), len(b)], c[len(a), len(b)]


def test_derivations(spark):
    r = np.random.default_rng(4)
    for _ in range(60):
        a, b = ([f"w{k}" for k in r.integers(0, 5, int(r.integers(0, 14)))] for _ in range(2))
        assert cohort.compared(a, b)[:2] == slow(a, b)
    df = spark.createDataFrame([("p", "a b c d", "a x c d", 1), ("q", None, "a", 2), ("r", "", None, 3)], "k string, x string, y string, edits_ int")
    got = {x.k: (x.edits, x.common, x.kept) for x in cohort.derivations(df, "x", "y").collect()}
    assert got == {"p": (1, 3, 0.75), "q": (1, 0, 0.0), "r": (0, 0, 1.0)}


def test_shared_anomalies(spark):
    rows = [(p, q, x) for p, xs in {"u": "abz", "v": "abz", "w": "aac", "t": "aa "}.items() for q, x in zip("123", xs) if x != " "]
    key = spark.createDataFrame([("1", "a"), ("2", "a"), ("3", "c")], "q string, x string")
    got = cohort.shared_anomalies(spark.createDataFrame([("u", "v"), ("u", "w")], "a string, b string"), spark.createDataFrame(rows, "p string, q string, x string"), "p", "q", "x", key).collect()
    assert [(r.a, r.b, r.n_shared) for r in got] == [("u", "v", 2)] and got[0].score == pytest.approx(np.log(2) + np.log(1.5))


def test_planned_ones(spark):
    v = spark.createDataFrame([(i, [float(i % 2) * 9, 1.0]) for i in range(20)] + [(99, None)], "id long, v array<float>")
    c, n = cohort.clustered(v, "id", "v", 2)
    assert len({r.cluster for r in c.where("id % 2 = 0").collect()}) == 1 and sorted((r.n, r.share) for r in n.collect()) == [(10, 0.5), (10, 0.5)] and c.count() == 20
    assert [(r.n_persons, r.enough) for r in cohort.enough_for_item_response(v.withColumn("e", F.lit("x")), "e", "id", 21).collect()] == [(21, True)]
    jobs = spark.createDataFrame([(1,), (1,), (2,)], ["j"])
    assert [r.j for r in store.pending(jobs, jobs.where("j = 2"), ["j"]).collect()] == [1]
