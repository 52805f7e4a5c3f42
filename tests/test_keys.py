"""Keys, printed options, sheets and names."""

from pyspark.sql import functions as F

from gradeline.functions import text as X
from gradeline.operators import keys as K, store

L = ["a", "b", "c", "d"]


def test_master_key(spark):
    rows = [("1", x, "t", x == "b") for x in L] + [("2", x, "t", x in "ab") for x in L] + [("3", x, None, x == "a") for x in "abc"] + [("4", x, "t", False) for x in L] + [("1", "a", "t", False)]
    got = {r.q: (r.correct_letter, r.errors) for r in K.master_key(spark.createDataFrame(rows, "q string, letter string, text string, red boolean"), "q", L).collect()}
    assert got == {"1": ("b", []), "2": (None, ["2 red options"]), "3": ("a", ["options a,b,c"]), "4": (None, ["0 red options"])}


def test_mapped_options(spark):
    master = spark.createDataFrame([("1", "a", "1/2", False), ("1", "b", r"\frac{3}{4}", True), ("1", "c", "2", False), ("1", "d", 'אף אחד מהנ"ל', False), ("2", "a", "1", True), ("2", "b", "2", False), ("2", "c", "3", False), ("2", "d", "4", False)], "q string, letter string, text string, correct boolean")
    printed = [("s", "1", "a", "0.75"), ("s", "1", "b", "0.5"), ("s", "1", "c", "none"), ("s", "1", "d", "2.0"), ("t", "1", "a", "0.75"), ("t", "1", "b", "3/4"), ("t", "1", "c", "2"), ("t", "1", "d", "0.5"), ("s", "2", "a", "4"), ("s", "2", "b", "3"), ("s", "2", "c", "2"), ("s", "2", "d", "1")]
    got = {(r.s, r.q): (r.letter, (r.issue or "")[:12]) for r in K.mapped_options(spark.createDataFrame(printed, "s string, q string, letter string, text string"), master, "s", "q", L).collect()}
    assert got == {("s", "1"): ("a", ""), ("t", "1"): (None, "not a permut"), ("s", "2"): ("d", ""), ("t", "2"): (None, "not on the p")}


def test_choice_rubric(spark):
    master = spark.createDataFrame([("1", "a"), ("2", None)], "q string, correct_letter string")
    v = spark.createDataFrame([("1", "heart", "c"), ("1", "club", "d"), ("1", "spade", None)], "q string, suit string, letter string")
    got = {r.q: (r.max_points, r.kind, r.mcq_keys) for r in K.choice_rubric(master, v, "q", "suit").collect()}
    assert got == {"1": (10.0, "mcq", {"master": "a", "heart": "c", "club": "d"}), "2": (10.0, "mcq", {"master": ""})}


def test_graded_sheets(spark):
    expected = spark.createDataFrame([(s, q, 5.0) for s in ("x", "y", "z") for q in ("1", "2")], "s string, q string, max_points double")
    rows = spark.createDataFrame([("x", "1", "a", False, ""), ("x", "2", None, False, ""), ("y", "1", "a", True, "low margin"), ("z", "1", "a", False, "")], "s string, q string, final_answer string, needs_review boolean, reasons string")
    sheets = spark.createDataFrame([("x", "heart"), ("y", "club"), ("z", None)], "s string, suit string")
    key = spark.createDataFrame([("heart", "1", "a"), ("heart", "2", "b"), ("club", "1", "c")], "suit string, q string, letter string")
    own = spark.createDataFrame([("x", "1", "a"), ("y", "1", "a")], "s string, q string, letter string")
    got = {(r.s, r.q): (r.score, r.review_reasons, r.evidence.key_letter, r.evidence.own_key_letter) for r in K.graded_sheets(expected, rows, sheets, key, own, "s", "q", "suit").collect()}
    assert got == {
        ("x", "1"): (5.0, "", "a", "a"), ("x", "2"): (0.0, "", "b", None), ("y", "1"): (0.0, "low margin; printed options give a, the key is c", "c", "a"),
        ("y", "2"): (None, "question not read; no approved key for the version", None, None), ("z", "1"): (None, "version unknown", None, None), ("z", "2"): (None, "question not read; version unknown", None, None),
    }
    marks = spark.createDataFrame([("x", "heart", "1", "a"), ("x", "heart", "2", None), ("y", "spade", "1", "a")], "s string, suit string, q string, mark string")
    assert sorted((r.s, r.q, r.reference) for r in K.hand_scores(marks, key, "q", "suit").collect()) == [("x", "1", 10.0), ("x", "2", 0.0), ("y", "1", None)]


def test_full_rows(spark):
    read = spark.createDataFrame([("x", 1, "a", 0), ("x", 1, "b", 1), ("x", 3, None, 2), ("y", None, None, 0), ("x", 9, "a", 3)], "s string, q int, letter string, pos int")
    assert sorted(tuple(r) for r in K.full_rows(read, "s", "q", 3).collect()) == [("x", 1, "b", ""), ("x", 2, None, "omitted"), ("x", 3, None, "")]


def test_names(spark):
    df = spark.createDataFrame([("maker/fam-2-mini",), ("fam-2",), ("other",), (None,)], "m string")
    assert [r.x for r in df.select(X.model_family("m", ["fam-2-mini", "fam-2"]).alias("x")).collect()] == ["fam-2-mini", "fam-2", "default", "default"]
    assert [r.x for r in df.select(X.routed_model("m", "maker", "fam-").alias("x")).collect()] == ["maker/fam-2-mini", "maker/fam-2", "other", None]
    assert df.select(X.filled('Q {m}: {{}} {n}', m="m", n=F.lit("{m}")).alias("x")).first().x == "Q maker/fam-2-mini: {{}} {m}"


def test_pseudonyms(spark):
    people = spark.createDataFrame([("a",), ("b",), ("b",), (None,), ("c",)], "p string")
    clash = people.limit(1).select(X.pseudonym(F.lit("c")).alias("pseudonym")).first().pseudonym
    known = spark.createDataFrame([("a", "STUDENT_X"), ("gone", clash)], "p string, pseudonym string")
    got = {r.p: r.pseudonym for r in store.pseudonyms(people, known, "p").collect()}
    assert got["a"] == "STUDENT_X" and len(set(got.values())) == 3 and got["c"].startswith(clash + "_") and got == {r.p: r.pseudonym for r in store.pseudonyms(people, known, "p").collect()}
