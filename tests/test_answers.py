"""Recorded model answers read into rows."""

import json

import pytest
from pyspark.sql import functions as F

from gradeline.operators import answers as A

LETTERS = ("א", "ב", "ג", "ד")


def test_grid_payloads():
    rows = [{"question": 1, "marks": [{"option": "א", "type": "X"}], "final_answer": "א"}, {"question": "2", "marks": [["ב", "circle"], ["z", "x"]], "final_answer": "z", "note": "n"}, "junk", {"question": "x"}, {"question": 1, "final_answer": "ג"}]
    for payload in (rows, {"rows": rows}):
        got = A.grid(payload, 3, LETTERS)
        assert got[0] == (1, [], "ג", "", None)  # the later row of a question
        assert got[1] == (2, [("ב", "circle")], None, "n", None)
        assert got[2] == (3, [], None, "omitted", "question 3 omitted")
        assert [e[-1].split(":")[0] for e in got[3:]] == ["malformed row", "row without a question number"]
    assert A.grid(None, 3, LETTERS) == [(None, [], None, "", A.UNREADABLE)] and len(A.grid({}, 3, LETTERS)) == 3 and len(A.grid("text", 2, LETTERS)) == 2


def test_grids(spark):
    df = spark.createDataFrame([(1, '{"rows": [{"question": 1, "marks": [["א", "x"]], "final_answer": "א", "note": ""}]}', 5), (2, None, 5), (3, "words", 5)], "id long, response string, question int")
    got = sorted((r.id, r.question, r.final_answer, r.error) for r in A.grids(df, ["id"], "response", 2, LETTERS).where("question is not null").collect())
    assert got == [(1, 1, "א", None), (1, 2, None, "question 2 omitted")]
    assert A.grids(df, ["id"], "response", 2, LETTERS).where("question is null").count() == 2 and A.grids(df.limit(0), ["id"], "response", 2, LETTERS).count() == 0


def test_printed_options(spark):
    page = lambda q, **o: json.dumps({"questions": [{"question": q, "options": o}]}, ensure_ascii=False)
    df = spark.createDataFrame([("b", 1, page(1, **{"(א)": " 1/2 ", "ב": "3"})), ("b", 2, page(1, א="0.7")), ("b", 3, page("4", ד="x")), ("b", 4, None)], "booklet string, page int, response string")
    got = {(r.question, r.letter): r.text for r in A.printed_options(df, ["booklet"], "response", LETTERS, "page").collect()}
    assert got[1, "א"] == "0.7" and got[1, "ב"] == "" and got[4, "ד"] == "x" and len(got) == 8


@pytest.mark.parametrize("corners, out", [([0.1, 0.2, 0.5, 0.6], (100, 400, 400, 800)), ([0.5, 0.5, 0.2, 0.2], (500, 1000, 200, 400)), ([0.5, 0.5, 0.5, 0.9], (500, 1000, 500, 1000)), ([-1, 0, 2, 1], (0, 0, 1000, 2000)), ([1, 1, 1, 1], (1000, 2000, 1, 1)), ([0, 0, 1], None), ("x", None), ([0, 0, "a", 1], None)])
def test_box(corners, out):
    assert A.box(corners, 1000, 2000) == out


def test_layout(spark):
    payload = {
        "page_summary": "s", "n_columns": 2, "reading_order_hint": "rtl", "override_gutter_prior": False, "tables": [{"bbox_norm": [0, 0, 0.5, 0.5]}, 3, {"bbox_norm": [1]}],
        "questions": [{"question_id": "1", "bbox_norm": [0, 0, 0.5, 0.5], "confidence": 0.6, "state": "blank"}, {"question_id": "2", "bbox_norm": [0, 0.5, 1, 1], "has_student_ink": False}, {"question_id": "1", "bbox_norm": [0.5, 0, 1, 0.5], "confidence": 0.6}, 7],
    }
    df = spark.createDataFrame([("p", json.dumps(payload), 100, 200), ("q", "not json", 100, 200), ("r", '{"page_summary": "empty"}', 100, 200), ("s", '{"questions": [1], "page_summary": "x"}', 100, 200)], "page string, response string, w int, h int")
    got = {r.page: r for r in A.layouts(df, ["page"], "response", "w", "h").collect()}
    p = got["p"]
    assert p.usable and [(r.question_id, r.x, r.state, r.confidence, r.reading_order) for r in p.regions] == [("2", 0, "blank", 0.8, 0), ("1", 50, "answered", 0.6, 1)] and p.errors == ["bad region 3"]
    assert [(t["index"], t.confidence, t.kind) for t in p.tables] == [(0, 0.7, "unknown")]
    assert not got["q"].usable and got["q"].errors == [A.UNREADABLE] and got["r"].usable and not got["s"].usable


def test_columns(spark):
    df = spark.createDataFrame([(101, 2, "rtl", False, 1), (101, 3, "ltr", False, 1), (101, 1, "x", True, 2), (101, 2, "ltr", False, 2)], "w int, n int, hint string, override boolean, found int")
    two = F.array(*(F.struct(F.lit(i).alias("index"), F.lit(x).alias("x0"), F.lit(y).alias("x1")) for i, x, y in ((0, 0, 40), (1, 60, 101))))
    found = F.when(F.col("found") == 2, two).otherwise(F.slice(two, 1, 1))
    got = [[tuple(c) for c in r.c] for r in df.select(A.chosen_columns(found, F.col("w"), F.col("n"), F.col("hint"), F.col("override")).alias("c")).collect()]
    assert got == [[(1, 50, 101), (0, 0, 50)], [(0, 0, 50), (1, 50, 101)], [(0, 0, 101)], [(0, 0, 40), (1, 60, 101)]]
    prior = json.loads(df.where("found = 2").select(A.columns_prior(found, F.col("w")).alias("j")).first().j)
    assert prior["n_columns"] == 2 and prior["is_multi_column"] and prior["columns"][1]["bbox_norm"] == [0.5941, 0.0, 1.0, 1.0]


def test_transcripts(spark):
    raw = '{"hebrew_text": " א ", "math_latex": ["x=1", " ", "\\\\frac{1}{"], "transcription_confidence": "0.9", "flagged_tokens": ["t"]}'
    df = spark.createDataFrame([("a", raw, ["e"]), ("b", "", ["e"]), ("c", None, ["e"]), ("d", raw, []), ("e", '{"is_blank": true}', ["e"]), ("f", "[1]", ["e"]), ("a", raw, ["e"])], "id string, raw_text string, errors array<string>")
    got = {r.id: r for r in A.repaired(df, ["id"]).collect()}
    assert set(got) == set("abcef") and {k for k, r in got.items() if r.repaired} == {"a", "e"}
    assert got["a"].interleaved_markdown == "א\n\n$x=1$\n$\\frac{1}{$" and got["a"].self_reported_confidence == 0.9
    m = {r.id: r for r in A.measured(A.repaired(df, ["id"]), F.col("is_blank")).collect()}
    assert (m["a"].latex_eval.total, m["a"].latex_eval.parsed, m["a"].latex_eval.parse_rate, m["a"].latex_eval.errors) == (2, 1, 0.5, ["\\frac{1}{"]) and m["e"].objective_confidence == 0.95 and m["b"].objective_confidence == 0.15
    assert A.parse_stats([]) == (0, 0, 1.0, []) and A.parse_stats(["x", "((", "))"], 1, 3) == (3, 1, 0.333, ["(("])


def test_proposals(spark):
    good = '{"paths": [{"milestones": [{"id": "m1", "points": 2, "expected": "0.6*0.95"}, {"id": "m2", "points": "3", "expected": null, "depends_on": ["m1"]}]}]}'
    df = spark.createDataFrame([("1", good), ("2", '{"paths": [{"milestones": [{"points": 1}]}]}'), ("3", None)], "question_id string, response string")
    got = {r.question_id: r for r in A.proposals(df, ["question_id"], "response").collect()}
    assert [(m.id, m.points, m.expected, m.depends_on) for m in got["1"].paths[0].milestones] == [("m1", 2.0, "0.6*0.95", []), ("m2", 3.0, None, ["m1"])] and got["1"].paths[0].path_id == "path1"
    assert got["2"].error == "path 1 is no list of milestones" and got["3"].error == A.UNREADABLE and not got["3"].paths
