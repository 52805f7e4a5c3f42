"""Grid responses as models return them: in words, in need of repair, or not readable."""

from gradeline.operators import votes
from gradeline.plans import grading

ROWS = '"rows": [{"question": 1, "marks": [["a"]], "final_answer": "a", "note": ""}, {"question": 2, "marks": [], "final_answer": null, "note": ""}]'


def test_responses(spark):
    rows = [
        (1, "plain", f'{{"suit": "heart", {ROWS}}}'), (2, "before", f'Here is the JSON:\n{{"suit": "heart", {ROWS}}}'), (3, "after", f'```json\n{{"suit": "heart", {ROWS}}}\n```\nAll marks were read.'),
        (4, "escape", f'{{"suit": "heart", {ROWS}, "note": "$\\leq$"}}'), (5, "cut", '{"suit": "heart", "rows": [{"question": 1, "final_answer": "b"'), (6, "words", "no grid here"), (7, "none", None),
    ]
    a = grading.grid_answers(spark.createDataFrame(rows, "id long, booklet_id string, raw_response string"))
    got = {}
    for r in a.collect():
        got.setdefault(r.booklet_id, []).append((r.suit, r.question, r.letter))
    both = [("heart", 1, "a"), ("heart", 2, None)]
    assert got == {"plain": both, "before": both, "after": both, "escape": both, "cut": [("heart", 1, "b")], "words": [(None, None, None)], "none": [(None, None, None)]}
    k = votes.majority(a.where("suit is not null"), ["suit", "question"], "letter")
    assert [(r.letter, r.support) for r in k.where("question = 1").collect()] == [("a", 4)]
    graded = {(r.booklet_id, r.question): r.score for r in votes.graded(a.withColumnRenamed("letter", "answer"), k, ["suit", "question"], "answer", 10.0).collect()}
    assert graded["words", None] is None and graded["before", 1] == 10.0 and graded["cut", 1] == 0.0
