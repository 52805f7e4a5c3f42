import json
import math
import random

from gradeline.llm import truncation as T

WHOLE = '{"path_followed": "p1", "values": {"p1.m1": "\\\\frac{1}{2}"}, "undeclared_method": {"used": false, "description": "", "reasoning_valid": null, "reaches_correct_conclusion": null}}'
GRID = '{"suit": "club", "rows": [{"question": 1, "marks": [["a", "x"]], "final_answer": "a", "note": ""}]}'
SCAN = '{"question_label": "1", "hebrew_text": "בד"כ", "transcription_confidence": 0.5}'


def tables(spark, grades, transcripts=()):
    g = spark.createDataFrame([(k, "m", t, 1) for k, t in enumerate(grades)], "id long, provider_model string, raw_response string, ending int")
    t = spark.createDataFrame([(f"T{k}", "m", t) for k, t in enumerate(transcripts)], "transcript_id string, actual_model string, raw_text string")
    return g, t


def test_endings(spark):
    whole = [WHOLE, "```json\n" + WHOLE + "\n```", "Here:\n" + WHOLE + "\nסוף.", GRID, GRID + "\n\nAll marks.", WHOLE.replace('"used": false', '"used" false')]
    cut = [WHOLE[:-1], WHOLE[:90], WHOLE[:90] + "…", WHOLE[:90] + ' [truncated]', WHOLE[:100] + '"}}', GRID[:60], GRID[:60] + "...", WHOLE[:150] + '"}}', "{"]
    g, t = tables(spark, whole + cut + [None, "", "  "], [SCAN, "```json\n" + SCAN + "\n```", "A sentence.", SCAN[:-2], SCAN[:40], "A sentence. And", "A sentence...", None, ""])
    got = {(r.source_table, r.record_id) for r in T.found(g.unionByName(g.limit(3)), t).collect()}
    assert got == {("grades", str(k)) for k in range(len(whole), len(whole) + len(cut))} | {("transcriber", f"T{k}") for k in (3, 4, 5, 6)}
    r = T.report(g, t).where("source_table = 'grades'").first()
    assert r.n_records == len(whole) + len(cut) and r.n_cut == len(cut)
    assert T.found(g.limit(0), t.limit(0)).count() == 0 and T.limits(g.limit(0), t.limit(0)).count() == 0


def found(spark, transcripts):
    g, t = tables(spark, [], transcripts)
    return {int(r.record_id[1:]) for r in T.found(g, t).collect()}


def lengths(n, seed=1):
    r = random.Random(seed)
    return [max(int(r.lognormvariate(5.5, 0.4)), 9) for _ in range(n)]


def words(n, seed):
    """A text of n characters with a full stop at its end and every 25 characters."""
    r = random.Random(seed)
    return "".join(r.choice("abcdefgh ") if k % 25 else "." for k in range(n, 1, -1)) + "."


def test_cut_behind_a_full_stop_at_a_limit(spark):
    texts = [words(n, k) if n < 300 else words(299, k)[:-1] + "xy" for k, n in enumerate(lengths(1500))]
    texts += [words(300, 5000 + k) for k in range(5)]
    ends = [k for k, x in enumerate(texts) if len(x) == 300]
    assert found(spark, texts) == set(ends)
    # without the others at that length they are whole
    assert found(spark, [x for x in texts if len(x) != 300] + texts[-5:]) == set()


def test_all_at_a_limit_with_full_stops(spark):
    texts = [words(n, k) for k, n in enumerate(lengths(500)) if n < 300] + [words(300, 5000 + k) for k in range(300)]
    assert found(spark, texts) == {k for k, x in enumerate(texts) if len(x) == 300}


def test_whole_json_as_long_as_the_limit(spark):
    whole = lambda n, k: json.dumps({"hebrew_text": str(k).rjust(6, "x") + "y" * (n - 70), "transcription_confidence": 0.5}).ljust(n)[:n]
    texts = [whole(n, k) for k, n in enumerate(lengths(300)) if 90 < n < 400] + [whole(400, 1000 + k) for k in range(100)] + [whole(500, 2000 + k)[:400] for k in range(100)]
    texts = [x.strip() if len(x) < 400 else x for x in texts]
    got = found(spark, texts)
    assert got == {k for k, x in enumerate(texts) if "confidence" not in x}


def test_one_cut_text_among_thousands(spark):
    assert found(spark, [words(n, k) for k, n in enumerate(lengths(4000, 3))] + ["half a sent"]) == {4000}


def test_one_message_many_times_is_no_limit(spark):
    assert found(spark, [words(n, k) for k, n in enumerate(lengths(200, 4))] + ["The crop is too dark to read."] * 90) == set()


def test_lead_in_of_any_length(spark):
    assert found(spark, ['He said "' + "long words " * 60 + '" and then: ' + x for x in (SCAN, SCAN[:-1])]) == {1}


def test_censored_fit_finds_the_distribution():
    r = random.Random(2)
    x = [r.gauss(6.0, 0.5) for _ in range(20000)]
    limit = math.log(500)
    bins = [(v, 1.0) for v in x if v < limit]
    mu, sd = T.fit(bins, [(limit, float(len(x) - len(bins)))])
    assert abs(mu - 6.0) < 0.02 and abs(sd - 0.5) < 0.02
    assert T.fit([(3.0, 5.0)], [])[0] == 3.0


def test_limits(spark):
    g, t = tables(spark, [], [words(n, k) if n < 300 else words(299, k)[:-1] + "xy" for k, n in enumerate(lengths(2000))])
    rows = T.limits(g, t).where("unit = 'chars'").collect()
    assert [r.at for r in rows if r.at] == [300]
    r = next(r for r in rows if r.at is None)
    assert abs(r.mu - 5.5) < 0.05 and abs(r.sd - 0.4) < 0.05
