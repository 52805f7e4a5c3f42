import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from gradeline.sources import files, models, sinks
from gradeline.streaming import feeds


def png(path, width=8, height=6):
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + bytes([200] * width) for _ in range(height)))) + chunk(b"IEND", b""))


def test_scans_and_images(spark, tmp_path):
    for n in ("a.PDF", "b.png", "c.txt"):
        (tmp_path / n).write_bytes(b"x")
    assert sorted((r.stem, r.reader) for r in files.scans(spark, str(tmp_path)).collect()) == [("a", "pdf"), ("b", "image")]
    png(tmp_path / "pages" / "page_001.png")
    assert [(r.width, r.height) for r in files.images(spark, str(tmp_path / "pages")).collect()] == [(8, 6)]
    (tmp_path / "pages" / "page_002.png").write_bytes(b"no image")
    assert [(r.path.rsplit("/", 1)[-1], r.error) for r in files.unreadable(spark, str(tmp_path / "pages")).collect()] == [("page_002.png", "not an image")]


def test_crops(spark, tmp_path):
    q = lambda i, state, crop: {"question_id": i, "label": "", "bbox": [0, 0, 1, 1], "state": state, "confidence": 0.5, "reading_order": 0, "crop": crop}
    d = tmp_path / "b1" / "page_002"
    png(d / "question_1.png")
    (d / "manifest.json").write_text(json.dumps({"booklet_id": "b1", "page_name": "page_002.png", "questions": [q("1", "answered", "question_1.png"), q("2", "answered", "gone.png"), q("3", "blank", "question_1.png")]}))
    assert [r.crop_id for r in files.crops(spark, str(tmp_path), ["b1"]).collect()] == ["b1/page_002/q1"]
    assert files.crops(spark, str(tmp_path), ["b2"]).count() == 0 and files.crops(spark, str(tmp_path), cover="page_002.png").count() == 0
    assert [r.crop_id for r in files.crops(spark, str(tmp_path), states=("answered", "blank"), limit=1).collect()] == ["b1/page_002/q1"]


def test_lists(spark, tmp_path):
    (tmp_path / "g.csv").write_text("﻿7,81.5\nname,grade\n123,\n12,90\n", encoding="utf-8")
    assert sorted(tuple(r) for r in files.grade_list(spark, str(tmp_path / "g.csv")).collect()) == [("07", 81.5), ("12", 90.0)]
    (tmp_path / "l.json").write_text(json.dumps({"01": {"version": "heart", "marks": ["a", None]}}))
    assert [(r.question, r.mark) for r in files.hand_labels(spark, str(tmp_path / "l.json")).orderBy("question").collect()] == [(1, "a"), (2, None)]
    (tmp_path / "t.json").write_text(json.dumps({"_note": "x", "c1": "text", "c2": 3, "c3": "42", "c4": "true", "c5": None, "c6": ["a"], "c7": "[x]"}))
    assert sorted(tuple(r) for r in files.ground_truth(spark, str(tmp_path / "t.json")).collect()) == [("c1", "text"), ("c3", "42"), ("c4", "true"), ("c7", "[x]")]
    (tmp_path / "r.json").write_text(json.dumps({"rubric_id": "r", "exam_id": "e", "questions": [{"question_id": "1", "max_points": 3, "paths": []}]}))
    r = files.rubric(spark, str(tmp_path / "r.json")).first()
    assert (r.source, r.kind) == ("instructor", "open")
    (tmp_path / "c.json").write_text(json.dumps({"cases": [{"id": "A", "set": "control"}]}))
    assert files.cases(spark, str(tmp_path / "c.json")).first().declared is True


def test_transcripts_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("c1", "a/b", "text"), ("c2", "a/b", None)], "crop_id string, model string, hebrew_text string")
    sinks.transcripts(rows, str(tmp_path / "t"))
    (tmp_path / "t" / "bad.json").write_text("{broken")
    assert files.transcripts(spark, str(tmp_path / "t")).where("crop_id = 'c1'").count() == 1
    text = sinks.report(rows, ["crop_id", "hebrew_text"])
    assert text.splitlines()[2:] == ["| c1 | text |", "| c2 | n/a |"]
    regions = spark.createDataFrame([("b", "p.png", 1, "2", "blank", 0, 0, 1, 1), ("b", "p.png", 0, "1", "answered", 0, 0, 1, 1)], "booklet_id string, page_name string, reading_order int, question_id string, state string, x int, y int, w int, h int")
    sinks.page_manifests(regions, str(tmp_path / "m"))
    assert [q.question_id for q in spark.read.json(str(tmp_path / "m")).first().questions] == ["1", "2"]
    pages = spark.createDataFrame([("b", "p.png", True, ["question 3 not found"]), ("b", "q.png", False, [])], "booklet_id string, page_name string, halted boolean, halt_reasons array<string>")
    tables = spark.createDataFrame([("b", "p.png", 0, 1, 2, 3, 4, 0.7, "grid")], "booklet_id string, page_name string, index int, x int, y int, w int, h int, confidence double, kind string")
    sinks.page_manifests(regions.withColumn("label", F.lit("l")), str(tmp_path / "m"), pages, tables)
    got = {r.page_name: r for r in spark.read.json(str(tmp_path / "m")).collect()}
    assert got["p.png"].halted and len(got["p.png"].tables) == 1 and got["p.png"].questions[0].label == "l" and got["q.png"].questions is None
    sinks.page_metrics(spark.createDataFrame([("b", "p", 0.5), ("c", "q", 1.0)], "booklet_id string, path string, fixing_score double"), str(tmp_path / "x"))
    (tmp_path / "x" / "booklet_id=c" / "bad.json").write_text("{broken")
    assert {(r.path, r.fixing_score) for r in files.page_metrics(spark, str(tmp_path / "x")).collect()} == {("p", 0.5), ("q", 1.0)}
    crop = spark.createDataFrame([("b", "p.png", "c1", 1, 1, 1, b"x"), ("b", "p.png", "c2", 1, 1, 1, b"y"), ("b", "q.png", "c3", 1, 1, 1, b"z")], "booklet_id string, page_name string, crop_id string, w int, h int, channels int, data binary")
    sinks.crops(crop, str(tmp_path / "c"))
    sinks.crops(crop.where("crop_id = 'c1'"), str(tmp_path / "c"))
    assert {r.crop_id for r in spark.read.parquet(str(tmp_path / "c")).collect()} == {"c1", "c3"}
    sinks.ledger(spark.range(2), str(tmp_path / "l"))
    sinks.ledger(spark.range(1), str(tmp_path / "l"))
    assert spark.read.json(str(tmp_path / "l")).count() == 3


def test_stores(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "crop_id string, model string, t int, v string")
    first = sinks.merged(rows(("a", "m", 1, "old"), ("b", "m", 1, "b"), ("", "m", 1, "x")), str(tmp_path / "s"), ["crop_id", "model"], "t")
    second = sinks.merged(rows(("a", "m", 1, "new"), ("a", "m", 0, "older"), ("c", "m", 1, "c")), str(tmp_path / "s"), ["crop_id", "model"], "t")
    read = lambda p: {(r.crop_id, r.v) for r in spark.read.parquet(p).collect()}
    assert read(first) == {("a", "old"), ("b", "b")} and read(second) == {("a", "new"), ("b", "b"), ("c", "c")} and second.endswith("v1")
    q = [{"question_id": i, "max_points": 3.0, "kind": k, "question_text": "t", "paths": p} for i, k, p in (("2", "mcq", None), ("10", "open", [{"path_id": "p", "description": "d", "milestones": [{"id": "m1", "description": "", "points": 3.0, "expected": "1/2", "depends_on": [], "abs_tol": None}]}]))]
    (tmp_path / "r.json").write_text(json.dumps({"rubric_id": "r", "exam_id": "e", "source": "s", "questions": q}))
    r = files.rubric(spark, str(tmp_path / "r.json"))
    sinks.rubrics(r, str(tmp_path / "rubrics"))
    assert sorted(map(str, files.rubric(spark, str(tmp_path / "rubrics")).collect())) == sorted(map(str, r.collect()))
    t = spark.createDataFrame([("b", "10", "ten", 0.5), ("b", "2", "two", None), ("c", None, None, None)], "booklet_id string, question_id string, interleaved_markdown string, objective_confidence double")
    sinks.transcript_pages(t, str(tmp_path / "p"))
    got = {x.booklet_id: x.value for x in spark.read.text(str(tmp_path / "p"), wholetext=True).collect()}
    assert got["b"] == "## 2\n\ntwo\n\n## 10 (0.50)\n\nten\n\n" and got["c"].startswith("## ?")
    (tmp_path / "file").write_text("x")
    assert sinks.ledger(spark.range(1), str(tmp_path / "file" / "below")) is False


def test_models(spark):
    req = spark.createDataFrame([("v1", "m", "one"), ("v1", "m", "two"), ("v1", "m", "one"), ("v1", "m", "three")], "prompt_version string, model string, prompt string")
    cache = models.keyed(req.where("prompt = 'one'")).dropDuplicates(["cache_key"]).select("cache_key", F.lit("ONE").alias("response"))
    answers, new = models.enriched(req, cache, models.Replay({"two": "TWO"}))
    assert sorted((r.prompt, r.response, r.cache_hit) for r in answers.collect()) == [("one", "ONE", True), ("one", "ONE", True), ("three", None, False), ("two", "TWO", False)]
    assert [r.response for r in new.collect()] == ["TWO"]
    calls, waits = [], []

    def flaky(p):
        calls.append(p)
        if len(calls) < 3:
            raise OSError("503")
        return "ok"

    assert models.with_retries(flaky, "x", sleep=waits.append) == ("ok", None, 3) and waits == [1.0, 2.0]
    assert models.with_retries(models.Replay({}), "x", sleep=waits.append)[2] == 1


def test_attempts_and_requests(spark, monkeypatch):
    a = models.Attempts([models.Replay({"x": "words", "y": '{"a": 1}'}), models.Replay({"x": '{"b": 2}'})], lambda t: t.startswith("{"))
    assert a("x") == '{"b": 2}' and a("y") == '{"a": 1}'
    with pytest.raises(models.Refused):
        a("z")
    monkeypatch.setenv("MODELS_TO_RUN", " a, ,b ")
    assert models.model_list("MODELS_TO_RUN", ["c"]) == ["a", "b"] and models.model_list("NOT_SET_HERE", ["c"]) == ["c"]
    r = models.requests(spark.createDataFrame([("1",)], "q string"), F.concat(F.lit("read "), "q"), "v1", ["a", "b"])
    assert sorted((x.model, x.prompt, x.prompt_version) for x in r.collect()) == [("a", "read 1", "v1"), ("b", "read 1", "v1")]
    got = models.called(models.keyed(r.where("model = 'a'")), models.Replay({"read 1": "{}"})).unionByName(models.called(models.keyed(r.where("model = 'b'")), models.Replay({})))
    assert sorted((x.model, x.n, x.n_answered, x.readable_rate, x.attempts) for x in models.compared(r, got, F.col("response").startswith("{")).collect()) == [("a", 1, 1, 1.0, 1), ("b", 1, 0, 0.0, 1)]


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, t int, v string")
    for i, part in enumerate((rows.where("t = 1"), rows.where("t = 2"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = feeds.overlay(feeds.feed(spark, str(tmp_path / "in"), rows.schema, 100), str(tmp_path / "out"), ["k"], ["t"], str(tmp_path / "cp"))
        q.awaitTermination(120)
        assert q.exception() is None
        got = {(r.k, r.v) for r in spark.read.parquet(str(tmp_path / f"out/v{i}")).collect()}
        assert got == ({("a", "x"), ("b", "z")} if i == 0 else {("a", "y"), ("b", "z")})


@pytest.mark.parametrize("what", ["dedupe", "window"])
def test_watermarks(spark, tmp_path, what):
    rows = spark.createDataFrame([("a", "2031-01-01 00:10:00", 1.0), ("a", "2031-01-01 00:10:00", 1.0), ("b", "2031-01-01 05:00:00", 2.0), ("c", "2031-01-02 05:00:00", 2.0)], "k string, t string, c double").withColumn("t", F.col("t").cast("timestamp"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = feeds.feed(spark, str(tmp_path / "in"), rows.schema)
    out = feeds.first_deliveries(s, "k", "t") if what == "dedupe" else feeds.spend_by_window(s, "t", "c")
    q = out.writeStream.format("memory").queryName(f"out_{what}").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    n = spark.table(f"out_{what}").count()
    assert n == 3 if what == "dedupe" else n >= 2
