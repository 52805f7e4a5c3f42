"""Queries over transcripts of crops."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions import fixed, scores as S, text as X
from ..operators import layout, measures, store
from .tables import Query, table

#: Letters of a script in order, so that an engine that counts bytes can measure edit distance on one-byte letters.
HEBREW_LETTERS = "אבגדהוזחטיךכלםמןנסעףפץצקרשת־׀׃׳״װױײ"
ASCII_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHI"


def rows(s, d, *cols):
    t = table(s, d, "transcriber")
    return t.select(*cols).distinct() if cols else t.distinct()


def ordered(s, d, *more):
    """Readings of a crop in order, without failed ones."""
    t = rows(s, d, "transcript_id", "crop_id", "transcribed_at", "hebrew_text", "interleaved_markdown", "errors", *more).where(F.size("errors") == 0)
    return t


def cer_pairs(s, d):
    """A crop's reading against the reading before it."""
    t = ordered(s, d).select("crop_id", "transcript_id", "transcribed_at", X.prose(X.first_text("hebrew_text", "interleaved_markdown")).alias("text"))
    w = W.partitionBy("crop_id").orderBy("transcribed_at", "transcript_id")
    p = t.withColumn("before_id", F.lag("transcript_id").over(w)).withColumn("before", F.lag("text").over(w)).where("before_id is not null")
    return p.select("crop_id", "before_id", "transcript_id", "before", "text", X.error_rate(F.col("before"), F.col("text")).alias("cer"))


PROSE_SQL = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({t}, '\$\$?[^$]+\$\$?', ' ', 'g'), '(?i)\[\[deleted:[^\]]+\]\]', ' ', 'g'), '\p{{Mn}}', '', 'g'), '[^\x{{0590}}-\x{{05FF}}0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"""
FIRST_SQL = "coalesce(nullif(hebrew_text, ''), nullif(interleaved_markdown, ''), '')"
PAIRS_SQL = f"""t AS (SELECT crop_id, transcript_id, transcribed_at, {PROSE_SQL.format(t=FIRST_SQL)} AS text FROM (SELECT DISTINCT crop_id, transcript_id, transcribed_at, hebrew_text, interleaved_markdown, errors FROM transcriber) WHERE len(errors) = 0),
p AS (SELECT *, lag(transcript_id) OVER w AS before_id, lag(text) OVER w AS before FROM t WINDOW w AS (PARTITION BY crop_id ORDER BY transcribed_at, transcript_id)),
c AS (SELECT crop_id, before_id, transcript_id, before, text, CASE WHEN before = '' AND text = '' THEN 0.0::DOUBLE WHEN before = '' OR text = '' THEN 1.0::DOUBLE
  ELSE levenshtein(translate(before, '{HEBREW_LETTERS}', '{ASCII_LETTERS}'), translate(text, '{HEBREW_LETTERS}', '{ASCII_LETTERS}'))::DOUBLE / length(before) END AS cer FROM p WHERE before_id IS NOT NULL)"""

CLEAN_SQL = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '^[\s$]+|[\s$]+$', '', 'g'), '\\dots', '\\ldots', 'g'), '\\[dt]frac', '\\frac', 'g'), '[=+\-*/,]+\s*$', '', 'g')"
MATH_SQL = r"(length({x}) > 0 AND length({x}) <= 500 AND NOT regexp_matches({x}, '[\x{{0590}}-\x{{05FF}}]') AND (regexp_matches({x}, '\\[a-zA-Z]+|[=^_{{}}\\+*/]|[0-9]') OR regexp_matches({x}, '^[A-Za-z]$')))"
FORMULAS_SQL = r"""list_concat(regexp_extract_all(coalesce(interleaved_markdown, ''), '\$\$([^$]+)\$\$', 1), regexp_extract_all(coalesce(interleaved_markdown, ''), '\$([^$]+)\$', 1))"""



def confidences(s, d):
    t = rows(s, d, "transcript_id", "state", "hebrew_text", "interleaved_markdown", "latex_eval", "flagged_tokens", "self_reported_confidence")
    c = S.confidence(F.col("state") == "blank", X.first_text("hebrew_text", "interleaved_markdown") != "", F.col("latex_eval.total"), F.col("latex_eval.parse_rate"), F.greatest(F.size("flagged_tokens"), F.lit(0)), F.col("self_reported_confidence"))
    return t.select("transcript_id", "state", c.alias("confidence"), "self_reported_confidence")


CONF_SQL = f"""c AS (SELECT transcript_id, state, self_reported_confidence AS sr, {FIRST_SQL} AS text, greatest(0.05, least(0.98, (CASE WHEN coalesce(latex_eval.total, 0) = 0 THEN 0.92::DOUBLE ELSE coalesce(latex_eval.parse_rate, 0) END) - least(0.35::DOUBLE, 0.07::DOUBLE * coalesce(len(flagged_tokens), 0)))) AS base
  FROM (SELECT DISTINCT transcript_id, state, hebrew_text, interleaved_markdown, latex_eval, flagged_tokens, self_reported_confidence FROM transcriber)),
conf AS (SELECT transcript_id, state, CASE WHEN state = 'blank' THEN 0.95::DOUBLE WHEN text = '' THEN 0.15::DOUBLE ELSE round(CAST(CASE WHEN sr IS NULL THEN base ELSE 0.9 * base + 0.1 * least(greatest(0, least(1, sr)), 0.85::DOUBLE) END AS DECIMAL(18, 8)), 4)::DOUBLE END AS confidence, sr AS self_reported_confidence FROM c)"""


def upserted(s, d):
    t = rows(s, d, "transcript_id", "crop_id", "model", "prompt_version", "state").where("prompt_version is not null")
    newest = t.agg(F.max("prompt_version")).first()[0]
    return store.upsert(t.where(F.col("prompt_version") != newest), t.where(F.col("prompt_version") == newest), ["crop_id", "model"], "transcript_id").select("crop_id", "model", "prompt_version", "transcript_id")


def expected_questions(s, d):
    """The questions of the rubrics that a booklet was graded by, and what was found of it."""
    r = table(s, d, "grades").select("booklet_id", "rubric_id").distinct().join(table(s, d, "curated_rubric").select("rubric_id", "question_id").distinct(), "rubric_id")
    return r.select("booklet_id", "question_id").distinct(), rows(s, d, "booklet_id", "question_id", "state")


def last_readings(s, d):
    """The last reading without errors of each crop by each model, with text."""
    t = ordered(s, d, "model").withColumn("text", X.first_text("hebrew_text", "interleaved_markdown")).where("text <> ''")
    return store.latest(t.select("crop_id", "model", "transcribed_at", "transcript_id", "text"), ["crop_id", "model"], "transcribed_at", "transcript_id")


def truth(s, d):
    return measures.agreed_truth(last_readings(s, d), "model", "crop_id", "text")


ASCII = lambda x: f"translate({x}, '{HEBREW_LETTERS}', '{ASCII_LETTERS}')"
CER_SQL = lambda a, b: f"CASE WHEN {a} = '' AND {b} = '' THEN 0.0::DOUBLE WHEN {a} = '' OR {b} = '' THEN 1.0::DOUBLE ELSE levenshtein({ASCII(a)}, {ASCII(b)})::DOUBLE / length({a}) END"
TRUTH_SQL = f"""l AS (SELECT crop_id, model, t, {PROSE_SQL.format(t="t")} AS p FROM (SELECT *, {FIRST_SQL} AS t FROM (SELECT DISTINCT crop_id, model, transcribed_at, transcript_id, hebrew_text, interleaved_markdown, errors FROM transcriber) WHERE len(errors) = 0)
  WHERE t <> '' QUALIFY row_number() OVER (PARTITION BY crop_id, model ORDER BY transcribed_at DESC, transcript_id DESC) = 1),
k AS (SELECT a.crop_id, a.model AS ra, b.model AS rb, CASE WHEN length(a.p) >= length(b.p) THEN a.t ELSE b.t END AS truth, greatest(length(a.p), length(b.p)) AS n, {CER_SQL("a.p", "b.p")} AS cer FROM l a JOIN l b ON a.crop_id = b.crop_id AND a.model < b.model),
truth AS (SELECT crop_id, truth FROM k WHERE cer <= 0.08 AND n >= 8 QUALIFY row_number() OVER (PARTITION BY crop_id ORDER BY cer, ra, rb) = 1)"""
GATE_COLUMNS = ("transcript_id", "crop_id", "actual_model", "hebrew_text", "interleaved_markdown", "math_latex", "latex_eval", "prompt_tokens", "candidate_tokens", "cache_hit", "errors", "ok")


def coverage(s, d):
    expected, found = expected_questions(s, d)
    return layout.coverage(expected, found, ["booklet_id", "question_id"])


QUERIES: dict[str, Query] = {
    "gate_metrics_by_model": Query(
        lambda s, d: measures.transcription_passes(rows(s, d, *GATE_COLUMNS), truth(s, d), "crop_id", "actual_model"),
        f"""WITH {TRUTH_SQL}, t AS (SELECT DISTINCT transcript_id, crop_id, actual_model, hebrew_text, interleaved_markdown, math_latex, latex_eval, prompt_tokens AS p, candidate_tokens AS c, cache_hit, errors, ok FROM transcriber),
        x AS (SELECT *, coalesce(len(errors), 0) > 0 AS failed, {FIRST_SQL} AS said, {FIRST_SQL} <> '' AS has FROM t),
        y AS (SELECT *, NOT failed AND NOT coalesce(cache_hit, false) AND (coalesce(ok, false) OR has OR coalesce(len(math_latex), 0) > 0) AND (coalesce(p, 0) > 0 OR coalesce(c, 0) > 0) AS paid FROM x),
        g AS (SELECT actual_model, count(*) AS n_with_truth, round(avg({CER_SQL("a", "b")}), 4) AS mean_cer FROM (SELECT actual_model, {PROSE_SQL.format(t="truth")} AS a, {PROSE_SQL.format(t="said")} AS b FROM x JOIN truth USING (crop_id) WHERE NOT failed) GROUP BY 1),
        m AS (SELECT actual_model, count(*) AS n_results, count(*) FILTER (WHERE coalesce(ok, false) OR (NOT failed AND has)) AS n_ok, round(avg(coalesce(latex_eval.parse_rate, 0)) FILTER (WHERE coalesce(latex_eval.total, 0) > 0 AND NOT failed), 4) AS mean_parse_rate,
          count(*) FILTER (WHERE failed) AS n_errors, CAST(sum(len(list_filter(coalesce(errors, []), lambda e: contains(e, '503') AND NOT contains(lower(e), 'retry')))) AS BIGINT) AS n_unhandled_overload,
          round(CASE WHEN count(*) FILTER (WHERE paid) >= 3 THEN median(coalesce(p, 0)) FILTER (WHERE paid) ELSE coalesce(avg(coalesce(p, 0)) FILTER (WHERE paid), 0) END, 1) AS typical_prompt_tokens,
          round(CASE WHEN count(*) FILTER (WHERE paid) >= 3 THEN median(coalesce(c, 0)) FILTER (WHERE paid) ELSE coalesce(avg(coalesce(c, 0)) FILTER (WHERE paid), 0) END, 1) AS typical_candidate_tokens,
          count(DISTINCT crop_id) AS n_crops FROM y GROUP BY 1),
        f AS (SELECT m.*, coalesce(n_with_truth, 0) AS n_with_truth, mean_cer, coalesce(mean_cer <= 0.08, false) AS mean_cer_pass, coalesce(mean_parse_rate >= 0.9, false) AS mean_parse_rate_pass, n_unhandled_overload <= 0 AS n_unhandled_overload_pass FROM m LEFT JOIN g USING (actual_model))
        SELECT *, mean_cer_pass AND mean_parse_rate_pass AND n_unhandled_overload_pass AS all_pass FROM f""",
    ),
    "agreed_truth": Query(truth, f"WITH {TRUTH_SQL} SELECT * FROM truth"),
    "cer_pairs": Query(
        lambda s, d: cer_pairs(s, d).select("crop_id", "before_id", "transcript_id", F.round("cer", 6).alias("cer")),
        f"WITH {PAIRS_SQL} SELECT crop_id, before_id, transcript_id, round(cer, 6) AS cer FROM c",
    ),
    "agreed_texts": Query(
        lambda s, d: cer_pairs(s, d).where((F.col("cer") <= 0.08) & (F.greatest(F.length("before"), F.length("text")) >= 8)).select("crop_id", "transcript_id", F.when(F.length("before") >= F.length("text"), F.col("before")).otherwise(F.col("text")).alias("agreed")),
        f"WITH {PAIRS_SQL} SELECT crop_id, transcript_id, CASE WHEN length(before) >= length(text) THEN before ELSE text END AS agreed FROM c WHERE cer <= 0.08 AND greatest(length(before), length(text)) >= 8",
    ),
    "mean_cer_by_model": Query(
        lambda s, d: cer_pairs(s, d).join(rows(s, d, "transcript_id", "actual_model"), "transcript_id").groupBy("actual_model").agg(F.count("*").alias("n"), F.round(F.avg("cer"), 4).alias("mean_cer")),
        f"WITH {PAIRS_SQL} SELECT actual_model, count(*) AS n, round(avg(cer), 4) AS mean_cer FROM c JOIN (SELECT DISTINCT transcript_id, actual_model FROM transcriber) USING (transcript_id) GROUP BY 1",
    ),
    "text_normalise": Query(
        lambda s, d: rows(s, d, "transcript_id", "hebrew_text", "question_label").select("transcript_id", X.prose("hebrew_text").alias("prose"), X.question_id("question_label").alias("question")),
        f"""SELECT transcript_id, {PROSE_SQL.format(t="coalesce(hebrew_text, '')")} AS prose, coalesce(nullif(regexp_extract(trim(coalesce(question_label, '')), 'שאלה\\s*(\\d+)', 1), ''), nullif(regexp_extract(trim(coalesce(question_label, '')), '\\b(\\d{{1,2}})\\b', 1), ''), nullif(trim(coalesce(question_label, '')), ''), 'unknown') AS question
        FROM (SELECT DISTINCT transcript_id, hebrew_text, question_label FROM transcriber)""",
    ),
    "formula_extract": Query(
        lambda s, d: rows(s, d, "transcript_id", "interleaved_markdown", "math_latex").select("transcript_id", F.array_join(X.all_formulas("math_latex", "interleaved_markdown"), " ; ").alias("formulas"), F.size(X.formulas("interleaved_markdown")).alias("n_spans")),
        f"""WITH t AS (SELECT DISTINCT transcript_id, interleaved_markdown, math_latex FROM transcriber),
        s AS (SELECT transcript_id, coalesce(math_latex, []) AS m, list_filter(list_transform({FORMULAS_SQL}, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS f FROM t),
        e AS (SELECT transcript_id, len(f) AS n_spans, list_transform(list_filter(list_concat(m, f), lambda x: x IS NOT NULL), lambda x: {CLEAN_SQL.format(x="x")}) AS l FROM s),
        k AS (SELECT transcript_id, n_spans, list_filter(l, lambda x: {MATH_SQL.format(x="x")}) AS l FROM e)
        SELECT transcript_id, array_to_string(list_transform(list_filter(list_zip(l, range(1, len(l) + 1)), lambda z: list_position(l, z[1]) = z[2]), lambda z: z[1]), ' ; ') AS formulas, CAST(n_spans AS INTEGER) AS n_spans FROM k""",
    ),
    "formula_results": Query(
        lambda s, d: rows(s, d, "transcript_id", "math_latex").select("transcript_id", F.explode("math_latex").alias("formula")).distinct().select("transcript_id", "formula", X.result_segment("formula").alias("result")).withColumn("last_number", X.last_number(F.col("result"))),
        f"""WITH e AS (SELECT DISTINCT transcript_id, unnest(math_latex) AS formula FROM transcriber),
        r AS (SELECT transcript_id, formula, coalesce(list_filter(list_transform(regexp_split_to_array(coalesce(formula, ''), '{fixed.RESULT_SIGNS}'), lambda x: trim(x)), lambda x: x <> '')[-1], '') AS result FROM e)
        SELECT transcript_id, formula, result, regexp_extract_all(result, '{fixed.NUMBER}')[-1] AS last_number FROM r""",
    ),
    "option_texts": Query(
        lambda s, d: rows(s, d, "transcript_id", "math_latex").select(F.explode("math_latex").alias("formula")).select(X.option_text("formula").alias("option")).groupBy("option").agg(F.count("*").alias("n")),
        r"""SELECT replace(replace(regexp_replace(coalesce(formula, ''), '^[\s$]+|[\s$]+$', '', 'g'), '\%', '%'), ' ', '') AS option, count(*) AS n FROM (SELECT unnest(math_latex) AS formula FROM (SELECT DISTINCT transcript_id, math_latex FROM transcriber)) GROUP BY 1""",
    ),
    "parse_stats_by_model": Query(
        lambda s, d: rows(s, d, "transcript_id", "actual_model", "latex_eval").groupBy("actual_model").agg(F.sum(F.coalesce("latex_eval.total", F.lit(0))).alias("formulas"), F.count_if(F.col("latex_eval.total") > 0).alias("n_with"), F.round(F.coalesce(F.avg(F.when(F.col("latex_eval.total") > 0, F.col("latex_eval.parse_rate"))), F.lit(1.0)), 4).alias("parse_rate")),
        """SELECT actual_model, CAST(sum(coalesce(latex_eval.total, 0)) AS BIGINT) AS formulas, count(*) FILTER (WHERE latex_eval.total > 0) AS n_with, round(coalesce(avg(latex_eval.parse_rate) FILTER (WHERE latex_eval.total > 0), 1.0), 4) AS parse_rate
        FROM (SELECT DISTINCT transcript_id, actual_model, latex_eval FROM transcriber) GROUP BY 1""",
    ),
    "confidence_score": Query(confidences, f"WITH {CONF_SQL} SELECT * FROM conf"),
    "calibration": Query(
        lambda s, d: rows(s, d, "transcript_id", "self_reported_confidence", "ok").where("self_reported_confidence is not null").groupBy(F.floor(F.col("self_reported_confidence") * 10).alias("tenth")).agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("ok", F.lit(False)).cast("int")), 6).alias("ok_rate")),
        "SELECT CAST(floor(self_reported_confidence * 10) AS BIGINT) AS tenth, count(*) AS n, round(avg(CASE WHEN coalesce(ok, false) THEN 1 ELSE 0 END), 6) AS ok_rate FROM (SELECT DISTINCT transcript_id, self_reported_confidence, ok FROM transcriber) WHERE self_reported_confidence IS NOT NULL GROUP BY 1",
    ),
    "latest_transcripts": Query(
        lambda s, d: store.latest(rows(s, d, "transcript_id", "crop_id", "model", "transcribed_at", "state"), ["crop_id", "model"], "transcribed_at", "transcript_id").select("crop_id", "model", "transcript_id", "state"),
        "SELECT crop_id, model, transcript_id, state FROM (SELECT DISTINCT transcript_id, crop_id, model, transcribed_at, state FROM transcriber) QUALIFY row_number() OVER (PARTITION BY crop_id, model ORDER BY transcribed_at DESC, transcript_id DESC) = 1",
    ),
    "keyed_upsert": Query(  # readings by the newest prompt over all earlier ones
        upserted,
        """SELECT crop_id, model, prompt_version, transcript_id FROM (SELECT DISTINCT transcript_id, crop_id, model, prompt_version, prompt_version = (SELECT max(prompt_version) FROM transcriber) AS src FROM transcriber
          WHERE crop_id <> '' AND model <> '' AND prompt_version IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY crop_id, model ORDER BY src DESC, transcript_id DESC) = 1""",
    ),
    "best_confidence": Query(
        lambda s, d: store.latest(rows(s, d, "transcript_id", "booklet_id", "question_id", "self_reported_confidence"), ["booklet_id", "question_id"], F.col("self_reported_confidence").desc_nulls_last(), F.col("transcript_id").desc()),
        "SELECT transcript_id, booklet_id, question_id, self_reported_confidence FROM (SELECT DISTINCT transcript_id, booklet_id, question_id, self_reported_confidence FROM transcriber) QUALIFY row_number() OVER (PARTITION BY booklet_id, question_id ORDER BY self_reported_confidence DESC NULLS LAST, transcript_id DESC) = 1",
    ),
    "coverage_states": Query(
        coverage,
        """WITH t AS (SELECT DISTINCT booklet_id, question_id, state FROM transcriber), e AS (SELECT DISTINCT booklet_id, q.question_id FROM (SELECT DISTINCT booklet_id, rubric_id FROM grades) JOIN (SELECT DISTINCT rubric_id, question_id FROM curated_rubric) q USING (rubric_id)),
        f AS (SELECT booklet_id, question_id, bool_and(state = 'blank') AS blank FROM t GROUP BY ALL)
        SELECT booklet_id, question_id, CASE WHEN blank IS NULL THEN 'not_found' WHEN blank THEN 'blank' ELSE 'answered' END AS coverage FROM e LEFT JOIN f USING (booklet_id, question_id)""",
    ),
    "halted_pages": Query(  # an expected question that is not found halts the booklet; what is blank does not
        lambda s, d: layout.halting(coverage(s, d), "booklet_id", "question_id"),
        """WITH t AS (SELECT DISTINCT booklet_id, question_id FROM transcriber), e AS (SELECT DISTINCT booklet_id, q.question_id FROM (SELECT DISTINCT booklet_id, rubric_id FROM grades) JOIN (SELECT DISTINCT rubric_id, question_id FROM curated_rubric) q USING (rubric_id)),
        c AS (SELECT e.booklet_id, e.question_id, t.booklet_id IS NULL AS missing FROM e LEFT JOIN t USING (booklet_id, question_id))
        SELECT booklet_id, bool_or(missing) AS halted, coalesce(string_agg(CASE WHEN missing THEN 'question ' || question_id || ' not found' END, '; ' ORDER BY question_id), '') AS reasons FROM c GROUP BY 1""",
    ),
    "crop_discovery": Query(
        lambda s, d: rows(s, d, "crop_id", "booklet_id", "page_name", "question_id", "state").where((F.col("state") == "answered") & (F.col("page_name") != "page_001.png")).join(table(s, d, "booklets").select("booklet_id").distinct(), "booklet_id", "left_semi")
        .select("crop_id", F.concat_ws("/", "booklet_id", X.stem("page_name"), F.concat(F.lit("q"), "question_id")).alias("composite_id"), X.safe_name("crop_id").alias("file_name")).distinct(),
        r"""SELECT DISTINCT crop_id, concat_ws('/', booklet_id, regexp_extract(page_name, '([^/]*?)(?:\.[^./]*)?$', 1), 'q' || question_id) AS composite_id, regexp_replace(crop_id, '[^\p{L}\p{N}_-]', '_', 'g') AS file_name
        FROM transcriber t WHERE state = 'answered' AND page_name <> 'page_001.png' AND EXISTS (SELECT 1 FROM booklets b WHERE b.booklet_id = t.booklet_id)""",
    ),
    "model_slugs": Query(
        lambda s, d: table(s, d, "transcriber").groupBy(X.slug(F.concat_ws(":", "model", "prompt_version")).alias("slug")).agg(F.count_distinct("crop_id").alias("n_crops")),
        "SELECT translate(concat_ws(':', model, prompt_version), '/:', '__') AS slug, count(DISTINCT crop_id) AS n_crops FROM transcriber GROUP BY 1",
    ),
    "tokens_by_model": Query(
        lambda s, d: rows(s, d, "transcript_id", "actual_model", "prompt_tokens", "candidate_tokens").rollup("actual_model").agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("candidate_tokens").alias("candidate_tokens"), F.count("*").alias("n")),
        "SELECT actual_model, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(candidate_tokens) AS BIGINT) AS candidate_tokens, count(*) AS n FROM (SELECT DISTINCT transcript_id, actual_model, prompt_tokens, candidate_tokens FROM transcriber) GROUP BY ROLLUP (actual_model)",
    ),
    "error_rows": Query(
        lambda s, d: rows(s, d, "transcript_id", "actual_model", "errors", "raw_text").where(F.size("errors") > 0).select("transcript_id", "actual_model", F.array_join("errors", "; ").alias("errors"), F.coalesce(F.length("raw_text"), F.lit(0)).alias("raw_length")),
        "SELECT DISTINCT transcript_id, actual_model, array_to_string(errors, '; ') AS errors, CAST(coalesce(length(raw_text), 0) AS INTEGER) AS raw_length FROM transcriber WHERE len(errors) > 0",
    ),
    "cache_misses": Query(
        lambda s, d: rows(s, d, "crop_id", "model", "prompt_version", "cache_hit").select(X.digest(F.concat_ws("\n", "prompt_version", "model", "crop_id"), 24).alias("cache_key"), "cache_hit")
        .where("not cache_hit").select("cache_key").distinct().join(rows(s, d, "crop_id", "model", "prompt_version", "cache_hit").where("cache_hit").select(X.digest(F.concat_ws("\n", "prompt_version", "model", "crop_id"), 24).alias("cache_key")), "cache_key", "left_anti"),
        "WITH k AS (SELECT DISTINCT substr(sha256(concat_ws(chr(10), prompt_version, model, crop_id)), 1, 24) AS cache_key, cache_hit FROM transcriber) SELECT DISTINCT cache_key FROM k WHERE NOT cache_hit AND cache_key NOT IN (SELECT cache_key FROM k WHERE cache_hit)",
    ),
    "pseudonyms": Query(
        lambda s, d: table(s, d, "booklets").select("booklet_id").distinct().select("booklet_id", X.pseudonym("booklet_id", "k").alias("pseudonym")),
        "SELECT DISTINCT booklet_id, 'STUDENT_' || upper(substr(sha256('k' || booklet_id), 1, 12)) AS pseudonym FROM booklets",
    ),
}
