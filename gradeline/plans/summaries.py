"""Queries of page summaries, fallbacks and payload clean-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as S, text as X
from ..operators import answers, intake, keys, measures, store
from .general import PARTS_SQL, page_parts
from .tables import Query, table
from .transcripts import GATE_COLUMNS, rows, truth


def reasons(s, d):
    p = page_parts(s, d).select("p_partkey", F.when(F.col("crop") >= 60, F.col("crop") / 1000).otherwise(0.0).alias("clamped"), (F.col("faint") / 200).alias("faint"), (F.col("lighting") / 10).alias("spread"), F.col("contrast"))
    return p.select("p_partkey", S.page_reason(*map(F.col, ("clamped", "faint", "spread", "contrast"))).alias("reason"))


def readings(s, d):
    """The last reading of each crop that has text, of the newest prompt that has one."""
    r = rows(s, d, "transcript_id", "crop_id", "prompt_version", "hebrew_text").where(F.coalesce("hebrew_text", F.lit("")) != "")
    return store.latest(r, ["crop_id"], "prompt_version", "transcript_id").select("crop_id", "transcript_id", "prompt_version")


def payload():
    """Formulas trimmed and blank ones dropped; a missing text in one piece made from prose and formulas."""
    listed = F.filter(F.transform(F.coalesce("math_latex", F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    made = F.concat_ws("\n", F.nullif(F.trim(F.coalesce("hebrew_text", F.lit(""))), F.lit("")), F.transform(listed, lambda x: F.concat(F.lit("$"), x, F.lit("$"))))
    return F.size(listed).alias("n_formulas"), X.first_text("interleaved_markdown", made).alias("markdown")


FAMILIES = ["lark-2-mini", "lark-2"]


def repaired(s, d):
    """Failed readings whose raw text can be read after all, measured again; the others ask for a new call."""
    r = answers.repaired(rows(s, d, "transcript_id", "errors", "raw_text"), ["transcript_id"])
    m = answers.measured(r, F.col("is_blank"))
    return m.select("transcript_id", "repaired", F.coalesce("error", F.lit("")).alias("error"), F.size("math_latex").alias("n_formulas"), "latex_eval.parse_rate", "objective_confidence")


def recomputed(s, d):
    """Gate metrics over stored results, with formulas parsed again."""
    t = rows(s, d, *GATE_COLUMNS)
    return measures.transcription_passes(answers.evaluated(t), truth(s, d), "crop_id", "actual_model")


QUERIES: dict[str, Query] = {
    "page_summary": Query(
        lambda s, d: rows(s, d, "transcript_id", "booklet_id", "page_name", "state", "self_reported_confidence").groupBy("booklet_id", "page_name").agg(
            F.count_if(F.col("state") == "answered").alias("n_answered"), F.count_if(F.col("state") == "blank").alias("n_blank"), F.round(F.coalesce(F.avg("self_reported_confidence"), F.lit(0.0)), 6).alias("mean_confidence")),
        """SELECT booklet_id, page_name, count(*) FILTER (WHERE state = 'answered') AS n_answered, count(*) FILTER (WHERE state = 'blank') AS n_blank, round(coalesce(avg(self_reported_confidence), 0), 6) AS mean_confidence
        FROM (SELECT DISTINCT transcript_id, booklet_id, page_name, state, self_reported_confidence FROM transcriber) GROUP BY ALL""",
    ),
    "layout_summary": Query(
        lambda s, d: rows(s, d, "transcript_id", "booklet_id", "page_name", "state", "prompt_tokens", "cache_hit").agg(
            F.count("*").alias("n_regions"), F.count_distinct("booklet_id", "page_name").alias("n_pages"), F.count_distinct("booklet_id").alias("n_booklets"), F.count_if(F.col("state") == "blank").alias("n_blank"),
            F.sum(F.coalesce("prompt_tokens", F.lit(0))).alias("tokens"), F.count_if("cache_hit").alias("n_cached")),
        """SELECT count(*) AS n_regions, count(DISTINCT (booklet_id, page_name)) AS n_pages, count(DISTINCT booklet_id) AS n_booklets, count(*) FILTER (WHERE state = 'blank') AS n_blank, CAST(sum(coalesce(prompt_tokens, 0)) AS BIGINT) AS tokens, count(*) FILTER (WHERE cache_hit) AS n_cached
        FROM (SELECT DISTINCT transcript_id, booklet_id, page_name, state, prompt_tokens, cache_hit FROM transcriber)""",
    ),
    "page_reasons": Query(
        reasons,
        f"""WITH {PARTS_SQL}, r AS (SELECT p_partkey, concat_ws(' ', CASE WHEN crop >= 60 THEN printf('White point moved %.1f%% of the pixels.', crop / 1000 * 100) END, CASE WHEN faint / 200 >= 0.3 THEN printf('Faint strokes: %.1f%%.', faint / 200 * 100) END,
          CASE WHEN lighting / 10 >= 6 THEN printf('Uneven light (%.1f).', lighting / 10) END, CASE WHEN contrast > 0 AND contrast < 32 THEN printf('Low contrast (%.1f).', contrast) END) AS t FROM parts)
        SELECT p_partkey, CASE WHEN t = '' THEN 'Highest score of its batch.' ELSE t END AS reason FROM r""",
    ),
    "page_owners": Query(
        lambda s, d: intake.pages(table(s, d, "booklets")).join(rows(s, d, "booklet_id").select("booklet_id", X.pseudonym("booklet_id").alias("owner")), "booklet_id", "left").select("booklet_id", "page_name", F.coalesce("owner", F.lit("N/A")).alias("owner")),
        r"""WITH p AS (SELECT booklet_id, unnest(pages) AS p FROM booklets), t AS (SELECT DISTINCT booklet_id, 'STUDENT_' || upper(substr(sha256(booklet_id), 1, 12)) AS owner FROM transcriber)
        SELECT booklet_id, regexp_extract(p.path, '([^/]*?)(?:\.[^./]*)?$', 1) AS page_name, coalesce(owner, 'N/A') AS owner FROM p LEFT JOIN t USING (booklet_id)""",
    ),
    "reading_fallback": Query(
        lambda s, d: rows(s, d, "crop_id").join(readings(s, d), "crop_id", "left").select("crop_id", F.col("transcript_id").alias("reading"), F.coalesce("prompt_version", F.lit("none")).alias("came_from")),
        """WITH r AS (SELECT * FROM (SELECT DISTINCT transcript_id, crop_id, prompt_version FROM transcriber WHERE coalesce(hebrew_text, '') <> '') QUALIFY row_number() OVER (PARTITION BY crop_id ORDER BY prompt_version DESC, transcript_id DESC) = 1)
        SELECT c.crop_id, r.transcript_id AS reading, coalesce(prompt_version, 'none') AS came_from FROM (SELECT DISTINCT crop_id FROM transcriber) c LEFT JOIN r USING (crop_id)""",
    ),
    "transcript_payload": Query(
        lambda s, d: rows(s, d, "transcript_id", "hebrew_text", "math_latex", "interleaved_markdown").select("transcript_id", *payload()),
        r"""WITH t AS (SELECT transcript_id, hebrew_text, interleaved_markdown, list_filter(list_transform(coalesce(math_latex, []), lambda x: trim(x)), lambda x: x <> '') AS l FROM (SELECT DISTINCT transcript_id, hebrew_text, math_latex, interleaved_markdown FROM transcriber)),
        p AS (SELECT transcript_id, CAST(len(l) AS INTEGER) AS n_formulas, interleaved_markdown AS md, array_to_string(list_filter(list_concat([nullif(trim(coalesce(hebrew_text, '')), '')], list_transform(l, lambda x: '$' || x || '$')), lambda x: x IS NOT NULL), chr(10)) AS made FROM t)
        SELECT transcript_id, n_formulas, coalesce(nullif(md, ''), nullif(made, ''), '') AS markdown FROM p""",
    ),
    "model_families": Query(
        lambda s, d: rows(s, d, "transcript_id", "actual_model", "prompt_tokens", "candidate_tokens").groupBy(X.model_family("actual_model", FAMILIES).alias("family")).agg(
            F.count("*").alias("n"), F.sum(F.coalesce("prompt_tokens", F.lit(0))).alias("prompt_tokens"), F.sum(F.coalesce("candidate_tokens", F.lit(0))).alias("candidate_tokens")),
        """SELECT CASE WHEN contains(actual_model, 'lark-2-mini') THEN 'lark-2-mini' WHEN contains(actual_model, 'lark-2') THEN 'lark-2' ELSE 'default' END AS family, count(*) AS n, CAST(sum(coalesce(prompt_tokens, 0)) AS BIGINT) AS prompt_tokens, CAST(sum(coalesce(candidate_tokens, 0)) AS BIGINT) AS candidate_tokens
        FROM (SELECT DISTINCT transcript_id, actual_model, prompt_tokens, candidate_tokens FROM transcriber) GROUP BY 1""",
    ),
    "routed_models": Query(
        lambda s, d: rows(s, d, "actual_model").select("actual_model", X.routed_model("actual_model", "provider", "vlm-").alias("routed")),
        "SELECT DISTINCT actual_model, CASE WHEN contains(actual_model, '/') THEN actual_model WHEN starts_with(actual_model, 'vlm-') THEN 'provider/' || actual_model ELSE actual_model END AS routed FROM transcriber",
    ),
    "crop_prompts": Query(
        lambda s, d: rows(s, d, "crop_id", "booklet_id", "question_id", "question_label").select("crop_id", X.filled("Booklet {booklet}, question {question} ({label}): transcribe.", booklet="booklet_id", question="question_id", label="question_label").alias("prompt")),
        "SELECT crop_id, 'Booklet ' || coalesce(booklet_id, '') || ', question ' || coalesce(question_id, '') || ' (' || coalesce(question_label, '') || '): transcribe.' AS prompt FROM (SELECT DISTINCT crop_id, booklet_id, question_id, question_label FROM transcriber)",
    ),
    "kept_pseudonyms": Query(  # those of the grades are given; the booklets get the same or new ones
        lambda s, d: store.pseudonyms(table(s, d, "booklets"), table(s, d, "grades").where("needs_review = 1").select("booklet_id").distinct().withColumn("pseudonym", F.concat(F.lit("KEPT_"), "booklet_id")), "booklet_id", "k"),
        """WITH k AS (SELECT DISTINCT booklet_id FROM grades WHERE needs_review = 1) SELECT DISTINCT b.booklet_id, CASE WHEN k.booklet_id IS NOT NULL THEN 'KEPT_' || b.booklet_id ELSE 'STUDENT_' || upper(substr(sha256('k' || b.booklet_id), 1, 12)) END AS pseudonym
        FROM booklets b LEFT JOIN k USING (booklet_id) WHERE b.booklet_id IS NOT NULL""",
    ),
    "model_columns": Query(  # columns by a model's count: pages by their number
        lambda s, d: intake.pages(table(s, d, "booklets")).select("booklet_id", "page_name", answers.model_columns(F.col("width"), F.col("page_index") % 3, F.when(F.col("page_index") % 2 == 0, "rtl").otherwise("ltr")).alias("c")).select("booklet_id", "page_name", F.size("c").alias("n"), F.col("c")[0]["x0"].alias("x0"), F.col("c")[0]["x1"].alias("x1")),
        r"""WITH p AS (SELECT booklet_id, unnest(pages) AS p FROM booklets), q AS (SELECT booklet_id, p.path AS path, p.width AS w, row_number() OVER (PARTITION BY booklet_id ORDER BY p.path) - 1 AS i FROM p)
        SELECT booklet_id, regexp_extract(path, '([^/]*?)(?:\.[^./]*)?$', 1) AS page_name, CASE WHEN i % 3 <= 1 THEN 1 ELSE 2 END AS n, CASE WHEN i % 3 = 2 AND i % 2 = 0 THEN CAST(floor(w / 2) AS INTEGER) ELSE 0 END AS x0, CASE WHEN i % 3 <= 1 OR i % 2 = 0 THEN w ELSE CAST(floor(w / 2) AS INTEGER) END AS x1 FROM q""",
    ),
    "option_sets": Query(  # lines of an order as a question's options, red by a flag
        lambda s, d: keys.master_key(table(s, d, "lineitem").select("l_orderkey", F.col("l_linestatus").alias("letter"), F.lit("").alias("text"), (F.col("l_returnflag") == "R").alias("red")), "l_orderkey", ["F", "O"]).select("l_orderkey", "correct_letter", F.array_join("errors", "; ").alias("errors")),
        """WITH o AS (SELECT l_orderkey, l_linestatus AS letter, bool_or(l_returnflag = 'R') AS red FROM lineitem GROUP BY ALL), g AS (SELECT l_orderkey, count_if(red) AS n, min(CASE WHEN red THEN letter END) AS r, string_agg(letter, ',' ORDER BY letter) AS have FROM o GROUP BY 1)
        SELECT l_orderkey, CASE WHEN n = 1 THEN r END AS correct_letter, concat_ws('; ', CASE WHEN n <> 1 THEN n || ' red options' END, CASE WHEN have <> 'F,O' THEN 'options ' || have END) AS errors FROM g""",
    ),
    "repaired_transcripts": Query(repaired),
    "recomputed_metrics": Query(recomputed),
}
