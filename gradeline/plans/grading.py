"""Queries over booklets, grades and rubrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import repair, scores as S, text as X
from ..operators import intake, keys, measures, scoring, store, votes
from .tables import Query, table

GRADE_KEYS = ["booklet_id", "question_id", "rubric_id"]


def grades(s, d, *cols):
    """Grades as delivered; a row delivered twice counts once."""
    g = table(s, d, "grades")
    return g.select(*cols).distinct() if cols else g.distinct()


def statuses(s, d):
    return intake.status(table(s, d, "booklets"))


def current(s, d, *more):
    return store.latest(grades(s, d, "id", *GRADE_KEYS, *more), GRADE_KEYS, "id")


def grid_answers(responses):
    """Answers read off grid responses (id, booklet_id, raw_response): (id, booklet_id, suit, question, letter). Responses are read
    with repairs and out of the words around them; one that cannot be read is a single row of nulls: not gradeable."""

    def whole(x):
        return int(x) if isinstance(x, int) and not isinstance(x, bool) or isinstance(x, str) and x.strip().isdecimal() else None

    def text(x):
        return x if x is None or isinstance(x, str) else str(x)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out: list[tuple] = []
            for i, booklet, response in zip(*(c.to_pylist() for c in b.columns)):
                x = repair.loads(response)
                rows = x.get("rows") if isinstance(x, dict) else None
                if not isinstance(rows, list):
                    out.append((i, booklet, None, None, None))
                    continue
                for r in rows:
                    r = r if isinstance(r, dict) else {}
                    out.append((i, booklet, text(x.get("suit")), whole(r.get("question")), text(r.get("final_answer"))))
            types = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string())
            cols = list(zip(*out)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["id", "booklet_id", "suit", "question", "letter"])

    return responses.select(F.col("id").cast("long"), "booklet_id", "raw_response").mapInArrow(run, "id long, booklet_id string, suit string, question int, letter string")


def grid_rows(s, d):
    """Answers of the latest grid response of each booklet."""
    return grid_answers(store.latest(grades(s, d, "id", "booklet_id", "model", "prompt_version", "raw_response").where("prompt_version = 'grid_v3'"), ["booklet_id"], "id"))


#: Rows of a response that are there as far as their note, the one it may break off in, and what it may break off behind or inside of and still be read.
ROW_SQL = r'\{\s*"question"\s*:\s*(\d+)\s*,\s*"marks"\s*:\s*\[[^{}]*?\]\s*,\s*"final_answer"\s*:\s*(?:null|"[^"]*")\s*,\s*"note"\s*:\s*"'
INNER_SQL = r'\[\s*|\[(?:\s*"[^"]*"\s*,)*\s*"[^"]*(?:"\s*)?|\[[^\[\]]*\]\s*'
LAST_SQL = rf'\{{\s*"question"\s*:\s*(\d+)\s*(?:,\s*"marks"\s*:\s*\[\s*(?:(?:\[[^\[\]]*\]\s*,\s*)*(?:{INNER_SQL})\]?\s*)?)?$'
ANSWER_SQL = r'\{\s*"question"\s*:\s*\d+\s*,\s*"marks"\s*:\s*\[[^{}]*?\]\s*,\s*"final_answer"\s*:\s*(?:null\s*|"[^"]*"?\s*)$'
BEGINS_SQL = r'^\s*(```(json)?)?\s*\{'
GRID_SQL = rf"""
WITH g AS (
  SELECT DISTINCT id, booklet_id, raw_response FROM grades WHERE prompt_version = 'grid_v3'
), l AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY booklet_id ORDER BY id DESC) = 1
), u AS (
  SELECT id, booklet_id, coalesce(raw_response, '') AS t FROM l
), j AS (SELECT id, booklet_id, regexp_extract(t, '"suit"\s*:\s*"([^"]*)"', 1) AS suit, list_concat(
    list_transform(regexp_extract_all(t, '{ROW_SQL}'), lambda r: {{'question': CAST(regexp_extract(r, '"question"\s*:\s*(\d+)', 1) AS INTEGER), 'letter': nullif(regexp_extract(r, '"final_answer"\s*:\s*"([^"]*)"', 1), '')}}),
    list_transform(CASE WHEN regexp_matches(t, '{BEGINS_SQL}') THEN regexp_extract_all(t, '{ANSWER_SQL}') ELSE [] END, lambda r: {{'question': CAST(regexp_extract(r, '"question"\s*:\s*(\d+)', 1) AS INTEGER), 'letter': CASE WHEN NOT regexp_matches(r, 'null\s*$') THEN regexp_extract(r, '"final_answer"\s*:\s*"([^"]*)', 1) END}}),
    list_transform(CASE WHEN regexp_matches(t, '{BEGINS_SQL}') THEN regexp_extract_all(t, '{LAST_SQL}') ELSE [] END, lambda r: {{'question': CAST(regexp_extract(r, '"question"\s*:\s*(\d+)', 1) AS INTEGER), 'letter': NULL::VARCHAR}})) AS x FROM u
), a AS (
  SELECT id, booklet_id, CASE WHEN len(x) > 0 THEN suit END AS suit, unnest(CASE WHEN len(x) > 0 THEN x ELSE [{{'question': NULL::INTEGER, 'letter': NULL::VARCHAR}}] END) AS r FROM j
), answers AS (
  SELECT id, booklet_id, suit, r.question AS question, r.letter AS letter FROM a
)"""
VOTE_SQL = GRID_SQL + """, n AS (SELECT suit, question, letter, count(*) AS support FROM answers WHERE letter IS NOT NULL AND suit IS NOT NULL GROUP BY ALL
), k AS (SELECT suit, question, letter, support, rank() OVER w AS r, count(*) OVER (PARTITION BY suit, question, support) AS same FROM n WINDOW w AS (PARTITION BY suit, question ORDER BY support DESC)
), key AS (SELECT suit, question, CASE WHEN max(same) = 1 THEN min(letter) END AS letter, CASE WHEN max(same) = 1 THEN max(support) END AS support,
  CASE WHEN max(same) > 1 THEN 'tied' END AS unresolved FROM k WHERE r = 1 GROUP BY suit, question)"""


def key(s, d):
    return votes.majority(grid_rows(s, d).where("suit is not null"), ["suit", "question"], "letter")


def sheet_letters(s, d):
    return grid_rows(s, d).where("question is not null").withColumnRenamed("letter", "mark")


def graded_sheets(s, d):
    expected = table(s, d, "grades").select("booklet_id", "rubric_id").distinct().join(table(s, d, "curated_rubric").select("rubric_id", "question_id", "max_points").distinct(), "rubric_id")
    expected = expected.groupBy("booklet_id", F.col("question_id").cast("int").alias("question")).agg(F.max("max_points").alias("max_points"))
    read = grid_rows(s, d)
    rows_ = read.where("question is not null").groupBy("booklet_id", "question").agg(F.max("letter").alias("final_answer")).withColumn("needs_review", F.lit(False)).withColumn("reasons", F.lit(""))
    own = own_letters(s, d).where("letter is not null").groupBy("booklet_id", F.col("question_id").cast("int").alias("question")).agg(F.max_by("letter", "id").alias("letter"))
    g = keys.graded_sheets(expected, rows_, read.groupBy("booklet_id").agg(F.min("suit").alias("suit")), key(s, d), own, "booklet_id", "question", "suit")
    return g.select("booklet_id", "question", "max_points", "score", "evidence.key_letter", "evidence.answer", "evidence.own_key_letter", "review_reasons")


def own_letters(s, d):
    g = grades(s, d, "id", "booklet_id", "question_id", "rubric_id", "model", "evidence")
    return g.withColumn("letter", F.get_json_object("evidence", "$.own_key_letter"))


OWN_SQL = "own AS (SELECT id, booklet_id, question_id, rubric_id, model, CAST(evidence AS JSON)->>'$.own_key_letter' AS letter FROM (SELECT DISTINCT id, booklet_id, question_id, rubric_id, model, evidence FROM grades))"
CURRENT_SQL = "cur AS (SELECT * FROM (SELECT DISTINCT id, booklet_id, question_id, rubric_id, score, max_score, model, needs_review, review_reasons, rubric_version, question_hash FROM grades) QUALIFY row_number() OVER (PARTITION BY booklet_id, question_id, rubric_id ORDER BY id DESC) = 1)"


def two_models(s, d):
    """The last score of every model for a question against that of every other one, each pair of models once."""
    last = store.latest(grades(s, d, "id", "booklet_id", "question_id", "model", "score", "max_score"), ["booklet_id", "question_id", "model"], "id")
    a = last.select("booklet_id", "question_id", F.col("model").alias("system_model"), F.col("score").alias("system"), F.col("max_score").alias("max_points"))
    b = last.select("booklet_id", "question_id", F.col("model").alias("reference_model"), F.col("score").alias("reference"))
    return a.join(b, ["booklet_id", "question_id"]).where("system_model < reference_model")


MODELS = ["system_model", "reference_model"]
TWO_SQL = """last AS (SELECT * FROM (SELECT DISTINCT id, booklet_id, question_id, model, score, max_score FROM grades)
  QUALIFY row_number() OVER (PARTITION BY booklet_id, question_id, model ORDER BY id DESC) = 1),
pairs AS (SELECT a.booklet_id, a.question_id, a.model AS system_model, b.model AS reference_model, a.score AS system, b.score AS reference, a.max_score AS max_points FROM last a JOIN last b USING (booklet_id, question_id)
  WHERE a.model < b.model)"""


def rounded(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) + 0.0 for n in names})  # no negative zero


def total_pairs(s, d):
    return two_models(s, d).groupBy(*MODELS, "booklet_id").agg(S.strict_sum(F.col("system")).alias("system"), S.strict_sum(F.col("reference")).alias("reference"))


TOTAL_SQL = TWO_SQL + """, totals AS (SELECT system_model, reference_model, booklet_id, CASE WHEN count(*) = count(system) THEN sum(system) END AS system,
  CASE WHEN count(*) = count(reference) THEN sum(reference) END AS reference FROM pairs GROUP BY ALL)"""


def open_answers(s, d):
    return grades(s, d, "id", "rubric_id", "question_id", "raw_response", "prompt_version").where("prompt_version like 'open_grade%'").withColumnRenamed("raw_response", "response")


def milestones(s, d):
    r = table(s, d, "curated_rubric").where("kind = 'open'").distinct()
    p = r.select("rubric_id", "question_id", "max_points", F.posexplode("paths").alias("pos", "p"))
    return p.select("rubric_id", "question_id", "max_points", "pos", F.col("p.path_id").alias("path_id"), F.explode("p.milestones").alias("m"))


PATHS_SQL = """p AS (SELECT rubric_id, question_id, max_points, paths, unnest(range(len(paths))) AS pos FROM (SELECT DISTINCT * FROM curated_rubric WHERE kind = 'open')),
m AS (SELECT rubric_id, question_id, max_points, pos, paths[pos + 1].path_id AS path_id, unnest(paths[pos + 1].milestones) AS m FROM p)"""


def path_totals(s, d):
    return milestones(s, d).groupBy("rubric_id", "question_id", "max_points", "pos", "path_id").agg(F.sum("m.points").alias("score"), F.count("*").alias("n_milestones"), F.count("m.expected").alias("n_values"))


def revisions(s, d):
    """What graders worked by, as proposals of content: the rubric's version stands for the content of its question."""
    g = grades(s, d, "id", "rubric_id", "question_id", "rubric_version", "needs_review")
    return g.select(F.concat_ws("/", "rubric_id", "question_id").alias("key"), X.digest(F.col("rubric_version").cast("string"), 8).alias("content"), "id", "needs_review")


REVISIONS_SQL = "e AS (SELECT DISTINCT rubric_id || '/' || question_id AS key, substr(sha256(CAST(rubric_version AS VARCHAR)), 1, 8) AS content, id, needs_review FROM grades)"


def rubric_versions(s, d):
    g = grades(s, d, "rubric_id", "rubric_version")
    return g.unionByName(g.groupBy("rubric_id").agg((F.max("rubric_version") + 1).cast("int").alias("rubric_version"))).distinct()


def faulty_rubric(s, d):
    r = table(s, d, "curated_rubric").distinct()
    turned = F.transform("paths", lambda p: F.struct(p["path_id"].alias("path_id"), F.when(F.col("question_id") == "3", F.reverse(p["milestones"])).otherwise(p["milestones"]).alias("milestones")))
    return r.withColumn("max_points", F.col("max_points") + (F.col("question_id") == "2").cast("int")).withColumn("paths", F.when(F.col("question_id") != "5", turned))


def cases(s, d):
    c = table(s, d, "curated_cases").select("id", "set", "rubric_id", "question_id", "declared", "slip", "expected_score").distinct()
    return c.join(table(s, d, "curated_rubric").select("rubric_id", "question_id", "max_points").distinct(), ["rubric_id", "question_id"], "left")


def judged_cases(s, d):
    """Cases with the last score that an open answer to the rubric's question got."""
    g = grades(s, d, "id", "rubric_id", "question_id", "prompt_version", "score", "needs_review", "evidence").where("prompt_version like 'open_grade%'")
    g = store.latest(g, ["rubric_id", "question_id"], "id").select("rubric_id", "question_id", "score", (F.col("needs_review") == 1).alias("needs_review"), F.from_json(F.get_json_object("evidence", "$.deductions"), "array<string>").alias("deductions"))
    return scoring.verdicts(cases(s, d).join(g, ["rubric_id", "question_id"], "left"))


CASES_SQL = """g AS (SELECT * FROM (SELECT DISTINCT id, rubric_id, question_id, prompt_version, score, needs_review, evidence FROM grades WHERE prompt_version LIKE 'open_grade%') QUALIFY row_number() OVER (PARTITION BY rubric_id, question_id ORDER BY id DESC) = 1),
c AS (SELECT DISTINCT id, "set", rubric_id, question_id, declared, slip, expected_score FROM curated_cases), q AS (SELECT DISTINCT rubric_id, question_id, max_points FROM curated_rubric),
j AS (SELECT c.*, q.max_points, g.score, g.needs_review = 1 AS needs_review, from_json(CAST(g.evidence AS JSON)->'$.deductions', '["VARCHAR"]') AS deductions FROM c LEFT JOIN q USING (rubric_id, question_id) LEFT JOIN g USING (rubric_id, question_id)),
verdicts AS (SELECT *, CASE WHEN score IS NULL OR max_points IS NULL THEN false WHEN "set" = 'alternative' THEN abs(score - max_points) < 1e-9 AND (coalesce(declared, true) OR coalesce(needs_review, false))
  WHEN "set" = 'consequential' THEN coalesce(deductions = [slip], false) AND coalesce(abs(score - expected_score) < 1e-9, false) ELSE abs(score - max_points) >= 1e-9 END AS passed FROM j)"""


def curated_run(s, d):
    """Cases scored from responses: the last recorded extraction for the rubric's question stands for the case's own."""
    g = grades(s, d, "id", "rubric_id", "question_id", "raw_response", "prompt_version").where("prompt_version like 'open_grade%'")
    r = store.latest(g, ["rubric_id", "question_id"], "id").withColumnRenamed("raw_response", "response")
    scores = scoring.scored(r, table(s, d, "curated_rubric")).join(r.select("id", "rubric_id", "question_id"), "id").drop("id")
    return scoring.verdicts(cases(s, d).join(scores, ["rubric_id", "question_id"], "left"))


REVIEW_SQL = "CAST(count(*) AS BIGINT) AS n_questions, CAST(sum(CASE WHEN needs_review = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_flagged"

QUERIES: dict[str, Query] = {
    "reconcile_status": Query(
        lambda s, d: statuses(s, d).select("booklet_id", "source_file", "n_pages", "expected_pages", "status", "reason"),
        """WITH b AS (SELECT *, len(pages) AS n, count(*) OVER (PARTITION BY booklet_id) AS same FROM booklets)
        SELECT booklet_id, source_file, CAST(n AS INTEGER) AS n_pages, expected_pages,
          CASE WHEN len(errors) > 0 THEN 'rasterize_error' WHEN same > 1 THEN 'duplicate_id' WHEN n < expected_pages THEN 'short_booklet' WHEN n > expected_pages THEN 'extra_pages' ELSE 'ok' END AS status,
          CASE WHEN len(errors) > 0 THEN 'errors: ' || array_to_string(errors, '; ') WHEN same > 1 THEN 'id appears ' || same || ' times'
            WHEN n <> expected_pages THEN 'expected ' || expected_pages || ' pages, got ' || n END AS reason FROM b""",
    ),
    "reconcile_report": Query(
        lambda s, d: intake.report(statuses(s, d)),
        """WITH b AS (SELECT len(pages) AS n, len(errors) AS e, (len(errors) = 0 AND count(*) OVER (PARTITION BY booklet_id) = 1 AND coalesce(len(pages) = expected_pages, true)) AS ok FROM booklets)
        SELECT count(*) AS n_booklets, CAST(sum(n) AS BIGINT) AS n_pages, count(*) FILTER (WHERE ok) AS n_ok, count(*) FILTER (WHERE NOT ok) AS n_halted, CAST(sum(e) AS BIGINT) AS n_errors, bool_and(ok) AS all_ok FROM b""",
    ),
    "halted_anti": Query(
        lambda s, d: intake.without_halted(table(s, d, "transcriber").select("transcript_id", "booklet_id").distinct(), statuses(s, d)).groupBy("booklet_id").agg(F.count("*").alias("n_transcripts")),
        """WITH b AS (SELECT booklet_id FROM (SELECT booklet_id, errors, pages, expected_pages, count(*) OVER (PARTITION BY booklet_id) AS same FROM booklets)
          WHERE len(errors) > 0 OR same > 1 OR len(pages) <> expected_pages)
        SELECT booklet_id, count(*) AS n_transcripts FROM (SELECT DISTINCT transcript_id, booklet_id FROM transcriber) t WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.booklet_id = t.booklet_id) GROUP BY 1""",
    ),
    "booklet_pages": Query(
        lambda s, d: intake.pages(table(s, d, "booklets")).select("booklet_id", "path", "page_name", "page_index", "width", "height"),
        """WITH p AS (SELECT booklet_id, unnest(pages) AS p FROM booklets)
        SELECT booklet_id, p.path AS path, regexp_extract(p.path, '([^/]*?)(?:\\.[^./]*)?$', 1) AS page_name, CAST(row_number() OVER (PARTITION BY booklet_id ORDER BY p.path) - 1 AS INTEGER) AS page_index, p.width AS width, p.height AS height FROM p""",
    ),
    "source_kinds": Query(
        lambda s, d: table(s, d, "booklets").select("booklet_id", X.stem("source_file").alias("stem"), intake.kind("source_file").alias("reader")).distinct(),
        r"""SELECT DISTINCT booklet_id, regexp_extract(source_file, '([^/]*?)(?:\.[^./]*)?$', 1) AS stem, CASE WHEN lower(source_file) LIKE '%.pdf' THEN 'pdf'
          WHEN regexp_matches(lower(source_file), '\.(png|jpe?g|tiff?|bmp)$') THEN 'image' END AS reader FROM booklets""",
    ),
    "roster_reconciliation": Query(
        lambda s, d: table(s, d, "booklets").select("booklet_id", F.lit(True).alias("scanned")).distinct()
        .join(grades(s, d, "booklet_id").withColumn("graded", F.lit(True)), "booklet_id", "full")
        .select("booklet_id", F.coalesce("scanned", F.lit(False)).alias("scanned"), F.coalesce("graded", F.lit(False)).alias("graded")),
        """SELECT booklet_id, coalesce(b.x, false) AS scanned, coalesce(g.x, false) AS graded FROM (SELECT DISTINCT booklet_id, true AS x FROM booklets) b
        FULL JOIN (SELECT DISTINCT booklet_id, true AS x FROM grades) g USING (booklet_id)""",
    ),
    "current_grades": Query(
        lambda s, d: current(s, d, "score", "max_score", "model"),
        f"WITH {CURRENT_SQL} SELECT id, booklet_id, question_id, rubric_id, score, max_score, model FROM cur",
    ),
    "derived_status": Query(
        lambda s, d: store.with_state(grades(s, d, "id", *GRADE_KEYS, "status"), GRADE_KEYS, "id").groupBy("status", "derived_status").agg(F.count("*").alias("n")),
        """SELECT status, derived_status, count(*) AS n FROM (SELECT status, CASE WHEN id = max(id) OVER (PARTITION BY booklet_id, question_id, rubric_id) THEN 'current' ELSE 'superseded' END AS derived_status
          FROM (SELECT DISTINCT id, booklet_id, question_id, rubric_id, status FROM grades)) GROUP BY ALL""",
    ),
    "next_version": Query(
        lambda s, d: table(s, d, "grades").groupBy("rubric_id").agg((F.max("rubric_version") + 1).alias("next_version")),
        "SELECT rubric_id, max(rubric_version) + 1 AS next_version FROM grades GROUP BY 1",
    ),
    "rubric_proposals": Query(  # content that comes again later keeps its version
        lambda s, d: store.proposals(revisions(s, d), "key", "content", "id").select("key", "content", "version", F.col("first").alias("first_id"), "n"),
        f"WITH {REVISIONS_SQL}, l AS (SELECT key, content, min(id) AS first_id, count(*) AS n FROM e GROUP BY ALL) SELECT key, content, row_number() OVER (PARTITION BY key ORDER BY first_id, content) AS version, first_id, n FROM l",
    ),
    "rubric_revisions": Query(  # with approvals: content comes back under a new version once other content was approved in its place
        lambda s, d: store.proposals(revisions(s, d), "key", "content", "id", revisions(s, d).where("needs_review = 0 and id % 3 = 0").select("key", "content", "id")).select("key", "content", "version", F.col("first").alias("first_id"), "n"),
        f"""WITH {REVISIONS_SQL}, a AS (SELECT key, content, id FROM e WHERE needs_review = 0 AND id % 3 = 0), f AS (SELECT key, old AS content, id FROM (SELECT *, lag(content) OVER (PARTITION BY key ORDER BY id) AS old FROM a) WHERE old <> content),
        log AS (SELECT key, content, id, 2 AS kind FROM e UNION ALL SELECT key, content, id, 1 FROM a UNION ALL SELECT key, content, id, 0 FROM f), w AS (SELECT *, lag(kind) OVER (PARTITION BY key, content ORDER BY id, kind) AS last FROM log),
        v AS (SELECT *, sum(CASE WHEN kind = 2 AND (last IS NULL OR last = 0) THEN 1 ELSE 0 END) OVER (PARTITION BY key, content ORDER BY id, kind) AS life FROM w), l AS (SELECT key, content, life, min(id) AS first_id, count(*) AS n FROM v WHERE kind = 2 GROUP BY ALL)
        SELECT key, content, row_number() OVER (PARTITION BY key ORDER BY first_id, content) AS version, first_id, n FROM l""",
    ),
    "approval_states": Query(  # approvals are the grades that asked for no review; the version after the newest is proposed only
        lambda s, d: store.approvals(grades(s, d, "id", "rubric_id", "rubric_version", "needs_review", "model").where("needs_review = 0"), rubric_versions(s, d), "rubric_id", "rubric_version", "id", "model").withColumnRenamed("approved_at", "last_id"),
        """WITH g AS (SELECT DISTINCT id, rubric_id, rubric_version, needs_review, model FROM grades), a AS (SELECT rubric_id, rubric_version, max(id) AS last_id, max_by(model, id) AS approved_by FROM g WHERE needs_review = 0 GROUP BY ALL),
        v AS (SELECT DISTINCT rubric_id, rubric_version FROM g UNION SELECT rubric_id, max(rubric_version) + 1 FROM g GROUP BY 1)
        SELECT rubric_id, rubric_version, last_id, approved_by, CASE WHEN last_id IS NULL THEN 'proposed' WHEN last_id = max(last_id) OVER (PARTITION BY rubric_id) THEN 'approved' ELSE 'superseded' END AS status FROM v LEFT JOIN a USING (rubric_id, rubric_version)""",
    ),
    "approval_errors": Query(  # approvals two versions ahead: some of versions that were never proposed
        lambda s, d: store.approval_errors(grades(s, d, "id", "rubric_id", "rubric_version").withColumn("rubric_version", F.col("rubric_version") + 2), rubric_versions(s, d), "rubric_id", "rubric_version").groupBy("rubric_id", "rubric_version", "error").agg(F.count("*").alias("n")),
        """WITH g AS (SELECT DISTINCT id, rubric_id, rubric_version FROM grades), v AS (SELECT DISTINCT rubric_id, rubric_version FROM g UNION SELECT rubric_id, max(rubric_version) + 1 FROM g GROUP BY 1)
        SELECT rubric_id, rubric_version + 2 AS rubric_version, 'unknown version' AS error, count(*) AS n FROM g WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.rubric_id = g.rubric_id AND v.rubric_version = g.rubric_version + 2) GROUP BY ALL""",
    ),
    "stale_grades": Query(  # a question's content is its hash and the rubric's version
        lambda s, d: store.stale(
            current(s, d, "question_hash", "rubric_version").withColumn("hash", X.digest(F.concat_ws("/", "question_hash", "rubric_version"), 16)),
            store.latest(grades(s, d, "id", "rubric_id", "question_id", "rubric_version", "question_hash"), ["rubric_id", "question_id"], "rubric_version", "id").select("rubric_id", "question_id", X.digest(F.concat_ws("/", "question_hash", "rubric_version"), 16).alias("hash")),
            ["rubric_id", "question_id"],
        ).select("id", "booklet_id", "question_id", "rubric_id", "hash", "approved_hash"),
        f"""WITH {CURRENT_SQL}, ap AS (SELECT * FROM (SELECT DISTINCT id, rubric_id, question_id, rubric_version, question_hash FROM grades) QUALIFY row_number() OVER (PARTITION BY rubric_id, question_id ORDER BY rubric_version DESC, id DESC) = 1),
        h AS (SELECT cur.id, cur.booklet_id, cur.question_id, cur.rubric_id, substr(sha256(concat_ws('/', cur.question_hash, cur.rubric_version)), 1, 16) AS hash, substr(sha256(concat_ws('/', ap.question_hash, ap.rubric_version)), 1, 16) AS approved_hash FROM cur JOIN ap USING (rubric_id, question_id))
        SELECT * FROM h WHERE hash <> approved_hash""",
    ),
    "stale_semi": Query(
        lambda s, d: table(s, d, "booklets").select("booklet_id", "source_file").distinct().join(grades(s, d, "booklet_id", "status").where("status = 'superseded'"), "booklet_id", "left_semi"),
        "SELECT DISTINCT booklet_id, source_file FROM booklets b WHERE EXISTS (SELECT 1 FROM grades g WHERE g.booklet_id = b.booklet_id AND g.status = 'superseded')",
    ),
    "question_hashes": Query(
        lambda s, d: table(s, d, "curated_rubric").select("rubric_id", "question_id", X.digest("question_text", 16).alias("content_hash")).distinct(),
        "SELECT DISTINCT rubric_id, question_id, substr(sha256(question_text), 1, 16) AS content_hash FROM curated_rubric",
    ),
    "version_key_vote": Query(key, VOTE_SQL + " SELECT suit, question, letter, support, unresolved FROM key"),
    "version_support": Query(
        lambda s, d: key(s, d).groupBy("suit").agg(F.min("support").alias("least"), F.max("support").alias("most"), F.count_if(F.col("unresolved").isNotNull()).alias("n_unresolved")),
        VOTE_SQL + " SELECT suit, min(support) AS least, max(support) AS most, count(unresolved) AS n_unresolved FROM key GROUP BY suit",
    ),
    "version_dissent": Query(
        lambda s, d: votes.dissent(grid_rows(s, d).where("suit is not null"), key(s, d), ["suit", "question"], "letter").select("booklet_id", "suit", "question", "letter", "agreed"),
        VOTE_SQL + " SELECT a.booklet_id, a.suit, a.question, a.letter, key.letter AS agreed FROM answers a JOIN key USING (suit, question) WHERE a.letter <> key.letter",
    ),
    "mcq_grade": Query(
        lambda s, d: votes.graded(grid_rows(s, d).withColumnRenamed("letter", "answer"), key(s, d), ["suit", "question"], "answer", 10.0).select("booklet_id", "suit", "question", "answer", "key_letter", "score"),
        VOTE_SQL + """ SELECT a.booklet_id, a.suit, a.question, a.letter AS answer, key.letter AS key_letter,
          CASE WHEN key.letter IS NOT NULL THEN CASE WHEN a.letter = key.letter THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END END AS score FROM answers a LEFT JOIN key USING (suit, question)""",
    ),
    "own_key_check": Query(
        lambda s, d: votes.dissent(own_letters(s, d), votes.majority(own_letters(s, d), ["rubric_id", "question_id"], "letter"), ["rubric_id", "question_id"], "letter").groupBy("rubric_id", "question_id", "agreed").agg(F.count("*").alias("n_against")),
        f"""WITH {OWN_SQL}, n AS (SELECT rubric_id, question_id, letter, count(*) AS k FROM own WHERE letter IS NOT NULL GROUP BY ALL), t AS (SELECT *, max(k) OVER (PARTITION BY rubric_id, question_id) AS top FROM n),
        key AS (SELECT rubric_id, question_id, min(letter) AS agreed FROM t WHERE k = top GROUP BY ALL HAVING count(*) = 1)
        SELECT rubric_id, question_id, agreed, count(*) AS n_against FROM own JOIN key USING (rubric_id, question_id) WHERE letter <> agreed GROUP BY ALL""",
    ),
    "cross_check": Query(
        lambda s, d: votes.cross_checked(
            store.latest(own_letters(s, d).where("model = 'cv:omr'"), GRADE_KEYS, "id").select(*GRADE_KEYS, F.col("letter").alias("answer"), F.when(F.col("letter").isNull(), "ambiguous").otherwise("answered").alias("status"), F.lit(False).alias("low_margin")),
            store.latest(own_letters(s, d).where("model <> 'cv:omr'"), GRADE_KEYS, "id").select(*GRADE_KEYS, F.col("letter").alias("answer")), GRADE_KEYS,
        ),
        f"""WITH {OWN_SQL}, a AS (SELECT * FROM own WHERE model = 'cv:omr' QUALIFY row_number() OVER (PARTITION BY booklet_id, question_id, rubric_id ORDER BY id DESC) = 1),
        b AS (SELECT *, true AS has FROM own WHERE model <> 'cv:omr' QUALIFY row_number() OVER (PARTITION BY booklet_id, question_id, rubric_id ORDER BY id DESC) = 1),
        j AS (SELECT a.booklet_id, a.question_id, a.rubric_id, a.letter AS first_answer, b.letter AS other, coalesce(a.letter, b.letter) AS final_answer,
          concat_ws('; ', CASE WHEN a.letter IS NULL THEN 'ambiguous' END, CASE WHEN b.has IS NULL THEN 'no second reading' WHEN a.letter IS DISTINCT FROM b.letter THEN 'readings differ' END) AS reasons
          FROM a LEFT JOIN b USING (booklet_id, question_id, rubric_id)) SELECT *, reasons <> '' AS needs_review FROM j""",
    ),
    "null_poison_total": Query(
        lambda s, d: current(s, d, "score").groupBy("booklet_id").agg(S.strict_sum(F.col("score")).alias("total"), F.count("*").alias("n_questions"), F.count("score").alias("n_scored")),
        f"WITH {CURRENT_SQL} SELECT booklet_id, CASE WHEN count(*) = count(score) THEN sum(score) END AS total, count(*) AS n_questions, count(score) AS n_scored FROM cur GROUP BY 1",
    ),
    "review_flags": Query(
        lambda s, d: current(s, d, "needs_review").groupBy("booklet_id").agg(F.count("*").alias("n_questions"), F.count_if(F.col("needs_review") == 1).alias("n_flagged"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("needs_review") == 1, F.col("question_id")))), ",").alias("flagged")),
        f"WITH {CURRENT_SQL} SELECT booklet_id, {REVIEW_SQL}, coalesce(string_agg(DISTINCT CASE WHEN needs_review = 1 THEN question_id END, ',' ORDER BY CASE WHEN needs_review = 1 THEN question_id END), '') AS flagged FROM cur GROUP BY 1",
    ),
    "review_reasons": Query(
        lambda s, d: current(s, d, "review_reasons").select("rubric_id", F.explode(F.from_json("review_reasons", "array<string>")).alias("reason")).groupBy("rubric_id", "reason").agg(F.count("*").alias("n")),
        f"WITH {CURRENT_SQL}, r AS (SELECT rubric_id, unnest(from_json(review_reasons, '[\"VARCHAR\"]')) AS reason FROM cur) SELECT rubric_id, reason, count(*) AS n FROM r GROUP BY ALL",
    ),
    "question_gate": Query(
        lambda s, d: rounded(measures.question_gate(two_models(s, d), *MODELS, "question_id"), "mae", "within1", "signed"),
        f"""WITH {TWO_SQL}, e AS (SELECT system_model, reference_model, question_id, (system - reference) * 10 / coalesce(nullif(max_points, 0), 10) AS d FROM pairs WHERE system IS NOT NULL AND reference IS NOT NULL)
        SELECT system_model, reference_model, question_id, count(*) AS n, round(avg(abs(d)), 6) AS mae, round(avg(CASE WHEN abs(d) <= 1 + 1e-9 THEN 1.0 ELSE 0.0 END), 6) AS within1, round(avg(d), 6) + 0.0 AS signed FROM e GROUP BY ALL""",
    ),
    "total_gate": Query(
        lambda s, d: rounded(measures.total_gate(total_pairs(s, d), *MODELS), "pearson", "mae_total", "signed"),
        f"""WITH {TOTAL_SQL}, e AS (SELECT * FROM totals WHERE system IS NOT NULL AND reference IS NOT NULL)
        SELECT system_model, reference_model, count(*) AS n, CASE WHEN count(*) >= 2 AND var_pop(system) > 0 AND var_pop(reference) > 0 THEN round(corr(system, reference), 6) + 0.0 END AS pearson, round(avg(abs(system - reference)), 6) AS mae_total,
          round(avg(system - reference), 6) + 0.0 AS signed, count(*) FILTER (WHERE abs(system - reference) < 1e-9) AS exact FROM e GROUP BY ALL""",
    ),
    "gate_passes": Query(
        lambda s, d: measures.gates(rounded(measures.question_gate(two_models(s, d), *MODELS, "question_id"), "mae", "within1", "signed"), {"mae": ("<=", 1.0), "within1": (">=", 0.85), "signed": ("abs<=", 0.3)}).select(*MODELS, "question_id", "mae_pass", "within1_pass", "signed_pass"),
        f"""WITH {TWO_SQL}, e AS (SELECT system_model, reference_model, question_id, (system - reference) * 10 / coalesce(nullif(max_points, 0), 10) AS d FROM pairs WHERE system IS NOT NULL AND reference IS NOT NULL)
        SELECT system_model, reference_model, question_id, round(avg(abs(d)), 6) <= 1 AS mae_pass, round(avg(CASE WHEN abs(d) <= 1 + 1e-9 THEN 1.0::DOUBLE ELSE 0 END), 6) >= 0.85 AS within1_pass, abs(round(avg(d), 6)) <= 0.3 AS signed_pass FROM e GROUP BY ALL""",
    ),
    "implied_question_error": Query(
        lambda s, d: total_pairs(s, d).join(two_models(s, d).groupBy(*MODELS, "booklet_id").agg(F.count("*").alias("n")), [*MODELS, "booklet_id"]).where("system is not null and reference is not null").select(*MODELS, "booklet_id", (F.round((F.col("system") - F.col("reference")) / F.col("n"), 6) + 0.0).alias("implied")),
        f"WITH {TOTAL_SQL} SELECT system_model, reference_model, booklet_id, round((t.system - t.reference) / n, 6) + 0.0 AS implied FROM totals t JOIN (SELECT system_model, reference_model, booklet_id, count(*) AS n FROM pairs GROUP BY ALL) USING (system_model, reference_model, booklet_id) WHERE t.system IS NOT NULL AND t.reference IS NOT NULL",
    ),
    "total_disagreements": Query(  # the totals that are not equal, per pair of models
        lambda s, d: total_pairs(s, d).where(F.abs(F.col("system") - F.col("reference")) >= 1e-9).select(*MODELS, "booklet_id", "system", "reference", (F.round(F.col("system") - F.col("reference"), 6) + 0.0).alias("gap")),
        f"WITH {TOTAL_SQL} SELECT system_model, reference_model, booklet_id, system, reference, round(system - reference, 6) + 0.0 AS gap FROM totals WHERE abs(system - reference) >= 1e-9",
    ),
    "question_totals_wide": Query(  # a map of a rubric's questions to their mean scores, whatever questions there are
        lambda s, d: current(s, d, "score").groupBy("rubric_id", "question_id").agg(F.avg("score").alias("m")).where("m is not null").groupBy("rubric_id")
        .agg(F.array_join(F.array_sort(F.collect_list(F.concat("question_id", F.lit("="), F.round("m", 4).cast("decimal(18,4)").cast("string")))), ",").alias("means")),
        f"WITH {CURRENT_SQL}, m AS (SELECT rubric_id, question_id, CAST(round(avg(score), 4) AS DECIMAL(18, 4)) AS m FROM cur GROUP BY ALL) SELECT rubric_id, string_agg(question_id || '=' || CAST(m AS VARCHAR), ',' ORDER BY question_id || '=' || CAST(m AS VARCHAR)) AS means FROM m WHERE m IS NOT NULL GROUP BY 1",
    ),
    "item_statistics": Query(
        lambda s, d: rounded(measures.item_statistics(current(s, d, "score", "max_score").withColumn("item", F.concat_ws("/", "rubric_id", "question_id")), "item", "booklet_id", "score", "max_score"), "facility", "point_biserial", "discrimination", digits=4),
        f"""WITH {CURRENT_SQL}, x AS (SELECT rubric_id || '/' || question_id AS item, score, score / nullif(max_score, 0) AS share, sum(score) OVER (PARTITION BY booklet_id) - score AS rest FROM cur WHERE score IS NOT NULL),
        e AS (SELECT item, quantile_cont(rest, 0.27) AS low, quantile_cont(rest, 0.73) AS high FROM x GROUP BY 1)
        SELECT item, count(*) AS n, round(avg(share), 4) AS facility, CASE WHEN count(*) >= 2 AND var_pop(score) > 0 AND var_pop(rest) > 0 THEN round(corr(score, rest), 4) + 0.0 END AS point_biserial,
          round(avg(share) FILTER (WHERE rest >= high) - avg(share) FILTER (WHERE rest <= low), 4) + 0.0 AS discrimination FROM x JOIN e USING (item) GROUP BY item""",
    ),
    "score_distribution": Query(
        lambda s, d: current(s, d, "score", "max_score").where("score is not null").groupBy("rubric_id", F.floor(F.try_divide("score", "max_score") * 10).alias("tenth")).agg(F.count("*").alias("n")),
        f"WITH {CURRENT_SQL} SELECT rubric_id, CAST(floor(score / nullif(max_score, 0) * 10) AS BIGINT) AS tenth, count(*) AS n FROM cur WHERE score IS NOT NULL GROUP BY ALL",
    ),
    "case_rates": Query(
        lambda s, d: table(s, d, "curated_cases").select("id", "set", "declared", "slip").distinct().groupBy("set").agg(F.count("*").alias("n"), F.round(F.avg(F.col("declared").cast("int")), 6).alias("declared_rate"), F.count("slip").alias("n_slips")),
        'SELECT "set", count(*) AS n, round(avg(CAST(declared AS INT)), 6) AS declared_rate, count(slip) AS n_slips FROM (SELECT DISTINCT id, "set", declared, slip FROM curated_cases) GROUP BY 1',
    ),
    "case_verdicts": Query(  # against the last recorded score of the rubric's question
        lambda s, d: judged_cases(s, d).select("id", "set", "score", "max_points", "needs_review", "passed"),
        f"WITH {CASES_SQL} SELECT id, \"set\", score, max_points, needs_review, passed FROM verdicts",
    ),
    "curated_rates": Query(
        lambda s, d: rounded(scoring.pass_rates(judged_cases(s, d)), "pass_rate"),
        f"WITH {CASES_SQL} SELECT \"set\", count(*) AS n, count_if(passed)::BIGINT AS n_passed, round(avg(passed::INT), 6) AS pass_rate, avg(passed::INT) >= 0.9 AS gate FROM verdicts GROUP BY 1",
    ),
    "curated_run": Query(lambda s, d: scoring.pass_rates(curated_run(s, d))),
    "case_rubrics": Query(
        lambda s, d: table(s, d, "curated_cases").select("id", "set", "rubric_id", "question_id").distinct().join(table(s, d, "curated_rubric").select("rubric_id", "question_id", "max_points", "kind").distinct(), ["rubric_id", "question_id"], "left").groupBy("set", "kind").agg(F.count("*").alias("n"), F.round(F.avg("max_points"), 6).alias("mean_points")),
        'SELECT "set", kind, count(*) AS n, round(avg(max_points), 6) AS mean_points FROM (SELECT DISTINCT id, "set", rubric_id, question_id FROM curated_cases) LEFT JOIN (SELECT DISTINCT rubric_id, question_id, max_points, kind FROM curated_rubric) USING (rubric_id, question_id) GROUP BY ALL',
    ),
    "path_totals": Query(
        lambda s, d: path_totals(s, d).select("rubric_id", "question_id", "path_id", F.round("score", 6).alias("total"), "n_milestones", "n_values"),
        f"WITH {PATHS_SQL} SELECT rubric_id, question_id, path_id, round(sum(m.points), 6) AS total, count(*) AS n_milestones, count(m.expected) AS n_values FROM m GROUP BY rubric_id, question_id, pos, path_id",
    ),
    "best_paths": Query(
        lambda s, d: scoring.best_paths(path_totals(s, d), "rubric_id", "question_id").select("rubric_id", "question_id", "path_id", F.round("score", 6).alias("total")),
        f"WITH {PATHS_SQL}, t AS (SELECT rubric_id, question_id, pos, path_id, sum(m.points) AS score FROM m GROUP BY ALL) SELECT rubric_id, question_id, path_id, round(score, 6) AS total FROM t QUALIFY row_number() OVER (PARTITION BY rubric_id, question_id ORDER BY score DESC, pos) = 1",
    ),
    "rubric_errors": Query(  # with faults put in: a point too many in questions 2, milestones the wrong way round in questions 3, no paths in questions 5
        lambda s, d: scoring.structure_errors(faulty_rubric(s, d)),
        """WITH r AS (SELECT DISTINCT rubric_id, question_id, kind, max_points + CASE WHEN question_id = '2' THEN 1 ELSE 0 END AS max_points, CASE WHEN question_id = '5' THEN NULL
          ELSE list_transform(paths, lambda p: struct_pack(path_id := p.path_id, milestones := CASE WHEN question_id = '3' THEN list_reverse(p.milestones) ELSE p.milestones END)) END AS paths FROM curated_rubric WHERE kind = 'open'),
        i AS (SELECT rubric_id, question_id, max_points, unnest(paths) AS p FROM r),
        x AS (SELECT rubric_id, question_id, p.path_id AS path_id, unnest(range(len(p.milestones))) AS k, p.milestones AS ms FROM i)
        SELECT rubric_id, question_id, 'no paths' AS error FROM r WHERE coalesce(len(paths), 0) = 0
        UNION SELECT rubric_id, question_id, 'sum of ' || p.path_id FROM i WHERE abs(list_sum(list_transform(p.milestones, lambda q: q.points)) - max_points) > 1e-6
        UNION SELECT rubric_id, question_id, 'bad id in ' || path_id FROM x WHERE NOT regexp_matches(ms[k + 1].id, '^[A-Za-z][A-Za-z0-9_]*$')
        UNION SELECT rubric_id, question_id, path_id || '.' || ms[k + 1].id || ' depends on a later one' FROM x WHERE NOT list_has_all(list_transform(ms[1:k], lambda q: q.id), coalesce(ms[k + 1].depends_on, []))""",
    ),
    "rubric_expression_errors": Query(lambda s, d: scoring.expression_errors(table(s, d, "curated_rubric").distinct())),
    "milestone_order": Query(
        lambda s, d: milestones(s, d).select("rubric_id", "question_id", "path_id", F.col("m.id").alias("milestone_id"), F.coalesce(F.substring_index("m.id", "m", -1).try_cast("int"), F.lit(0)).alias("number")),
        f"WITH {PATHS_SQL} SELECT rubric_id, question_id, path_id, m.id AS milestone_id, coalesce(TRY_CAST(string_split(m.id, 'm')[-1] AS INT), 0) AS number FROM m",
    ),
    "open_scores": Query(lambda s, d: scoring.scored(open_answers(s, d), table(s, d, "curated_rubric")).withColumn("deductions", F.array_join("deductions", ",")).withColumn("reasons", F.array_join("reasons", "; "))),
    "grid_full": Query(  # questions 1 to 10 of every sheet that was read
        lambda s, d: keys.full_rows(grid_rows(s, d).withColumn("pos", F.lit(0)), "booklet_id", "question", 10),
        GRID_SQL + """, s AS (SELECT DISTINCT booklet_id FROM answers WHERE question IS NOT NULL), r AS (SELECT booklet_id, question, max(letter) AS letter, true AS has FROM answers GROUP BY ALL)
        SELECT s.booklet_id, CAST(q AS INTEGER) AS question, letter, CASE WHEN has IS NULL THEN 'omitted' ELSE '' END AS note FROM s CROSS JOIN range(1, 11) t(q) LEFT JOIN r ON r.booklet_id = s.booklet_id AND r.question = t.q""",
    ),
    "choice_rubric": Query(  # rubric rows of the voted keys; the master is the vote of all suits together
        lambda s, d: keys.choice_rubric(votes.majority(grid_rows(s, d), ["question"], "letter").where("question is not null").select("question", F.col("letter").alias("correct_letter")), key(s, d), "question", "suit")
        .select("question", "max_points", "kind", F.array_join(F.transform(F.array_sort(F.map_entries("mcq_keys")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("keys")),
        VOTE_SQL + """, mn AS (SELECT question, letter, count(*) AS k FROM answers WHERE letter IS NOT NULL GROUP BY ALL), mt AS (SELECT *, max(k) OVER (PARTITION BY question) AS top FROM mn),
        m AS (SELECT question, CASE WHEN count(*) = 1 THEN min(letter) END AS letter FROM mt WHERE k = top AND question IS NOT NULL GROUP BY question),
        every AS (SELECT question, 'master' AS suit, coalesce(letter, '') AS letter FROM m UNION ALL SELECT question, suit, letter FROM key WHERE letter IS NOT NULL AND question IN (SELECT question FROM m))
        SELECT question, 10.0::DOUBLE AS max_points, 'mcq' AS kind, string_agg(suit || '=' || letter, ',' ORDER BY suit) AS keys FROM every GROUP BY question""",
    ),
    "hand_scores": Query(  # the letters read off a sheet stand for those read by hand
        lambda s, d: keys.hand_scores(sheet_letters(s, d), key(s, d), "question", "suit").select("booklet_id", "suit", "question", "mark", "reference"),
        VOTE_SQL + """ SELECT a.booklet_id, a.suit, a.question, a.letter AS mark, CASE WHEN key.letter IS NOT NULL THEN CASE WHEN a.letter = key.letter THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END END AS reference
        FROM answers a LEFT JOIN key USING (suit, question) WHERE a.question IS NOT NULL""",
    ),
    "sheet_grades": Query(  # sheets with evidence: questions of the booklet's rubrics, readings and printed keys from the grades
        graded_sheets,
        VOTE_SQL + f""", cr AS (SELECT DISTINCT rubric_id, question_id, max_points FROM curated_rubric), br AS (SELECT DISTINCT booklet_id, rubric_id FROM grades),
        e AS (SELECT booklet_id, CAST(question_id AS INTEGER) AS question, max(max_points) AS max_points FROM br JOIN cr USING (rubric_id) GROUP BY ALL),
        sh AS (SELECT booklet_id, min(suit) AS suit FROM answers GROUP BY 1), r AS (SELECT booklet_id, question, max(letter) AS answer, true AS has FROM answers WHERE question IS NOT NULL GROUP BY ALL),
        {OWN_SQL}, o AS (SELECT booklet_id, CAST(question_id AS INTEGER) AS question, max_by(letter, id) AS own_key_letter FROM own WHERE letter IS NOT NULL GROUP BY ALL),
        joined AS (SELECT e.booklet_id, e.question, e.max_points, sh.suit, r.answer, r.has, key.letter AS key_letter, o.own_key_letter FROM e LEFT JOIN sh USING (booklet_id) LEFT JOIN r USING (booklet_id, question) LEFT JOIN key ON key.suit = sh.suit AND key.question = e.question LEFT JOIN o ON o.booklet_id = e.booklet_id AND o.question = e.question)
        SELECT booklet_id, question, max_points, CASE WHEN key_letter IS NOT NULL THEN CASE WHEN answer = key_letter THEN max_points ELSE 0.0::DOUBLE END END AS score, key_letter, answer, own_key_letter,
          concat_ws('; ', CASE WHEN has IS NULL THEN 'question not read' END, CASE WHEN suit IS NULL THEN 'version unknown' END, CASE WHEN suit IS NOT NULL AND key_letter IS NULL THEN 'no approved key for the version' END,
            CASE WHEN own_key_letter <> key_letter THEN 'printed options give ' || own_key_letter || ', the key is ' || key_letter END) AS review_reasons FROM joined""",
    ),
}
