"""Recorded answers of models read into rows: page layouts, answer grids, printed options, transcripts, proposed rubrics.

Each operator is one Arrow-fed pass over the raw responses, which are read with repairs (``repair.loads``); what cannot be read gives a row with
an error, never silence, as a page that a model could not read is not an empty page. Everything behind the reading is relational.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import expr, repair, scores as S, text as X

UNREADABLE = "unreadable response"
#: Confidence of a region and of a table that names none, and how far corners may reach to be taken as width and height; least extent of a box.
REGION_SURE, TABLE_SURE, EXTENT_SUM, LEAST_EXTENT = 0.8, 0.7, 1.5, 0.05


def number(x, default: float | None = None) -> float | None:
    """A number or a text that is one; booleans and what is no finite number give the default."""
    if isinstance(x, bool) or x is None:
        return default
    try:
        v = float(x)
    except (TypeError, ValueError):
        return default
    return v if math.isfinite(v) else default


def whole(x) -> int | None:
    v = number(x)
    return int(v) if v is not None and v == int(v) else None


def text(x) -> str:
    return "" if x is None else x.strip() if isinstance(x, str) else str(x)


def texts(x) -> list[str]:
    return [t for t in map(text, x if isinstance(x, list) else []) if t]


def listed(payload, name: str) -> list:
    """The list itself or the one under ``name``."""
    got = payload.get(name) if isinstance(payload, dict) else payload
    return got if isinstance(got, list) else []


def per_response(rows: DataFrame, keys: list[str], response: str, read: Callable, schema: str, *more: str) -> DataFrame:
    """Rows of ``read(payload, *more)`` under the keys of each response; ``payload`` is None where the response cannot be read."""
    types = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    names = [*keys, *(c.split()[0] for c in _columns(schema))]
    n = len(keys)

    def run(frames):
        import pandas as pd

        for f in frames:
            out = [(*r[:n], *x) for r in f.itertuples(index=False, name=None) for x in read(repair.loads(r[-1]), *r[n:-1])]
            yield pd.DataFrame(out, columns=names)

    return rows.select(*keys, *more, response).mapInPandas(run, f"{types}, {schema}")


def _columns(schema: str) -> list[str]:
    """Column definitions of a schema text, nested commas left alone."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[last:i])
            last = i + 1
    return [*out, schema[last:]]



# -- answer grids ---------------------------------------------------------------------------------


def grid(payload, n: int, letters: tuple[str, ...]) -> list[tuple]:
    """(question, marks, final_answer, note, error) of questions 1 to n. A row is read from a list or from ``rows``; of two rows for one
    question the later counts. A question that is not there is ``omitted``; rows that are none, and numbers that are none, are errors."""
    if payload is None:
        return [(None, [], None, "", UNREADABLE)]
    found: dict[int, tuple] = {}
    errors = []
    for row in listed(payload, "rows"):
        q = whole(row.get("question")) if isinstance(row, dict) else None
        if q is None:
            errors.append((None, [], None, "", f"{'row without a question number' if isinstance(row, dict) else 'malformed row'}: {str(row)[:120]}"))
            continue
        marks = []
        for m in row.get("marks") if isinstance(row.get("marks"), list) else []:
            option, kind = (m.get("option"), m.get("type")) if isinstance(m, dict) else (*m, None, None)[:2] if isinstance(m, list) else (m, None)
            if text(option) in letters:
                marks.append((text(option), text(kind).lower() or "other"))
        answer = text(row.get("final_answer"))
        found[q] = (q, marks, answer if answer in letters else None, text(row.get("note")), None)
    return [found.get(q, (q, [], None, "omitted", f"question {q} omitted")) for q in range(1, n + 1)] + errors


def grids(rows: DataFrame, keys: list[str], response: str, n: int, letters: tuple[str, ...]) -> DataFrame:
    schema = "question int, marks array<struct<option:string,type:string>>, final_answer string, note string, error string"
    return per_response(rows, keys, response, lambda x: [(q, [{"option": o, "type": t} for o, t in m], *r) for q, m, *r in grid(x, n, letters)], schema)


# -- printed options ------------------------------------------------------------------------------


def printed(payload, letters: tuple[str, ...]) -> list[tuple]:
    """(question, letter, text, error): every letter of every question, an empty text where it is not there."""
    if payload is None:
        return [(None, None, None, UNREADABLE)]
    out: dict[tuple[int, str], tuple] = {}
    for item in listed(payload, "questions"):
        q = whole(item.get("question")) if isinstance(item, dict) else None
        if q is not None:
            given = item.get("options") if isinstance(item.get("options"), dict) else {}
            given = {k.strip("() "): text(v) for k, v in given.items()}
            out |= {(q, x): (q, x, given.get(x, ""), None) for x in letters}
    return list(out.values())


def printed_options(rows: DataFrame, keys: list[str], response: str, letters: tuple[str, ...], page: str) -> DataFrame:
    """Options of all pages of a key; a question that two pages have is read from the later page."""
    every = per_response(rows, [*keys, page], response, lambda x: printed(x, letters), "question int, letter string, text string, error string")
    last = every.where("error is null").groupBy(*keys, "question").agg(F.max(page).alias(page))
    return every.join(last, [*keys, "question", page], "left_semi").select(*keys, "question", "letter", "text")


# -- page layouts ---------------------------------------------------------------------------------


def box(corners, width: int, height: int) -> tuple[int, int, int, int] | None:
    """Normalised corners as a pixel box (x, y, w, h) inside the page, at least a pixel wide and high. Four numbers of which the last two
    are no second corner are taken as width and height; a box without extent gets a twentieth of the page. None for what is no box."""
    v = [number(c) for c in corners] if isinstance(corners, list) else []
    if len(v) != 4 or None in v:
        return None
    sides = []
    is_extent = not (v[2] > v[0] and v[3] > v[1]) and max(v[2:]) <= 1 and v[2] + v[3] < EXTENT_SUM and min(v[2:]) > 0
    for lo, hi, size in ((v[0], v[2], width), (v[1], v[3], height)):
        lo, hi = (min(max(e, 0.0), 1.0) for e in (lo, lo + hi if is_extent else hi))
        hi = hi if hi > lo else min(1.0, lo + LEAST_EXTENT)
        at = round(lo * size)
        sides.append((at, max(1, round(hi * size) - at)))
    return sides[0][0], sides[1][0], sides[0][1], sides[1][1]


def layout(payload, width: int, height: int) -> list[tuple]:
    """One page: (usable, n_columns, hint, override, summary, regions, tables, errors). Usable is a page with regions or tables, or with a
    summary and no error. Of two regions of a question the surer counts, of equally sure ones the later; a region without a box is an error."""
    if not isinstance(payload, dict):
        return [(False, 1, "single", False, "", [], [], [UNREADABLE])]
    errors, best = [], {}
    for i, q in enumerate(listed(payload, "questions")):
        b = box(q.get("bbox_norm") or [0, 0, 1, 1], width, height) if isinstance(q, dict) else None
        if b is None:
            errors.append(f"bad region {i}")
            continue
        state = text(q.get("state")).lower()
        if state not in ("answered", "blank"):
            state = "blank" if q.get("has_student_ink") is False else "answered"
        sure = round(min(max(number(q.get("confidence") or None, REGION_SURE), 0.0), 1.0), 3)
        label = text(q.get("label"))
        name = text(q.get("question_id"))
        if name not in best or sure >= best[name][0]:
            best[name] = (sure, i, {"question_id": name, "label": label, "x": b[0], "y": b[1], "w": b[2], "h": b[3], "state": state, "confidence": sure, "is_sub": bool(q.get("is_subquestion"))})
    regions = [r | {"reading_order": k} for k, (_, _, r) in enumerate(sorted(best.values(), key=lambda r: r[1]))]
    tables = []
    for i, t in enumerate(listed(payload, "tables")):
        b = box(t.get("bbox_norm") or [0, 0, 1, 1], width, height) if isinstance(t, dict) else None
        if b is not None:
            tables.append({"index": i, "x": b[0], "y": b[1], "w": b[2], "h": b[3], "confidence": number(t.get("confidence") or None, TABLE_SURE), "kind": text(t.get("kind")) or "unknown"})
    summary = text(payload.get("page_summary"))
    return [(bool(regions or tables or (summary and not errors)), max(1, whole(payload.get("n_columns") or None) or 1), text(payload.get("reading_order_hint")) or "single", bool(payload.get("override_gutter_prior")), summary, regions, tables, errors)]


_REGION = "struct<question_id:string,label:string,x:int,y:int,w:int,h:int,state:string,confidence:double,is_sub:boolean,reading_order:int>"
_TABLE = "struct<index:int,x:int,y:int,w:int,h:int,confidence:double,kind:string>"
LAYOUT = f"usable boolean, n_columns int, hint string, override boolean, summary string, regions array<{_REGION}>, tables array<{_TABLE}>, errors array<string>"


def layouts(pages: DataFrame, keys: list[str], response: str, width: str, height: str) -> DataFrame:
    return per_response(pages, keys, response, layout, LAYOUT, width, height)


def model_columns(width: Column, n_columns: Column, hint: Column) -> Column:
    """Columns by a model's count, in reading order: one, or two that part in the middle, the right one first where the hint is ``rtl``."""
    mid = F.floor(width / 2).cast("int")
    band = lambda i, x0, x1: F.struct(F.lit(i).alias("index"), x0.cast("int").alias("x0"), x1.cast("int").alias("x1"))
    left, right = band(0, F.lit(0), mid), band(1, mid, width)
    return F.when(n_columns <= 1, F.array(band(0, F.lit(0), width))).when(hint == "rtl", F.array(right, left)).otherwise(F.array(left, right))


def chosen_columns(found: Column, width: Column, n_columns: Column, hint: Column, override: Column) -> Column:
    """Columns found on the page, or those of the model where it says so or counts otherwise."""
    return F.when(override | ((n_columns > 0) & (n_columns != F.size(found))), model_columns(width, n_columns, hint)).otherwise(found)


def columns_prior(found: Column, width: Column) -> Column:
    """What a model is told of the columns found on a page, as JSON with boxes of four decimals."""
    share = lambda x: F.round(x / width, 4)
    one = lambda c: F.struct(c["index"].alias("index"), F.array(share(c["x0"]), F.lit(0.0), share(c["x1"]), F.lit(1.0)).alias("bbox_norm"))
    return F.to_json(F.struct(F.size(found).alias("n_columns"), (F.size(found) > 1).alias("is_multi_column"), F.transform(found, one).alias("columns")))


# -- transcripts ----------------------------------------------------------------------------------


def parse_stats(formulas: list[str], most: int = 5, digits: int = 4) -> tuple[int, int, float, list[str]]:
    """(total, parsed, rate, the first ``most`` that cannot be read, cut to 120 characters); no formula: rate 1."""
    bad = [f for f in formulas if not expr.parses(f)]
    n = len(formulas)
    return n, n - len(bad), round((n - len(bad)) / n, digits) if n else 1.0, [f[:120] for f in bad[:most]]


def transcript(payload) -> list[tuple]:
    """(hebrew_text, math_latex, interleaved_markdown, flagged_tokens, strikethrough_regions, self_reported_confidence, legibility, is_blank, error).
    Texts are trimmed and blank entries dropped; without a text in one piece, prose and formulas make one."""
    if not isinstance(payload, dict):
        return [(None, [], None, [], [], None, None, False, UNREADABLE)]
    prose, formulas, whole_ = text(payload.get("hebrew_text")), texts(payload.get("math_latex")), text(payload.get("interleaved_markdown"))
    if not whole_:
        whole_ = "\n\n".join(x for x in (prose, "\n".join(f"${f}$" for f in formulas)) if x)
    own = number(payload.get("transcription_confidence"))
    return [(prose, formulas, whole_, texts(payload.get("flagged_tokens")), texts(payload.get("strikethrough_regions")), own, text(payload.get("legibility")), payload.get("is_blank") is True, None)]


TRANSCRIPT = "hebrew_text string, math_latex array<string>, interleaved_markdown string, flagged_tokens array<string>, strikethrough_regions array<string>, self_reported_confidence double, legibility string, is_blank boolean, error string"


def transcripts(rows: DataFrame, keys: list[str], response: str) -> DataFrame:
    return per_response(rows, keys, response, transcript, TRANSCRIPT)


def evaluated(rows: DataFrame) -> DataFrame:
    """Adds ``latex_eval`` (total, parsed, parse_rate, errors) of the formulas of a transcript, each once, to rows with math_latex and interleaved_markdown."""

    def run(batches):
        import pyarrow as pa

        kept: dict[str, tuple] = {}
        t = pa.struct([("total", pa.int32()), ("parsed", pa.int32()), ("parse_rate", pa.float64()), ("errors", pa.list_(pa.string()))])
        for b in batches:
            out = []
            for fs in b.column(b.num_columns - 1).to_pylist():
                k = "\n".join(fs or [])
                if k not in kept:
                    if len(kept) > 50_000:
                        kept.clear()
                    kept[k] = parse_stats(fs or [])
                out.append(dict(zip(("total", "parsed", "parse_rate", "errors"), kept[k])))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, t)], names=[*b.schema.names[:-1], "latex_eval"])

    base = rows.drop("latex_eval")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    return base.withColumn("_formulas", X.all_formulas("math_latex", "interleaved_markdown")).mapInArrow(run, f"{fields}, latex_eval struct<total:int,parsed:int,parse_rate:double,errors:array<string>>")


def measured(rows: DataFrame, blank: Column) -> DataFrame:
    """``evaluated`` with the objective confidence; what was stored of both before is replaced."""
    e = evaluated(rows.drop("objective_confidence"))
    has = X.first_text("hebrew_text", "interleaved_markdown") != ""
    flags = F.greatest(F.coalesce(F.size("flagged_tokens"), F.lit(0)), F.lit(0))
    return e.withColumn("objective_confidence", S.confidence(blank, has, F.col("latex_eval.total"), F.col("latex_eval.parse_rate"), flags, F.col("self_reported_confidence")))


def repaired(rows: DataFrame, keys: list[str], raw: str = "raw_text") -> DataFrame:
    """Failed transcripts (errors not empty) read again from the raw text that was kept: (keys, the fields of a transcript, repaired). Where there is no raw text
    or it cannot be read, the row stays failed and asks for a new call. Text that is no object is not a transcript."""
    failed = rows.where(F.size("errors") > 0).select(*keys, raw).distinct()
    t = transcripts(failed, keys, raw)
    content = (X.first_text("hebrew_text", "interleaved_markdown") != "") | (F.size("math_latex") > 0) | F.col("is_blank")
    return t.withColumn("repaired", F.col("error").isNull() & content)


# -- rubrics --------------------------------------------------------------------------------------


def proposal(payload) -> list[tuple]:
    """(paths, error) of a proposed question: paths with ordered milestones; ids of paths are made where they are missing."""
    if not isinstance(payload, dict) or not isinstance(payload.get("paths"), list):
        return [([], UNREADABLE)]
    out = []
    for i, p in enumerate(payload["paths"]):
        steps = p.get("milestones") if isinstance(p, dict) else None
        if not isinstance(steps, list) or any(not isinstance(m, dict) or not text(m.get("id")) for m in steps):
            return [([], f"path {i + 1} is no list of milestones")]
        ms = [{"id": text(m["id"]), "description": text(m.get("description")), "points": number(m.get("points"), 0.0), "expected": text(m.get("expected")) or None, "depends_on": texts(m.get("depends_on")), "abs_tol": number(m.get("abs_tol"))} for m in steps]
        out.append({"path_id": text(p.get("path_id")) or f"path{i + 1}", "description": text(p.get("description")), "milestones": ms})
    return [(out, None)]


def proposals(rows: DataFrame, keys: list[str], response: str) -> DataFrame:
    """Proposed paths of open questions; they wait for approval and for ``scoring.rubric_errors``, nothing approves them here."""
    ms = "array<struct<id:string,description:string,points:double,expected:string,depends_on:array<string>,abs_tol:double>>"
    return per_response(rows, keys, response, proposal, f"paths array<struct<path_id:string,description:string,milestones:{ms}>>, error string")
