"""Sinks: page manifests, transcripts, ledgers, reports. Writes go to a new or own path; a partition is replaced whole."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.utils import AnalysisException

from ..functions import text as X
from ..operators import store


def page_manifests(regions: DataFrame, folder: str, pages: DataFrame | None = None, tables: DataFrame | None = None) -> None:
    """One record per page with its regions in reading order, partitioned by booklet. ``pages`` adds what is known of a page (booklet_id, page_name, page_size,
    columns, gutters, coverage, halted, halt_reasons, errors, method, ...), also of pages without a region; ``tables`` its tables (index, x, y, w, h, confidence, kind)."""
    key = ["booklet_id", "page_name"]
    optional = [c for c in ("label", "confidence", "column_index", "is_sub", "crop") if c in regions.columns]
    m = regions.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("reading_order", "question_id", "state", "x", "y", "w", "h", *optional))).alias("questions"))
    if tables is not None:
        t = tables.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("index", "x", "y", "w", "h", "confidence", "kind"))).alias("tables"))
        m = m.join(t, key, "full")
    if pages is not None:
        m = pages.join(m, key, "left")
    m.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("booklet_id").json(folder)


def crops(cut: DataFrame, folder: str) -> None:
    """Crops (booklet_id, page_name, crop_id, w, h, channels, data) as bytes; what a booklet's page had before is replaced, so no crop of an earlier layout stays."""
    cut.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("booklet_id", "page_name").parquet(folder)


def page_metrics(measures: DataFrame, folder: str) -> None:
    """Measures of pages as records beside them, partitioned by booklet."""
    measures.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("booklet_id").json(folder)


def transcripts(rows: DataFrame, folder: str) -> None:
    rows.withColumn("model_slug", X.slug("model")).write.mode("append").partitionBy("model_slug").json(folder)


def ledger(spend: DataFrame, folder: str) -> bool:
    """Appends spending records; a ledger that cannot be written is a warning, as the calls have been made. Whether it was written."""
    try:
        spend.write.mode("append").json(folder)
    except Exception as e:  # noqa: BLE001 - whatever the file system raises
        logging.getLogger(__name__).warning("spend ledger %s not written: %s", folder, e)
        return False
    return True


def merged(rows: DataFrame, folder: str, keys: list[str], *order: str) -> str:
    """Overlays stored results with new rows and writes the whole as the next version, as a table that is read is not overwritten. The path of the new version;
    the ones before stay. Rows with an empty key are dropped."""
    spark = rows.sparkSession
    old, n = None, 0
    while True:
        try:
            old = spark.read.parquet(f"{folder}/v{n}")
        except AnalysisException:
            break
        n += 1
    both = store.upsert(old if old is not None else rows.limit(0), rows, keys, *order)
    both.write.mode("errorifexists").parquet(f"{folder}/v{n}")
    return f"{folder}/v{n}"


def rubrics(questions: DataFrame, folder: str) -> None:
    """One record per rubric with its questions in order, as ``files.rubric`` reads them. A rubric has few questions."""
    q = F.struct("question_id", "max_points", "kind", "question_text", "paths")
    r = questions.groupBy("rubric_id", "exam_id", "source").agg(F.array_sort(F.collect_list(F.struct(F.coalesce(F.col("question_id").try_cast("int"), F.lit(0)).alias("_n"), F.col("question_id").alias("_q"), q.alias("q")))).alias("_s"))
    r.select("rubric_id", "exam_id", "source", F.transform("_s", lambda x: x["q"]).alias("questions")).write.mode("overwrite").option("ignoreNullFields", "false").json(folder)


def transcript_pages(rows: DataFrame, folder: str) -> None:
    """Markdown of each booklet (booklet_id, question_id, interleaved_markdown, objective_confidence): a section a question, by number, partitioned by booklet."""
    head = F.concat(F.lit("## "), F.coalesce("question_id", F.lit("?")), F.when(F.col("objective_confidence").isNotNull(), F.format_string(" (%.2f)", "objective_confidence")).otherwise(""))
    part = F.struct(F.coalesce(F.col("question_id").try_cast("int"), F.lit(0)).alias("n"), F.concat(head, F.lit("\n\n"), F.coalesce("interleaved_markdown", F.lit("")), F.lit("\n")).alias("t"))
    one = rows.groupBy("booklet_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), "\n").alias("value"))
    one.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("booklet_id").text(folder)


def report(rows: DataFrame, columns: list[str]) -> str:
    """Markdown table of a small report; its rows are few by construction (one per model, question or gate)."""
    head = "| " + " | ".join(columns) + " |\n|" + " --- |" * len(columns)
    text = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("n/a")) for c in columns)), F.lit(" |"))
    return "\n".join([head, *(r.line for r in rows.select(text.alias("line"), *columns).orderBy(*columns).collect())])
