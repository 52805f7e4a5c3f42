"""Booklets: reconciliation of what was scanned with what was expected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as X

KINDS = {".pdf": "pdf", ".png": "image", ".jpg": "image", ".jpeg": "image", ".tif": "image", ".tiff": "image", ".bmp": "image"}


def status(booklets: DataFrame) -> DataFrame:
    """Adds n_pages, status and reason to (booklet_id, source_file, pages, errors, expected_pages). The first fault counts:
    errors, repeated id, too few pages, too many. Without an expectation the count is not judged."""
    n = F.coalesce(F.size("pages"), F.lit(0))
    same = F.count("*").over(W.partitionBy("booklet_id"))
    b = booklets.withColumn("n_pages", F.when(n < 0, 0).otherwise(n)).withColumn("_same", same)
    short = F.col("expected_pages") - F.col("n_pages")
    s = (
        F.when(F.size("errors") > 0, "rasterize_error").when(F.col("_same") > 1, "duplicate_id")
        .when(short > 0, "short_booklet").when(short < 0, "extra_pages").otherwise("ok")
    )
    reason = (
        F.when(F.col("status") == "rasterize_error", F.concat(F.lit("errors: "), F.array_join("errors", "; ")))
        .when(F.col("status") == "duplicate_id", F.concat(F.lit("id appears "), F.col("_same").cast("string"), F.lit(" times")))
        .when(F.col("status").isin("short_booklet", "extra_pages"), F.format_string("expected %d pages, got %d", "expected_pages", "n_pages"))
    )
    return b.withColumn("status", s).withColumn("reason", reason).drop("_same")


def report(statuses: DataFrame) -> DataFrame:
    """One row: booklets, pages, booklets without fault, halted ones, whether all are well."""
    ok = F.col("status") == "ok"
    return statuses.agg(
        F.count("*").alias("n_booklets"), F.coalesce(F.sum("n_pages"), F.lit(0)).alias("n_pages"), F.count_if(ok).alias("n_ok"),
        F.count_if(~ok).alias("n_halted"), F.coalesce(F.sum(F.size("errors")), F.lit(0)).alias("n_errors"), F.coalesce(F.bool_and(ok), F.lit(True)).alias("all_ok"),
    )


def without_halted(rows: DataFrame, statuses: DataFrame) -> DataFrame:
    """Rows whose booklet is not halted; those of booklets never scanned stay."""
    return rows.join(statuses.where("status <> 'ok'").select("booklet_id").distinct(), "booklet_id", "left_anti")


def pages(booklets: DataFrame) -> DataFrame:
    """One row per page, numbered again by its path."""
    p = booklets.select("booklet_id", F.explode("pages").alias("p")).select("booklet_id", F.col("p.path").alias("path"), F.col("p.width").alias("width"), F.col("p.height").alias("height"))
    w = W.partitionBy("booklet_id").orderBy("path")
    return p.withColumn("page_index", F.row_number().over(w) - 1).withColumn("page_name", X.stem("path"))


def kind(path: Column | str, strict: bool = False) -> Column:
    """What reader a file needs, by its ending; for others null, or with ``strict`` an error."""
    e = X.extension(path)
    out = F.raise_error(F.concat(F.lit("unsupported file "), path if isinstance(path, Column) else F.col(path))).cast("string") if strict else F.lit(None).cast("string")
    for ending, k in KINDS.items():
        out = F.when(e == ending, k).otherwise(out)
    return out
