"""Sources: scanned files, manifests, transcripts, grade lists, fixtures. All are lazy DataFrames with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as X
from ..operators.intake import kind

PATH_GLOB = "*.{pdf,PDF,png,PNG,jpg,JPG,jpeg,JPEG,tif,TIF,tiff,TIFF,bmp,BMP}"
REGION = "struct<question_id:string,label:string,bbox:array<int>,state:string,confidence:double,reading_order:int,crop:string>"
MANIFEST = f"booklet_id string, page_name string, page_size struct<width:int,height:int>, questions array<{REGION}>, coverage map<string,string>"
MILESTONE = "struct<id:string,description:string,points:double,expected:string,depends_on:array<string>,abs_tol:double>"
RUBRIC = f"rubric_id string, exam_id string, source string, questions array<struct<question_id:string,max_points:double,kind:string,question_text:string,paths:array<struct<path_id:string,description:string,milestones:array<{MILESTONE}>>>>>"
CASES = "cases array<struct<id:string,`set`:string,question_id:string,declared:boolean,slip:string,expected_score:double,transcript:string>>"
TRANSCRIPT = (
    "crop_id string, model string, hebrew_text string, math_latex array<string>, interleaved_markdown string, flagged_tokens array<string>, latex_eval struct<total:int,parse_rate:double>, "
    "prompt_tokens int, candidate_tokens int, cache_hit boolean, errors array<string>, ok boolean, _corrupt_record string"
)


def scans(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, modificationTime, reader, stem) of the scan files right in a folder, contents unread. A missing folder raises when
    the frame is made, an empty one gives no row."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", PATH_GLOB).option("recursiveFileLookup", "false").load(folder)
    return files.select("path", "length", "modificationTime", kind("path").alias("reader"), X.stem("path").alias("stem"))


def images(spark: SparkSession, folder: str, glob: str = "*.png") -> DataFrame:
    """Pages decoded by Spark's own image source; files that are no images are dropped."""
    from ..operators.imaging import from_images

    return from_images(spark.read.format("image").option("dropInvalid", "true").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder))


def unreadable(spark: SparkSession, folder: str, glob: str = "*.png") -> DataFrame:
    """(path, error) of the files that the image source cannot decode, so that none is lost without trace."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder).select("path")
    tail = lambda c: F.regexp_replace(c, r"^file:/+", "/")  # noqa: E731 - the two sources write the scheme differently
    good = images(spark, folder, glob).select(tail(F.col("path")).alias("_p"))
    return files.withColumn("_p", tail(F.col("path"))).join(good, "_p", "left_anti").select("path", F.lit("not an image").alias("error"))


def _pdf(spark: SparkSession, folder: str, what: str, schema: str, names: list[str]) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{pdf,PDF}").option("recursiveFileLookup", "true").load(folder).select("path", "content")

    def run(frames):
        import pandas as pd

        from ..functions import pdf

        read = getattr(pdf, what)
        for f in frames:
            rows = []
            for path, content in f.itertuples(index=False, name=None):
                for page, found, error in pdf.read(bytes(content), read):
                    rows += [(path, page, k, None, *([x[n] for n in names] if isinstance(x, dict) else x)) for k, x in enumerate(found)] or [(path, page, None, error, *[None] * len(names))]
            yield pd.DataFrame(rows, columns=["path", "page_index", "pos", "error", *names])

    return files.mapInPandas(run, "path string, page_index int, pos int, error string, " + schema)


def pdf_spans(spark: SparkSession, folder: str) -> DataFrame:
    """(path, page_index, pos, error, text, x, y, size, color): text spans of digital PDFs, y from the top. A page without text has a row of nulls, one that cannot be
    read, or a file, has its error."""
    return _pdf(spark, folder, "page_spans", "text string, x double, y double, size double, color int", ["text", "x", "y", "size", "color"])


def pdf_images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, page_index, pos, error, width, height, channels, format, data): the images on the pages of scanned PDFs, the largest of a page first. Nothing is rendered."""
    return _pdf(spark, folder, "page_images", "width int, height int, channels int, format string, data binary", ["width", "height", "channels", "format", "data"])


PAGE_METRICS = "path string, paper_white double, clamped double, skew double, skew_after double, std double, faint double, spread double, ink double, fixing_score double, _corrupt_record string"


def page_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Measures that ``sinks.page_metrics`` wrote beside the pages; records that do not parse are left out."""
    m = spark.read.schema(PAGE_METRICS).option("mode", "PERMISSIVE").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(folder)
    return m.where("_corrupt_record is null and path is not null").drop("_corrupt_record")


def manifests(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "manifest.json").json(folder)


def crops(spark: SparkSession, folder: str, booklets: list[str] | None = None, states: tuple[str, ...] = ("answered",), cover: str | None = None, limit: int | None = None) -> DataFrame:
    """Regions of the manifests in a folder whose crop file is there, filtered by booklet before they are exploded; without the page named ``cover``,
    and with ``limit`` only the first so many by crop_id."""
    m = manifests(spark, folder)
    if cover:
        m = m.where(F.col("page_name") != cover)
    if booklets:
        m = m.where(F.col("booklet_id").isin(booklets))
    q = m.select("booklet_id", "page_name", F.explode("questions").alias("q")).select("booklet_id", "page_name", "q.*").where(F.col("state").isin(*states))
    there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.png").load(folder)
    there = there.select(F.regexp_extract("path", r"([^/]+/[^/]+/[^/]+)$", 1).alias("tail"))
    tail = F.concat_ws("/", "booklet_id", X.stem("page_name"), "crop")
    found = q.withColumn("tail", tail).join(there, "tail", "left_semi").withColumn("crop_id", F.concat_ws("/", "booklet_id", X.stem("page_name"), F.concat(F.lit("q"), "question_id"))).drop("tail")
    return found.orderBy("crop_id").limit(limit) if limit is not None else found


def transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """Transcripts of a folder and below; records that do not parse are left out."""
    t = spark.read.schema(TRANSCRIPT).option("mode", "PERMISSIVE").option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(folder)
    return t.where("_corrupt_record is null and crop_id is not null").drop("_corrupt_record")


def grade_list(spark: SparkSession, path: str) -> DataFrame:
    """(booklet_id, total) of a list without header: rows with a number as id and a grade; ids get two digits at least."""
    rows = spark.read.schema("id string, grade string").option("header", "false").csv(path)
    rows = rows.select(F.regexp_replace(F.trim("id"), "^﻿", "").alias("id"), F.trim("grade").alias("grade"))
    return rows.where(F.col("id").rlike(r"^\d+$") & (F.col("grade") != "")).select(F.format_string("%02d", F.col("id").cast("long")).alias("booklet_id"), F.col("grade").try_cast("double").alias("total"))


def hand_labels(spark: SparkSession, path: str) -> DataFrame:
    """(booklet_id, version, question, mark) of an object booklet -> {version, marks}."""
    whole = spark.read.text(path, wholetext=True)
    m = whole.select(F.explode(F.from_json("value", "map<string,struct<version:string,marks:array<string>>>")).alias("booklet_id", "v"))
    return m.select("booklet_id", F.col("v.version").alias("version"), F.posexplode("v.marks").alias("pos", "mark")).select("booklet_id", "version", (F.col("pos") + 1).alias("question"), "mark")


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """(crop_id, text) of an object; keys that begin with an underscore are notes. What is no JSON text, by its type, is left out; a text of digits stays."""
    raw = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    each = raw.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
    return each.where(~F.col("key").startswith("_") & (F.schema_of_variant("value") == "STRING")).select(F.col("key").alias("crop_id"), F.variant_get("value", "$", "string").alias("text"))


def rubric(spark: SparkSession, path: str) -> DataFrame:
    """One row per question, missing kinds open and missing sources instructor."""
    r = spark.read.schema(RUBRIC).option("multiLine", "true").option("pathGlobFilter", "*.json").json(path).select("rubric_id", "exam_id", F.coalesce("source", F.lit("instructor")).alias("source"), F.explode("questions").alias("q"))
    return r.select("rubric_id", "exam_id", "source", "q.*").withColumn("kind", F.coalesce("kind", F.lit("open")))


def cases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CASES).option("multiLine", "true").json(path).select(F.explode("cases").alias("c")).select("c.*").withColumn("declared", F.coalesce("declared", F.lit(True)))
