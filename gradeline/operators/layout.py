"""Regions, columns and headers of pages as joins on intervals and order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def coverage(expected: DataFrame, found: DataFrame, keys: list[str], state: str = "state") -> DataFrame:
    """Each expected key as answered, blank or not_found; the three are distinct, none is null."""
    f = found.groupBy(*keys).agg(F.bool_and(F.col(state) == "blank").alias("_blank"))
    j = expected.select(*keys).distinct().join(f, keys, "left")
    return j.withColumn("coverage", F.when(F.col("_blank").isNull(), "not_found").when(F.col("_blank"), "blank").otherwise("answered")).drop("_blank")


def halting(coverage: DataFrame, page: str, question: str) -> DataFrame:
    """(page, halted, reasons): a page halts if a question that it should have is not found; the reasons name them in order."""
    missing = F.when(F.col("coverage") == "not_found", F.concat(F.lit("question "), F.col(question), F.lit(" not found")))
    one = coverage.withColumn("_m", missing).groupBy(page).agg(F.array_sort(F.collect_set("_m")).alias("_r"))
    return one.select(page, (F.size("_r") > 0).alias("halted"), F.array_join("_r", "; ").alias("reasons"))


def band_of(points: DataFrame, value: str, bands: list[tuple[float, float]]) -> DataFrame:
    """The first band (from and to included) that holds a value, 0 where none does. A page has few bands, so they are an expression, not a join."""
    out = F.lit(0)
    for i, (lo, hi) in reversed(list(enumerate(bands))):
        out = F.when(F.col(value).between(lo, hi), i).otherwise(out)
    return points.withColumn("band", out)


def column_of(regions: DataFrame, columns: DataFrame, page: str, centre: str) -> DataFrame:
    """Adds ``column_index``: of the page's own columns (page, pos, x0, x1), the first by pos whose span holds the centre, else 0.
    Columns come as one array a page, which has few, so a page's regions meet them in one row each."""
    c = columns.groupBy(page).agg(F.array_sort(F.collect_list(F.struct("pos", "x0", "x1"))).alias("_c"))
    hit = F.filter("_c", lambda k: F.col(centre).between(k["x0"], k["x1"]))
    return regions.join(c, page, "left").withColumn("column_index", F.coalesce(F.get(hit, F.lit(0))["pos"].cast("int"), F.lit(0))).drop("_c")


def band_rows(spans: DataFrame, labels: DataFrame, page: str, height: int = 6) -> DataFrame:
    """(page, label, text spans): spans within ``height`` of a label's line, left of it and right of the label before it on that line (text runs from right to left).
    ``labels`` has label, lx, ly, ``spans`` text, x, y, in integers. Equi-joined on cells of the line's height."""
    l = labels.select(page, "label", "lx", "ly").withColumn("_cell", F.floor(F.col("ly") / height))
    n = labels.select(page, F.col("lx").alias("ox"), F.col("ly").alias("oy"))
    n = n.withColumn("_cell", F.explode(F.array(*(F.floor(F.col("oy") / height) + k for k in (-1, 0, 1)))))
    left = l.join(n, [page, "_cell"], "left").withColumn("_near", (F.abs(F.col("oy") - F.col("ly")) <= height) & (F.col("ox") < F.col("lx")))
    left = left.groupBy(page, "label", "lx", "ly").agg(F.max(F.when(F.col("_near"), F.col("ox"))).alias("bound")).withColumn("_cell", F.floor(F.col("ly") / height))
    s = spans.select(page, "text", "x", "y").withColumn("_cell", F.explode(F.array(*(F.floor(F.col("y") / height) + k for k in (-1, 0, 1)))))
    hit = left.join(s, [page, "_cell"]).where((F.abs(F.col("y") - F.col("ly")) <= height) & (F.col("x") < F.col("lx")) & (F.col("bound").isNull() | (F.col("x") > F.col("bound"))))
    return hit.select(page, "label", "text", "x", "y")


def backward_asof(left: DataFrame, right: DataFrame, key: str, at: str, value: str, cell) -> DataFrame:
    """For each left row the ``value`` of the last right row of its key that is not later; of right rows at one time the greatest counts.

    ``cell`` maps the position to a coarse cell, which must not fall as the position grows. Windows run within (key, cell), so a busy key is spread
    over its cells; what a cell begins with is carried over from the cells before by their last values, one row a cell.
    """
    l = left.withColumn("_t", F.col(at)).withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast(right.schema[value].dataType))
    r = right.select(F.col(key), F.col(at).alias("_t"), F.col(value).alias("_v"), F.lit(0).alias("_side")).where("_v is not null")
    cells = r.groupBy(key, cell(F.col("_t")).alias("_cell")).agg(F.max_by("_v", F.struct("_t", "_v")).alias("_end"))
    both = l.unionByName(r, allowMissingColumns=True).withColumn("_cell", cell(F.col("_t")))
    w = W.partitionBy(key, "_cell").orderBy("_t", "_side", F.col("_v").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)
    inside = both.withColumn("_in", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    need = inside.select(key, "_cell").distinct().join(cells, [key, "_cell"], "full")
    before = W.partitionBy(key).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    carry = need.withColumn("_carry", F.last("_end", ignorenulls=True).over(before)).drop("_end")
    out = inside.join(carry, [key, "_cell"], "left")
    return out.withColumn("last_value", F.coalesce("_in", "_carry")).select(*left.columns, "last_value")


def within(left: DataFrame, right: DataFrame, key: str, at: str, width: int) -> DataFrame:
    """Pairs of a key whose integer positions are at most ``width`` apart: an equi-join on cells of that width and their
    neighbours, so that a busy key is split over its cells."""
    a = left.withColumn("_cell", F.floor(F.col(f"l_{at}") / width))
    b = right.withColumn("_cell", F.explode(F.array(*(F.floor(F.col(f"r_{at}") / width) + k for k in (-1, 0, 1)))))
    return a.join(b, [key, "_cell"]).where(F.abs(F.col(f"l_{at}") - F.col(f"r_{at}")) <= width).drop("_cell")


def reading_order(regions: DataFrame, page: str, *order) -> DataFrame:
    return regions.withColumn("reading_order", F.row_number().over(W.partitionBy(page).orderBy(*order)) - 1)


def right_to_left(columns: DataFrame, page: str, index: str) -> DataFrame:
    return columns.withColumn("rtl_index", F.count("*").over(W.partitionBy(page)) - 1 - F.col(index))
