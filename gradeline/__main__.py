"""``python -m gradeline QUERY FOLDER [OUT]``: run a named query; ``python -m gradeline halted FOLDER`` ends with 1 if a booklet is halted."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .operators import intake
from .plans import registry
from .plans.tables import table


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0: done; 1: a booklet is halted; 2: no such query."""
    p = argparse.ArgumentParser(prog="gradeline", description=__doc__)
    p.add_argument("query")
    p.add_argument("folder")
    p.add_argument("out", nargs="?", help="folder for the rows, as Parquet; else they are shown")
    p.add_argument("--booklets", default="", help="only these booklets, with commas between")
    a = p.parse_args(argv)
    known = registry.queries()
    if a.query != "halted" and a.query not in known:
        print("queries: " + " ".join(sorted(known)), file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.getOrCreate()
    rows = intake.status(table(spark, a.folder, "booklets")).where("status <> 'ok'") if a.query == "halted" else known[a.query](spark, a.folder)
    only = [x.strip() for x in a.booklets.split(",") if x.strip()]
    if only and "booklet_id" in rows.columns:
        rows = rows.where(rows["booklet_id"].isin(only))
    if a.out:
        rows.write.mode("errorifexists").parquet(a.out)
    else:
        rows.show(50, truncate=80)
    return int(a.query == "halted" and not rows.isEmpty())


if __name__ == "__main__":
    sys.exit(main())
