"""Queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import looks, markup, mixing, near, overlap, packing, repetition, truncation
from .common import table
from .sql import oracle_sql  # noqa: F401 - part of this module's contract


def _texts(fields):
    return lambda s, d: looks.all_texts({t: table(s, d, t) for t, *_ in fields}, fields)


def _with(f: Callable[..., DataFrame], *names: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: f(*(table(s, d, n) for n in names))


_looks, _near = _texts(looks.FIELDS), _texts(near.FIELDS)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": _with(truncation.found, "grades", "transcriber"),
        "p1_rates": _with(truncation.report, "grades", "transcriber"),
        "p1_limits": _with(truncation.limits, "grades", "transcriber"),
        "p2_found": _with(overlap.pairs, "curated_cases", "curated_cases_heldout"),
        "p2_report": _with(overlap.report, "curated_cases", "curated_cases_heldout"),
        "p3_found": lambda s, d: looks.look_pairs(_looks(s, d)),
        "p3_forms": lambda s, d: looks.canonical(_looks(s, d), "text").select("field", "id", "canonical_text").distinct(),
        "p3_classes": lambda s, d: looks.look_classes(_looks(s, d)),
        "p4_found": lambda s, d: near.near_pairs(_near(s, d)),
        "p4_groups": lambda s, d: near.groups(_near(s, d)),
        "p5_found": _with(markup.found, "transcriber"),
        "p5_clean": _with(markup.cleaned, "transcriber"),
        "p5_report": _with(markup.report, "transcriber"),
        "p6_windows": _with(packing.laid_out, "documents", "window_sizes"),
        "p6_fill": _with(packing.report, "documents", "window_sizes"),
        "p7_mixture": _with(mixing.mixture, "documents", "source_targets"),
        "p7_shares": _with(mixing.report, "documents", "source_targets"),
        "p8_found": _with(repetition.found, "documents"),
        "p8_shares": lambda s, d: repetition.shares(table(s, d, "documents")),
        "p8_report": _with(repetition.report, "documents"),
    }
