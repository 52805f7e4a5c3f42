"""Numeric functions as native columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def clamp(x: Column, lo, hi) -> Column:
    return F.least(F.greatest(x, F.lit(lo) if not isinstance(lo, Column) else lo), F.lit(hi) if not isinstance(hi, Column) else hi)


#: The numbers of the functions below are fixed values.
def confidence(blank: Column, has_content: Column, n_formulas: Column, parse_rate: Column, n_flags: Column, self_reported: Column, agreement: Column | None = None) -> Column:
    """Objective confidence: blank .95; empty .15; else the parse rate (.92 without formulas) less .07 a flag, .35 at most,
    within [.05, .98]; .4 of it from another model's agreement, then .1 from the model's own, counted up to .85."""
    base = F.when(F.coalesce(n_formulas, F.lit(0)) == 0, 0.92).otherwise(F.coalesce(parse_rate, F.lit(0.0)))
    score = clamp(base - F.least(F.lit(0.35), 0.07 * F.coalesce(n_flags, F.lit(0))), 0.05, 0.98)
    if agreement is not None:
        score = F.when(agreement.isNull(), score).otherwise(0.6 * score + 0.4 * clamp(agreement, 0.0, 1.0))
    score = F.when(self_reported.isNull(), score).otherwise(0.9 * score + 0.1 * F.least(clamp(self_reported, 0.0, 1.0), F.lit(0.85)))
    return F.when(blank, 0.95).when(~has_content, 0.15).otherwise(F.round(score.cast("decimal(18,8)"), 4).cast("double"))


def centre(x: Column) -> Column:
    """Median of three values or more, mean of fewer, 0 of none; an aggregate."""
    return F.when(F.count(x) >= 3, F.median(x)).otherwise(F.coalesce(F.avg(x), F.lit(0.0)))


def strict_sum(x: Column) -> Column:
    """Null if any value is null; an aggregate."""
    return F.when(F.count("*") == F.count(x), F.sum(x))


def pearson(x: Column, y: Column) -> Column:
    """Null for fewer than two pairs or no variance; an aggregate."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.when(F.count(a) >= 2, F.try_divide(F.covar_pop(a, b), F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))))


def fixing_score(deskew: Column, crop: Column, contrast: Column, faint: Column, lighting: Column) -> Column:
    """Weighted page score of five parts, each within 0 and 100."""
    return sum((w * clamp(F.coalesce(x, F.lit(0.0)), 0.0, 100.0) for w, x in ((0.30, deskew), (0.20, crop), (0.20, contrast), (0.15, faint), (0.15, lighting))), F.lit(0.0))


def effective_dpi(widths_px: Column, page_inches: Column, requested: int, least_px: int = 1000) -> Column:
    """Resolution worth rendering at: that of the page's large images, from 72 up to the requested one."""
    native = F.array_max(F.transform(F.filter(widths_px, lambda w: w >= least_px), lambda w: w / page_inches))
    return F.when(native.isNull(), F.lit(requested)).otherwise(clamp(F.round(native).cast("int"), 72, requested))


def box(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """Normalised corners in any order as a pixel box (x, y, w, h) inside the page, at least one pixel wide and high."""
    ax, bx = F.least(x0, x1), F.greatest(x0, x1)
    ay, by = F.least(y0, y1), F.greatest(y0, y1)
    x = clamp(F.bround(ax * width).cast("int"), 0, width - 1)
    y = clamp(F.bround(ay * height).cast("int"), 0, height - 1)
    w = clamp(F.bround(bx * width).cast("int") - x, 1, width - x)
    h = clamp(F.bround(by * height).cast("int") - y, 1, height - y)
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def is_red(rgb: Column, least_red: int = 0xC0, most_other: int = 0x60) -> Column:
    """Whether a packed 24-bit colour is red."""
    part = lambda n: F.shiftright(rgb, n).bitwiseAND(0xFF)
    return (part(16) >= least_red) & (part(8) <= most_other) & (part(0) <= most_other)


def suit(ink_ratio: Column, holes: Column, top: Column, solidity: Column) -> Column:
    """Card suit of a glyph, null where its features disagree: hollow ones are red suits, told apart by the ink on
    top; filled ones are told apart by the ink on top and by solidity."""
    hollow = ink_ratio < 0.70
    return F.when(
        hollow == (holes >= 1),
        F.when(hollow, F.when(top >= 0.45, "heart").otherwise("diamond"))
        .when((top >= 0.24) & (solidity <= 0.82), "club")
        .when((top < 0.24) & (solidity > 0.82), "spade"),
    )


#: From which a page's measure is named as a reason for its score; contrast below it, if there is any.
FAINT, SPREAD, CONTRAST = 0.30, 6.0, 32.0


def page_reason(clamped: Column, faint: Column, spread: Column, contrast: Column) -> Column:
    """Why a page was worked on, in a sentence for each measure that passes its limit; a default where none does."""
    said = F.concat_ws(
        " ",
        F.when(clamped > 0, F.format_string("White point moved %.1f%% of the pixels.", clamped * 100)), F.when(faint >= FAINT, F.format_string("Faint strokes: %.1f%%.", faint * 100)),
        F.when(spread >= SPREAD, F.format_string("Uneven light (%.1f).", spread)), F.when((contrast > 0) & (contrast < CONTRAST), F.format_string("Low contrast (%.1f).", contrast)),
    )
    return F.when(said == "", "Highest score of its batch.").otherwise(said)
