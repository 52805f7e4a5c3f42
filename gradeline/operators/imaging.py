"""Page operators over Spark's ``image`` source, or any rows of page bytes: one Arrow pass, pages in, rows out."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions import pages as P


def from_images(images: DataFrame) -> DataFrame:
    """(path, height, width, channels, data) of ``spark.read.format("image")``."""
    return images.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").toDF("path", "height", "width", "channels", "data")


def array_of(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return a[..., 0] if channels == 1 else a


def per_page(pages: DataFrame, fn: Callable[[np.ndarray], Iterable[tuple]], schema: str) -> DataFrame:
    """Rows of ``fn`` for every page, with the page's path first. A page that cannot be read gives none and is left to ``unreadable``."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                if r.data is not None and len(r.data) == r.height * r.width * r.channels and len(r.data):
                    rows += [(r.path, *x) for x in fn(array_of(r.data, r.height, r.width, r.channels))]
            yield pd.DataFrame(rows, columns=["path", *names])

    return pages.select("path", "height", "width", "channels", "data").mapInPandas(run, "path string, " + schema)


def unreadable(pages: DataFrame) -> DataFrame:
    return pages.where(F.col("data").isNull() | (F.length("data") == 0) | (F.length("data") != F.col("height") * F.col("width") * F.col("channels"))).select("path")


def measured(pages: DataFrame, clamp: bool = True) -> DataFrame:
    """Measures of each page after straightening and, with ``clamp``, the white-point clamp; ``skew_after`` is what the straightened page still leans."""

    def one(a):
        straight, angle = P.deskew(a)
        clean, changed = P.clamp_white(straight, clamp)
        s = P.statistics(clean)
        yield P.paper_white(a), changed, angle, angle if straight is a else P.skew(straight), s["std"], s["faint"], s["spread"], s["ink"]

    return per_page(pages, one, "paper_white double, clamped double, skew double, skew_after double, std double, faint double, spread double, ink double")


def columns(pages: DataFrame) -> DataFrame:
    """Columns of each page in reading order, with the mean confidence of the page's gutters, 1 where it has none."""

    def one(a):
        sure = P.gutter_confidences(a)
        yield from ((x0, x1, k, float(np.mean(sure)) if sure else 1.0) for k, (x0, x1) in enumerate(P.columns(a)))

    return per_page(pages, one, "x0 int, x1 int, reading_order int, gutter_confidence double")


def grid_crops(pages: DataFrame, rows: int, cols: int) -> DataFrame:
    """The answer grid of each page, made upright, as bytes, for a second reading; pages without one give no row."""

    def one(a):
        got = P.rectified_grid(a, rows, cols)
        if got:
            t = got[0]
            yield t.shape[0], t.shape[1], 1 if t.ndim == 2 else t.shape[2], np.ascontiguousarray(t).tobytes()

    return per_page(pages, one, "height int, width int, channels int, data binary")


def regions(pages: DataFrame) -> DataFrame:
    keys = ("x", "y", "w", "h", "column", "reading_order", "ink", "state", "confidence", "is_sub")
    return per_page(pages, lambda a: (tuple(b[k] for k in keys) for b in P.blocks(a)), "x int, y int, w int, h int, column int, reading_order int, ink double, state string, confidence double, is_sub boolean")


def tables(pages: DataFrame) -> DataFrame:
    keys = ("x", "y", "w", "h", "rows", "cols", "confidence", "kind")
    return per_page(pages, lambda a: (tuple(t[k] for k in keys) for t in P.tables(a)), "x int, y int, w int, h int, rows int, cols int, confidence double, kind string")


def grid_cells(pages: DataFrame, rows: int | None = None, cols: int | None = None) -> DataFrame:
    """Ink of each box of a page's answer grid, ready for ``votes.resolved_rows``. With ``rows`` and ``cols`` the grid of that many boxes is found,
    made upright and read on its lattice; a page without one gives no row and is left to ``without_grid``. Else the boxes between the lines of the largest table are read."""

    def one(a):
        if rows and cols:
            got = P.rectified_grid(a, rows, cols)
            a, ys, xs = got if got else (a, [], [])
        else:
            found = max(P.tables(a), key=lambda t: t["w"] * t["h"], default={"ys": [], "xs": []})
            ys, xs = found["ys"], found["xs"]
        yield from ((r, str(c), ink, core) for r, c, ink, core in P.cells(a, xs, ys))

    return per_page(pages, one, "row int, letter string, ink double, core_fill double")


def without_grid(pages: DataFrame, cells: DataFrame) -> DataFrame:
    """(path, error) of the pages on which no grid was found."""
    return pages.select("path").join(cells.select("path").distinct(), "path", "left_anti").withColumn("error", F.lit("answer grid not found"))


def upright(pages: DataFrame) -> DataFrame:
    """Pages with their sheet cut out of a dark ground and made rectangular; ``changed`` tells which."""

    def one(a):
        b, changed = P.upright_page(a)
        yield b.shape[0], b.shape[1], 1 if b.ndim == 2 else b.shape[2], np.ascontiguousarray(b).tobytes(), changed

    return per_page(pages, one, "height int, width int, channels int, data binary, changed boolean")


def masked(pages: DataFrame, share: float = 0.15) -> DataFrame:
    """Pages with their top made black, natively on the bytes."""
    top = (F.round(F.col("height") * share) * F.col("width") * F.col("channels")).cast("int")
    black = F.unhex(F.repeat(F.lit("00"), top))
    return pages.withColumn("data", F.concat(black, F.substring("data", top + 1, F.length("data"))))


def crops(pages: DataFrame, boxes: DataFrame) -> DataFrame:
    """The bytes of each box (path, x, y, w, h), cut off at the page's edge; row by row, natively."""
    j = boxes.join(pages.select("path", "height", "width", "channels", "data"), "path")
    x0, y0 = F.greatest("x", F.lit(0)), F.greatest("y", F.lit(0))
    x1, y1 = F.least(F.col("x") + F.col("w"), F.col("width")), F.least(F.col("y") + F.col("h"), F.col("height"))
    j = j.select("path", "channels", "data", "width", x0.alias("x"), y0.alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h")).where("w > 0 and h > 0")
    row = lambda r: F.col("data").substr(((F.col("y") + r) * F.col("width") + F.col("x")) * F.col("channels") + 1, F.col("w") * F.col("channels"))
    bytes_ = F.aggregate(F.sequence(F.lit(0), F.col("h") - 1), F.unhex(F.lit("")), lambda acc, r: F.concat(acc, row(r)))
    return j.select("path", "x", "y", "w", "h", "channels", bytes_.alias("data"))


def drawn(ids: DataFrame, height: int = 400, width: int = 300) -> DataFrame:
    """Pages drawn from ids: ghosts of the back side, text lines in one or two columns, and a grid on every third."""

    def page(i: int) -> np.ndarray:
        rng = np.random.default_rng(i)
        a = np.full((height, width), 252, np.uint8)
        a[20:26, 20 : width - 20] = 240
        bands = [(20, width - 20)] if i % 2 else [(20, width // 2 - 15), (width // 2 + 15, width - 20)]
        for x0, x1 in bands:
            for y in range(50, height // 2, 12):
                a[y : y + 5, x0 : x1 - int(rng.integers(0, 20))] = 40
        if i % 3 == 0:
            xs, ys = np.linspace(60, 240, 5).astype(int), np.linspace(height // 2 + 20, height - 20, 6).astype(int)
            for y in ys:
                a[y : y + 2, 60:242] = 0
            for x in xs:
                a[ys[0] : ys[-1] + 2, x : x + 2] = 0
            for r in range(5):
                c = int(rng.integers(0, 4))
                cy, cx = (ys[r] + ys[r + 1]) // 2, (xs[c] + xs[c + 1]) // 2
                a[cy - 6 : cy + 6, cx - 6 : cx + 6] = 30
        return a

    def run(batches):
        import pandas as pd

        for b in batches:
            yield pd.DataFrame([(str(i), height, width, 1, page(int(i)).tobytes()) for i in b.iloc[:, 0]], columns=["path", "height", "width", "channels", "data"])

    # few ids make many bytes: they are spread before they are drawn
    return ids.repartition(max(8, ids.sparkSession.sparkContext.defaultParallelism)).mapInPandas(run, "path string, height int, width int, channels int, data binary")
