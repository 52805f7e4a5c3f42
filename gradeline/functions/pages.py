"""Measurements on page arrays, with numpy alone: rows x columns (x 3) of bytes, 255 white.

Ink is what is darker than ``INK``. Structure is found from runs in projections: columns lie between the long
runs of light columns, blocks between the long runs of light rows, tables where long dark runs cross.
"""

from __future__ import annotations

import numpy as np

INK = 200
#: Fixed values of the white point: darkest safe ink, least paper, floor and band of the clamp.
INK_SAFE, PAPER_LEAST, CLAMP_FLOOR, BLEED_BAND = 180, 230, 238, 0.08


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else np.round(image[..., :3] @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)


def lightness(image: np.ndarray) -> np.ndarray:
    """Perceived lightness from 0 to 255 (the L of Lab) of blue-green-red pages; grey pages are their own."""
    if image.ndim == 2:
        return image
    c = image[..., :3].astype(np.float64) / 255
    linear = np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4)
    y = linear @ np.array([0.0722, 0.7152, 0.2126])
    return np.round(np.where(y > 216 / 24389, 116 * np.cbrt(y) - 16, y * 24389 / 27) * 2.55).astype(np.uint8)


def runs(mask: np.ndarray) -> np.ndarray:
    """Start and end of each run of true, one row each."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return edge.reshape(-1, 2)


def smooth(x: np.ndarray, width: int) -> np.ndarray:
    width = max(1, width | 1)
    c = np.cumsum(np.concatenate((np.full(width // 2 + 1, 0.0), x, np.zeros(width // 2))))
    return (c[width:] - c[:-width]) / width


def paper_white(image: np.ndarray) -> float:
    """The paper's lightness: a high percentile or the bright peak of the histogram, whichever is brighter."""
    g = lightness(image)
    high = float(np.percentile(g, 99))
    low = int(max(PAPER_LEAST, min(high - 20, 250)))
    return max(high, float(low + np.argmax(np.bincount(g.ravel(), minlength=256)[low:])))


def clamp_white(image: np.ndarray, on: bool = True) -> tuple[np.ndarray, float]:
    """Ghosts near the paper's white become white, what is dark enough for ink stays; the share changed. Dark paper stays as it is, as does everything unless ``on``."""
    paper = paper_white(image) if on else 0.0
    if paper < PAPER_LEAST:
        return image, 0.0
    at = max(paper - 255 * BLEED_BAND, CLAMP_FLOOR, INK_SAFE)
    if at >= paper:
        at = max(INK_SAFE, paper - 8)
    g = lightness(image)
    ghost = g >= int(at)
    changed = float(np.mean(ghost & (g < 255)))
    out = image.copy()
    out[ghost] = 255
    return out, changed


def equalise(image: np.ndarray, tiles: int = 8, clip: float = 2.0) -> np.ndarray:
    """Contrast-limited equalisation: a clipped histogram map per tile, blended between tile centres."""
    g = grey(image)
    h, w = g.shape
    ys, xs = (np.linspace(0, n, tiles + 1).astype(int) for n in (h, w))
    maps = np.empty((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            t = g[ys[i] : max(ys[i + 1], ys[i] + 1), xs[j] : max(xs[j + 1], xs[j] + 1)]
            hist = np.bincount(t.ravel(), minlength=256).astype(float)
            top = max(1.0, clip * t.size / 256)
            over = np.maximum(hist - top, 0).sum()
            maps[i, j] = np.cumsum(np.minimum(hist, top) + over / 256) * 255 / t.size
    fy, fx = ((np.arange(n) + 0.5) * tiles / n - 0.5 for n in (h, w))
    y0, x0 = (np.clip(np.floor(f).astype(int), 0, tiles - 1) for f in (fy, fx))
    y1, x1 = np.minimum(y0 + 1, tiles - 1), np.minimum(x0 + 1, tiles - 1)
    ay, ax = np.clip(fy - y0, 0, 1)[:, None], np.clip(fx - x0, 0, 1)[None, :]
    at = lambda a, b: maps[a[:, None], b[None, :], g]
    top_, low = at(y0, x0) * (1 - ax) + at(y0, x1) * ax, at(y1, x0) * (1 - ax) + at(y1, x1) * ax
    return np.clip(np.round(top_ * (1 - ay) + low * ay), 0, 255).astype(np.uint8)


def rotate(image: np.ndarray, degrees: float) -> np.ndarray:
    """About the middle, nearest neighbour, white outside."""
    h, w = image.shape[:2]
    a = np.deg2rad(degrees)
    y, x = np.mgrid[0:h, 0:w].astype(np.float32)
    y, x = y - h / 2, x - w / 2
    sx, sy = np.round(np.cos(a) * x - np.sin(a) * y + w / 2).astype(int), np.round(np.sin(a) * x + np.cos(a) * y + h / 2).astype(int)
    inside = (sx >= 0) & (sx < w) & (sy >= 0) & (sy < h)
    out = np.full_like(image, 255)
    out[inside] = image[sy[inside], sx[inside]]
    return out


def skew(image: np.ndarray, most: float = 15.0) -> float:
    """Degrees by which lines of ink lean: the shear whose row projection is sharpest, coarse to fine."""
    ink = grey(image) < INK
    step = max(1, max(ink.shape) // 800)
    y, x = np.nonzero(ink[::step, ::step])
    if len(y) < 50:
        return 0.0
    best, width = 0.0, most
    for parts in (31, 21, 21):
        angles = np.linspace(best - width, best + width, parts)
        sharp = []
        for a in angles:
            rows = np.round(y - x * np.tan(np.deg2rad(a))).astype(int)
            n = np.bincount(rows - rows.min())
            sharp.append(float((n.astype(float) ** 2).sum()))
        best, width = float(angles[int(np.argmax(sharp))]), 2 * width / (parts - 1)
    return best


def deskew(image: np.ndarray) -> tuple[np.ndarray, float]:
    """Straightened page and the angle it had; up to half a degree it stays, beyond fifteen it is left alone."""
    a = skew(image)
    return (rotate(image, a) if 0.5 < abs(a) <= 15 else image), a


def crop_border(image: np.ndarray, dark: int = 90) -> np.ndarray:
    """Without dark scanner borders, which are rows and columns that are mostly dark, counted from each edge."""
    g = grey(image) < dark
    y, x = (np.flatnonzero(g.mean(axis=k) < 0.6) for k in (1, 0))
    return image[y[0] : y[-1] + 1, x[0] : x[-1] + 1] if len(y) and len(x) else image


def warp(image: np.ndarray, corners: np.ndarray, width: int, height: int) -> np.ndarray:
    """The quadrangle of ``corners`` (x, y; from the top left on, clockwise) as an upright page of that size; nearest neighbour, white where the image ends."""
    u, v = np.array([0, width - 1, width - 1, 0.0]), np.array([0, 0, height - 1, height - 1.0])
    x, y = np.asarray(corners, float).T
    one, zero = np.ones(4), np.zeros(4)
    # x = (a u + b v + c) / (g u + h v + 1), y likewise, at the four corners
    rows = np.concatenate([np.stack([u, v, one, zero, zero, zero, -u * x, -v * x], 1), np.stack([zero, zero, zero, u, v, one, -u * y, -v * y], 1)])
    a, b, c, d, e, f, g, h = np.linalg.solve(rows, np.concatenate([x, y]))
    v, u = np.mgrid[0:height, 0:width].astype(float)
    z = g * u + h * v + 1
    sx, sy = np.rint((a * u + b * v + c) / z).astype(int), np.rint((d * u + e * v + f) / z).astype(int)
    inside = (sx >= 0) & (sx < image.shape[1]) & (sy >= 0) & (sy < image.shape[0])
    out = np.full((height, width, *image.shape[2:]), 255, np.uint8)
    out[inside] = image[sy[inside], sx[inside]]
    return out


def largest(mask: np.ndarray) -> np.ndarray:
    """The largest connected part of a mask, by its rows' runs, neighbours at corners included."""
    at, own, above = [], [], (np.zeros((0, 2), int), np.zeros(0, int))
    parent: list[int] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for y in range(len(mask)):
        r = runs(mask[y])
        ids = np.arange(len(parent), len(parent) + len(r))
        parent.extend(ids.tolist())
        first = np.searchsorted(above[0][:, 1], r[:, 0])  # runs above that end at or behind the start
        for k, (a, b) in enumerate(r):
            j = first[k]
            while j < len(above[0]) and above[0][j, 0] <= b:
                parent[root(int(above[1][j]))] = root(int(ids[k]))
                j += 1
        at += [(y, a, b) for a, b in r]
        own.append(ids)
        above = (r, ids)
    out = np.zeros_like(mask)
    if at:
        roots = np.array([root(i) for i in range(len(parent))])
        at = np.array(at)
        size = np.bincount(roots, at[:, 2] - at[:, 1])
        for y, a, b in at[roots == int(np.argmax(size))]:
            out[y, a:b] = True
    return out


def corners(mask: np.ndarray) -> np.ndarray:
    """Its outermost points towards the four corners, from the top left on, clockwise, as (x, y)."""
    y, x = np.nonzero(mask)
    return np.array([(x[k], y[k]) for k in (np.argmin(x + y), np.argmax(x - y), np.argmax(x + y), np.argmin(x - y))])


def sides(c: np.ndarray) -> tuple[int, int]:
    """Width and height of a quadrangle: the longer of either two."""
    d = np.linalg.norm(np.roll(c, -1, 0) - c, axis=1)
    return int(round(max(d[0], d[2]))) + 1, int(round(max(d[1], d[3]))) + 1


def upright_page(image: np.ndarray, bright: int = 200, least: float = 0.5) -> tuple[np.ndarray, bool]:
    """The bright sheet on a dark ground, made rectangular. A sheet that reaches the image's corners, or covers less than ``least`` of a side, is left as it is."""
    sheet = grey(image) > bright
    if not sheet.any():
        return image, False
    h, w = sheet.shape
    c = corners(largest(sheet))
    wide, high = sides(c)
    off = np.abs(c - np.array([(0, 0), (w - 1, 0), (w - 1, h - 1), (0, h - 1)])).max()
    if wide < least * w or high < least * h or off <= 0.01 * max(h, w):
        return image, False
    return warp(image, c, wide, high), True


def ruled(mask: np.ndarray, across: int, down: int) -> np.ndarray:
    """Pixels that belong to a horizontal run of ``across`` or a vertical one of ``down`` at least."""
    out = np.zeros_like(mask)
    for m, o, least in ((mask, out, across), (mask.T, out.T, down)):
        for k in range(len(m)):
            for a, b in runs(m[k]):
                if b - a >= least:
                    o[k, a:b] = True
    return out


def lattice(found: list[int], n: int, most: float = 0.15) -> list[int] | None:
    """Of positions found, the ``n`` that lie most evenly; None if there are too few or the best of them are off by more than ``most`` of a step."""
    x = np.array(sorted(found), float)
    best, cost = None, most
    for i in range(len(x)):
        for j in range(i + n - 1, len(x)):
            step = (x[j] - x[i]) / (n - 1)
            want = x[i] + step * np.arange(n)
            k = np.clip(np.searchsorted(x, want), 1, len(x) - 1)
            k = np.where(want - x[k - 1] <= x[k] - want, k - 1, k)
            off = np.abs(x[k] - want).max() / max(step, 1.0)
            if len(set(k.tolist())) == n and off < cost:
                best, cost = x[k].astype(int).tolist(), off
    return best


def rectified_grid(image: np.ndarray, rows: int, cols: int) -> tuple[np.ndarray, list[int], list[int]] | None:
    """The ruled table of ``rows`` x ``cols`` boxes, made upright, with the places of its lines (ys, xs); None if no part of the page has such a lattice.
    Rows that are nearly all dark, a mask, are no lines."""
    ink = grey(image) < 128
    ink[ink.mean(axis=1) > 0.9] = False
    h, w = ink.shape
    lines_ = ruled(ink, max(12, w // 30), max(12, h // 40))
    if not lines_.any():
        return None
    c = corners(largest(lines_))
    wide, high = sides(c)
    if wide < 0.2 * w or high < 0.1 * h:
        return None
    table = warp(image, c, wide, high)
    dark = grey(table) < 128
    out = []
    for axis, n in ((1, rows + 1), (0, cols + 1)):
        size = dark.shape[1 - axis]
        p = smooth(ruled(dark, *((wide // 3, 10**9) if axis else (10**9, high // 3))).mean(axis=axis), 5)
        if p.max() <= 0:
            return None
        peaks = [int(a + np.argmax(p[a:b])) for a, b in runs(p >= 0.35 * p.max())]
        gap = max(4, size // (2 * n))
        peaks += [e for e in (0, size - 1) if all(abs(e - q) >= gap for q in peaks)]
        out.append(lattice(peaks, n))
    return None if None in out else (table, *out)


def mask_top(image: np.ndarray, share: float = 0.15) -> np.ndarray:
    out = image.copy()
    out[: int(round(len(image) * share))] = 0
    return out


def statistics(image: np.ndarray) -> dict[str, float]:
    """Contrast, share of faint ink and unevenness of light over the quarters."""
    g = grey(image).astype(float)
    ink = g < 235
    h, w = g.shape[0] // 2, g.shape[1] // 2
    quarters = [q.mean() for q in (g[:h, :w], g[:h, w:], g[h:, :w], g[h:, w:]) if q.size]
    return {"std": float(g.std()), "faint": float((ink & (g > 150)).sum() / max(1, ink.sum())), "spread": float(max(quarters) - min(quarters)), "ink": float((g < INK).mean())}


def gutters(image: np.ndarray) -> list[tuple[int, int]]:
    """Up to two wide light strips between inked columns, left to right."""
    ink = (grey(image) < INK).sum(axis=0).astype(float)
    w = len(ink)
    s = smooth(ink, int(w * 0.01))
    edge = int(w * 0.12)
    peak = float(np.percentile(s, 90))
    if peak <= 0:
        return []
    found = [(a, b) for a, b in runs(s < 0.12 * peak) if a > edge and b < w - edge and b - a >= 0.015 * w and s[:a].max() > 0.25 * peak and s[b:].max() > 0.25 * peak]
    return sorted(sorted(found, key=lambda r: (r[0] - r[1], abs(r[0] + r[1] - w)))[:2])


def gutter_confidences(image: np.ndarray) -> list[float]:
    """How free of ink each gutter is against its columns: 1 for white, 0 for as much as half a column has."""
    ink = (grey(image) < INK).mean(axis=0)
    column = float(np.percentile(ink, 90))
    return [round(float(np.clip(1 - ink[a:b].mean() / max(column / 2, 1e-9), 0, 1)), 3) for a, b in gutters(image)]


def columns(image: np.ndarray) -> list[tuple[int, int]]:
    """Columns in reading order from right to left; none narrower than a fifth of the page, else one column."""
    w = image.shape[1]
    cuts = [0, *((a + b) // 2 for a, b in gutters(image)), w]
    if any(b - a < w / 5 for a, b in zip(cuts, cuts[1:])):
        cuts = [0, w]
    return list(zip(cuts, cuts[1:]))[::-1]


def blocks(image: np.ndarray) -> list[dict]:
    """Blocks of ink in reading order: box, share of ink, state and confidence."""
    g = grey(image)
    h = len(g)
    out = []
    for k, (x0, x1) in enumerate(columns(image)):
        pad = max(2, (x1 - x0) // 50)
        part = g[:, x0 + pad : x1 - pad] < INK
        s = smooth(part.sum(axis=1).astype(float), int(h * 0.005))
        if s.max() <= 0:
            continue
        lines = runs(s > 0.02 * s.max())
        gap = max(8, int(h * 0.025))
        joined: list[list[int]] = []
        for a, b in lines:
            if joined and a - joined[-1][1] < gap:
                joined[-1][1] = int(b)
            else:
                joined.append([int(a), int(b)])
        for a, b in joined:
            if b - a < max(6, h * 0.01):
                continue
            ink = float(part[a:b].mean())
            blank = ink < 0.004
            out.append({
                "x": int(x0 + pad), "y": a, "w": int(x1 - x0 - 2 * pad), "h": b - a, "column": k, "reading_order": len(out), "ink": round(ink, 5),
                "state": "blank" if blank else "answered", "confidence": 0.7 if blank else round(min(0.95, 0.55 + 8 * ink), 3), "is_sub": bool(out) and b - a < 0.08 * h,
            })
    return out


def lines(mask: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Horizontal dark lines (row, from, to) at least so long, thick ones once."""
    out: list[tuple[int, int, int]] = []
    for y in np.flatnonzero(mask.sum(axis=1) >= least):
        for a, b in runs(mask[y]):
            if b - a >= least and not any(y - py <= 4 and a < pb and b > pa for py, pa, pb in out[-6:]):
                out.append((int(y), int(a), int(b)))
    return out


def tables(image: np.ndarray) -> list[dict]:
    """Where at least three horizontal and three vertical lines cross: box, line counts, confidence, kind."""
    mask = grey(image) < 128
    h, w = mask.shape
    across, down = lines(mask, max(30, w // 10)), lines(mask.T, max(30, h // 20))
    left = sorted(across)
    out = []
    while left:
        y, a, b = left[0]
        same = [r for r in left if abs(r[1] - a) <= 0.05 * w and abs(r[2] - b) <= 0.05 * w]
        left = [r for r in left if r not in same]
        y0, y1 = same[0][0], same[-1][0]
        cross = [x for x, p, q in down if a - 3 <= x <= b + 3 and p <= y0 + 5 and q >= y1 - 5]
        if len(same) >= 3 and len(cross) >= 3:
            n = len(same) * len(cross)
            out.append({"x": a, "y": y0, "w": b - a, "h": y1 - y0, "rows": len(same), "cols": len(cross), "ys": [r[0] for r in same], "xs": sorted(cross), "confidence": round(min(0.98, 0.5 + n / 60), 3), "kind": "grid" if n >= 20 else "table"})
    return out


def cells(image: np.ndarray, xs: list[int], ys: list[int]) -> list[tuple[int, int, float, float]]:
    """(row, column, ink, core fill) of the boxes of a lattice, measured in the middle of each box."""
    g = grey(image)
    out = []
    for r, (a, b) in enumerate(zip(ys, ys[1:])):
        for c, (p, q) in enumerate(zip(xs, xs[1:])):
            cy, cx, size = (a + b) // 2, (p + q) // 2, min(b - a, q - p)
            box = lambda f, least: g[max(0, cy - max(least, int(size * f))) : cy + max(least, int(size * f)), max(0, cx - max(least, int(size * f))) : cx + max(least, int(size * f))]  # noqa: B023, E731
            probe, core = box(0.33, 3), box(0.14, 2)
            out.append((r, c, float((probe < INK).mean()), float(1 - core.mean() / 255)))
    return out


def glyph(image: np.ndarray) -> dict[str, float]:
    """Features of a suit sign: ink ratio of its hull, holes, share of ink on top, solidity (of the row-wise hull)."""
    ink = grey(image) < 128
    y, x = np.nonzero(ink)
    if not len(y):
        return {"ink_ratio": 0.0, "holes": 0.0, "top": 0.0, "solidity": 0.0}
    t = ink[y.min() : y.max() + 1, x.min() : x.max() + 1]
    filled = t.copy()
    for r in filled:
        at = np.flatnonzero(r)
        if len(at):
            r[at[0] : at[-1] + 1] = True
    outside = np.zeros(np.add(t.shape, 2), bool)
    outside[0] = True
    free = np.pad(~t, 1, constant_values=True)
    while True:  # flood from the border
        grown = outside | free & (np.roll(outside, 1, 0) | np.roll(outside, -1, 0) | np.roll(outside, 1, 1) | np.roll(outside, -1, 1))
        if (grown == outside).all():
            break
        outside = grown
    holes = free & ~outside
    return {"ink_ratio": float(t.sum() / max(1, (t | holes[1:-1, 1:-1]).sum())), "holes": float(holes.any()), "top": float(t[: max(1, len(t) // 2)].sum() / t.sum()), "solidity": float(t.sum() / filled.sum())}
