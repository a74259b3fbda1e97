"""Boxes, crop windows, canvases, frame rates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewise.functions.fixed_values import CANVASES, FRAME_RATES
from cuewise.functions.text import col


def _box(b):
    b = col(b)
    return b["x"], b["y"], b["w"], b["h"]


def area(b) -> Column:
    _, _, w, h = _box(b)
    return F.greatest(w * h, F.lit(0.0))


def iou(a, b) -> Column:
    """Intersection over union of two boxes (structs with x, y, w, h)."""
    ax, ay, aw, ah = _box(a)
    bx, by, bw, bh = _box(b)
    ix = F.greatest(F.least(ax + aw, bx + bw) - F.greatest(ax, bx), F.lit(0.0))
    iy = F.greatest(F.least(ay + ah, by + bh) - F.greatest(ay, by), F.lit(0.0))
    inter = ix * iy
    return inter / F.greatest(area(a) + area(b) - inter, F.lit(1e-9))


def clamp(x, lo, hi) -> Column:
    return F.least(F.greatest(x, lo), hi)


@dataclass(frozen=True)
class Frame:
    """Source size and the largest canvas-shaped window in it."""

    src_w: float
    src_h: float
    canvas_w: int
    canvas_h: int

    @property
    def base(self) -> tuple[float, float, float, float]:
        aspect = self.canvas_w / self.canvas_h
        if self.src_w / self.src_h > aspect:
            w, h = self.src_h * aspect, self.src_h
        else:
            w, h = self.src_w, self.src_w / aspect
        return self.src_w / 2 - w / 2, self.src_h / 2 - h / 2, w, h

    @property
    def min_h(self) -> float:
        """Fewest source rows a crop may shrink to (bounded upscaling)."""
        return self.canvas_h * (540.0 / 1920.0)


def frame_for(aspect: str, src_w: float, src_h: float) -> Frame:
    for name, w, h in CANVASES:
        if name == aspect.strip().replace("x", ":"):
            return Frame(src_w, src_h, w, h)
    raise ValueError(f"unknown aspect {aspect!r}")


def _placed(cx, cy, w, h, f: Frame) -> tuple[Column, Column]:
    x = clamp(cx - w / 2, F.lit(0.0), F.greatest(f.src_w - w, F.lit(0.0)))
    y = clamp(cy - h * 0.4, F.lit(0.0), F.greatest(f.src_h - h, F.lit(0.0)))
    return x, y


def _window(x, y, w, h) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def face_window(face, f: Frame) -> Column:
    """Crop for one face: gentle zoom by size, capped by confidence, face at 40 % height."""
    fx, fy, fw, fh = _box(face)
    _, _, bw, bh = f.base
    u = clamp((col(face)["score"] - 0.5) / 0.3, F.lit(0.0), F.lit(1.0))
    zmax = F.least(1.15 + 0.15 * u * u * (3.0 - 2.0 * u), F.lit(max(bh / f.min_h, 1.0)))
    z = clamp(0.38 / F.greatest(fh / f.src_h, F.lit(0.05)), F.lit(1.0), zmax)
    w, h = bw / z, bh / z
    x, y = _placed(fx + fw / 2, fy + fh / 2, w, h, f)
    return _window(x, y, w, h)


def zoom_window(win, ax, ay, zoom: float, f: Frame) -> Column:
    """Zoom a window about an anchor, between the base window and the minimum rows."""
    if zoom == 1.0:
        return col(win)
    _, _, bw, bh = f.base
    z0 = bw / col(win)["w"]
    cap = F.greatest(F.lit(max(bh / f.min_h, 1.0)), z0)
    z = F.greatest(F.least(z0 * zoom, cap), F.lit(1.0))
    x, y = _placed(ax, ay, bw / z, bh / z, f)
    return F.when((col(win)["w"] <= 0) | (z == z0), col(win)).otherwise(_window(x, y, bw / z, bh / z))


def reacquire_frac(unseen_s) -> Column:
    return F.least(0.08 + 0.25 * F.greatest(col(unseen_s), F.lit(0.0)), F.lit(0.2))


def clamped_rect(cx, cy, w, h, f: Frame) -> Column:
    """A rectangle by centre, its size then its position clamped into the source."""
    w2, h2 = clamp(w, F.lit(2.0), F.lit(float(f.src_w))), clamp(h, F.lit(2.0), F.lit(float(f.src_h)))
    x = clamp(cx - w2 / 2, F.lit(0.0), F.greatest(f.src_w - w2, F.lit(0.0)))
    y = clamp(cy - h2 / 2, F.lit(0.0), F.greatest(f.src_h - h2, F.lit(0.0)))
    return _window(x, y, w2, h2)


def panel_rect(face, sep, share: float, f: Frame) -> Column:
    """Head-and-shoulders crop of a typical face (x, y are its centre) for a panel that takes
    ``share`` of the canvas height, kept off a neighbour ``sep`` away."""
    fx, fy, _, fh = _box(face)
    aspect = f.canvas_w / (f.canvas_h * share)
    min_h = f.min_h * share
    h0 = F.least(F.greatest(fh * 3.2, F.lit(min_h)), F.lit(float(f.src_h)))
    floor = F.greatest(fh * 1.6, F.lit(min_h))
    tight = F.least(F.greatest(sep * 0.95 / aspect, floor), h0)
    h = F.when(h0 * aspect > sep * 0.95, tight).otherwise(h0)
    w = F.least(h * aspect, F.lit(float(f.src_w)))
    h = w / aspect
    return clamped_rect(fx, fy + 0.12 * h, w, h, f)


def nearest_rate(df: DataFrame, num: str, den: str) -> DataFrame:
    """Add ``fps_n``/``fps_d``: the nearest broadcast rate within 3 %; over 61 is 60; else 30."""
    f = F.col(num) / F.col(den)
    known = (F.col(num) > 0) & (F.col(den) > 0) & f.between(9.0, 1000.0)
    rates = F.array(*[F.struct((F.abs(F.lit(n / d) - f) / f).alias("err"), F.lit(i).alias("i"),
                               F.lit(n).alias("n"), F.lit(d).alias("d")) for i, (n, d) in enumerate(FRAME_RATES)])
    best = F.array_min(rates)
    thirty = F.struct(F.lit(30).alias("n"), F.lit(1).alias("d"))
    pick = (
        F.when(~F.coalesce(known, F.lit(False)), thirty)
        .when(f > 61.0, F.struct(F.lit(60).alias("n"), F.lit(1).alias("d")))
        .when(best["err"] < 0.03, F.struct(best["n"].alias("n"), best["d"].alias("d")))
        .otherwise(thirty)
    )
    return df.withColumn("__r", pick).select(
        *df.columns, F.col("__r.n").alias("fps_n"), F.col("__r.d").alias("fps_d"))
