"""Colour transforms on r, g, b, from 0 to 255 unless said otherwise. Integer columns stay integer, cut off as a cast does."""

from __future__ import annotations

from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratocloud.functions.keyed import normal, uniform
from stratocloud.operators.scenes import SCENE, beside

RGB = ("r", "g", "b")
_ORDERS = list(permutations(range(4)))


def _clip(value: Column, low: float = 0.0, high: float = 255.0) -> Column:
    return F.greatest(F.lit(low), F.least(value, F.lit(high)))


def _set(points: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Replaces columns and keeps their types."""
    return points.withColumns({c: v.cast(points.schema[c].dataType) for c, v in values.items()})


def normalize_color(points: DataFrame) -> DataFrame:
    """To 0..1."""
    return points.withColumns({c: F.col(c) / F.lit(255.0) for c in RGB})


def gray(r: Column, g: Column, b: Column) -> Column:
    return r * F.lit(0.2989) + g * F.lit(0.587) + b * F.lit(0.114)


def auto_contrast(points: DataFrame, blend: float | None = None, p: float = 0.2, seed: int = 42) -> DataFrame:
    """Stretches each channel of a scene to 0..255 and blends; a channel of one value stays."""
    df = beside(points, *(f(c).alias(f"_{n}{c}") for c in RGB for n, f in (("lo", F.min), ("hi", F.max))))
    by = F.lit(blend) if blend is not None else uniform(seed, "contrast/blend", F.col(SCENE))
    on = F.lit(True) if p >= 1 else uniform(seed, "contrast/p", F.col(SCENE)) < p
    out = {}
    for c in RGB:
        wide = F.coalesce(F.try_divide((F.col(c) - F.col(f"_lo{c}")) * F.lit(255.0), F.col(f"_hi{c}") - F.col(f"_lo{c}")), F.col(c))
        out[c] = F.when(on, (F.lit(1.0) - by) * F.col(c) + by * wide).otherwise(F.col(c)).cast("double")
    return df.withColumns(out).select(*points.columns)


def color_translation(points: DataFrame, ratio: float = 0.05, p: float = 0.95, seed: int = 42) -> DataFrame:
    """One offset a channel for each scene."""
    on = uniform(seed, "translate/p", F.col(SCENE)) < p
    move = lambda c: (uniform(seed, f"translate/{c}", F.col(SCENE)) - 0.5) * (255.0 * 2 * ratio)
    return points.withColumns({c: F.when(on, _clip(F.col(c) + move(c))).otherwise(F.col(c).cast("double")) for c in RGB})


def color_jitter_noise(points: DataFrame, std: float = 0.005, p: float = 0.95, seed: int = 42, key: str = "pid") -> DataFrame:
    """Normal noise on every channel of every point."""
    on = uniform(seed, "noise/p", F.col(SCENE)) < p
    noise = lambda c: normal(seed, f"noise/{c}", F.col(SCENE), F.col(key)) * (std * 255)
    return points.withColumns({c: F.when(on, _clip(F.col(c) + noise(c))).otherwise(F.col(c).cast("double")) for c in RGB})


def grayscale(points: DataFrame, p: float = 1.0, seed: int = 42) -> DataFrame:
    on = F.lit(True) if p >= 1 else uniform(seed, "gray/p", F.col(SCENE)) < p
    value = gray(*map(F.col, RGB))
    return _set(points, {c: F.when(on, value).otherwise(F.col(c)) for c in RGB})


def _blend(a: Column, b: Column, ratio: Column) -> Column:
    return _clip(ratio * a + (F.lit(1.0) - ratio) * b)


def _ratio(x: Column | float) -> Column:
    return F.lit(float(x)) if isinstance(x, (int, float)) else x


def brightness(points: DataFrame, ratio: Column | float) -> DataFrame:
    return _set(points, {c: _blend(F.col(c), F.lit(0.0), _ratio(ratio)) for c in RGB})


def contrast(points: DataFrame, ratio: Column | float) -> DataFrame:
    """Blends with the scene's mean gray (of grays cut to the colour's type)."""
    value = gray(*map(F.col, RGB)).cast(points.schema["r"].dataType)
    df = beside(points, F.avg(value).alias("_mean"))
    return _set(df, {c: _blend(F.col(c), F.col("_mean"), _ratio(ratio)) for c in RGB}).select(*points.columns)


def saturation(points: DataFrame, ratio: Column | float) -> DataFrame:
    value = gray(*map(F.col, RGB)).cast(points.schema["r"].dataType)
    return _set(points, {c: _blend(F.col(c), value, _ratio(ratio)) for c in RGB})


def _to_hsv(df: DataFrame, unit: float = 255.0) -> DataFrame:
    """Adds _h and _s in 0..1 and _v in 0..255 / unit."""
    df = df.withColumns({f"_{c}": F.col(c) / F.lit(unit) for c in RGB})
    r, g, b = (F.col(f"_{c}") for c in RGB)
    df = df.withColumns({"_v": F.greatest(r, g, b), "_d": F.greatest(r, g, b) - F.least(r, g, b)})
    v, d = F.col("_v"), F.col("_d")
    sixth = F.when(d == 0, 0.0).when(v == r, (g - b) / d).when(v == g, F.lit(2.0) + (b - r) / d).otherwise(F.lit(4.0) + (r - g) / d)
    hue = sixth / F.lit(6.0)
    return df.withColumns({"_h": hue - F.floor(hue), "_s": F.when(v == 0, 0.0).otherwise(d / v)})


def _from_hsv(h: Column, s: Column, v: Column) -> dict[str, Column]:
    i = F.floor(h * 6.0)
    f = h * 6.0 - i
    p, q, t = v * (F.lit(1.0) - s), v * (F.lit(1.0) - s * f), v * (F.lit(1.0) - s * (F.lit(1.0) - f))
    pick = lambda *x: F.get(F.array(*x), F.pmod(i, F.lit(6)).cast("int"))
    return {"r": pick(v, q, p, p, t, v), "g": pick(t, v, v, q, p, p), "b": pick(p, p, t, v, v, q)}


def hue(points: DataFrame, factor: Column | float) -> DataFrame:
    """Turns the hue by a share of the circle."""
    df = _to_hsv(points)
    turned = F.col("_h") + _ratio(factor)
    df = df.withColumn("_h", turned - F.floor(turned))
    rgb = _from_hsv(F.col("_h"), F.col("_s"), F.col("_v"))
    return _set(df, {c: v * 255.0 for c, v in rgb.items()}).select(*points.columns)


def color_jitter(
    points: DataFrame, bright=(0.6, 1.4), contrast_=(0.6, 1.4), saturate=(0.6, 1.4), hue_=(-0.1, 0.1), p: float = 0.95,
    seed: int = 42,
) -> DataFrame:
    """The four adjustments in an order of each scene's own, each with probability ``p``.

    Only contrast needs more than the point itself: what precedes it in a scene's order is applied first, then one mean for each scene is taken.
    """
    for name, (lo, hi) in (("brightness", bright), ("contrast", contrast_), ("saturation", saturate)):
        if not 0 <= lo <= hi:
            raise ValueError(f"{name} must be an interval of numbers that aren't negative")
    if not -0.5 <= hue_[0] <= hue_[1] <= 0.5:
        raise ValueError("hue must be an interval within -0.5 and 0.5")
    at = F.floor(uniform(seed, "jitter/order", F.col(SCENE)) * len(_ORDERS)).cast("int")
    on = sum((F.when(uniform(seed, f"jitter/p{k}", F.col(SCENE)) < p, 1 << k).otherwise(0) for k in range(4)), F.lit(0))
    by = {f"_by{k}": uniform(seed, f"jitter/{k}", F.col(SCENE), low=lo, high=hi) for k, (lo, hi) in enumerate((bright, contrast_, saturate, hue_))}
    drawn = {"_order": at, "_on": on} | by
    kind = points.schema["r"].dataType
    kinds = [points.schema[c].dataType for c in RGB]
    given = [*(F.col(c).cast("double") for c in RGB), *drawn]
    # a table of points may look small as a compressed file; broadcast, it would leave the rest to one task
    before = points.hint("merge").join(points.select(SCENE).distinct().withColumns(drawn), SCENE)
    level = F.arrow_udf(lambda *columns: _jittered(kinds, *columns), "double")(*given)
    means = before.groupBy(SCENE).agg(F.avg(level.cast(kind)).alias("_mean")).withColumns(drawn)
    done = F.arrow_udf(lambda *columns: _jittered(kinds, *columns), "r double, g double, b double")(*given, F.col("_mean").cast("double"))
    df = points.hint("merge").join(means, SCENE).withColumn("_rgb", done)
    return _set(df, {c: F.col(f"_rgb.{c}") for c in RGB}).select(*points.columns)


# The steps of the jitter on arrays: as expressions, seven passes with every step in each are too long to be compiled.


def _jittered(kinds: list[T.DataType], *columns: pa.Array) -> pa.Array:
    """Colours after all four steps or, without the scenes' means, the grays that contrast will find. Columns: r, g, b, order, steps that are on, four ratios, mean."""
    (r, g, b), order, on, by, mean = columns[:3], columns[3].to_numpy(), columns[4].to_numpy(), [c.to_numpy() for c in columns[5:9]], columns[9:]
    none = np.stack([c.is_null().to_numpy(zero_copy_only=False) for c in (r, g, b)])
    rgb = np.stack([c.to_numpy(zero_copy_only=False) for c in (r, g, b)])
    typed = [_typed(kind) for kind in kinds]
    steps, reached = np.array(_ORDERS)[order], np.zeros(len(order), bool)
    for place in range(4):
        if not mean:
            reached |= steps[:, place] == 1
        for k in range(4):
            rows = np.flatnonzero((steps[:, place] == k) & (on >> k & 1 == 1) & ~reached)
            if not len(rows):
                continue
            old, ratio, was = rgb[:, rows], by[k][rows], none[:, rows]
            if k == 3:
                new = _turned(old, was, ratio)
                none[:, rows] = was.any(axis=0) & np.isnan(new)
            else:
                goal = 0.0 if k == 0 else mean[0].to_numpy(zero_copy_only=False)[rows] if k == 1 else typed[0](_gray(old))
                new = ratio * old + (1.0 - ratio) * goal
                new = np.where(np.isnan(new), 255.0, np.clip(new, 0.0, 255.0))  # as ``_clip`` does, of nulls too
                none[:, rows] = False
            rgb[:, rows] = np.stack([cut(c) for cut, c in zip(typed, new)])
    if not mean:
        return pa.array(_gray(rgb), mask=none.any(axis=0))
    return pa.StructArray.from_arrays([pa.array(c, mask=m) for c, m in zip(rgb, none)], list(RGB))


def _gray(rgb: np.ndarray) -> np.ndarray:
    return rgb[0] * 0.2989 + rgb[1] * 0.587 + rgb[2] * 0.114


def _turned(rgb: np.ndarray, none: np.ndarray, by: np.ndarray) -> np.ndarray:
    """``hue`` of arrays; NaN where a null comes in, but for colours without a hue."""
    unit = rgb / 255.0
    r, g, b = unit
    v = np.fmax.reduce(unit)
    d = v - np.fmin.reduce(unit)
    with np.errstate(divide="ignore", invalid="ignore"):
        sixth = np.select([d == 0, v == r, v == g], [0.0, (g - b) / d, 2.0 + (b - r) / d], 4.0 + (r - g) / d)
        s = np.where(v == 0, 0.0, d / v)
    h = sixth / 6.0
    h = h - np.floor(h) + by
    h = h - np.floor(h)
    i = np.floor(h * 6.0)
    f = h * 6.0 - i
    p, q, t = v * (1.0 - s), v * (1.0 - s * f), v * (1.0 - s * (1.0 - f))
    at = np.where(np.isnan(i), 0, i).astype(int) % 6
    out = np.stack([np.choose(at, x) for x in ((v, q, p, p, t, v), (t, v, v, q, p, p), (p, p, t, v, v, q))]) * 255.0
    out[:, np.isnan(h) | (np.isnan(rgb) & ~none).any(axis=0)] = np.nan
    return out


def _typed(kind: T.DataType) -> Callable[[np.ndarray], np.ndarray]:
    """What a cast to a column's type leaves of numbers."""
    if isinstance(kind, T.IntegralType):
        return np.trunc
    if isinstance(kind, T.FloatType):
        return lambda values: values.astype(np.float32).astype(float)
    if isinstance(kind, T.DecimalType):
        unit = Decimal(1).scaleb(-kind.scale)
        return np.vectorize(lambda v: float(Decimal(repr(float(v))).quantize(unit, ROUND_HALF_UP)), otypes=[float])
    return lambda values: values


def hue_saturation_translation(
    points: DataFrame, hue_max: float = 0.5, saturation_max: float = 0.2, seed: int = 42,
    shift: tuple[float, float] | None = None,
) -> DataFrame:
    """Moves hue and saturation by one amount for each scene (or the given ``shift``); colours are cut to integers."""
    draw = lambda n, m: uniform(seed, f"hst/{n}", F.col(SCENE), low=-m, high=m)
    dh, ds = map(F.lit, shift) if shift else (draw("h", hue_max), F.lit(1.0) + draw("s", saturation_max))
    df = _to_hsv(points, 1.0)
    turned = F.pmod(dh + F.col("_h") + F.lit(1.0), F.lit(1.0))
    df = df.withColumns({"_h": turned, "_s": _clip(ds * F.col("_s"), 0.0, 1.0)})
    return df.withColumns({c: _clip(v).cast("int") for c, v in _from_hsv(F.col("_h"), F.col("_s"), F.col("_v")).items()}).select(*points.columns)


def color_drop(points: DataFrame, p: float = 0.2, factor: float = 0.0, seed: int = 42) -> DataFrame:
    """Multiplies all colours of a share ``p`` of the scenes."""
    on = uniform(seed, "drop/p", F.col(SCENE)) < p
    return _set(points, {c: F.when(on, F.col(c) * F.lit(factor)).otherwise(F.col(c)) for c in RGB})


