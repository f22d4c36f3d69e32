"""Global statistics and contrast: rescaling, histograms, level maps, and their search for a blend of histograms."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.scalars import preserve_hue, stretch_bin

LEVELS = 256


def with_range(vol: DataFrame) -> DataFrame:
    """The volume with its least and greatest value (one row is broadcast)."""
    return vol.join(F.broadcast(vol.agg(F.min("v").cast("double").alias("low"), F.max("v").cast("double").alias("high"))))


def rescale(vol: DataFrame, known: tuple[float, float] | None = None) -> DataFrame:
    """(v - least) / (greatest - least); a constant volume becomes 0. known: the least and greatest value, if they are
    known, such as those of a store; then the volume is read once."""
    v = F.when(F.col("high") == F.col("low"), F.lit(0.0)).otherwise(F.try_divide(F.col("v") - F.col("low"), F.col("high") - F.col("low")))
    ranged = with_range(vol) if known is None else vol.withColumns({"low": F.lit(known[0]), "high": F.lit(known[1])})
    return ranged.select("z", "y", "x", v.alias("v"))


def histogram(bins: DataFrame) -> DataFrame:
    """(bin, n, p) of a column bin: 256 rows, also for empty bins."""
    counts = bins.groupBy(F.col("bin").cast("int").alias("bin")).agg(F.count("*").alias("n"))
    all_ = bins.sparkSession.range(LEVELS).select(F.col("id").cast("int").alias("bin"))
    full = all_.join(F.broadcast(counts), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))  # 256 rows
    return full.join(F.broadcast(full.agg(F.sum("n").alias("total")))).select("bin", "n", F.coalesce(F.try_divide("n", "total"), F.lit(0.0)).alias("p"))


def level_map(hist: DataFrame, lam: float) -> DataFrame:
    """(bin, p, t): the histogram mixed with the uniform one, and the level that its running sum gives (at most 255)."""
    mixed = F.col("p") / (1 + lam) + F.lit(lam / (1 + lam) / LEVELS)
    running = F.sum("h").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))  # 256 rows
    return hist.select("bin", mixed.alias("h")).select("bin", F.col("h").alias("p"), F.least(F.ceil(255 * running + 0.5 - 1e-9).cast("int"), F.lit(255)).alias("t"))


def contrast_gap(levels: DataFrame) -> DataFrame:
    """One row: the widest gap between bins that share a level. levels: (bin, t)."""
    gaps = levels.groupBy("t").agg((F.max("bin") - F.min("bin")).alias("gap"))
    return gaps.agg(F.max("gap").cast("int").alias("gap"))


def gap_of(p: np.ndarray, lam: float) -> int:
    """The same gap, from 256 numbers, among occupied bins."""
    t = np.minimum(np.ceil(255 * np.cumsum(p / (1 + lam) + lam / (1 + lam) / LEVELS) + 0.5 - 1e-9), 255)
    used = np.flatnonzero(p > 0)
    return max((int(np.ptp(used[t[used] == x])) for x in np.unique(t[used])), default=0)


#: The golden ratio, and how far beyond the last point a parabola may lead a bracket.
GOLDEN, FARTHEST = (1 + 5**0.5) / 2, 110.0


def bracket(f: Callable[[float], float], a: float = 0.0, b: float = 1.0) -> tuple[float, float, float]:
    """Three places in a row of which the middle one is no higher than the others: downhill from a and b, by golden steps or
    to where a parabola through the last three has its low."""
    fa, fb = f(a), f(b)
    if fa < fb:
        a, b, fa, fb = b, a, fb, fa
    c = b + GOLDEN * (b - a)
    fc = f(c)
    while fc < fb:
        r, q = (b - a) * (fb - fc), (b - c) * (fb - fa)
        below = 2 * (q - r if abs(q - r) > 1e-21 else 1e-21)
        u, most = b - ((b - c) * q - (b - a) * r) / below, b + FARTHEST * (c - b)
        if (u - c) * (b - u) > 0:  # between the last two
            fu = f(u)
            if fu < fc:
                return b, u, c
            if fu > fb:
                return a, b, u
            u = c + GOLDEN * (c - b)
            fu = f(u)
        elif (u - most) * (most - c) >= 0:
            u, fu = most, f(most)
        elif (u - most) * (c - u) > 0:  # beyond, and not too far
            fu = f(u)
            if fu < fc:
                b, c, u = c, u, u + GOLDEN * (u - c)
                fb, fc, fu = fc, fu, f(u)
        else:
            u = c + GOLDEN * (c - b)
            fu = f(u)
        a, b, c, fa, fb, fc = b, c, u, fb, fc, fu
    return a, b, c


def lowest(f: Callable[[float], float], tolerance: float = 1.48e-8, most: int = 500) -> float:
    """A low of f by Brent's method: within a bracket, to the low of a parabola through the three best places, and by a
    golden section where that leads nowhere."""
    a, x, c = bracket(f)
    low, high = min(a, c), max(a, c)
    best = second = third = x
    f_best = f_second = f_third = f(x)
    step = before = 0.0
    for _ in range(most):
        near = tolerance * abs(best) + 1e-11
        middle = (low + high) / 2
        if abs(best - middle) < 2 * near - (high - low) / 2:
            break
        golden = True
        if abs(before) > near:
            r, q = (best - second) * (f_best - f_third), (best - third) * (f_best - f_second)
            p, q = (best - third) * q - (best - second) * r, 2 * (q - r)
            p, q = (-p, q) if q > 0 else (p, -q)
            if low < best + (p / q if q else np.inf) < high and abs(p) < abs(q * before / 2):
                before, step, golden = step, p / q, False
                if best + step - low < 2 * near or high - best - step < 2 * near:
                    step = near if best <= middle else -near
        if golden:
            before = (low if best >= middle else high) - best
            step = (2 - GOLDEN) * before
        u = best + (step if abs(step) >= near else near if step >= 0 else -near)
        fu = f(u)
        if fu > f_best:
            low, high = (u, high) if u < best else (low, u)
            if fu <= f_second or second == best:
                second, third, f_second, f_third = u, second, fu, f_second
            elif fu <= f_third or third in (best, second):
                third, f_third = u, fu
        else:
            low, high = (best, high) if u >= best else (low, best)
            best, second, third, f_best, f_second, f_third = u, best, second, fu, f_best, f_second
    return best


def best_blend(hist: DataFrame) -> float:
    """The lambda at which Brent's method, from 0 and 1, ends on the gap; only 256 numbers leave the cluster. Lambdas of -1
    and less, which mix nothing, count as no good."""
    p = np.array([r.p for r in hist.orderBy("bin").collect()])
    return lowest(lambda lam: gap_of(p, lam) if lam > -1 else np.inf)


def equalise(vol: DataFrame, lam: float | None) -> DataFrame:
    """(z, y, x, v, i, g, y_g): each voxel's level before (i) and after (g), and its value with the hue preserved.
    lam: None for that of ``best_blend``."""
    bins = with_range(vol).withColumn("i", stretch_bin(F.col("v"), F.col("low"), F.col("high")))
    stretched = 255 * (F.col("v") - F.col("low")) / (F.col("high") - F.col("low") + F.lit(1e-8))
    counted = histogram(bins.select(F.col("i").alias("bin")))
    levels = level_map(counted, best_blend(counted) if lam is None else lam)
    out = bins.withColumn("s", stretched).join(F.broadcast(levels.select(F.col("bin").alias("i"), F.col("t").alias("g"))), "i")  # 256 rows
    return out.select("z", "y", "x", "v", "i", "g", preserve_hue(F.col("g"), F.col("i"), F.col("s")).alias("y_g"), F.col("s").alias("stretched"))
