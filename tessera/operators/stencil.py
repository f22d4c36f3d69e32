"""Weighted neighbourhoods: smoothing, sharpening, Laplacian, tiled equalisation and total-variation smoothing.

Smoothing, sharpening and the Laplacian are kernels over dense blocks that exchange halos (``blocks``); borders repeat or
mirror the volume. Total variation works in overlapping tiles that exchange their dual variables.
"""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.scalars import blend, clamp, preserve_hue, scrub, well_exposed
from tessera.operators import blocks
from tessera.operators.blocks import Blocks, BlockScratch
from tessera.operators.stats import LEVELS, equalise, rescale
from tessera.sources.shared import Scratch

Triple = tuple[int, int, int]


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    radius = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [x / sum(w) for x in w]


def gaussian(vol: DataFrame, shape: Triple, sigma: float, edge: int = blocks.EDGE) -> DataFrame:
    """Gaussian smoothing; places beyond the border stand for the border voxel. Voxels that are not there count as 0."""
    return blocks.smooth(Blocks.of(vol, shape, edge), gaussian_weights(sigma)).voxels()


def unsharp(vol: DataFrame, shape: Triple, radius: float = 4.0, amount: float = 2.0, low: float = 0.0, high: float = 1.0, edge: int = blocks.EDGE) -> DataFrame:
    """v + amount (v - smoothed v), within low..high."""
    return blocks.sharpen(Blocks.of(vol, shape, edge), gaussian_weights(radius), amount, low, high).voxels()


def laplacian(vol: DataFrame, shape: Triple, edge: int = blocks.EDGE) -> DataFrame:
    """Per z-slice: 2 on the diagonals, -8 in the centre; borders mirror the volume without the border voxel."""
    return blocks.laplacian(Blocks.of(vol, shape, edge)).voxels()


def fusion_weights(vol: DataFrame, shape: Triple) -> DataFrame:
    """(z, y, x, w): the lesser of local detail (absolute Laplacian over its greatest) and good exposure."""
    detail = laplacian(vol, shape).select("z", "y", "x", F.least(F.abs("v"), F.lit(255.0)).alias("d"))
    top = F.broadcast(detail.agg(F.max("d").alias("top")))  # one row
    exposed = rescale(vol).select("z", "y", "x", well_exposed(F.col("v")).alias("b"))
    share = F.col("d") / (F.col("top") + F.lit(1e-8)) + F.lit(1e-5)
    return detail.join(top).select("z", "y", "x", share.alias("c")).join(exposed, ["z", "y", "x"]).select("z", "y", "x", F.least("c", "b").alias("w"))


def clahe(vol: DataFrame, shape: Triple, tiles: Triple, bins: int = LEVELS, clip: float = 2.0) -> DataFrame:
    """Contrast-limited adaptive equalisation to 0..1 of values in 0..1.

    Histograms are counted by tile; counts above clip times the mean are spread over all bins; a voxel blends the level
    maps of the nearest tiles (2 an axis; an axis with one tile isn't blended). Three tables of tiles x bins rows at most.
    """
    size = [-(-n // t) for n, t in zip(shape, tiles, strict=True)]
    bin_ = F.least(F.floor(F.col("v") * bins), F.lit(bins - 1)).cast("int")
    rows = vol.select("z", "y", "x", "v", bin_.alias("bin"))
    tile = [F.expr(f"{a} div {s}").cast("int").alias(f"t{a}") for a, s in zip("zyx", size, strict=True)]
    names = ["tz", "ty", "tx"]
    counts = rows.groupBy(*tile, "bin").agg(F.count("*").alias("n"))
    totals = counts.groupBy(*names).agg(F.sum("n").alias("total"), F.max("bin").alias("top"))
    all_bins = totals.select(*names, "total", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    full = all_bins.join(counts, [*names, "bin"], "left").select(*names, "bin", "total", F.coalesce("n", F.lit(0)).alias("n"))
    limit = F.greatest(F.lit(1.0), F.lit(clip) * F.col("total") / bins)
    own = Window.partitionBy(*names)
    clipped = full.withColumn("c", F.least(F.col("n").cast("double"), limit)).withColumn("over", F.sum(F.col("n") - F.col("c")).over(own))
    h = F.col("c") + F.col("over") / bins
    maps = clipped.withColumn("cdf", F.sum(h).over(own.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) / F.col("total")).select(*names, "bin", "cdf")
    for a, s, t in zip("zyx", size, tiles, strict=True):
        at = (F.col(a) + 0.5) / s - 0.5
        low = F.floor(at)
        near = F.array(F.struct(low.alias("t"), (1 - (at - low)).alias("w")), F.struct((low + 1).alias("t"), (at - low).alias("w")))
        near = near if t > 1 else F.array(F.struct(F.lit(0).cast("long").alias("t"), F.lit(1.0).cast("double").alias("w")))
        last = -(-shape["zyx".index(a)] // s) - 1
        rows = rows.withColumn(f"_{a}", F.explode(near)).withColumn(f"t{a}", F.least(F.greatest(F.col(f"_{a}.t"), F.lit(0)), F.lit(last)).cast("int"))
    weight = F.col("_z.w") * F.col("_y.w") * F.col("_x.w")
    return rows.join(maps, [*names, "bin"]).groupBy("z", "y", "x").agg(F.sum(weight * F.col("cdf")).alias("v"))


def clahe_slices(vol: DataFrame, shape: Triple, tiles: int = 8, bins: int = LEVELS, clip: float = 2.0) -> DataFrame:
    """Each z-slice by itself."""
    return clahe(vol, shape, (shape[0], tiles, tiles), bins, clip) if shape[0] > 1 else clahe(vol, shape, (1, tiles, tiles), bins, clip)


def denoise_slice(v: np.ndarray, weight: float = 0.1, eps: float = 2e-4, most: int = 200) -> np.ndarray:
    """Total-variation smoothing of a slice by Chambolle's dual projection."""
    p = np.zeros((2, *v.shape))
    out, before, first = v, None, None
    for i in range(most):
        p, out, d, norm = _tv_step(v, p, weight)
        energy = ((d**2).sum() + weight * norm.sum()) / v.size
        if i == 0:
            first = energy
        elif abs(before - energy) < eps * first:
            break
        before = energy
    return out


def _tv_step(v: np.ndarray, p: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(dual variables after a step, smoothed values before it, their difference from v, the norm of their gradient)."""
    d = -(p[0] + p[1])
    d[1:] += p[0, :-1]
    d[:, 1:] += p[1, :, :-1]
    out = v + d
    g = np.zeros_like(p)
    g[0, :-1], g[1, :, :-1] = np.diff(out, axis=0), np.diff(out, axis=1)
    norm = np.sqrt((g**2).sum(0))
    return (p - 0.25 * g) / (1 + norm * 0.25 / weight), out, d, norm


def tv_denoise(vol: DataFrame, shape: Triple, weight: float = 0.1, eps: float = 2e-4, most: int = 200, tile: int = 512, inner: int = 16) -> DataFrame:
    """Total-variation smoothing slice by slice, in overlapping tiles: a task holds a few tiles at a time, whatever the slice.

    Each tile takes ``inner`` steps of the dual variables on itself and a border of its neighbours that is as wide, so that
    its own values are those of the whole slice; then borders are exchanged anew. The energies of a round's steps are added
    up per slice, and a slice ends at the step where it would end as a whole: at the first whose energy differs by less than
    ``eps`` of the first energy, or after ``most`` steps. Results are those of ``denoise_slice`` but for the order in which
    energies are added. The driver holds a few numbers a slice.
    """
    n_slices, h, w = shape
    edge = (1, min(tile, h), min(tile, w))
    rows = vol.select("z", "y", "x", F.col("v").cast("double").alias("v"))
    if edge[1:] == (h, w):  # no borders
        return Blocks.of(rows, shape, edge).map(lambda a, before, start: denoise_slice(a[0, 0], weight, eps, most)[None, None]).voxels()
    scratch = BlockScratch(vol.sparkSession, "tv")
    zero = F.lit(0.0)
    state = Blocks.of(rows.select("z", "y", "x", "v", zero.alias("p0"), zero.alias("p1")), shape, edge, ("v", "p0", "p1")).kept(scratch, "state-0")
    reach = (0, inner + 1, inner + 1)

    def core(a: np.ndarray, before: Triple, start: Triple) -> tuple[slice, slice]:
        return tuple(slice(before[i], before[i] + min(edge[i], shape[i] - start[i])) for i in (1, 2))

    def steps(a: np.ndarray, before: Triple, start: Triple) -> tuple[np.ndarray, np.ndarray]:
        v, p, at, energies = a[0, 0], a[1:, 0], core(a, before, start), []
        for _ in range(inner):
            p, _, d, norm = _tv_step(v, p, weight)
            energies.append((d[at] ** 2).sum() + weight * norm[at].sum())
        return np.stack([v[at], *p[(slice(None), *at)]])[:, None], np.array(energies)

    def finish(ends: dict[int, int]):
        def run(a: np.ndarray, before: Triple, start: Triple) -> np.ndarray:
            v, p = a[0, 0], a[1:, 0]
            for _ in range(ends[start[0]]):
                p = _tv_step(v, p, weight)[0]
            return _tv_step(v, p, weight)[1][core(a, before, start)][None, None]

        return run

    first: dict[int, float] = {}
    last: dict[int, float] = {}
    open_slices, done, turn = None, [], 0
    while open_slices is None or open_slices:
        out = state.map(steps, reach, extra=inner).kept(scratch, f"state-{turn + 1}")
        sums = out.df.groupBy("bz").agg(F.array(*[F.sum(F.get("extra", F.lit(j))) for j in range(inner)]).alias("e"))
        ends: dict[int, int] = {}
        for z, energies in ((r.bz, r.e) for r in sums.collect()):
            first.setdefault(z, energies[0])
            for j, e in enumerate(energies):
                i = turn * inner + j
                if (z in last and abs(last[z] - e) < eps * first[z] * (i > 0)) or i == most - 1:
                    ends[z] = j
                    break
                last[z] = e
            last[z] = energies[-1]
        if ends:
            ended = state.where(F.col("bz").isin(list(ends))).map(finish(ends), reach, channels=1)
            done.append(scratch.write(ended.df, f"done-{turn}"))
        open_slices = {z for z in last if z not in ends} if open_slices is None else open_slices - set(ends)
        state = out.where(~F.col("bz").isin(list(ends))) if ends else out
        scratch.drop(f"state-{turn}")
        turn += 1
    scratch.keep(*[f"done-{i}" for i in range(turn)])
    return Blocks(functools.reduce(DataFrame.unionByName, done), shape, edge, stored=True).voxels() if done else rows


def local_global_contrast(vol: DataFrame, shape: Triple, lam: float | None = None) -> DataFrame:
    """Blend of global equalisation and per-slice tiled equalisation, each with the hue preserved, weighted by the detail
    and exposure of their levels, scrubbed and rescaled to 0..1. lam: the share of the uniform histogram; None: searched."""
    scratch = Scratch(vol.sparkSession, "contrast")  # each step below reads its input several times
    glob = scratch.write(equalise(vol, lam), "global")
    tiles = min(8, shape[1], shape[2])
    local = clahe_slices(glob.select("z", "y", "x", (F.col("i") / 255.0).alias("v")), shape, tiles).select("z", "y", "x", F.round(F.col("v") * 255).alias("l"))
    both = scratch.write(glob.join(local, ["z", "y", "x"]).select("z", "y", "x", "g", "l", "y_g", preserve_hue(F.col("l"), F.col("i"), F.col("stretched")).alias("y_l")), "both")
    wg = fusion_weights(both.select("z", "y", "x", F.col("g").alias("v")), shape).withColumnRenamed("w", "wg")
    wl = fusion_weights(both.select("z", "y", "x", F.col("l").alias("v")), shape).withColumnRenamed("w", "wl")
    out = both.join(wg, ["z", "y", "x"]).join(wl, ["z", "y", "x"])
    blended = out.select("z", "y", "x", scrub(blend(F.col("y_g"), F.col("wg"), F.col("y_l"), F.col("wl"))).alias("v"))
    return rescale(scratch.write(blended, "blended"))


