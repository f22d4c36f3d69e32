"""Chains of operators: loading, slice ETL, segmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import high_nibble, keep_void, normalised_iso, scale_to_byte, zero_below
from tessera.operators import neighbours, pool, stats, stencil, superpixels
from tessera.sources.shared import Scratch

Triple = tuple[int, int, int]


def preprocess(vol: DataFrame, shape: Triple, factor: int = 1, sigma: float = 2.0, bins: int = 64) -> tuple[DataFrame, Triple]:
    """Downscale, smooth, equalise in 3-D tiles, rescale to 0..255. Returns the volume and its shape."""
    if factor > 1:
        vol, shape = pool.downscale(vol, shape, factor), pool.out_shape(shape, (factor,) * 3)
    smooth = stats.rescale(stencil.gaussian(vol, shape, sigma))
    tiles = tuple(min(8, n) for n in shape)
    even = stencil.clahe(smooth, shape, tiles, bins, clip=0.01 * bins)
    return stats.rescale(even).select("z", "y", "x", (F.col("v") * 255).cast("float").alias("v")), shape


def clean_slices(vol: DataFrame, shape: Triple, lam: float | None = None) -> DataFrame:
    """Slice ETL: smooth by total variation and a Gaussian, sharpen, even out the contrast, equalise each slice in tiles
    by 16 bins, scale to a byte, keep void voxels void and the four highest bits."""
    scratch = Scratch(vol.sparkSession, "clean")
    smooth = scratch.write(stencil.gaussian(stencil.tv_denoise(stats.rescale(vol), shape), shape, 2.0), "smooth")
    sharp = scratch.write(stencil.unsharp(smooth, shape, 4.0, 2.0), "sharp")
    contrast = scratch.write(stencil.local_global_contrast(sharp, shape, lam), "contrast")
    even = stats.rescale(scratch.write(stencil.clahe_slices(contrast, shape, min(8, shape[1], shape[2]), 16, clip=0.16), "even"))
    both = even.join(vol.select("z", "y", "x", F.col("v").alias("raw")), ["z", "y", "x"])
    return both.select("z", "y", "x", high_nibble(keep_void(F.col("raw"), scale_to_byte(F.col("v"))).cast("int")).alias("v"))


def segment(vol: DataFrame, shape: Triple, iso: float, block: int, step: int = 4, compactness: float = 10.0, bins: int = 16) -> DataFrame:
    """Mask below iso, cluster by block, grow segments from the brightest superpixels, rank them, paint: (z, y, x, segment, grey)."""
    masked = vol.select("z", "y", "x", zero_below(F.col("v"), iso).alias("v"))
    labelled = Scratch(vol.sparkSession, "segment").write(superpixels.snic(stats.rescale(masked), shape, block, step, compactness), "labels")
    about = superpixels.label_stats(labelled)
    edges = neighbours.label_adjacency(labelled)
    mapping = superpixels.grow(about, edges, normalised_iso(iso), bins)
    ranks = superpixels.rank_segments(about, mapping)
    ranked = mapping.join(F.broadcast(ranks.select("segment", "rank")), "segment", "left").select("label", F.coalesce(F.col("rank") + 1, F.lit(0)).alias("segment"))
    return superpixels.paint(labelled, ranked, ranks.count() + 1)  # with the void
