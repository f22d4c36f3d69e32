"""Neighbourhood joins over voxels and labels: equi-joins on shifted coordinates, never a distance predicate; connected
components by block, then across blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import blocks
from tessera.operators.blocks import Blocks, BlockScratch
from tessera.operators.components import components

FACES = [(0, 0, 1), (0, 0, -1), (0, 1, 0), (0, -1, 0), (1, 0, 0), (-1, 0, 0)]
#: One of each opposite pair of the 26 neighbours.
HALF_26 = [(a, b, c) for a in (0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) > (0, 0, 0)]


def shifted(df: DataFrame, offsets: list[tuple[int, int, int]]) -> DataFrame:
    """Each row once for every offset, with (nz, ny, nx) the shifted coordinates."""
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a, b, c in offsets])
    rows = df.withColumn("_o", F.explode(steps))
    return rows.select(*df.columns, (F.col("z") + F.col("_o.a")).alias("nz"), (F.col("y") + F.col("_o.b")).alias("ny"), (F.col("x") + F.col("_o.c")).alias("nx"))


def face_pairs(vol: DataFrame, value: str = "v") -> DataFrame:
    """(z, y, x, value, nz, ny, nx, other) for each voxel and each of its face neighbours inside the table."""
    other = vol.select(F.col("z").alias("nz"), F.col("y").alias("ny"), F.col("x").alias("nx"), F.col(value).alias("other"))
    return shifted(vol.select("z", "y", "x", value), FACES).join(other, ["nz", "ny", "nx"])


def iso_faces(vol: DataFrame, iso: float) -> DataFrame:
    """Faces between a voxel above iso and one that isn't: (z, y, x) inside, (nz, ny, nx) outside."""
    return face_pairs(vol).where((F.col("v") > iso) & (F.col("other") <= iso)).select("z", "y", "x", "nz", "ny", "nx")


def label_adjacency(labelled: DataFrame) -> DataFrame:
    """(src, dst, weight): for face pairs p in src, q in dst, the sum of q's value. labelled: (z, y, x, label, v)."""
    there = labelled.select(F.col("z").alias("nz"), F.col("y").alias("ny"), F.col("x").alias("nx"), F.col("label").alias("dst"), F.col("v").cast("double").alias("w"))
    pairs = shifted(labelled.select("z", "y", "x", F.col("label").alias("src")), FACES).join(there, ["nz", "ny", "nx"])
    return pairs.where("src <> dst").groupBy("src", "dst").agg(F.sum("w").alias("weight"))


def neighbour_sets(edges: DataFrame, most: int = 112) -> DataFrame:
    """(label, neighs, overflow): sorted distinct neighbours of each label, and how many there are beyond ``most``."""
    sets = edges.groupBy(F.col("src").alias("label")).agg(F.sort_array(F.collect_set("dst")).alias("neighs"))
    return sets.select("label", "neighs", F.greatest(F.size("neighs") - most, F.lit(0)).alias("overflow"))


def merge_labels(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges between what labels map to: mapping (label, segment); pairs inside a segment are left out."""
    a = mapping.select(F.col("label").alias("src"), F.col("segment").alias("s"))
    b = mapping.select(F.col("label").alias("dst"), F.col("segment").alias("d"))
    both = edges.join(a, "src").join(b, "dst").where("s <> d")
    return both.groupBy(F.col("s").alias("src"), F.col("d").alias("dst")).agg(F.sum("weight").alias("weight"))


def label_block(on: np.ndarray) -> np.ndarray:
    """Labels of the true places that touch at a face, an edge or a corner: 1 and the place (in raster order) of the first
    of them; 0 elsewhere. Union-find: the larger root of a pair takes the smaller as parent, then all take their roots."""
    at = np.flatnonzero(on)
    number = np.full(on.shape, -1, np.int64)
    number.ravel()[at] = np.arange(len(at))
    a, b = [], []
    for step in HALF_26:
        here = tuple(slice(max(0, -d), n - max(0, d)) for d, n in zip(step, on.shape, strict=True))
        there = tuple(slice(max(0, d), n - max(0, -d)) for d, n in zip(step, on.shape, strict=True))
        both = on[here] & on[there]
        a.append(number[here][both])
        b.append(number[there][both])
    a, b, parent = np.concatenate(a), np.concatenate(b), np.arange(len(at))
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while (parent[parent] != parent).any():
            parent = parent[parent]
    out = np.zeros(on.shape, np.int64)
    out.ravel()[at] = at[parent] + 1
    return out


def label_components(vol: DataFrame, shape: tuple[int, int, int], iso: float, edge: int = blocks.EDGE) -> DataFrame:
    """(z, y, x, component) of voxels above iso that touch at a face, an edge or a corner; component: the place of its
    first voxel in raster order.

    In two levels: each block labels its own voxels, and sends its neighbours the labels at its border only. Where labels
    touch across a border they are linked; the components of these links (a table of labels, not of voxels) are sent back
    to the blocks whose labels they change. Voxels are shuffled once, into blocks, and only those above iso.
    """
    scratch, (_, h, w) = BlockScratch(vol.sparkSession, "components"), shape
    on = vol.where(F.col("v") > iso).select("z", "y", "x", F.lit(1.0).alias("v"))

    def label(a: np.ndarray, before: tuple, start: tuple) -> np.ndarray:
        own = label_block(a[0] > 0)
        z, y, x = np.unravel_index(np.maximum(own - 1, 0), own.shape)
        return np.where(own > 0, ((z + start[0]) * h + y + start[1]) * w + x + start[2] + 1, 0)[None].astype(np.float64)

    labelled = Blocks.of(on, shape, edge).map(label).kept(scratch, "labels")
    size = labelled.edge

    def touching(a: np.ndarray, before: tuple, start: tuple) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of labels that touch, one inside the block and one outside."""
        a = a[0].astype(np.int64)
        core = tuple(slice(b, b + min(e, n - s)) for b, e, n, s in zip(before, size, shape, start, strict=True))
        inside = np.zeros(a.shape, bool)
        inside[core] = True
        found = [np.zeros((2, 0), np.int64)]
        for step in HALF_26:
            here = tuple(slice(max(0, -d), n - max(0, d)) for d, n in zip(step, a.shape, strict=True))
            there = tuple(slice(max(0, d), n - max(0, -d)) for d, n in zip(step, a.shape, strict=True))
            both = (a[here] > 0) & (a[there] > 0) & (inside[here] != inside[there])
            found.append(np.stack([a[here][both], a[there][both]]))
        pairs = np.unique(np.concatenate(found, axis=1), axis=1)
        return np.zeros(0), np.array([*pairs.ravel()], np.float64)

    pairs = scratch.write(labelled.map(touching, (1, 1, 1), extra=-1).df, "pairs")
    n = F.expr("cast(size(extra) / 2 as int)")
    links = pairs.select(F.explode(F.arrays_zip(F.slice("extra", F.lit(1), n).alias("a"), F.slice("extra", n + 1, n).alias("b"))).alias("l"))
    links = links.select(F.col("l.a").cast("long").alias("a"), F.col("l.b").cast("long").alias("b"))
    moved = components(links).where("id <> component")
    z, y, x = (F.expr(f"(id - 1) div {h * w}"), F.expr(f"(id - 1) div {w} % {h}"), F.expr(f"(id - 1) % {w}"))
    places = [F.expr(f"cast({c} div {e} as int)").alias(b) for c, e, b in zip(("lz", "ly", "lx"), size, blocks.KEY, strict=True)]
    moved = moved.select("id", "component", z.alias("lz"), y.alias("ly"), x.alias("lx")).select("id", "component", *places)
    by_block = moved.groupBy(*blocks.KEY).agg(F.collect_list("id").alias("ids"), F.collect_list("component").alias("to"))

    @F.arrow_udf("array<double>")
    def relabel(data: pa.Array, ids: pa.Array, to: pa.Array) -> pa.Array:
        out = []
        for own, old, new in zip(data.to_numpy(zero_copy_only=False), ids.to_pylist(), to.to_pylist(), strict=True):
            if old:
                old, new = np.array(old, np.float64), np.array(new, np.float64)
                order = np.argsort(old)
                old, new = old[order], new[order]
                at = np.minimum(np.searchsorted(old, own), len(old) - 1)
                own = np.where(old[at] == own, new[at], own)
            out.append(own)
        return pa.array(out, pa.list_(pa.float64()))

    final = labelled.df.join(by_block.hint("shuffle_hash"), blocks.KEY, "left").select(*blocks.KEY, relabel("data", "ids", "to").alias("data"))
    return Blocks(final, shape, size).voxels().where("v > 0").select("z", "y", "x", (F.col("v") - 1).cast("long").alias("component"))


def component_info(labelled: DataFrame) -> DataFrame:
    """(component, size, sample point, centroid) of each component."""
    return labelled.groupBy("component").agg(
        F.count("*").alias("size"), F.min(F.struct("z", "y", "x")).alias("sample_point"), F.avg("z").alias("cz"), F.avg("y").alias("cy"), F.avg("x").alias("cx")
    )


def remove_components(vol: DataFrame, labelled: DataFrame, min_size: int = 0, max_size: int | None = None) -> DataFrame:
    """The volume with 0 where a component is smaller than min_size or larger than max_size."""
    sizes = labelled.groupBy("component").agg(F.count("*").alias("size"))
    bad = sizes.where((F.col("size") < min_size) | (F.col("size") > max_size if max_size is not None else F.lit(False)))
    gone = labelled.join(bad, "component", "left_semi").select("z", "y", "x", F.lit(True).alias("gone"))
    return vol.join(gone, ["z", "y", "x"], "left").select("z", "y", "x", F.when(F.col("gone"), F.lit(0)).otherwise(F.col("v")).alias("v"))
