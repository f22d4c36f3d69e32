"""Superpixels and segments: SNIC clustering across blocks, statistics of labels, seeds, region growing and painting."""

from __future__ import annotations

import functools
import heapq
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.blocks import KEY, Blocks, BlockScratch
from tessera.sources.shared import Scratch

Triple = tuple[int, int, int]


def seed_places(start: Triple, end: Triple, shape: Triple, step: int) -> list[tuple[int, Triple]]:
    """(number from 1, place) of the seeds in a box: a grid over the whole volume, numbered in raster order; one in the
    middle of a volume that is too small for the grid."""
    half = step // 2
    counts = [len(range(half, n, step)) for n in shape]
    if not all(counts):
        middle = tuple(n // 2 for n in shape)
        return [(1, middle)] if all(a <= m < b for a, m, b in zip(start, middle, end, strict=True)) else []
    axes = [range(max(0, -(-(a - half) // step)), min(c, max(0, -(-(b - half) // step)))) for a, b, c in zip(start, end, counts, strict=True)]
    return [((i * counts[1] + j) * counts[2] + k + 1, (half + i * step, half + j * step, half + k * step)) for i in axes[0] for j in axes[1] for k in axes[2]]


def snic_block(v: np.ndarray, labels: np.ndarray, start: Triple, seeds: list[tuple[int, Triple]], sums: dict[int, np.ndarray], weight: float) -> np.ndarray:
    """Labels of a box of the volume that begins at ``start``: voxels join, nearest first, the cluster whose running mean of
    value and place is nearest. Ties go to what was queued first, seeds before all else.

    labels: what is settled already (0: open); it stays, and its clusters grow on from there with the running sums (value,
    z, y, x, count) that are given for them.
    """
    d, h, w = v.shape
    labels, sums = labels.copy(), {k: x.copy() for k, x in sums.items()}
    queue = [(0.0, n, z - start[0], y - start[1], x - start[2], k) for n, (k, (z, y, x)) in enumerate(seeds, 1)]
    heapq.heapify(queue)
    count = len(queue)

    def offer(z: int, y: int, x: int, k: int) -> None:
        nonlocal count
        c, mz, my, mx, n = sums[k].tolist()
        c, mz, my, mx = c / n, mz / n - start[0], my / n - start[1], mx / n - start[2]
        for a, b, e in ((z + 1, y, x), (z - 1, y, x), (z, y + 1, x), (z, y - 1, x), (z, y, x + 1), (z, y, x - 1)):
            if 0 <= a < d and 0 <= b < h and 0 <= e < w and not labels[a, b, e]:
                count += 1
                far = (100 * (c - v[a, b, e])) ** 2 + weight * ((mz - a) ** 2 + (my - b) ** 2 + (mx - e) ** 2)
                heapq.heappush(queue, (far, count, a, b, e, k))

    for z, y, x in zip(*(i.tolist() for i in np.nonzero(labels)), strict=True):
        if int(labels[z, y, x]) in sums:
            offer(z, y, x, int(labels[z, y, x]))
    while queue:
        _, _, z, y, x, k = heapq.heappop(queue)
        if labels[z, y, x]:
            continue
        labels[z, y, x] = k
        own = sums.setdefault(k, np.zeros(5))
        own += (v[z, y, x], z + start[0], y + start[1], x + start[2], 1)
        offer(z, y, x, k)
    return labels


def label_sums(v: np.ndarray, labels: np.ndarray, start: Triple) -> np.ndarray:
    """(label, value, z, y, x, count) of each label of a block: sums, a row a label."""
    ids, at = np.unique(labels.ravel(), return_inverse=True)
    places = np.indices(v.shape).reshape(3, -1) + np.array(start)[:, None]
    columns = [np.bincount(at.ravel(), x, len(ids)) for x in (v.ravel(), *places, np.ones(v.size))]
    return np.stack([ids, *columns], axis=1)[ids > 0]


def snic(vol: DataFrame, shape: Triple, block: int, step: int = 8, compactness: float = 10.0) -> DataFrame:
    """(z, y, x, v, label): superpixels; a label is the number of its seed in the grid of the whole volume.

    Blocks are clustered in eight colours, so that no two blocks of a colour touch. A block is clustered with a border of
    ``step`` voxels: with the seeds there, so that clusters come in from blocks whose turn is later, and with what blocks
    before it have settled there, whose clusters grow on with the running sums that are passed on. Its own voxels then are
    settled. Superpixels so go across borders. With a block as large as the volume, clustering is that of the whole volume.
    Blocks without a seed in reach wait for their neighbours. Missing voxels of a block count as 0; blocks without a voxel
    are left out.
    """
    scratch = BlockScratch(vol.sparkSession, "snic")
    rows = vol.select("z", "y", "x", F.col("v").cast("double").alias("v"), F.lit(0.0).alias("label"))
    raw = Blocks.of(rows, shape, block, ("v", "label")).kept(scratch, "raw")
    edge, reach = raw.edge, tuple(min(step, n) for n in shape)
    seeds_in_all = max(1, int(np.prod([len(range(step // 2, n, step)) for n in shape])))
    weight = compactness * compactness * seeds_in_all / (shape[0] * shape[1] * shape[2])

    def cluster(a: np.ndarray, before: Triple, start: Triple, beside: list[np.ndarray] = ()) -> tuple[np.ndarray, np.ndarray]:
        v, labels = a[0], a[1].astype(np.int64)
        low = tuple(s - b for s, b in zip(start, before, strict=True))
        core = tuple(slice(b, b + min(e, n - s)) for b, e, n, s in zip(before, edge, shape, start, strict=True))
        sums: dict[int, np.ndarray] = {}
        for row in np.concatenate([np.zeros((0, 6)), *(x.reshape(-1, 6) for x in beside)]):
            sums[int(row[0])] = sums.get(int(row[0]), np.zeros(5)) + row[1:]  # blocks have voxels of their own
        high = tuple(x + n for x, n in zip(low, v.shape, strict=True))
        labels = snic_block(v, labels, low, seed_places(low, high, shape, step), sums, weight)[core]
        return np.stack([v[core], labels]), label_sums(v[core], labels, start)

    def colour(at: tuple[int, int, int]) -> int:
        return at[0] % 2 * 4 + at[1] % 2 * 2 + at[2] % 2

    of_block = F.expr("bz % 2 * 4 + by % 2 * 2 + bx % 2")
    grid = [-(-n // e) for n, e in zip(shape, edge, strict=True)]
    colours = [c for c in range(8) if all(c >> (2 - i) & 1 < g for i, g in enumerate(grid))]
    nothing = F.array().cast("array<double>")
    todo, settled, turn = raw, [], 0
    while True:
        for c in colours:
            # all blocks send what they have: settled ones labels and sums, the others their values
            waiting = todo.where(of_block >= c).df.select(*KEY, "data", nothing.alias("extra"))
            senders = functools.reduce(DataFrame.unionByName, [x.select(*KEY, "data", "extra") for x in settled], waiting)
            halos = replace(raw, df=senders).halos(reach, to=lambda at, c=c: colour(at) == c)
            out = todo.where(of_block == c).map(cluster, reach, extra=1, halos=halos)
            settled.append(scratch.write_buckets(out.df, f"labels-{turn}-{c}", KEY))
        n = functools.reduce(lambda a, b: a * b, [F.least(F.lit(e), F.lit(m) - F.col(k) * e) for k, e, m in zip(KEY, edge, shape, strict=True)])
        is_open = F.exists(F.slice("data", n + 1, n), lambda x: x == 0)
        everything = functools.reduce(DataFrame.unionByName, settled)
        left = everything.where(is_open)
        if turn == 3 or not left.limit(1).count():  # a block without a seed has one at a corner at the farthest
            break
        turn += 1
        todo = replace(raw, df=left.select(*KEY, "data"), stored=False).kept(scratch, f"open-{turn}")
        settled = [scratch.write_buckets(everything.where(~is_open), f"settled-{turn}", KEY)]
    return replace(raw, df=everything.select(*KEY, "data")).voxels(("v", "label")).withColumn("label", F.col("label").cast("long"))


def label_stats(labelled: DataFrame, lowmid: float = 80 / 255, midhigh: float = 160 / 255, full: int = 1) -> DataFrame:
    """(label, z, y, x, c, n, nlow, nmid, nhig): mean place and value, size, and voxels in three bands of value.

    full: the value that counts as 1. Whole numbers are added up as such and divided once, so that a mean is the double
    nearest to the exact one in whatever order voxels come, and one at the border of two bins falls into the upper."""
    v = F.col("v") / F.lit(float(full))
    return labelled.groupBy("label").agg(
        *[F.avg(c).alias(c) for c in "zyx"], F.try_divide(F.sum("v").cast("double"), F.count("v") * F.lit(float(full))).alias("c"), F.count("*").alias("n"),
        F.count_if(v <= lowmid).alias("nlow"), F.count_if((v > lowmid) & (v <= midhigh)).alias("nmid"), F.count_if(v > midhigh).alias("nhig"),
    )


def binned(stats: DataFrame, bins: int = 16) -> DataFrame:
    """(label, c, bin): c in 0..1 to equal bins."""
    return stats.select("label", "c", F.least(F.floor(F.col("c") * bins), F.lit(bins - 1)).cast("int").alias("bin"))


def seeds(stats: DataFrame, bins: int = 16, most: int = 256) -> DataFrame:
    """(segment, label): the brightest superpixels, by bin, value and label; segments are numbered from 1."""
    top = binned(stats, bins).orderBy(F.desc("bin"), F.desc("c"), "label").limit(most)
    return top.select(F.row_number().over(Window.orderBy(F.desc("bin"), F.desc("c"), "label")).alias("segment"), "label")  # ``most`` rows


def grow(stats: DataFrame, edges: DataFrame, iso: float, bins: int = 16, most: int = 256) -> DataFrame:
    """(label, segment): segments take turns, by number, round by round. In its turn a segment takes one superpixel: of the
    bright ones (c >= iso) beside it that no segment has, the brightest, of equally bright ones the smallest label. A round
    in which none is taken is the last. Segments begin with the bright seeds, numbered as in ``seeds``. 0: in no segment.

    A round is a join of what was taken last with the links, and the frontier stays a table. In a round, a segment loses
    ``most`` - 1 superpixels to those before it at most, so its first ``most`` candidates decide: turns are settled over
    most**2 rows, by one task, however large the graph is. There are as many rounds as the longest segment has superpixels.
    """
    scratch = Scratch(stats.sparkSession, "grow")
    bright = scratch.write(stats.where(F.col("c") >= iso).select(F.col("label").cast("long").alias("label"), F.col("c").cast("double").alias("c")), "bright")
    links = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("label")).where("src <> label").distinct()
    links = scratch.write(links.join(bright, "label"), "links")
    first = seeds(stats, bins, most).join(bright, "label").select("label", "segment")

    def settle(table: pa.Table) -> pa.Table:
        taken: dict[int, int] = {}
        done = None
        for segment, _, label in sorted(zip(*(table[c].to_pylist() for c in ("segment", "dark", "label")), strict=True)):
            if segment != done and label not in taken:
                taken[label], done = segment, segment
        return pa.table({"label": pa.array(list(taken), pa.int64()), "segment": pa.array(list(taken.values()), pa.int32())})

    owned = new = scratch.write(first, "owned-0")
    front, turn = None, 0
    while True:
        turn += 1
        reached = new.withColumnRenamed("label", "src").join(links, "src").select("segment", "label", "c")
        reached = reached if front is None else front.unionByName(reached)
        front = scratch.write(reached.distinct().join(owned, "label", "left_anti"), f"front-{turn}")
        best = Window.partitionBy("segment").orderBy(F.desc("c"), "label")
        some = front.withColumn("place", F.row_number().over(best)).where(F.col("place") <= most)
        new = scratch.write(some.select("segment", (-F.col("c")).alias("dark"), "label").withColumn("all", F.lit(0)).groupBy("all").applyInArrow(settle, "label long, segment int"), f"new-{turn}")
        scratch.drop(f"front-{turn - 1}", f"new-{turn - 1}")
        if not new.limit(1).count():
            break
        owned = scratch.write(owned.unionByName(new), f"owned-{turn}")
        scratch.drop(f"owned-{turn - 1}")
    return stats.select("label").join(owned, "label", "left").select("label", F.coalesce("segment", F.lit(0)).alias("segment"))


def rank_segments(stats: DataFrame, mapping: DataFrame) -> DataFrame:
    """(segment, mean_c, n, rank): segments by mean value of their superpixels; 0 stays void. At most 256 rows."""
    means = mapping.where("segment > 0").join(stats.select("label", "c"), "label").groupBy("segment").agg(F.avg("c").alias("mean_c"), F.count("*").alias("n"))
    return means.withColumn("rank", F.row_number().over(Window.orderBy("mean_c", "segment")) - 1)


def paint(labelled: DataFrame, mapping: DataFrame, n_segments: int) -> DataFrame:
    """(z, y, x, segment, grey): each voxel's segment (0: none) and rank * 256 div segments."""
    rows = labelled.select("z", "y", "x", "label").join(mapping, "label", "left").withColumn("segment", F.coalesce("segment", F.lit(0)))
    return rows.select("z", "y", "x", "segment", F.expr(f"cast(segment * 256 div {n_segments} as int)").alias("grey"))
