"""Dense blocks of a volume, and kernels over them that exchange halos.

A block is one row: its place in the grid of blocks and its values as one array (channels, z, y, x, in C order). A kernel
that looks ``reach`` voxels far needs, besides its own block, only slabs of the blocks around it: each block sends each
neighbour the part that lies within that neighbour's reach, by a hash of the neighbour's place. The blocks themselves stay
where they are: they are kept in a table that is bucketed by that hash, so that the join of blocks with their halos moves
halos only. Blocks at the end of an axis may be smaller; where the reach is larger than a block, slabs come from blocks
farther off too. A task holds a few blocks at a time: kernels run while a table is written, in batches of bounded bytes.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.shared import Scratch

Triple = tuple[int, int, int]
KEY = ["bz", "by", "bx"]
#: Edge of a block.
EDGE = 64
#: Voxels that a task packs at once while a volume is cut into blocks.
PACKED = 1 << 17
#: Size of a batch of blocks that a worker is given, or one block.
BATCH_BYTES = "2m"
_HALO = "array<struct<dz: int, dy: int, dx: int, slab: array<double>, extra: array<double>>>"

#: A kernel: (values (channels, z, y, x) with halos, voxels of halo before the block on each axis, the block's first voxel) to
#: the values of the block itself (channels, z, y, x).
Kernel = Callable[[np.ndarray, Triple, Triple], np.ndarray]


def box(at: Sequence[int], edge: Triple, shape: Triple) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """(first voxel, end) of the block at a place."""
    start = tuple(b * e for b, e in zip(at, edge, strict=True))
    return start, tuple(min(s + e, n) for s, e, n in zip(start, edge, shape, strict=True))


def _overlap(start, end, other_start, other_end) -> tuple[slice, ...] | None:
    """Where the second box meets the first, as slices of the first."""
    low, high = np.maximum(start, other_start), np.minimum(end, other_end)
    return tuple(slice(int(a - s), int(b - s)) for a, b, s in zip(low, high, start, strict=True)) if (low < high).all() else None


def _arrays(values: pa.Array) -> list[np.ndarray]:
    """The lists of an Arrow column as arrays."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    flat, ends = values.values.to_numpy(zero_copy_only=False), values.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *(x.size for x in values)])
    flat = np.concatenate([np.ravel(x) for x in values]) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.float64()))


def _places(bz: pa.Array, by: pa.Array, bx: pa.Array) -> list[tuple[int, int, int]]:
    return list(zip(bz.to_pylist(), by.to_pylist(), bx.to_pylist(), strict=True))


class BlockScratch(Scratch):
    """Tables of blocks: a row is large, and a kernel makes several times as much of it, so batches are bounded by bytes."""

    SETTINGS = Scratch.SETTINGS | {"spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}


@dataclass(frozen=True)
class Blocks:
    """df (bz, by, bx, data array<double>) of a volume of ``shape``; with ``stored``, a table bucketed by (bz, by, bx)."""

    df: DataFrame
    shape: Triple
    edge: Triple
    channels: int = 1
    stored: bool = False

    @classmethod
    def of(cls, vol: DataFrame, shape: Triple, edge: int | Triple = EDGE, columns: Sequence[str] = ("v",)) -> Blocks:
        """From voxels (z, y, x and a column for each channel). Blocks that hold no voxel are left out; voxels that are not
        there, or null, are 0. Voxels outside the shape raise; of repeated ones any stays."""
        edge = (edge,) * 3 if isinstance(edge, int) else tuple(edge)
        edge, shape, width = tuple(min(e, n) for e, n in zip(edge, shape, strict=True)), tuple(shape), len(columns)

        def pack(batches):
            held, size = [], 0
            for batch in batches:
                held.append(batch)
                size += batch.num_rows
                if size >= PACKED:
                    yield packed(held)
                    held, size = [], 0
            if size:
                yield packed(held)

        def packed(held) -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            at = np.stack([table[c].to_numpy() for c in "zyx"]).astype(np.int64)
            if (at < 0).any() or (at >= np.array(shape)[:, None]).any():
                raise ValueError(f"a voxel lies outside {shape}")
            block = at // np.array(edge)[:, None]
            order = np.lexsort(block[::-1])
            block, at = block[:, order], at[:, order]
            v = np.stack([np.nan_to_num(table[c].to_numpy(), nan=0.0, posinf=np.inf, neginf=-np.inf) if table[c].null_count else table[c].to_numpy() for c in columns]).astype(np.float64)[:, order]
            begins = np.flatnonzero(np.concatenate(([True], (block[:, 1:] != block[:, :-1]).any(axis=0))))
            chunks = []
            for a, b in zip(begins.tolist(), [*begins[1:].tolist(), at.shape[1]], strict=True):
                start, end = box(block[:, a], edge, shape)
                place = np.ravel_multi_index(at[:, a:b] - np.array(start)[:, None], np.subtract(end, start))
                chunks.append(np.int64(b - a).tobytes() + place.astype(np.int64).tobytes() + v[:, a:b].tobytes())
            return pa.record_batch([*(pa.array(block[i, begins], pa.int32()) for i in range(3)), pa.array(chunks, pa.binary())], [*KEY, "chunk"])

        @F.arrow_udf("array<double>")
        def dense(bz: pa.Array, by: pa.Array, bx: pa.Array, chunks: pa.Array) -> pa.Array:
            out = []
            for at, parts in zip(_places(bz, by, bx), chunks.to_pylist(), strict=True):
                start, end = box(at, edge, shape)
                data = np.zeros((width, int(np.prod(np.subtract(end, start)))))
                for part in parts:
                    n = int(np.frombuffer(part, np.int64, 1)[0])
                    data[:, np.frombuffer(part, np.int64, n, 8)] = np.frombuffer(part, np.float64, offset=8 * (n + 1)).reshape(width, n)
                out.append(data)
            return _lists(out)

        rows = vol.select("z", "y", "x", *[F.col(c).cast("double").alias(c) for c in columns]).mapInArrow(pack, "bz int, by int, bx int, chunk binary")
        grouped = rows.groupBy(*KEY).agg(F.collect_list("chunk").alias("chunks"))
        return cls(grouped.select(*KEY, dense(*KEY, "chunks").alias("data")), shape, edge, width)

    def voxels(self, names: Sequence[str] = ("v",)) -> DataFrame:
        """(z, y, x and a column for each channel). Blocks that aren't stored are written first: whoever reads the voxels then
        runs no kernels, and batches are those of ``BlockScratch``."""
        df = self.df if self.stored else BlockScratch(self.df.sparkSession, "blocks").write(self.df, "blocks")
        sizes = [F.least(F.lit(e), F.lit(n) - F.col(b) * e) for b, e, n in zip(KEY, self.edge, self.shape, strict=True)]
        rows = df.select(*KEY, "data", *[s.alias(f"n{a}") for s, a in zip(sizes, "zyx", strict=True)])
        n = F.col("nz") * F.col("ny") * F.col("nx")
        if self.channels == 1:
            rows = rows.select(*KEY, "ny", "nx", F.posexplode("data").alias("i", names[0]))
        else:
            parts = [F.slice("data", F.lit(k) * n + 1, n).alias(c) for k, c in enumerate(names)]
            rows = rows.select(*KEY, "ny", "nx", F.posexplode(F.arrays_zip(*parts)).alias("i", "c")).select(*KEY, "ny", "nx", "i", *[F.col(f"c.{c}").alias(c) for c in names])
        z, y, x = F.expr("i div (ny * nx)"), F.expr("i div nx % ny"), F.expr("i % nx")
        return rows.select(*[(F.col(b) * e + c).cast("int").alias(a) for a, b, e, c in zip("zyx", KEY, self.edge, (z, y, x), strict=True)], *names)

    def halos(self, reach: Triple, to: Callable[[tuple[int, int, int]], bool] | None = None) -> DataFrame:
        """(bz, by, bx, halo): what each block is sent by the others within ``reach``; dz, dy, dx lead from sender to block.
        to: which blocks are sent anything. A column ``extra`` of the senders goes with each slab."""
        shape, edge, channels = self.shape, self.edge, self.channels
        rings = [-(-r // e) for r, e in zip(reach, edge, strict=True)]
        ways = [d for d in itertools.product(*(range(-n, n + 1) for n in rings)) if any(d)]
        grid = [-(-n // e) for n, e in zip(shape, edge, strict=True)]

        @F.arrow_udf(_HALO)
        def slabs(bz: pa.Array, by: pa.Array, bx: pa.Array, data: pa.Array, extra: pa.Array) -> pa.Array:
            counts, steps, parts, beside = [0], [], [], []
            for at, own, more in zip(_places(bz, by, bx), _arrays(data), _arrays(extra), strict=True):
                start, end = box(at, edge, shape)
                own = own.reshape(channels, *np.subtract(end, start))
                for d in ways:
                    place = tuple(a + b for a, b in zip(at, d, strict=True))
                    if all(0 <= t < g for t, g in zip(place, grid, strict=True)) and (to is None or to(place)):
                        low, high = box(place, edge, shape)
                        part = _overlap(start, end, np.subtract(low, reach), np.add(high, reach))
                        if part is not None:
                            steps.append(d)
                            parts.append(own[(slice(None), *part)])
                            beside.append(more)
                counts.append(len(parts))
            step = np.array(steps, np.int32).reshape(-1, 3)
            items = pa.StructArray.from_arrays([*(pa.array(step[:, i]) for i in range(3)), _lists(parts), _lists(beside)], ["dz", "dy", "dx", "slab", "extra"])
            return pa.ListArray.from_arrays(pa.array(counts, pa.int32()), items)

        extra = F.col("extra") if "extra" in self.df.columns else F.array().cast("array<double>")
        sent = self.df.select(*KEY, F.explode(slabs(*KEY, "data", extra)).alias("s"))
        sent = sent.select(*[(F.col(b) + F.col(f"s.{d}")).alias(b) for b, d in zip(KEY, ("dz", "dy", "dx"), strict=True)], "s")
        return sent.groupBy(*KEY).agg(F.collect_list("s").alias("halo"))

    def map(self, kernel: Kernel, reach: Triple = (0, 0, 0), border: str | None = None, channels: int | None = None, extra: int = 0, halos: DataFrame | None = None) -> Blocks:
        """The kernel's values for each block. border: how voxels beyond the volume are made up, as in numpy.pad (``edge``,
        ``reflect``); None: the array ends at the volume's border. extra: so many numbers more that the kernel gives beside
        the values, as column ``extra``; any other than 0 will do, and -1 says that it
        gives these only. halos: of others' making; the kernel is then also given what the senders had as ``extra``. Blocks that aren't stored are, where halos are needed: they are read twice."""
        shape, edge, wide = self.shape, self.edge, self.channels
        reach = tuple(min(r, n) if border is None else r for r, n in zip(reach, shape, strict=True))
        beside = halos is not None

        @F.arrow_udf("array<double>")
        def apply(bz: pa.Array, by: pa.Array, bx: pa.Array, data: pa.Array, halo: pa.Array) -> pa.Array:
            out = []
            slabs = _halo_slabs(halo)
            for at, own, around in zip(_places(bz, by, bx), _arrays(data), slabs, strict=True):
                start, end = box(at, edge, shape)
                low, high = np.maximum(np.subtract(start, reach), 0), np.minimum(np.add(end, reach), shape)
                a = np.zeros((wide, *(high - low)))
                before = tuple(int(x) for x in np.subtract(start, low))
                a[(slice(None), *(slice(b, b + n) for b, n in zip(before, np.subtract(end, start).tolist(), strict=True)))] = own.reshape(wide, *np.subtract(end, start))
                for step, slab, _ in around:
                    other = box(np.subtract(at, step), edge, shape)
                    part = _overlap(low, high, *other)
                    a[(slice(None), *part)] = slab.reshape(wide, *(s.stop - s.start for s in part))
                if border is not None:
                    pad = [(0, 0)] + [(r - b, r - (h - e)) for r, b, h, e in zip(reach, before, high.tolist(), end, strict=True)]
                    a, before = np.pad(a, pad, mode=border), reach
                got = kernel(a, before, start, [more for *_, more in around]) if beside else kernel(a, before, start)
                out.append(got if not extra else np.concatenate([np.ravel(x) for x in got]))
            return _lists(out)

        if any(reach):
            own = self if self.stored else self.kept()
            sent = own.halos(reach) if halos is None else halos
            rows = own.df.select(*KEY, "data").join(sent.hint("shuffle_hash"), KEY, "left")
        else:
            rows = self.df.withColumn("halo", F.lit(None).cast(_HALO))
        out = rows.select(*KEY, apply(*KEY, "data", "halo").alias("data"))
        if extra == -1:
            out = out.withColumnRenamed("data", "extra")
        elif extra:
            ends = [F.least(F.lit(e), F.lit(m) - F.col(b) * e) for b, e, m in zip(KEY, edge, shape, strict=True)]
            n = ends[0] * ends[1] * ends[2] * (channels or wide)
            out = out.select(*KEY, F.slice("data", F.lit(1), n).alias("data"), F.slice("data", n + 1, F.size("data")).alias("extra"))
        return replace(self, df=out, channels=channels or wide, stored=False)

    def kept(self, scratch: Scratch | None = None, table: str = "blocks") -> Blocks:
        """Written to a table in the shared folder, bucketed by place, and read from there."""
        scratch = scratch or BlockScratch(self.df.sparkSession, "blocks")
        return replace(self, df=scratch.write_buckets(self.df, table, KEY), stored=True)

    def where(self, condition: Column) -> Blocks:
        """Some of the blocks: a condition on bz, by, bx."""
        return replace(self, df=self.df.where(condition))


def _halo_slabs(halo: pa.Array) -> list[list[tuple[tuple[int, int, int], np.ndarray, np.ndarray]]]:
    if isinstance(halo, pa.ChunkedArray):
        halo = halo.combine_chunks()
    items, ends, valid = halo.values, halo.offsets.to_numpy(), halo.is_valid().to_pylist()
    if not len(items):
        return [[] for _ in valid]
    steps = list(zip(*(items.field(d).to_pylist() for d in ("dz", "dy", "dx")), strict=True))
    slabs, more = _arrays(items.field("slab")), _arrays(items.field("extra"))
    return [[(steps[i], slabs[i], more[i]) for i in range(a, b)] if ok else [] for a, b, ok in zip(ends[:-1].tolist(), ends[1:].tolist(), valid, strict=True)]


def _weighted(a: np.ndarray, axis: int, weights: Sequence[float]) -> np.ndarray:
    """Sums of ``weights`` along an axis; the result is shorter by their number less one."""
    n = a.shape[axis] - len(weights) + 1
    out = np.zeros([n if i == axis else m for i, m in enumerate(a.shape)])
    for k, w in enumerate(weights):
        out += w * a[tuple(slice(k, k + n) if i == axis else slice(None) for i in range(a.ndim))]
    return out


def smooth(blocks: Blocks, weights: Sequence[float]) -> Blocks:
    """Weighted means along each axis in one exchange; places beyond the volume stand for the voxel at its border."""
    weights, r = list(weights), len(weights) // 2

    def kernel(a: np.ndarray, before: Triple, start: Triple) -> np.ndarray:
        for axis in (1, 2, 3):
            a = _weighted(a, axis, weights)
        return a

    return blocks.map(kernel, (r, r, r), "edge")


def sharpen(blocks: Blocks, weights: Sequence[float], amount: float, low: float, high: float) -> Blocks:
    """v + amount (v - smoothed v), within low..high, in one exchange."""
    weights, r = list(weights), len(weights) // 2

    def kernel(a: np.ndarray, before: Triple, start: Triple) -> np.ndarray:
        v = a[:, r : a.shape[1] - r, r : a.shape[2] - r, r : a.shape[3] - r]
        for axis in (1, 2, 3):
            a = _weighted(a, axis, weights)
        return np.clip(v + amount * (v - a), low, high)

    return blocks.map(kernel, (r, r, r), "edge")


def laplacian(blocks: Blocks) -> Blocks:
    """Per z-slice: 2 on the diagonals, -8 in the centre; borders mirror the volume without the border voxel."""

    def kernel(a: np.ndarray, before: Triple, start: Triple) -> np.ndarray:
        around = a[:, :, :-2, :-2] + a[:, :, :-2, 2:] + a[:, :, 2:, :-2] + a[:, :, 2:, 2:]
        return 2.0 * around - 8.0 * a[:, :, 1:-1, 1:-1]

    return blocks.map(kernel, (0, 1, 1), "reflect")
