import itertools
import random
import re
import tracemalloc
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from tessera.operators import blocks, neighbours, stencil
from tessera.operators.blocks import Blocks

SHAPE = (7, 12, 9)


def frame(spark, v, keep=None):
    rows = [(*map(int, i), float(v[i])) for i in np.ndindex(v.shape) if keep is None or keep[i]]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, "z int, y int, x int, v double").repartition(3)


def array(df, shape, column="v", fill=np.nan):
    out = np.full(shape, fill)
    for r in df.collect():
        assert out[r.z, r.y, r.x] is not None
        out[r.z, r.y, r.x] = r[column]
    return out


@pytest.fixture(scope="module")
def values():
    return np.random.default_rng(1).random(SHAPE)


@pytest.mark.parametrize("edge", [3, (7, 5, 2), 64])
def test_voxels_go_in_and_out(spark, values, edge):
    keep = values > 0.3
    keep[:3, :3, :3] = False  # with edge 3, a block without a voxel
    cut = Blocks.of(frame(spark, values, keep), SHAPE, edge)
    got = array(cut.voxels(), SHAPE)
    assert np.array_equal(got[keep], values[keep]) and set(got[~keep & ~np.isnan(got)]) <= {0.0}
    assert np.isnan(got[:3, :3, :3]).all() == (edge == 3)
    two = Blocks.of(frame(spark, values).withColumn("w", -F.col("v")), SHAPE, edge, ("v", "w"))
    assert np.array_equal(array(two.voxels(("v", "w")), SHAPE, "w"), -values)


def test_odd_volumes(spark):
    empty = spark.createDataFrame([], "z int, y int, x int, v double")
    assert Blocks.of(empty, SHAPE, 4).voxels().count() == 0 and stencil.gaussian(empty, SHAPE, 2.0).count() == 0
    assert neighbours.label_components(empty, SHAPE, 0.5).count() == 0 and stencil.tv_denoise(empty, SHAPE, tile=4).count() == 0
    one = spark.createDataFrame([(0, 0, 0, None, "x")], "z int, y int, x int, v double, bz string")
    assert [tuple(r) for r in stencil.gaussian(one, (1, 1, 1), 2.0).collect()] == [(0, 0, 0, 0.0)]
    with pytest.raises(Exception, match="outside"):
        Blocks.of(spark.createDataFrame([(0, 0, 9, 1.0)], "z int, y int, x int, v double"), SHAPE, 4).df.collect()


@pytest.mark.parametrize("edge", [2, 5, (3, 12, 4), 64])
def test_kernels_are_those_of_the_whole_volume(spark, values, edge):
    vol = frame(spark, values)
    for sigma in (0.5, 2.0):  # a reach of 2 and of 8 voxels: beyond several blocks, and beyond the volume
        weights = stencil.gaussian_weights(sigma)
        r = len(weights) // 2
        want = np.pad(values, r, mode="edge")
        for axis in range(3):
            want = sum(w * np.take(want, range(k, want.shape[axis] - 2 * r + k), axis) for k, w in enumerate(weights))
        assert np.allclose(array(stencil.gaussian(vol, SHAPE, sigma, edge), SHAPE), want, atol=1e-12)
        assert np.allclose(array(stencil.unsharp(vol, SHAPE, sigma, 2.0, edge=edge), SHAPE), np.clip(values + 2 * (values - want), 0, 1), atol=1e-12)
    p = np.pad(values, ((0, 0), (1, 1), (1, 1)), mode="reflect")
    corners = sum(p[:, 1 + a : p.shape[1] - 1 + a, 1 + b : p.shape[2] - 1 + b] for a, b in itertools.product((-1, 1), repeat=2))
    assert np.allclose(array(stencil.laplacian(vol, SHAPE, edge), SHAPE), 2 * corners - 8 * values)


def shuffles(df):
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return final, [x for x in final.splitlines() if re.search(r"[-+] Exchange ", x)]


def test_only_halos_are_shuffled(spark, values):
    kept = Blocks.of(frame(spark, values), SHAPE, 4).kept()
    plan, found = shuffles(blocks.smooth(kept, [0.25, 0.5, 0.25]).df)
    assert len(found) == 1 and plan.count("Bucketed: true") == 2 and "ShuffledHashJoin" in plan
    assert re.search(r"Exchange.*\n.*partial_collect_list\(s#", plan)  # the slabs
    sent = kept.halos((1, 1, 1)).select(F.explode("halo").alias("h")).agg(F.sum(F.size("h.slab"))).first()[0]
    want = 0
    for at in itertools.product(*(range(-(-n // 4)) for n in SHAPE)):
        start, end = blocks.box(at, (4, 4, 4), SHAPE)
        want += np.prod(np.minimum(np.add(end, 1), SHAPE) - np.maximum(np.subtract(start, 1), 0)) - np.prod(np.subtract(end, start))
    assert sent == want


def flood(on):
    """Components by a walk from each voxel in raster order."""
    out = np.full(on.shape, -1)
    for i in zip(*np.nonzero(on), strict=True):
        if out[i] < 0:
            first, todo = np.ravel_multi_index(i, on.shape), [i]
            out[i] = first
            while todo:
                p = todo.pop()
                for d in itertools.product((-1, 0, 1), repeat=3):
                    q = tuple(np.add(p, d))
                    if all(0 <= a < n for a, n in zip(q, on.shape, strict=True)) and on[q] and out[q] < 0:
                        out[q] = first
                        todo.append(q)
    return out


def snake():
    """One component that winds through all blocks, and lone voxels beside it."""
    on = np.zeros(SHAPE, bool)
    on[:, ::4, :] = True
    on[:, 2::4, 4] = False
    for k, y in enumerate(range(0, SHAPE[1], 4)):
        on[k % 2 * (SHAPE[0] - 1), y : y + 4, 0] = True
    on[3, 2, 5] = on[6, 10, 8] = True
    return on


@pytest.mark.parametrize("edge", [1, 3, (7, 5, 2), 64])
@pytest.mark.parametrize("iso", [0.95, 0.8, 0.5, None])
def test_components(spark, values, edge, iso):
    on = snake() if iso is None else values > iso
    want = flood(on)
    assert np.array_equal(neighbours.label_block(on) - 1, want)
    vol = frame(spark, np.where(on, 1.0, 0.0)) if iso is None else frame(spark, values)
    got = array(neighbours.label_components(vol, SHAPE, 0.5 if iso is None else iso, edge), SHAPE, "component", -1)
    assert np.array_equal(got, want)


def energy(out, v, weight):
    g = np.zeros((2, *v.shape))
    g[0, :-1], g[1, :, :-1] = np.diff(out, axis=0), np.diff(out, axis=1)
    return ((out - v) ** 2).sum() / 2 + weight * np.sqrt((g**2).sum(0)).sum()


@pytest.mark.parametrize(("tile", "inner", "most"), [(64, 16, 200), (16, 8, 200), (13, 5, 200), (9, 4, 23)])
def test_total_variation_in_tiles(spark, tile, inner, most):
    shape, rng = (3, 30, 22), np.random.default_rng(2)
    v = rng.random(shape) * np.array([1.0, 0.1, 0.0])[:, None, None] + np.linspace(0, 1, 22)
    got = array(stencil.tv_denoise(frame(spark, v), shape, tile=tile, inner=inner, most=most), shape)
    want = np.stack([stencil.denoise_slice(x, most=most) for x in v])
    assert np.allclose(got, want, atol=1e-12)  # each slice ends at the step where it ends as a whole
    for a, b, x in zip(got, want, v, strict=True):
        assert energy(a, x, 0.1) == pytest.approx(energy(b, x, 0.1), rel=1e-9)


def test_batches_of_blocks_are_bounded_by_bytes(spark):
    """A worker is given a few blocks at a time, whatever the number of blocks in a task; whoever reads the voxels runs none."""
    shape, edge = (256, 64, 64), 8
    vol = spark.range(4 * 64**3).select(*[F.expr(f"cast(id div {n} % {256 if a == 'z' else 64} as int)").alias(a) for a, n in (("z", 4096), ("y", 64), ("x", 1))], F.lit(1.0).alias("v"))
    seen = spark.sparkContext.accumulator(0)

    @F.arrow_udf("array<double>")
    def note(data: pa.Array) -> pa.Array:
        seen.add(1)
        return data

    cut = Blocks.of(vol.coalesce(1), shape, edge)
    df = cut.df.coalesce(1)
    out = replace(cut, df=df.withColumn("data", note("data"))).voxels()
    ran = seen.value
    assert ran >= 4  # 8 MB in 2048 blocks, one batch before
    assert out.agg(F.sum("v")).first()[0] == 4 * 64.0**3 and seen.value == ran
    assert "ArrowEvalPython" not in out._jdf.queryExecution().executedPlan().toString()


def test_a_worker_that_packs_a_volume_holds_little_of_it(spark, monkeypatch):
    frame, made = type(spark.range(0)), []
    real = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, schema, *a: (made.append(f), real(self, f, schema, *a))[1])
    vol = spark.createDataFrame([(0, 0, 0, 1.0)], "z int, y int, x int, v double").withColumn("p", F.lit(0.0)).withColumn("q", F.lit(0.0))
    Blocks.of(vol, (1, 1024, 1024), (1, 64, 64), ("v", "p", "q"))
    at = np.random.default_rng(0).permutation(1 << 20).astype(np.int32)
    names = ["z", "y", "x", "v", "p", "q"]
    batches = (pa.record_batch([0 * i, i >> 10, i & 1023, *[i.astype(float)] * 3], names) for i in np.split(at, 128))
    tracemalloc.start()
    sizes = [len(c) for out in made[0](batches) for c in out["chunk"].to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(sizes) - 8 * len(sizes) == 32 << 20  # every voxel: its place and three values
    assert peak < 60e6
