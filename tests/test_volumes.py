import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import neighbours, pool, spatial, stats, stencil, superpixels
from tessera.plans import pipelines
from tessera.sources import volume
from tessera.streaming.slices import ingest_stream


def frame(spark, a, kind="double"):
    rows = [(int(z), int(y), int(x), float(v) if kind == "double" else int(v)) for (z, y, x), v in np.ndenumerate(a)]
    return spark.createDataFrame(rows, f"z int, y int, x int, v {kind}")


def array(df, shape, column="v"):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.z, r.y, r.x] = r[column]
    return out


def brute_pool(a, how, k, s, d):
    out = np.zeros([-(-n // q) for n, q in zip(a.shape, s, strict=True)])
    pads = [S.padding(n, kk, q) for n, kk, q in zip(a.shape, k, s, strict=True)]
    for o in np.ndindex(*out.shape):
        taps = []
        for i, t in enumerate(itertools.product(*map(range, k))):
            at = tuple(oo * q - p + tt * dd for oo, q, p, tt, dd in zip(o, s, pads, t, d, strict=True))
            if all(0 <= x < n for x, n in zip(at, a.shape, strict=True)):
                taps.append((a[at], sum(abs(tt - kk // 2) for tt, kk in zip(t, k, strict=True)), i))
        if taps:
            v = [t[0] for t in taps]
            out[o] = {"sum": sum(v), "avg": sum(v) / len(v), "max": max(v), "min": min(v), "argmax": min(taps, key=lambda t: (-t[0], t[1], t[2]))[2], "argmin": min(taps)[2]}[how]
    return out


@pytest.mark.parametrize(("shape", "k", "s", "d"), [((5, 3, 7), (3, 2, 4), (2, 1, 3), (1, 1, 1)), ((1, 1, 1), (3, 3, 3), (1, 1, 1), (2, 2, 2)), ((4, 4, 4), (4, 4, 4), (1, 1, 1), (2, 1, 1)), ((4, 4, 6), (2, 2, 3), (2, 2, 3), (1, 1, 1))])
def test_pools(spark, shape, k, s, d):
    a = np.random.default_rng(0).integers(0, 9, shape)
    vol = frame(spark, a)
    for how in ("sum", "avg", "max", "min"):
        want = brute_pool(a, how, k, s, d)
        assert np.allclose(array(pool.pool(vol, shape, how, k, s, d), want.shape), want)
    for how in ("max", "min"):
        want = brute_pool(a, f"arg{how}", k, s, d)
        assert np.array_equal(array(pool.arg_pool(vol, shape, how, k, s, d), want.shape), want)


def test_rescale_and_scrub(spark):
    assert np.array_equal(array(stats.rescale(frame(spark, np.full((3, 3, 3), 7))), (3, 3, 3)), np.zeros((3, 3, 3)))
    a = np.array([[[np.nan, np.inf], [-np.inf, 3.0]]])
    got = array(frame(spark, a).select("z", "y", "x", S.scrub(F.col("v")).alias("v")), a.shape)
    assert got.tolist() == [[[0, 255], [0, 3]]]


def test_gaussian_laplacian_unsharp(spark):
    a = np.random.default_rng(1).random((4, 5, 6))
    want = a
    for axis in range(3):
        w = stencil.gaussian_weights(1.0)
        idx = [np.clip(np.arange(a.shape[axis]) + k - len(w) // 2, 0, a.shape[axis] - 1) for k in range(len(w))]
        want = sum(x * np.take(want, i, axis) for x, i in zip(w, idx, strict=True))
    vol = frame(spark, a)
    assert np.allclose(array(stencil.gaussian(vol, a.shape, 1.0), a.shape), want)
    p = np.pad(a, ((0, 0), (1, 1), (1, 1)), mode="reflect")
    lap = 2 * (p[:, :-2, :-2] + p[:, :-2, 2:] + p[:, 2:, :-2] + p[:, 2:, 2:]) - 8 * a
    assert np.allclose(array(stencil.laplacian(vol, a.shape), a.shape), lap)
    sharp = array(stencil.unsharp(vol, a.shape, 1.0, 2.0), a.shape)
    assert np.allclose(sharp, np.clip(a + 2 * (a - want), 0, 1))


def test_clahe_and_tv(spark):
    a = np.random.default_rng(2).random((4, 8, 8))
    got = array(stencil.clahe(frame(spark, a), a.shape, (1, 1, 1), bins=256, clip=1e9), a.shape)
    order = np.searchsorted(np.sort(np.minimum(np.floor(a.ravel() * 256), 255)), np.minimum(np.floor(a.ravel() * 256), 255), side="right") / a.size
    assert np.allclose(got.ravel(), order)
    tiled = array(stencil.clahe(frame(spark, a), a.shape, (2, 2, 2), bins=16, clip=2.0), a.shape)
    assert np.isfinite(tiled).all() and tiled.min() > 0 and tiled.max() <= 1 + 1e-9
    step = np.concatenate([np.zeros((8, 4)), np.ones((8, 4))], axis=1)
    noisy = step + np.random.default_rng(3).normal(0, 0.1, step.shape)
    assert np.abs(stencil.denoise_slice(noisy) - step).mean() < np.abs(noisy - step).mean()


def test_components(spark):
    a = np.zeros((8, 8, 8))
    a[0:2, 0:2, 0:2] = 1
    a[4:7, 4:7, 4:7] = 1
    vol = frame(spark, a)
    labelled = neighbours.label_components(vol, a.shape, 0.5)
    info = {r.component: r for r in neighbours.component_info(labelled).collect()}
    assert sorted(r["size"] for r in info.values()) == [8, 27]
    assert tuple(info[0].sample_point) == (0, 0, 0) and info[0].cz == 0.5
    assert array(neighbours.remove_components(vol, labelled, min_size=9), a.shape).sum() == 27
    assert array(neighbours.remove_components(vol, labelled, max_size=9), a.shape).sum() == 8
    diag = np.zeros((3, 3, 3))
    diag[[0, 1, 2], [0, 1, 2], [0, 1, 2]] = 1
    assert neighbours.label_components(frame(spark, diag), diag.shape, 0.5).select("component").distinct().count() == 1


def test_adjacency_and_plans(spark):
    a = np.zeros((4, 4, 4))
    a[2:] = 1
    labelled = frame(spark, a).withColumn("label", (F.col("z") >= 2).cast("int"))
    edges = {(r.src, r.dst): r.weight for r in neighbours.label_adjacency(labelled).collect()}
    assert edges == {(0, 1): 16.0, (1, 0): 0.0}
    plan = neighbours.label_adjacency(labelled)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def plain_snic(v, step, compactness):
    """Clusters from seeds on a grid; of the queued voxels the nearest to its cluster's mean value and place is next."""
    half = step // 2
    seeds = [(z, y, x) for z in range(half, v.shape[0], step) for y in range(half, v.shape[1], step) for x in range(half, v.shape[2], step)]
    weight = compactness**2 * len(seeds) / v.size
    labels, members, queued = np.zeros(v.shape, int), {}, []
    queue = [(0.0, n, p, n) for n, p in enumerate(seeds, 1)]
    n = len(queue)
    while queue:
        queue.sort(reverse=True)
        _, _, p, k = queue.pop()
        if labels[p]:
            continue
        labels[p] = k
        members.setdefault(k, []).append((v[p], *p))
        mean = np.mean(members[k], axis=0)
        for axis, d in itertools.product(range(3), (1, -1)):
            q = tuple(c + d * (i == axis) for i, c in enumerate(p))
            if all(0 <= c < m for c, m in zip(q, v.shape, strict=True)) and not labels[q]:
                n += 1
                queue.append(((100 * (mean[0] - v[q])) ** 2 + weight * ((mean[1:] - q) ** 2).sum(), n, q, k))
    return labels


@pytest.mark.parametrize(("shape", "block", "step"), [((6, 20, 18), 8, 4), ((5, 5, 17), 4, 4), ((9, 9, 9), 4, 4), ((4, 9, 10), (3), 4), ((1, 30, 30), 10, 5)])
def test_snic_goes_across_blocks(spark, shape, block, step):
    ramp = np.indices(shape).sum(0) / sum(shape)
    got = superpixels.snic(frame(spark, ramp * 0.01), shape, block=block, step=step)
    labels = array(got, shape, "label").astype(int)
    assert labels.min() >= 1 and np.array_equal(array(got, shape, "v"), ramp * 0.01)
    seeds = superpixels.seed_places((0, 0, 0), shape, shape, step)
    assert all(labels[p] == k for k, p in seeds)  # each keeps its seed
    for axis in range(3):  # labels change at borders about as often as at other places
        changes = (np.diff(labels, axis=axis) != 0).mean(axis=tuple(i for i in range(3) if i != axis))
        at_border = [i for i in range(len(changes)) if (i + 1) % block == 0]
        if at_border and len(changes) > len(at_border):
            assert (changes[at_border] < 1).all() or changes.max() == 1
    places = [{(z // block, y // block, x // block) for z, y, x in np.argwhere(labels == k)} for k in range(1, len(seeds) + 1)]
    assert sum(len(p) > 1 for p in places) > len(seeds) / 8
    again = superpixels.snic(frame(spark, ramp * 0.01).repartition(7), shape, block=block, step=step)
    assert np.array_equal(array(again, shape, "label"), labels)


def test_snic_where_blocks_have_no_seed(spark):
    shape = (9, 9, 9)  # the last voxel of an axis lies in a block of its own, without a seed
    labels = array(superpixels.snic(frame(spark, np.zeros(shape)), shape, block=8, step=8), shape, "label")
    assert labels.min() >= 1
    tiny = array(superpixels.snic(frame(spark, np.zeros((2, 2, 2))), (2, 2, 2), block=1, step=8), (2, 2, 2), "label")
    assert (tiny == 1).all()


def plain_growth(c, links, iso, most):
    """Turn by turn, one superpixel a turn."""
    order = sorted(c, key=lambda k: (-min(int(c[k] * 16), 15), -c[k], k))[:most]
    owner = {k: i for i, k in enumerate(order, 1) if c[k] >= iso}
    progress = True
    while progress:
        progress = False
        for segment in range(1, most + 1):
            front = [q for p, q in links if owner.get(p) == segment and q not in owner and c[q] >= iso]
            if front:
                owner[min(front, key=lambda q: (-c[q], q))] = segment
                progress = True
    return {k: owner.get(k, 0) for k in c}


@pytest.mark.parametrize(("n", "most", "iso", "seed"), [(30, 3, 0.3, 1), (60, 8, 0.2, 2), (40, 1, 0.0, 3), (25, 40, 0.5, 4)])
def test_growth_in_turns(spark, n, most, iso, seed):
    rng = np.random.default_rng(seed)
    c = {k: float(np.round(rng.random(), 1)) for k in range(n)}  # ties
    links = {(int(a), int(b)) for a, b in rng.integers(0, n, (2 * n, 2)) if a != b}
    links |= {(b, a) for a, b in links}
    stats_ = spark.createDataFrame(list(c.items()), "label long, c double")
    edges = spark.createDataFrame(sorted(links) * 2, "src long, dst long")
    got = {r.label: r.segment for r in superpixels.grow(stats_, edges, iso, most=most).collect()}
    assert got == plain_growth(c, links, iso, most)


def test_snic(spark):
    a = np.random.default_rng(5).random((8, 8, 8))
    labels = plain_snic(a, 4, 10.0)
    assert labels.min() == 1 and labels.max() == S.seed_count(a.shape, 4) == 8
    for k in range(1, 9):  # each is connected by faces
        where = {tuple(i) for i in np.argwhere(labels == k)}
        todo = [next(iter(where))]
        seen = set(todo)
        while todo:
            z, y, x = todo.pop()
            for n in ((z + 1, y, x), (z - 1, y, x), (z, y + 1, x), (z, y - 1, x), (z, y, x + 1), (z, y, x - 1)):
                if n in where and n not in seen:
                    seen.add(n)
                    todo.append(n)
        assert seen == where
    got = superpixels.snic(frame(spark, a), a.shape, block=8, step=4)
    assert np.array_equal(array(got, a.shape, "label"), labels)
    about = superpixels.label_stats(got)
    assert about.agg(F.sum("n")).collect()[0][0] == 512
    mapping = {r.label: r.segment for r in superpixels.grow(about, neighbours.label_adjacency(got), 0.0, most=2).collect()}
    assert len(mapping) == 8 and set(mapping.values()) == {1, 2}
    assert {r.segment for r in superpixels.grow(about, neighbours.label_adjacency(got), 2.0).collect()} == {0}


def test_points(spark):
    rng = np.random.default_rng(6)
    p = rng.integers(0, 30, (200, 3))
    df = spark.createDataFrame([(i, *map(int, r)) for i, r in enumerate(p)], "pid long, z int, y int, x int")
    got = {}
    for r in spatial.nearest(df, df.where("pid < 20"), k=4, max_distance=6.0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.pid)
    for q in range(20):
        d = ((p - p[q]) ** 2).sum(1)
        assert got[q] == [int(i) for i in np.lexsort((np.arange(200), d)) if d[i] < 36][:4]
    assert spatial.within(df, df.where("pid = 3"), 6.0).count() == (((p - p[3]) ** 2).sum(1) <= 36).sum()


def test_means_do_not_follow_the_order_of_voxels(spark):
    """Values whose exact mean is the border of two bins: in this order the sum of the quotients is below it."""
    rng, orders = np.random.default_rng(0), []
    while not orders:
        a = rng.integers(0, 256, 64)
        a[0] += (8160 - a.sum()) % 1020
        if a[0] < 256 and a.sum() % 1020 == 0 and np.floor(np.cumsum(a / 255.0)[-1] / 64 * 16) < a.sum() // 1020:
            orders = [a, np.sort(a), np.sort(a)[::-1]]
    for a in orders:
        df = spark.createDataFrame([(0, 0, i, int(v), 7) for i, v in enumerate(a)], "z int, y int, x int, v long, label int").coalesce(1)
        got = superpixels.binned(superpixels.label_stats(df, full=255), 16).first()
        assert (got.c, got.bin) == (a.sum() / 16320, a.sum() // 1020)


def test_nearest_meets_few_points(spark):
    """Many points at one place, and a dense heap: candidates follow k, and the answers are those of brute force."""
    rng = np.random.default_rng(8)
    p = np.concatenate([np.full((300, 3), 4.0), 7 + 2 * rng.random((600, 3)), 60 * rng.random((100, 3))])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(p)], "pid long, z double, y double, x double")
    asks = df.where("pid % 5 = 0")
    got = {}
    for r in spatial.nearest(df, asks, k=3, max_distance=10.0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.pid, r.dist))
    for q in range(0, 1000, 5):
        d = ((p - p[q]) ** 2).sum(1)
        assert got[q] == [(int(i), pytest.approx(np.sqrt(d[i]))) for i in np.lexsort((np.arange(1000), d)) if d[i] < 100][:3]
    assert spatial._halvings(df, 3, 10.0) >= 2  # 900 points in two of the widest cells
    same = spark.range(3000).selectExpr("id as pid", "1 as z", "1 as y", "1 as x")
    got = spatial.within(same, same.where("pid < 2"), 1.0)
    assert got.count() == 6000 and got.distinct().count() == 6000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode(pids") < plan.index("Join")  # ids are paired after the join of places


def test_pairs_within_a_radius_are_written_small(spark, tmp_path):
    """512 places of 100 points in one cell, asked from 40 places: each pair is there, and a row takes a part of a byte."""
    at = ["int(n div 64) as z", "int(n div 8 % 8) as y", "int(n % 8) as x"]
    points = spark.range(51200).selectExpr("id as pid", "id % 512 as n").selectExpr("pid", *at)
    asks = spark.range(40).selectExpr("id as pid", "id * 12 as n").selectExpr("pid", *at)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # the join that large inputs take
    try:
        spatial.within(points, asks, 9.0, digits=6).write.parquet(f"{tmp_path}/pairs")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    got = spark.read.parquet(f"{tmp_path}/pairs")
    p = np.array([(n // 64, n // 8 % 8, n % 8) for n in range(512)])
    d = {(q, n): round(float(np.sqrt(((p[n] - p[q * 12]) ** 2).sum())), 6) for q in range(40) for n in range(512)}
    want = {(q, n, x) for (q, n), x in d.items() if x <= 9.0}
    found = got.groupBy("query_id", F.expr("pid % 512").alias("n"), "dist").agg(F.count("*").alias("rows"), F.countDistinct("pid").alias("pids")).collect()
    assert {(r.query_id, r.n, r.dist) for r in found} == want and len(found) == len(want)
    assert all(r.rows == r.pids == 100 for r in found)
    written = sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet"))
    assert written < 0.5 * 100 * len(want)


def test_store_and_stream(spark, tmp_path):
    a = np.random.default_rng(7).integers(0, 255, (6, 4, 4))
    vol = frame(spark, a, "int")
    store = volume.VolumeStore(spark, str(tmp_path / "s"), a.shape, block=2)
    store.create(vol, "v")
    with pytest.raises(Exception, match="exist"):
        store.create(vol, "v")
    part = store.chunk("v", (1, 0, 2), (3, 4, 2))
    assert np.array_equal(array(part, (3, 4, 2)), a[1:4, :, 2:])
    assert "PartitionFilters: [isnotnull(bz" in part._jdf.queryExecution().executedPlan().toString()
    for start, size in [((-1, 0, 0), (1, 1, 1)), ((0, 0, 0), (7, 1, 1))]:
        with pytest.raises(ValueError, match="not inside"):
            store.chunk("v", start, size)
    store.overwrite_blocks(vol.where("z < 2").withColumn("v", F.lit(1)), "v")
    assert array(store.read("v"), a.shape)[2:].sum() == a[2:].sum() and array(store.read("v"), a.shape)[:2].sum() == 32

    incoming = str(tmp_path / "in")
    for z in (0, 1):
        vol.where(F.col("z") == z).select("z", "y", "x", (F.col("v") * 256).alias("v"), F.lit("u16").alias("kind")).write.mode("append").parquet(incoming)
        ingest_stream(spark, incoming, store, "w", str(tmp_path / "ck")).awaitTermination()
    assert np.array_equal(array(store.read("w"), (2, 4, 4)), a[:2] & 0xF0)


def test_range_is_gathered_while_writing(spark, tmp_path):
    a = np.random.default_rng(17).integers(3, 200, (6, 4, 4))
    vol = frame(spark, a, "int")
    store = volume.VolumeStore(spark, str(tmp_path / "s"), a.shape, block=2)
    store.create(vol, "v")
    assert store.range("v") == (a.min(), a.max())
    scaled = stats.rescale(store.read("v"), store.range("v"))
    plan = scaled._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan and "Exchange" not in plan  # the volume is read once
    assert np.allclose(array(scaled, a.shape), unit(a.astype(float)))
    store.overwrite_blocks(vol.where("z < 2").withColumn("v", F.lit(1)), "v")
    assert store.range("v") == (1, a[2:].max())  # scanned anew
    store.create(vol.where("z < 0"), "none")
    assert store.range("none") is None


@pytest.mark.parametrize("stored", ["yxz", "zyx", "xzy"])
def test_transposed(spark, stored):
    a = np.random.default_rng(18).integers(0, 255, (2, 3, 4))
    own = np.transpose(a, ["zyx".index(c) for c in stored])  # its first axis is stored[0]
    assert np.array_equal(array(volume.transposed(frame(spark, own, "int"), stored), a.shape), a)
    with pytest.raises(ValueError, match="axes"):
        volume.transposed(frame(spark, own, "int"), "zzy")


def test_repeated_voxels_of_a_batch(spark, tmp_path):
    store = volume.VolumeStore(spark, str(tmp_path / "s"), (1, 1, 2), block=1)
    rows = [(0, 0, 0, v, "u8") for v in (16, 240, 32)] + [(0, 0, 1, 48, "u8")]
    spark.createDataFrame(rows, "z int, y int, x int, v int, kind string").repartition(4).write.parquet(str(tmp_path / "in"))
    ingest_stream(spark, str(tmp_path / "in"), store, "w", str(tmp_path / "ck")).awaitTermination()
    assert array(store.read("w"), (1, 1, 2)).ravel().tolist() == [240, 48]


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 50), st.integers(1, 7), st.integers(1, 7))
def test_padding(size, kernel, stride):
    assert 0 <= S.padding(size, kernel, stride) < kernel


def test_search_for_a_blend():
    p = np.random.default_rng(8).random(256) ** 4
    p /= p.sum()
    assert stats.gap_of(p, 10.0) <= stats.gap_of(p, 0.0)


def traced(f):
    places = []
    return places, lambda x: places.append(x) or f(x)


def test_bracket_goes_downhill():
    places, f = traced(lambda x: (x - 2) ** 2)
    a, b, c = stats.bracket(f)
    assert places[:3] == [0.0, 1.0, 1.0 + stats.GOLDEN] and places[3] == pytest.approx(2)  # the parabola's own low
    assert len(places) == 4 and (a, b, c) == (1.0, places[3], 1.0 + stats.GOLDEN)
    places, f = traced(lambda x: (x + 50) ** 4)  # the other way, and far off
    a, b, c = stats.bracket(f)
    assert places[:3] == [0.0, 1.0, -stats.GOLDEN] and f(b) <= min(f(a), f(c)) and (a - b) * (c - b) < 0
    places, f = traced(lambda x: 7)  # flat: the first three will do
    assert stats.bracket(f) == (1.0, 0.0, -stats.GOLDEN) or stats.bracket(f) == (0.0, 1.0, 1.0 + stats.GOLDEN)


@pytest.mark.parametrize(
    ("f", "low"),
    [(lambda x: (x - 2) ** 2, 2.0), (lambda x: np.cosh(x + 1.25), -1.25), (lambda x: abs(x - 0.3) ** 1.5, 0.3), (lambda x: np.inf if x <= -1 else x - np.log1p(x), 0.0)],
)
def test_lowest(f, low):
    places, g = traced(f)
    assert stats.lowest(g) == pytest.approx(low, abs=1e-4) and len(places) < 60


def test_lowest_of_steps():
    """On a stepped function it ends, on the lowest place that it has seen."""
    for step in (0.1, 0.5, 3.0):
        places, f = traced(lambda x, step=step: np.floor(abs(x - 1.7) / step))
        found = stats.lowest(f)
        assert f(found) == min(map(f, list(places))) and len(places) < 200
    p = np.random.default_rng(8).random(256) ** 4
    p /= p.sum()
    places, f = traced(lambda lam: stats.gap_of(p, lam) if lam > -1 else np.inf)
    found = stats.lowest(f)
    assert f(found) == min(f(x) for x in list(places)) <= stats.gap_of(p, 0.0)


def unit(a):
    return (a - a.min()) / (a.max() - a.min()) if a.max() > a.min() else a * 0.0


def brute_clahe(a, tiles, bins, clip):
    size = [-(-n // t) for n, t in zip(a.shape, tiles, strict=True)]
    bin_ = np.minimum((a * bins).astype(int), bins - 1)
    cdf = {}
    for tile in np.ndindex(*[-(-n // s) for n, s in zip(a.shape, size, strict=True)]):
        part = bin_[tuple(slice(t * s, t * s + s) for t, s in zip(tile, size, strict=True))]
        n = np.bincount(part.ravel(), minlength=bins)
        kept = np.minimum(n, max(1.0, clip * part.size / bins))
        cdf[tile] = np.cumsum(kept + (n - kept).sum() / bins) / part.size
    out = np.zeros(a.shape)
    for at in np.ndindex(*a.shape):
        near = []
        for p, n, s, t in zip(at, a.shape, size, tiles, strict=True):
            c = (p + 0.5) / s - 0.5
            low, last = int(np.floor(c)), -(-n // s) - 1
            near.append([(min(max(low + k, 0), last), (1 - c + low, c - low)[k]) for k in (0, 1)] if t > 1 else [(0, 1.0)])
        for corner in itertools.product(*near):
            out[at] += np.prod([w for _, w in corner]) * cdf[tuple(t for t, _ in corner)][bin_[at]]
    return out


def brute_weights(levels):
    p = np.pad(levels, ((0, 0), (1, 1), (1, 1)), mode="reflect")
    h, w = levels.shape[1:]
    edge = 2 * sum(p[:, y : y + h, x : x + w] for y in (0, 2) for x in (0, 2)) - 8 * levels
    detail = np.minimum(np.abs(edge), 255)
    return np.minimum(detail / (detail.max() + 1e-8) + 1e-5, np.exp(-((unit(levels) - 0.5) ** 2) / 0.08))


def brute_contrast(a, lam):
    s = 255 * (a - a.min()) / (a.max() - a.min() + 1e-8)
    i = np.clip(s, 0, 255).astype(int)
    p = np.bincount(i.ravel(), minlength=256) / i.size
    g = np.minimum(np.ceil(255 * np.cumsum(p / (1 + lam) + lam / (1 + lam) / 256) + 0.5 - 1e-9), 255)[i]
    tiles = min(8, *a.shape[1:])
    local = np.floor(brute_clahe(i / 255, (a.shape[0], tiles, tiles), 256, 2.0) * 255 + 0.5)
    y = [np.where(t <= i, t / (i + 1e-8) * s, (255 - t) / (255 - i + 1e-8) * (s - i) + t) for t in (g, local)]
    w = [brute_weights(t) for t in (g, local)]
    return unit(np.clip(sum(v * u for v, u in zip(y, w, strict=True)) / (sum(w) + 1e-8), 0, 255))


def test_contrast_is_that_of_numpy(spark):
    a = np.random.default_rng(11).random((2, 9, 10)) ** 2 * 300
    vol = frame(spark, a)
    even = array(stencil.clahe(frame(spark, unit(a)), a.shape, (1, 3, 4), 16, clip=1.5), a.shape)
    assert np.allclose(even, brute_clahe(unit(a), (1, 3, 4), 16, 1.5))
    assert np.allclose(array(stencil.local_global_contrast(vol, a.shape, 0.5), a.shape), brute_contrast(a, 0.5))
    hist = np.bincount((255 * (a - a.min()) / (a.max() - a.min() + 1e-8)).astype(int).ravel(), minlength=256) / a.size
    lam = stats.best_blend(spark.createDataFrame([(i, float(p)) for i, p in enumerate(hist)], "bin int, p double"))
    assert np.allclose(array(stencil.local_global_contrast(vol, a.shape), a.shape), brute_contrast(a, lam))


def test_slice_etl(spark):
    a = np.random.default_rng(12).integers(0, 255, (2, 8, 9))
    a[:, :2] = 0
    shape = a.shape
    out = array(pipelines.clean_slices(frame(spark, a, "int"), shape), shape)
    smooth = stencil.gaussian(stencil.tv_denoise(stats.rescale(frame(spark, a, "int")), shape), shape, 2.0)
    sharp = array(stencil.unsharp(smooth, shape, 4.0, 2.0), shape)
    s = np.clip(255 * (sharp - sharp.min()) / (sharp.max() - sharp.min() + 1e-8), 0, 255).astype(int)
    lam = stats.best_blend(spark.createDataFrame([(i, float(p)) for i, p in enumerate(np.bincount(s.ravel(), minlength=256) / s.size)], "bin int, p double"))
    even = brute_clahe(brute_contrast(sharp, lam), (2, 8, 8), 16, 0.16)
    level = unit(even) * 255
    want = np.where(a == 0, 0, level.astype(int) & 0xF0)
    at_step = np.abs(level / 16 - np.round(level / 16)) < 1e-9
    assert np.all((out == want) | at_step) and at_step.mean() < 0.1 and np.all(out[:, :2] == 0)


def brute_gaussian(a, sigma):
    for axis in range(3):
        w = stencil.gaussian_weights(sigma)
        places = [np.clip(np.arange(a.shape[axis]) + k - len(w) // 2, 0, a.shape[axis] - 1) for k in range(len(w))]
        a = sum(x * np.take(a, i, axis) for x, i in zip(w, places, strict=True))
    return a


def test_preprocess_is_that_of_numpy(spark):
    a = np.random.default_rng(13).integers(0, 255, (6, 8, 10))
    vol, shape = pipelines.preprocess(frame(spark, a), a.shape, factor=2, bins=16)
    small = a.reshape(3, 2, 4, 2, 5, 2).sum((1, 3, 5)).astype(float)
    even = brute_clahe(unit(brute_gaussian(small, 2.0)), (3, 4, 5), 16, 0.16)
    assert shape == small.shape
    got = array(vol, shape)
    assert np.allclose(got, unit(even) * 255, atol=1e-3)


def test_total_variation_minimises_its_energy():
    rng = np.random.default_rng(14)
    v = np.kron(rng.random((3, 3)), np.ones((5, 5))) + rng.normal(0, 0.05, (15, 15))

    def energy(u):
        down, right = np.diff(u, axis=0, append=u[-1:]), np.diff(u, axis=1, append=u[:, -1:])
        return 0.1 * np.sqrt(down**2 + right**2).sum() + ((u - v) ** 2).sum() / 2

    u = stencil.denoise_slice(v, 0.1, eps=1e-9, most=3000)
    assert np.isclose(u.mean(), v.mean())
    best = energy(u)
    assert best < energy(v) and best < energy(np.full_like(v, v.mean()))
    for _ in range(200):  # the energy is convex: no step to anywhere lowers it
        step = rng.normal(0, 1, v.shape) * 10.0 ** rng.uniform(-3, -1) * (rng.random(v.shape) < rng.random())
        assert energy(u + step) >= best - 1e-4
    for other in (v, np.full_like(v, v.mean())):
        assert energy(0.95 * u + 0.05 * other) >= best - 1e-4


def test_segmentation_is_that_of_plain_loops(spark):
    a = np.random.default_rng(15).integers(0, 256, (4, 8, 8))
    got = pipelines.segment(frame(spark, a, "int"), a.shape, 100, block=8, step=2)
    segment, grey = array(got, a.shape, "segment"), array(got, a.shape, "grey")

    v = unit(np.where(a < 100, 0, a).astype(float))
    labels = plain_snic(v, 2, 10.0)
    mean = {k: v[labels == k].mean() for k in np.unique(labels).tolist()}
    edges = set()
    for axis in range(3):
        one, two = np.moveaxis(labels, axis, 0)[:-1].ravel().tolist(), np.moveaxis(labels, axis, 0)[1:].ravel().tolist()
        edges |= {(p, q) for p, q in [*zip(one, two, strict=True), *zip(two, one, strict=True)] if p != q}
    iso = 100 / 256
    owner = {k: s for k, s in plain_growth(mean, edges, iso, 256).items() if s}
    members = {s: [k for k in owner if owner[k] == s] for s in set(owner.values())}
    order = sorted(members, key=lambda s: (np.mean([mean[k] for k in members[s]]), s))
    number = {s: i for i, s in enumerate(order, 1)}
    want = np.vectorize(lambda k: number[owner[k]] if k in owner else 0)(labels)
    assert len(order) > 1 and np.array_equal(segment, want)
    assert np.array_equal(grey, want * 256 // (len(order) + 1))
