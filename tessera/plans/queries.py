"""A query for each operator over volumes derived from the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import neighbours, pool, spatial, stats, stencil, superpixels
from tessera.plans import pipelines
from tessera.sources import volume
from tessera.sources.shared import Scratch

D = 16
SHAPE = (D, D, D)
CELL = 4
ISO = 230
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _axis(n: int) -> str:
    return f"(select cast(range as int) as i from range({n}))"


def _vol(size: int = D, measure: str = "l_quantity") -> str:
    return f"""(select a.i as z, b.i as y, c.i as x, coalesce(r.v, 0) as v from {_axis(size)} a cross join {_axis(size)} b cross join {_axis(size)} c
        left join (select l_orderkey % {size} as z, l_partkey % {size} as y, l_suppkey % {size} as x, cast(sum({measure}) as bigint) % 256 as v from lineitem group by 1, 2, 3) r
        on r.z = a.i and r.y = b.i and r.x = c.i)"""


VOL, INK = _vol(), _vol(measure="l_linenumber * 37")
CELLS = f"(select z, y, x, v, cast((z // {CELL} * {D // CELL} + y // {CELL}) * {D // CELL} + x // {CELL} as int) as label from {VOL})"
PTS = "(select event_id as pid, cast(user_id % 50 as int) as z, cast(event_id % 97 as int) as y, cast(floor(value) as int) as x from events)"
STATS = f"(select label, avg(z) as z, avg(y) as y, avg(x) as x, avg(v / 255.0) as c, count(*) as n from {CELLS} group by 1)"
FACE_STEPS = "(values (0, 0, 1), (0, 0, -1), (0, 1, 0), (0, -1, 0), (1, 0, 0), (-1, 0, 0)) o(a, b, c)"


def vol(spark: SparkSession, sf: str) -> DataFrame:
    return volume.from_lineitem(spark, sf, D)


def cells(spark: SparkSession, sf: str) -> DataFrame:
    return volume.grid_labels(vol(spark, sf), D, CELL)


def cell_stats(spark: SparkSession, sf: str) -> DataFrame:
    return superpixels.label_stats(cells(spark, sf), full=255)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# --- scans, projections, filters


@query(f"select z - 2 as z, y, x - 4 as x, v from {VOL} where z >= 2 and z < 9 and y < 7 and x >= 4 and x < 12")
def vol_scan_slice(spark, sf):
    return volume.cuboid(vol(spark, sf), (2, 0, 4), (7, 7, 8), SHAPE)


@query("select cast(vec_id as int) as z, cast((i - 1) // 8 as int) as y, cast((i - 1) % 8 as int) as x, round(cast(embedding[i] as double), 6) as v from embeddings, (select unnest(range(1, 65)) as i)")
def embedding_volume(spark, sf):
    return volume.from_embeddings(spark, sf).withColumn("v", r6(F.col("v").cast("double")))


@query(f"select z, y, x, v & 240 as v, ((v * 257) >> 8) & 240 as w from {VOL}")
def quantize_4bit(spark, sf):
    return vol(spark, sf).select("z", "y", "x", S.high_nibble(F.col("v")).alias("v"), S.to_byte(F.col("v") * 257).alias("w"))


@query(f"select z, y, x, round((v - (select min(v) from {VOL})) / (select cast(max(v) - min(v) as double) from {VOL}), 6) as v from {VOL}")
def rescale_minmax(spark, sf):
    return stats.rescale(vol(spark, sf)).withColumn("v", r6("v"))


@query(f"select z, y, x, cast(0 as double) as v from {VOL}")
def rescale_constant(spark, sf):
    return stats.rescale(vol(spark, sf).withColumn("v", F.lit(7)))


@query(f"select z, y, x, case when v = 0 then 0 else 255 - v end as v, case when v < 100 then 0 else v end as w from {VOL}")
def mask_preserving(spark, sf):
    return vol(spark, sf).select("z", "y", "x", S.keep_void(F.col("v"), 255 - F.col("v")).alias("v"), S.zero_below(F.col("v"), 100).alias("w"))


@query(f"select z, y, x, cast(floor(v / 255.0 * 255) as int) as v, round(v / 255.0, 6) as f from {VOL}")
def scale_byte(spark, sf):
    return vol(spark, sf).select("z", "y", "x", S.scale_to_byte(F.col("v") / 255.0).alias("v"), r6(F.col("v") / 255.0).alias("f"))


@query(f"select z, y, x, round(255 * cast(v - low as double) / (high - low), 6) as v from {VOL}, (select min(v) as low, max(v) as high from {VOL})")
def linear_stretch(spark, sf):
    return stats.with_range(vol(spark, sf)).select("z", "y", "x", r6(S.linear_stretch(F.col("v"), F.col("low"), F.col("high"))).alias("v"))


@query(f"select z, y, x, case when v % 3 = 0 then 0.0 when v % 3 = 1 then 255.0 else least(255.0, greatest(0.0, cast(v * 2 - 100 as double))) end as v from {VOL}")
def clip_scrub(spark, sf):
    raw = F.when(F.col("v") % 3 == 0, F.lit(float("nan"))).when(F.col("v") % 3 == 1, F.lit(float("inf"))).otherwise((F.col("v") * 2 - 100).cast("double"))
    return vol(spark, sf).select("z", "y", "x", S.scrub(raw).alias("v"))


@query(f"select z, y, x, v from {VOL} where v >= round(128 / 256.0 * 256)")
def iso_normalise(spark, sf):
    return vol(spark, sf).where(F.col("v") / 256.0 >= S.normalised_iso(128))


@query(f"select z, y, x, cast(case when v <= 127 then 0.0 when v < 128 then v - 127.0 else 1.0 end as double) as a from {VOL}")
def opacity_transfer(spark, sf):
    return vol(spark, sf).select("z", "y", "x", S.opacity(F.col("v"), 128).cast("double").alias("a"))


@query(f"select z, y, x, case when label = 21 then 255 else 0 end as v from {CELLS}")
def segment_highlight(spark, sf):
    return cells(spark, sf).select("z", "y", "x", S.highlight(F.col("label"), 21).alias("v"))


@query(f"select a.z as z, a.y as y, a.x as x, case when a.v >= 128 then b.v else 0 end as v from {VOL} a join {INK} b on a.z = b.z and a.y = b.y and a.x = b.x")
def blend_ink(spark, sf):
    ink = volume.from_lineitem(spark, sf, D, "l_linenumber", 37).withColumnRenamed("v", "ink")
    both = vol(spark, sf).join(ink, ["z", "y", "x"], "left")
    return both.select("z", "y", "x", F.when(F.col("v") >= 128, F.coalesce("ink", F.lit(0))).otherwise(0).alias("v"))


@query(f"select pid, cast(least(15, greatest(0, round_even((z - 1.0) / 4.0, 0))) as int) as z, cast(least(15, greatest(0, round_even((y - 0.0) / 6.0, 0))) as int) as y from {PTS}")
def world_to_voxel(spark, sf):
    return volume.points(spark, sf).select("pid", S.world_to_voxel(F.col("z"), 1.0, 4.0, 16).alias("z"), S.world_to_voxel(F.col("y"), 0.0, 6.0, 16).alias("y"))


@query("select o_orderkey, cast(o_orderkey % 24 // 12 - 1 as int) as dz, cast(o_orderkey % 24 // 4 % 3 - 1 as int) as dy, cast(o_orderkey % 4 - 2 as int) as dx from orders")
def index_to_offset(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    return orders.select("o_orderkey", S.tap_offset(F.col("o_orderkey") % 24, (2, 3, 4)).alias("o")).select("o_orderkey", "o.dz", "o.dy", "o.dx")


@query(f"select z, y, x, cast((z * {D} + y) * {D} + x as bigint) as c, cast((x * {D} + y) * {D} + z as bigint) as f, x as tz, z as ty, y as tx from {VOL}")
def transpose_linear(spark, sf):
    return vol(spark, sf).select("z", "y", "x", S.linear_index(SHAPE).alias("c"), S.linear_index(SHAPE, "F").alias("f"), F.col("x").alias("tz"), F.col("z").alias("ty"), F.col("y").alias("tx"))


# --- dimensions, names, sets

SCANS = [(1, "/volumes/one", ["20240101120000", "20240102120000"]), (2, "/volumes/two", ["20240201120000"]), (3, "/volumes/three", []), (4, "/volumes/four", ["20240401120000", "20240402120000", "20240403120000"])]
_SCANS = "(values " + ", ".join(f"({i}, '{p}', {t}::varchar[])" for i, p, t in SCANS) + ") s(scroll, path, stamps)"


def scans(spark):
    return spark.createDataFrame(SCANS, "scroll int, path string, stamps array<string>")


@query("select r_regionkey as scroll, '/volumes/' || lower(r_name) as path, n_name as stamp from region join nation on n_regionkey = r_regionkey")
def scroll_dim(spark, sf):
    nation = spark.read.parquet(f"{sf}/nation.parquet").groupBy("n_regionkey").agg(F.collect_list("n_name").alias("stamps"))
    region = spark.read.parquet(f"{sf}/region.parquet").select(F.col("r_regionkey").alias("scroll"), F.concat(F.lit("/volumes/"), F.lower("r_name")).alias("path"))
    dim = region.join(nation, region.scroll == nation.n_regionkey)
    return dim.select("scroll", "path", F.explode("stamps").alias("stamp"))


@query(
    f"select o_orderkey, s.path || '/' || stamps[1] || '/' || printf('cell_yxz_%03d_%03d_%03d.tif', o_orderkey % 7, o_orderkey % 11, o_orderkey % 13) as url "
    f"from orders join {_SCANS} on o_orderkey % 4 + 1 = scroll where len(stamps) > 0"
)
def cell_urls(spark, sf):
    k = F.col("o_orderkey")
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", (k % 4 + 1).cast("int").alias("scroll"))
    rows = orders.join(F.broadcast(scans(spark).where(F.size("stamps") > 0)), "scroll")  # four rows
    url = F.concat_ws("/", F.lit("https:/"), F.substring("path", 2, 100), F.element_at("stamps", 1), S.cell_name(k % 7, k % 11, k % 13))
    return rows.select("o_orderkey", S.cache_path(url, "").alias("url"))


_PARTS = "(select p_brand || '-' || p_partkey || case when p_size % 3 = 0 then '.tiff' else '.tif' end as name from part)"


@query(f"select name, cast(row_number() over (order by case when name like '%.tiff' then 0 else 1 end, name) - 1 as int) as z from {_PARTS}")
def stack_union(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet")
    names = [part.where(which).select(F.concat_ws("-", "p_brand", F.concat(F.col("p_partkey").cast("string"), F.lit(end))).alias("name")) for which, end in (("p_size % 3 = 0", ".tiff"), ("p_size % 3 <> 0", ".tif"))]
    return volume.stack(names[0].unionByName(names[1]))


@query(f"select distinct a.i as z from {_axis(40)} a where not exists (select 1 from {VOL} v where v.z = a.i and v.v > 128)")
def missing_slices(spark, sf):
    wanted = spark.range(40).select(F.col("id").cast("int").alias("z"))
    return volume.missing(wanted, vol(spark, sf).where("v > 128").select("z").distinct())


@query(f"select pid, z, y, x from {PTS} where pid % 2 = 0 union select pid + 1000000, z, y, x from {PTS} where pid % 3 = 0 except select pid, z, y, x from {PTS} where z = 0")
def point_sets(spark, sf):
    p = volume.points(spark, sf)
    added = p.where("pid % 3 = 0").select((F.col("pid") + 1000000).alias("pid"), "z", "y", "x")
    return p.where("pid % 2 = 0").unionByName(added).distinct().subtract(p.where("z = 0"))


# --- pools


def _pool_sql(agg: str, k: int, s: int, d: int, arg: bool = False) -> str:
    before, out = S.padding(D, k, s), -(-D // s)
    on = " and ".join(f"v.{c} = o.{c} * {s} - {before} + t.{c} * {d}" for c in "zyx")
    taps = f"(select a.i as z, b.i as y, c.i as x from {_axis(k)} a cross join {_axis(k)} b cross join {_axis(k)} c)"
    outs = f"(select a.i as z, b.i as y, c.i as x from {_axis(out)} a cross join {_axis(out)} b cross join {_axis(out)} c)"
    value = agg if arg else f"cast({agg}(v.v) as float)"
    return f"select o.z as z, o.y as y, o.x as x, {value} as v from {outs} o cross join {taps} t join {VOL} v on {on} group by 1, 2, 3"


def _pooled(name: str, how: str, k: int, s: int, d: int = 1):
    def run(spark, sf):
        return pool.pool(vol(spark, sf), SHAPE, how, (k,) * 3, (s,) * 3, (d,) * 3)

    run.__name__ = name
    query(_pool_sql(how, k, s, d))(run)


for _name, _how, _k, _s, _d in [("avgpool", "avg", 3, 2, 1), ("maxpool", "max", 3, 2, 1), ("minpool", "min", 3, 2, 1), ("sumpool", "sum", 3, 2, 1), ("pool_dilated", "avg", 3, 1, 2), ("downscale", "sum", 2, 2, 1), ("sumpool_wide", "sum", 5, 1, 1)]:
    _pooled(_name, _how, _k, _s, _d)

_I, _FAR = "((t.z * 3 + t.y) * 3 + t.x)", "(abs(t.z - 1) + abs(t.y - 1) + abs(t.x - 1))"


@query(_pool_sql(f"cast(arg_max({_I}, v.v * 1000000 - {_FAR} * 1000 - {_I}) as int)", 3, 2, 1, True))
def argmaxpool(spark, sf):
    return pool.arg_pool(vol(spark, sf), SHAPE, "max", (3,) * 3, (2,) * 3)


@query(_pool_sql(f"cast(arg_min({_I}, v.v * 1000000 + {_FAR} * 1000 + {_I}) as int)", 3, 2, 1, True))
def argminpool(spark, sf):
    return pool.arg_pool(vol(spark, sf), SHAPE, "min", (3,) * 3, (2,) * 3)


# --- histograms and contrast

HIST = f"(select a.i as bin, coalesce(n, 0) as n, coalesce(n, 0) / cast({D**3} as double) as p from {_axis(256)} a left join (select v, count(*) as n from {VOL} group by 1) h on h.v = a.i)"


def _lut(lam: float) -> str:
    return f"(select bin, h as p, cast(least(ceil(255 * sum(h) over (order by bin) + 0.5 - 1e-9), 255) as int) as t from (select bin, p / (1 + {lam}) + {lam / (1 + lam) / 256!r} as h from {HIST}))"


def hist(spark, sf):
    return stats.histogram(vol(spark, sf).select(F.col("v").alias("bin")))


@query(f"select bin, n, round(p, 6) as p, round(1 / 256.0, 6) as u from {HIST}")
def histogram256(spark, sf):
    return hist(spark, sf).select("bin", "n", r6("p").alias("p"), r6(F.lit(1 / 256)).alias("u"))


@query(f"select z, y, x, v, t from {VOL} join {_lut(1.0)} l on l.bin = v")
def cdf_lut(spark, sf):
    levels = stats.level_map(hist(spark, sf), 1.0).select(F.col("bin").alias("v"), "t")
    return vol(spark, sf).join(F.broadcast(levels), "v").select("z", "y", "x", "v", "t")  # 256 rows


@query(f"select cast(max(gap) as int) as gap from (select max(bin) - min(bin) as gap from {_lut(0.25)} group by t)")
def contrast_gap(spark, sf):
    return stats.contrast_gap(stats.level_map(hist(spark, sf), 0.25))


_EQ = f"""(select z, y, x, v, i, s, t as g, case when t <= i then t / (i + 1e-8) * s else (255 - t) / (255 - i + 1e-8) * (s - i) + t end as y_g from
    (select z, y, x, v, 255 * cast(v - low as double) / (high - low + 1e-8) as s, cast(floor(least(255.0, greatest(0.0, 255 * cast(v - low as double) / (high - low + 1e-8)))) as int) as i
     from {VOL}, (select min(v) as low, max(v) as high from {VOL})) q
    join (select bin, cast(least(ceil(255 * sum(h) over (order by bin) + 0.5 - 1e-9), 255) as int) as t from
      (select a.i as bin, coalesce(n, 0) / cast({D**3} as double) / 2.0 + {0.5 / 256!r} as h from {_axis(256)} a left join
        (select cast(floor(least(255.0, greatest(0.0, 255 * cast(v - low as double) / (high - low + 1e-8)))) as int) as b, count(*) as n from {VOL}, (select min(v) as low, max(v) as high from {VOL}) group by 1) h on h.b = a.i)) l
    on l.bin = q.i)"""


@query(f"select z, y, x, i, g, round(y_g, 5) as v from {_EQ}")
def glce_fixed_lambda(spark, sf):
    return stats.equalise(vol(spark, sf), 1.0).select("z", "y", "x", "i", "g", F.round("y_g", 5).alias("v"))


@query(f"select z, y, x, round(case when w <= v then w / (v + 1e-8) * v else (255 - w) / (255 - v + 1e-8) * (v - v) + w end, 6) as h from (select a.z as z, a.y as y, a.x as x, cast(a.v as double) as v, cast(b.v as double) as w from {VOL} a join {INK} b on a.z = b.z and a.y = b.y and a.x = b.x)")
def hue_preserve(spark, sf):
    ink = volume.from_lineitem(spark, sf, D, "l_linenumber", 37).withColumnRenamed("v", "w")
    v, w = F.col("v").cast("double"), F.col("w").cast("double")
    return vol(spark, sf).join(ink, ["z", "y", "x"]).select("z", "y", "x", r6(S.preserve_hue(w, v, v)).alias("h"))


# --- stencils

_LAP_TAPS = "(values (0, 0, -8), (-1, -1, 2), (-1, 1, 2), (1, -1, 2), (1, 1, 2)) o(b, c, w)"
_MIRROR = lambda c, o: f"case when a.{c} + o.{o} < 0 then 1 when a.{c} + o.{o} > {D - 1} then {D - 2} else a.{c} + o.{o} end"
LAP = f"(select a.z as z, a.y as y, a.x as x, sum(q.v * o.w) as v from {VOL} a cross join {_LAP_TAPS} join {VOL} q on q.z = a.z and q.y = {_MIRROR('y', 'b')} and q.x = {_MIRROR('x', 'c')} group by 1, 2, 3)"


@query(f"select z, y, x, cast(v as double) as v from {LAP}")
def laplacian(spark, sf):
    return stencil.laplacian(vol(spark, sf), SHAPE)


@query(
    f"select l.z as z, l.y as y, l.x as x, round(least(least(abs(l.v), 255) / (top + 1e-8) + 1e-5, exp(-power((b.v - low) / (high - low) - 0.5, 2) / 0.08)), 6) as w from {LAP} l "
    f"join {VOL} b on l.z = b.z and l.y = b.y and l.x = b.x, (select max(least(abs(v), 255)) as top from {LAP}), (select cast(min(v) as double) as low, cast(max(v) as double) as high from {VOL})"
)
def fusion_weights(spark, sf):
    return stencil.fusion_weights(vol(spark, sf), SHAPE).withColumn("w", r6("w"))


def _gauss(sigma: float) -> str:
    w = stencil.gaussian_weights(sigma)
    taps = "(values " + ", ".join(f"({k - len(w) // 2}, {x!r}::double)" for k, x in enumerate(w)) + ") o(d, w)"
    out = VOL
    for axis in "zyx":
        on = " and ".join(f"q.{c} = " + (f"least(greatest(a.{c} + o.d, 0), {D - 1})" if c == axis else f"a.{c}") for c in "zyx")
        out = f"(select a.z as z, a.y as y, a.x as x, sum(q.v * o.w) as v from {VOL} a cross join {taps} join {out} q on {on} group by 1, 2, 3)"
    return out


@query(f"select z, y, x, round(v, 5) as v from {_gauss(2.0)}")
def gaussian_sep(spark, sf):
    return stencil.gaussian(vol(spark, sf), SHAPE, 2.0).withColumn("v", F.round("v", 5))


@query(f"select a.z as z, a.y as y, a.x as x, round(least(255.0, greatest(0.0, a.v + 2.0 * (a.v - g.v))), 5) as v from {VOL} a join {_gauss(4.0)} g on a.z = g.z and a.y = g.y and a.x = g.x")
def unsharp(spark, sf):
    return stencil.unsharp(vol(spark, sf), SHAPE, 4.0, 2.0, 0.0, 255.0).withColumn("v", F.round("v", 5))


@query()
def clahe_slice(spark, sf):
    return stencil.clahe_slices(stats.rescale(vol(spark, sf)), SHAPE, tiles=4).withColumn("v", r6("v"))


@query()
def clahe_3d(spark, sf):
    return stencil.clahe(stats.rescale(vol(spark, sf)), SHAPE, (4, 4, 4), bins=64, clip=0.64).withColumn("v", r6("v"))


@query()
def tv_denoise(spark, sf):
    return stencil.tv_denoise(stats.rescale(vol(spark, sf)), SHAPE).withColumn("v", r6("v"))


@query()
def glce_searched_lambda(spark, sf):
    return stats.equalise(vol(spark, sf), stats.best_blend(hist(spark, sf))).select("z", "y", "x", "i", "g")


@query()
def contrast_3d(spark, sf):
    return stencil.local_global_contrast(vol(spark, sf), SHAPE).withColumn("v", r6("v"))


# --- neighbours and labels


@query(f"select a.z as z, a.y as y, a.x as x, count(*) as n, cast(sum(q.v) as bigint) as s from {VOL} a cross join {FACE_STEPS} join {VOL} q on q.z = a.z + o.a and q.y = a.y + o.b and q.x = a.x + o.c group by 1, 2, 3")
def face_neighbors(spark, sf):
    return neighbours.face_pairs(vol(spark, sf)).groupBy("z", "y", "x").agg(F.count("*").alias("n"), F.sum("other").alias("s"))


@query(f"select a.z as z, a.y as y, a.x as x, q.z as nz, q.y as ny, q.x as nx from {VOL} a cross join {FACE_STEPS} join {VOL} q on q.z = a.z + o.a and q.y = a.y + o.b and q.x = a.x + o.c where a.v > 200 and q.v <= 200")
def iso_faces(spark, sf):
    return neighbours.iso_faces(vol(spark, sf), 200)


ADJ = f"(select a.label as src, q.label as dst, cast(sum(q.v) as double) as weight from {CELLS} a cross join {FACE_STEPS} join {CELLS} q on q.z = a.z + o.a and q.y = a.y + o.b and q.x = a.x + o.c where a.label <> q.label group by 1, 2)"


@query(f"select * from {ADJ}")
def label_adjacency(spark, sf):
    return neighbours.label_adjacency(cells(spark, sf))


@query(f"select src as label, array_to_string(list(dst order by dst), ',') as neighs, cast(0 as int) as overflow from {ADJ} group by 1")
def neighbor_sets(spark, sf):
    sets = neighbours.neighbour_sets(neighbours.label_adjacency(cells(spark, sf)))
    return sets.select("label", F.concat_ws(",", F.transform("neighs", lambda x: x.cast("string"))).alias("neighs"), "overflow")


@query(f"select src % 8 as src, dst % 8 as dst, sum(weight) as weight from {ADJ} where src % 8 <> dst % 8 group by 1, 2")
def segment_connectivity(spark, sf):
    labelled = cells(spark, sf)
    mapping = labelled.select("label", (F.col("label") % 8).alias("segment")).distinct()
    return neighbours.merge_labels(neighbours.label_adjacency(labelled), mapping)


CC = f"""with recursive pix as (select cast((z * {D} + y) * {D} + x as bigint) as id, z, y, x from {VOL} where v > {ISO}),
    edge as (select a.id as a, b.id as b from pix a join pix b on a.z - b.z between -1 and 1 and a.y - b.y between -1 and 1 and a.x - b.x between -1 and 1),
    reach as (select id, id as r from pix union select reach.id, edge.b from reach join edge on reach.r = edge.a),
    cc as (select p.z as z, p.y as y, p.x as x, min(r) as component from reach join pix p on p.id = reach.id group by 1, 2, 3)"""


def labelled_components(spark, sf):
    return neighbours.label_components(vol(spark, sf), SHAPE, ISO)


@query(f"{CC} select z, y, x, component from cc")
def cc_labels(spark, sf):
    return labelled_components(spark, sf)


@query(f"{CC} select component, count(*) as size, cast(dense_rank() over (order by component) as int) as label from cc group by 1")
def cc_sizes(spark, sf):
    from pyspark.sql.window import Window

    sizes = labelled_components(spark, sf).groupBy("component").agg(F.count("*").alias("size"))
    return sizes.select("component", "size", F.dense_rank().over(Window.orderBy("component")).alias("label"))


@query(f"{CC} select component, count(*) as size, component // {D * D} as sz, component // {D} % {D} as sy, component % {D} as sx, round(avg(z), 6) as cz, round(avg(y), 6) as cy, round(avg(x), 6) as cx from cc group by 1")
def cc_info(spark, sf):
    info = neighbours.component_info(labelled_components(spark, sf))
    s = lambda c: F.col(f"sample_point.{c}").cast("long").alias(f"s{c}")
    return info.select("component", "size", s("z"), s("y"), s("x"), *[r6(f"c{c}").alias(f"c{c}") for c in "zyx"])


def _cc_removed(bad: str) -> str:
    return f"{CC} select v.z as z, v.y as y, v.x as x, case when s.component is null then v.v else 0 end as v from {VOL} v left join cc on cc.z = v.z and cc.y = v.y and cc.x = v.x left join (select component from cc group by 1 having {bad}) s on s.component = cc.component"


@query(_cc_removed("count(*) < 4"))
def cc_remove_small(spark, sf):
    return neighbours.remove_components(vol(spark, sf), labelled_components(spark, sf), min_size=4)


@query(_cc_removed("count(*) > 10"))
def cc_remove_large(spark, sf):
    return neighbours.remove_components(vol(spark, sf), labelled_components(spark, sf), max_size=10)


# --- points: every id divisible by 50 asks all

_PAIRS = f"(select q.pid as query_id, p.pid as pid, (q.z - p.z) * (q.z - p.z) + (q.y - p.y) * (q.y - p.y) + (q.x - p.x) * (q.x - p.x) as d2 from {PTS} q cross join {PTS} p where q.pid % 50 = 0)"


@query(f"select query_id, cast(rank as int) as rank, round(sqrt(d2), 6) as dist, pid from (select *, row_number() over (partition by query_id order by d2, pid) as rank from {_PAIRS} where d2 < 100) where rank <= 3")
def knn_points(spark, sf):
    p = volume.points(spark, sf)
    return spatial.nearest(p, p.where("pid % 50 = 0"), k=3, max_distance=10.0).withColumn("dist", r6("dist"))


@query(f"select query_id, round(sqrt(d2), 6) as dist, pid from {_PAIRS} where d2 <= 100")
def radius_points(spark, sf):
    p = volume.points(spark, sf)
    return spatial.within(p, p.where("pid % 50 = 0"), 10.0, digits=6)


# --- blocks: a cube whose edge follows the rows of lineitem (30 at scale 0.01, 64 at 0.1)


PER_VOXEL = 0.4368
_EDGE = f"(select cast(ceil(cbrt(count(*) * {PER_VOXEL})) as int) as n from lineitem)"
CUBE = f"""(with e as {_EDGE}, ax as (select cast(unnest(range(n)) as int) as i from e)
        select a.i as z, b.i as y, c.i as x, coalesce(r.v, 0) as v, n from e cross join ax a cross join ax b cross join ax c
        left join (select l_orderkey % n as z, l_partkey % n as y, l_suppkey % n as x, cast(sum(l_quantity) as bigint) % 256 as v from lineitem, e group by 1, 2, 3) r
        on r.z = a.i and r.y = b.i and r.x = c.i)"""


def cube(spark, sf):
    """(volume, shape)"""
    n = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    edge = math.ceil(math.cbrt(n * PER_VOXEL))
    return volume.from_lineitem(spark, sf, edge), (edge,) * 3


BLOCK = 16


def _cube_gauss(sigma: float) -> str:
    w = stencil.gaussian_weights(sigma)
    taps = "(values " + ", ".join(f"({k - len(w) // 2}, {x!r}::double)" for k, x in enumerate(w)) + ") o(d, w)"
    out = "cube"
    for axis in "zyx":
        on = " and ".join(f"q.{c} = " + (f"least(greatest(a.{c} + o.d, 0), a.n - 1)" if c == axis else f"a.{c}") for c in "zyx")
        out = f"(select a.z as z, a.y as y, a.x as x, sum(q.v * o.w) as v from cube a cross join {taps} join {out} q on {on} group by 1, 2, 3)"
    return out


@query(f"with cube as materialized {CUBE} select z, y, x, round(v, 5) as v from {_cube_gauss(1.0)}")
def blocks_gaussian(spark, sf):
    vol, shape = cube(spark, sf)
    return stencil.gaussian(vol, shape, 1.0, BLOCK).withColumn("v", F.round("v", 5))


@query(f"with cube as materialized {CUBE} select a.z as z, a.y as y, a.x as x, round(least(255.0, greatest(0.0, a.v + 2.0 * (a.v - g.v))), 5) as v from cube a join {_cube_gauss(1.5)} g on a.z = g.z and a.y = g.y and a.x = g.x")
def blocks_unsharp(spark, sf):
    vol, shape = cube(spark, sf)
    return stencil.unsharp(vol, shape, 1.5, 2.0, 0.0, 255.0, BLOCK).withColumn("v", F.round("v", 5))


_CORNERS = "(values (-1, -1, 2), (-1, 1, 2), (1, -1, 2), (1, 1, 2), (0, 0, -8)) o(b, c, w)"
_MIRROR = "case when a.{0} + o.{1} < 0 then 1 when a.{0} + o.{1} >= a.n then a.n - 2 else a.{0} + o.{1} end"


@query(f"with cube as materialized {CUBE} select a.z as z, a.y as y, a.x as x, cast(sum(q.v * o.w) as double) as v from cube a cross join {_CORNERS} join cube q on q.z = a.z and q.y = {_MIRROR.format('y', 'b')} and q.x = {_MIRROR.format('x', 'c')} group by 1, 2, 3")
def blocks_laplacian(spark, sf):
    vol, shape = cube(spark, sf)
    return stencil.laplacian(vol, shape, BLOCK)


CUBE_ISO = 110


_STEPS = "(select a.i as dz, b.i as dy, c.i as dx from (values (-1), (0), (1)) a(i), (values (-1), (0), (1)) b(i), (values (-1), (0), (1)) c(i))"


@query(f"""with recursive cube as materialized {CUBE},
    pix as materialized (select cast((z * n + y) * n + x as bigint) as id, z, y, x from cube where v > {CUBE_ISO}),
    edge as materialized (select a.id as a, b.id as b from (select id, z + dz as z, y + dy as y, x + dx as x from pix, {_STEPS}) a join pix b on b.z = a.z and b.y = a.y and b.x = a.x),
    reach as (select a as id, a as r from edge union select reach.id, edge.b from reach join edge on reach.r = edge.a)
    select p.z as z, p.y as y, p.x as x, min(r) as component from reach join pix p on p.id = reach.id group by 1, 2, 3""")
def blocks_components(spark, sf):
    vol, shape = cube(spark, sf)
    return neighbours.label_components(vol, shape, CUBE_ISO, BLOCK)


@query()
def tv_tiles(spark, sf):
    vol, shape = cube(spark, sf)
    return stencil.tv_denoise(stats.rescale(vol), shape, tile=BLOCK).withColumn("v", r6("v"))


@query()
def snic_blocks(spark, sf):
    vol, shape = cube(spark, sf)
    return superpixels.snic(stats.rescale(vol), shape, block=BLOCK, step=8).select("z", "y", "x", "label")


# --- superpixels and segments


@query(f"select cast(ceil((max(vec_id) + 1 - {CELL // 2}) / {CELL}.0) * {S.seed_count((CELL, 8, 8), CELL)} as bigint) as n from embeddings")
def snic_seed_count(spark, sf):
    half = CELL // 2
    on_grid = " and ".join(f"{a} >= {half} and ({a} - {half}) % {CELL} = 0" for a in "zyx")
    return volume.from_embeddings(spark, sf).where(on_grid).agg(F.count("*").alias("n"))


@query(f"select label, round(avg(z), 6) as z, round(avg(y), 6) as y, round(avg(x), 6) as x, round(avg(v / 255.0), 6) as c, count(*) as n, count(*) filter (v <= 80) as nlow, count(*) filter (v > 80 and v <= 160) as nmid, count(*) filter (v > 160) as nhig from {CELLS} group by 1")
def superpixel_stats(spark, sf):
    return cell_stats(spark, sf).select("label", *[r6(c).alias(c) for c in "zyxc"], "n", "nlow", "nmid", "nhig")


@query(f"select label, cast(least(floor(c * 16), 15) as int) as bin from {STATS}")
def bin_superpixels(spark, sf):
    return superpixels.binned(cell_stats(spark, sf), 16).select("label", "bin")


@query(f"select cast(row_number() over (order by least(floor(c * 16), 15) desc, c desc, label) as int) as segment, label from {STATS} order by 1 limit 10")
def top_seeds(spark, sf):
    return superpixels.seeds(cell_stats(spark, sf), 16, 10)


@query(f"select label % 8 as segment, round(avg(c), 6) as mean_c, count(*) as n, cast(row_number() over (order by avg(c), label % 8) - 1 as int) as rank from {STATS} where label % 8 > 0 group by label % 8")
def segment_ranks(spark, sf):
    about = cell_stats(spark, sf)
    return superpixels.rank_segments(about, about.select("label", (F.col("label") % 8).alias("segment"))).withColumn("mean_c", r6("mean_c"))


@query(f"select z, y, x, coalesce(case when label % 3 > 0 then label % 8 end, 0) as segment, cast(coalesce(case when label % 3 > 0 then label % 8 end, 0) * 256 // 8 as int) as grey from {CELLS}")
def paint_segments(spark, sf):
    labelled = cells(spark, sf)
    mapping = labelled.where("label % 3 > 0").select("label", (F.col("label") % 8).alias("segment")).distinct()
    return superpixels.paint(labelled, mapping, 8)


@query()
def snic_labels(spark, sf):
    return superpixels.snic(stats.rescale(vol(spark, sf)), SHAPE, block=8, step=4).select("z", "y", "x", "label")


@query()
def snic_stats(spark, sf):
    out = superpixels.label_stats(superpixels.snic(stats.rescale(vol(spark, sf)), SHAPE, block=8, step=4))
    return out.select("label", *[r6(c).alias(c) for c in "zyxc"], "n", "nlow", "nmid", "nhig")


@query()
def region_grow(spark, sf):
    labelled = cells(spark, sf)
    return superpixels.grow(cell_stats(spark, sf), neighbours.label_adjacency(labelled), 0.45, most=4)


# --- chains and stores


@query()
def load_preprocess(spark, sf):
    return pipelines.preprocess(vol(spark, sf), SHAPE, factor=2)[0].withColumn("v", F.round("v", 3))


@query()
def etl_slices(spark, sf):
    return pipelines.clean_slices(vol(spark, sf), SHAPE)


@query()
def do_segmentation(spark, sf):
    return pipelines.segment(vol(spark, sf), SHAPE, 100, block=8)


@query(f"select z - 3 as z, y - 1 as y, x - 2 as x, v from {VOL} where z >= 3 and z < 11 and y >= 1 and y < 6 and x >= 2 and x < 16")
def volume_store(spark, sf):
    store = volume.VolumeStore(spark, Scratch(spark, "store").root, SHAPE, block=4)
    store.create(vol(spark, sf), "v")
    return store.chunk("v", (3, 1, 2), (8, 5, 14))


@query(f"select z, y - 2 as y, x - 3 as x, cast(v as float) as v from {INK} where y >= 2 and y < 10 and x >= 3 and x < 11 and z < 10")
def ink_store(spark, sf):
    """A second volume, stored in the order y, x, z of its own; a cuboid of it is read and turned round."""
    ink = volume.from_lineitem(spark, sf, D, "l_linenumber", 37)
    store = volume.VolumeStore(spark, Scratch(spark, "store").root, SHAPE, block=4)
    store.create(ink.select(F.col("y").alias("z"), F.col("x").alias("y"), F.col("z").alias("x"), "v"), "ink")
    return volume.transposed(store.chunk("ink", (2, 3, 0), (8, 8, 10)), "yxz")


@query(f"select z, y, x, round((v - (select min(v) from {VOL})) / (select cast(max(v) - min(v) as double) from {VOL}), 6) as v from {VOL}")
def rescale_stored(spark, sf):
    store = volume.VolumeStore(spark, Scratch(spark, "store").root, SHAPE, block=4)
    store.create(vol(spark, sf), "v")
    return stats.rescale(store.read("v"), store.range("v")).withColumn("v", r6("v"))


def entry(spark: SparkSession, sf: str) -> DataFrame:
    """Scan, cut, downscale, rescale and count the levels of a volume."""
    part = volume.cuboid(volume.from_lineitem(spark, sf, 8), (0, 0, 0), (8, 8, 8), (8, 8, 8))
    small = stats.rescale(pool.downscale(part, (8, 8, 8), 2))
    return stats.histogram(small.select(S.scale_to_byte(F.col("v")).alias("bin")))
