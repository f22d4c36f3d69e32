"""Pooling: strided, dilated windows over a dense voxel table (z, y, x, v).

A voxel is sent to the windows that hold it (no join); partial aggregation runs before the one shuffle on the window.
Windows that tile the volume need no copies at all. Sum, mean, least and greatest are separable: where the copies of a
voxel would be many, they run as three passes along one axis each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import padding

Triple = tuple[int, int, int]
#: Copies of a voxel at which separable pools run axis by axis.
MANY = 32


def out_shape(shape: Triple, stride: Triple) -> Triple:
    return tuple(-(-n // s) for n, s in zip(shape, stride, strict=True))


def grid(df: DataFrame, shape: Triple) -> DataFrame:
    """Every (z, y, x) of a shape, made where it is used."""
    d, h, w = shape
    return df.sparkSession.range(d * h * w).select(F.expr(f"cast(id div {h * w} as int)").alias("z"), F.expr(f"cast(id div {w} % {h} as int)").alias("y"), F.expr(f"cast(id % {w} as int)").alias("x"))


def _outs(axis: str, size: int, kernel: int, stride: int, dilation: int) -> Column:
    """[(o, t)]: the windows along an axis that hold a voxel, and the tap it is there."""
    before, last = padding(size, kernel, stride), -(-size // stride)
    taps = F.sequence(F.lit(0), F.lit(kernel - 1))
    at = lambda t: F.col(axis) + before - t * dilation
    found = F.filter(taps, lambda t: (at(t) >= 0) & (at(t) % stride == 0) & (at(t) < last * stride))
    return F.transform(found, lambda t: F.struct((at(t) / stride).cast("int").alias("o"), t.alias("t")))


def _spread(vol: DataFrame, shape: Triple, kernel: Triple, stride: Triple, dilation: Triple, axes: str = "zyx") -> DataFrame:
    for axis, n, k, s, d in zip("zyx", shape, kernel, stride, dilation, strict=True):
        if axis in axes:
            vol = vol.withColumn(f"_{axis}", F.explode(_outs(axis, n, k, s, d))).withColumn(axis, F.col(f"_{axis}.o"))
    return vol


def _filled(vol: DataFrame, pooled: DataFrame, shape: Triple, stride: Triple, dilation: Triple, zero: Column) -> DataFrame:
    """Windows without a tap inside the volume (only dilation makes any) as 0."""
    if max(dilation) == 1:
        return pooled
    return grid(vol, out_shape(shape, stride)).join(pooled, ["z", "y", "x"], "left").select("z", "y", "x", F.coalesce("v", zero).alias("v"))


def pool(vol: DataFrame, shape: Triple, how: str, kernel: Triple, stride: Triple, dilation: Triple = (1, 1, 1)) -> DataFrame:
    """(z, y, x, v float): ``sum``, ``avg``, ``max`` or ``min`` over the taps inside the volume; 0 where there is none."""
    value = F.col("v").cast("double")
    if kernel == stride and dilation == (1, 1, 1) and not any(n % k for n, k in zip(shape, kernel, strict=True)):
        tiles = [F.expr(f"{a} div {k}").cast("int").alias(a) for a, k in zip("zyx", kernel, strict=True)]
        return vol.groupBy(*tiles).agg(getattr(F, how)(value).cast("float").alias("v"))
    copies = kernel[0] * kernel[1] * kernel[2] / (stride[0] * stride[1] * stride[2])
    if copies < MANY:
        pooled = _spread(vol, shape, kernel, stride, dilation).groupBy("z", "y", "x").agg(getattr(F, how)(value).alias("v"))
    else:
        pooled = vol.select("z", "y", "x", value.alias("v"), F.lit(1).alias("n"))
        for axis in "xyz":
            part = _spread(pooled, shape, kernel, stride, dilation, axis).groupBy("z", "y", "x")
            pooled = part.agg(F.sum("v").alias("v") if how == "avg" else getattr(F, how)("v").alias("v"), F.sum("n").alias("n"))
        pooled = pooled.select("z", "y", "x", (F.col("v") / F.col("n")).alias("v") if how == "avg" else F.col("v"))
    return _filled(vol, pooled, shape, stride, dilation, F.lit(0.0)).select("z", "y", "x", F.col("v").cast("float").alias("v"))


def arg_pool(vol: DataFrame, shape: Triple, how: str, kernel: Triple, stride: Triple, dilation: Triple = (1, 1, 1)) -> DataFrame:
    """(z, y, x, v int): flat index of the tap with the greatest (``max``) or least (``min``) value; of several, the one
    nearest to the kernel's centre (city blocks), then the first."""
    kz, ky, kx = kernel
    spread = _spread(vol, shape, kernel, stride, dilation)
    tz, ty, tx = F.col("_z.t"), F.col("_y.t"), F.col("_x.t")
    index = ((tz * ky + ty) * kx + tx).alias("i")
    far = F.abs(tz - kz // 2) + F.abs(ty - ky // 2) + F.abs(tx - kx // 2)
    rows = spread.select("z", "y", "x", index, F.col("v").cast("double").alias("w"), far.alias("far"))
    best = F.max_by("i", F.struct("w", -F.col("far"), -F.col("i"))) if how == "max" else F.min_by("i", F.struct("w", "far", "i"))
    pooled = rows.groupBy("z", "y", "x").agg(best.cast("int").alias("v"))
    return _filled(vol, pooled, shape, stride, dilation, F.lit(0))


def downscale(vol: DataFrame, shape: Triple, factor: int) -> DataFrame:
    return pool(vol, shape, "sum", (factor,) * 3, (factor,) * 3)
