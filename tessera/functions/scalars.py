"""Column builders for voxel values, coordinates and names. All stay in Spark's generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def high_nibble(v: Column) -> Column:
    """Quantise to the four highest of eight bits."""
    return v.bitwiseAND(F.lit(240))


def to_byte(v: Column, kind: Column | str = "u16") -> Column:
    """Quantise at ingest: 16-bit values lose their low byte first; 8-bit ones stay. Then the four highest bits."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return high_nibble(F.when(kind == "u16", F.shiftright(v, 8)).otherwise(v))


def clamp(v: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), v))


def scale_to_byte(v: Column) -> Column:
    """0..1 to 0..255, cut off (v >= 0)."""
    return F.floor(v * 255).cast("int")


def keep_void(raw: Column, v: Column) -> Column:
    """0 where the raw value is 0 (void), else the new value."""
    return F.when(raw == 0, F.lit(0)).otherwise(v)


def zero_below(v: Column, iso: float) -> Column:
    return F.when(v < iso, F.lit(0)).otherwise(v)


def linear_stretch(v: Column, low: Column, high: Column, levels: int = 256) -> Column:
    """(levels-1) (v-low) / (high-low); null for a constant volume."""
    return F.try_divide((levels - 1) * (v - low), (high - low).cast("double"))


def stretch_bin(v: Column, low: Column, high: Column) -> Column:
    """Guarded stretch to a bin 0..255."""
    return clamp(F.lit(255) * (v - low) / (high - low + F.lit(1e-8)), 0.0, 255.0).cast("int")


def preserve_hue(g: Column, i: Column, x: Column, levels: int = 256) -> Column:
    """Scale x by how the level i has moved to g: towards 0 below, towards the highest level above."""
    eps = F.lit(1e-8)
    return F.when(g <= i, g / (i + eps) * x).otherwise((levels - 1 - g) / (levels - 1 - i + eps) * (x - i) + g)


def scrub(v: Column, low: float = 0.0, high: float = 255.0) -> Column:
    """NaN to 0; infinities and everything else into low..high."""
    return clamp(F.when(F.isnan(v), F.lit(0.0)).otherwise(v), low, high)


def well_exposed(v01: Column, sigma: float = 0.2) -> Column:
    return F.exp(-F.pow(v01 - 0.5, 2) / (2 * sigma * sigma))


def blend(g: Column, wg: Column, local: Column, wl: Column) -> Column:
    total = wg + wl + F.lit(1e-8)
    return wg / total * g + wl / total * local


def opacity(v: Column, iso: float) -> Column:
    """Piecewise linear: 0 up to iso-1, 1 from iso on."""
    return F.when(v <= iso - 1, F.lit(0.0)).when(v < iso, v - (iso - 1)).otherwise(F.lit(1.0))


def highlight(label: Column, chosen: int) -> Column:
    return F.when(label == chosen, F.lit(255)).otherwise(F.lit(0))


def world_to_voxel(w: Column, origin: float, spacing: float, size: int) -> Column:
    """Nearest voxel, halves to the even one, inside the volume."""
    return clamp(F.bround((w - origin) / spacing), 0.0, float(size - 1)).cast("int")


def tap_offset(index: Column, kernel: tuple[int, int, int]) -> Column:
    """Flat index of a kernel's tap as the offset (dz, dy, dx) from its centre."""
    kz, ky, kx = kernel
    i = index.cast("long")
    return F.struct(
        (F.floor(i / (ky * kx)) - kz // 2).cast("int").alias("dz"),
        (F.floor(i / kx) % ky - ky // 2).cast("int").alias("dy"),
        (i % kx - kx // 2).cast("int").alias("dx"),
    )


def linear_index(shape: tuple[int, int, int], order: str = "C") -> Column:
    """Place of (z, y, x) in a flat array, last axis fastest (C) or first axis fastest (F)."""
    d, h, w = shape
    z, y, x = (F.col(c).cast("long") for c in "zyx")
    return (z * h + y) * w + x if order == "C" else (x * h + y) * d + z


def cell_name(y: Column, x: Column, z: Column) -> Column:
    return F.format_string("cell_yxz_%03d_%03d_%03d.tif", y, x, z)


def cache_path(url: Column, root: str) -> Column:
    return F.concat_ws("/", F.lit(root), F.regexp_replace(url, "^https://", ""))


def normalised_iso(iso: float) -> float:
    return iso / 256 if iso > 1 else iso


def padding(size: int, kernel: int, stride: int) -> int:
    """Taps before the first voxel, as if the kernel weren't dilated."""
    return max(0, (-(-size // stride) - 1) * stride + kernel - size) // 2


def seed_count(shape: tuple[int, int, int], step: int) -> int:
    n = 1
    for size in shape:
        n *= max(0, -(-(size - step // 2) // step))
    return n
