"""Volumes as voxel tables: derived from the tables at hand, stored as partitioned Parquet, read back by cuboid."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scalars import to_byte
from tessera.operators.pool import grid

Triple = tuple[int, int, int]
#: Edge of a storage block in z.
BLOCK = 256


def from_lineitem(spark: SparkSession, sf_dir: str, size: int, measure: str = "l_quantity", factor: int = 1) -> DataFrame:
    """(z, y, x, v): a dense cube from the keys of lineitem, modulo its edge, and the sum of a measure modulo 256."""
    raw = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    axes = [F.expr(f"cast({k} % {size} as int)").alias(a) for k, a in zip(("l_orderkey", "l_partkey", "l_suppkey"), "zyx", strict=True)]
    sums = raw.groupBy(*axes).agg((F.sum(F.col(measure) * factor).cast("long") % 256).alias("v"))
    return grid(sums, (size,) * 3).join(sums, ["z", "y", "x"], "left").select("z", "y", "x", F.coalesce("v", F.lit(0)).alias("v"))


def from_embeddings(spark: SparkSession, sf_dir: str, width: int = 8) -> DataFrame:
    """(z, y, x, v): a vector is a slice, its components row by row."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("int").alias("z"), F.posexplode("embedding").alias("i", "v"))
    return rows.select("z", F.expr(f"cast(i div {width} as int)").alias("y"), F.expr(f"cast(i % {width} as int)").alias("x"), "v")


def grid_labels(vol: DataFrame, size: int, cell: int) -> DataFrame:
    """The volume with label: the number of the cubic cell that a voxel lies in."""
    m = size // cell
    return vol.withColumn("label", F.expr(f"cast((z div {cell} * {m} + y div {cell}) * {m} + x div {cell} as int)"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pid, z, y, x) from events."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("pid"), F.expr("cast(user_id % 50 as int)").alias("z"), F.expr("cast(event_id % 97 as int)").alias("y"), F.expr("cast(floor(value) as int)").alias("x"))


def cuboid(vol: DataFrame, start: Triple, size: Triple, shape: Triple | None = None) -> DataFrame:
    """The voxels of a cuboid, with coordinates from its corner. With a shape, bounds are checked."""
    if shape is not None and not all(0 <= a and 0 < n and a + n <= most for a, n, most in zip(start, size, shape, strict=True)):
        raise ValueError(f"cuboid {start}+{size} is not inside {shape}")
    for axis, a, n in zip("zyx", start, size, strict=True):
        vol = vol.where((F.col(axis) >= a) & (F.col(axis) < a + n))
    return vol.select(*[(F.col(c) - a).alias(c) for c, a in zip("zyx", start, strict=True)], *[c for c in vol.columns if c not in ("z", "y", "x", "bz")])


def transposed(vol: DataFrame, stored: str = "yxz") -> DataFrame:
    """(z, y, x, v float) of a volume whose first, second and third coordinate (its z, y and x) are the axes ``stored``."""
    if sorted(stored) != ["x", "y", "z"]:
        raise ValueError(f"axes {stored} are not x, y and z")
    return vol.select(*[F.col("zyx"[stored.index(a)]).alias(a) for a in "zyx"], F.col("v").cast("float").alias("v"))


@dataclass(frozen=True)
class VolumeStore:
    """Volumes of one shape in a folder: a directory per volume and block of z-slices."""

    spark: SparkSession
    path: str
    shape: Triple
    block: int = BLOCK

    def create(self, vol: DataFrame, volume_id: str) -> None:
        """Write a new volume; one that is there raises. Its range is gathered on the way and kept beside it."""
        seen = Observation()
        blocks = self._blocks(vol).observe(seen, F.min("v").cast("double").alias("low"), F.max("v").cast("double").alias("high"))
        blocks.write.mode("errorifexists").partitionBy("bz").parquet(f"{self.path}/volume_id={volume_id}")
        self._keep_range(volume_id, True, seen.get["low"], seen.get["high"])

    def _keep_range(self, volume_id: str, known: bool, low: float | None, high: float | None) -> None:
        one = self.spark.createDataFrame([(known, low, high)], "known boolean, low double, high double").coalesce(1)
        one.write.mode("overwrite").parquet(f"{self.path}-ranges/volume_id={volume_id}")

    def range(self, volume_id: str) -> tuple[float, float] | None:
        """The least and greatest value: what was gathered while the volume was written; where blocks were replaced since,
        or a volume has no such record, the volume is scanned. None if it has no values."""
        try:
            kept = self.spark.read.schema("known boolean, low double, high double").parquet(f"{self.path}-ranges/volume_id={volume_id}").first()
        except AnalysisException:
            kept = None
        if kept is None or not kept.known:
            kept = self.read(volume_id).agg(F.min("v").cast("double").alias("low"), F.max("v").cast("double").alias("high")).first()
        return None if kept.low is None else (kept.low, kept.high)

    def overwrite_blocks(self, vol: DataFrame, volume_id: str) -> None:
        """Replace the blocks that hold the given slices; others stay. The range that was gathered no longer holds."""
        self._keep_range(volume_id, False, None, None)
        self._blocks(vol).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bz").parquet(f"{self.path}/volume_id={volume_id}")

    def _blocks(self, vol: DataFrame) -> DataFrame:
        out = vol.withColumn("bz", F.expr(f"cast(z div {self.block} as int)"))
        return out.repartitionByRange("bz", "z", "y").sortWithinPartitions("bz", "z", "y", "x")

    def read(self, volume_id: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/volume_id={volume_id}")

    def chunk(self, volume_id: str, start: Triple, size: Triple) -> DataFrame:
        """A cuboid; only the directories and row groups that hold it are read."""
        vol = self.read(volume_id).where(F.col("bz").between(start[0] // self.block, (start[0] + size[0] - 1) // self.block))
        return cuboid(vol, start, size, self.shape)


def ingest(raw: DataFrame) -> DataFrame:
    """(z, y, x, v) from (z, y, x, v, kind): 16-bit or 8-bit values to the four highest of eight bits."""
    return raw.select("z", "y", "x", to_byte(F.col("v"), F.col("kind")).alias("v"))


def missing(wanted: DataFrame, there: DataFrame, key: str = "z") -> DataFrame:
    """Keys that are wanted and not there."""
    return wanted.join(there, key, "left_anti")


def stack(files: DataFrame) -> DataFrame:
    """(name, z): files of a slice stack, .tiff before .tif, each in the order of their names. A row per slice."""
    from pyspark.sql.window import Window

    group = F.when(F.col("name").endswith(".tiff"), 0).otherwise(1)
    return files.select("name", (F.row_number().over(Window.orderBy(group, "name")) - 1).alias("z"))
