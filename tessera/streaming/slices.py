"""Incremental ingest: z-slices that arrive as Parquet files are quantised and written to a volume store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.sources.volume import VolumeStore, ingest


def ingest_stream(spark: SparkSession, incoming: str, store: VolumeStore, volume_id: str, checkpoint: str) -> StreamingQuery:
    """Run once over what has arrived at ``incoming`` ((z, y, x, v, kind) files) and stop.

    A block that a batch touches is rewritten as a whole, its new voxels over the ones there, of repeated ones the greatest;
    so a batch that is repeated after a failure leaves the same store.
    """

    def write(batch: DataFrame, _: int) -> None:
        new = ingest(batch).groupBy("z", "y", "x").agg(F.max("v").alias("v"))
        blocks = new.selectExpr(f"cast(z div {store.block} as int) bz").distinct()
        try:
            old = store.read(volume_id).join(blocks, "bz", "left_semi").drop("bz").join(new, ["z", "y", "x"], "left_anti")
            merged = old.unionByName(new).checkpoint()
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            merged = new
        store.overwrite_blocks(merged, volume_id)

    rows = spark.readStream.schema("z int, y int, x int, v int, kind string").parquet(incoming)
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
