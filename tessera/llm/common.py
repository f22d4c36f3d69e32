"""What the operators of this subpackage share: the cluster's shared folder, intermediate tables in it, and Arrow plumbing.

Intermediate tables are written to the folder named by ``spark.checkpoint.dir`` (every executor sees it), so a lost
executor costs a re-read and never a wrong or partial result. Nothing is written to a machine-local folder.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import hashing
from tessera.sources import shared

#: Rows of an Arrow batch while a table is written.
BATCH_ROWS = 512
#: Bytes of a batch that a function works on at once, or one row: what a worker makes of a text is some ten times as large.
BATCH_BYTES = 2_000_000
#: Stands for a null id inside joins; a null id sorts before all others.
NULL_ID = -(2**63)


class Scratch(shared.Scratch):
    SETTINGS = shared.Scratch.SETTINGS | {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS)}

    def write_lists(self, df: DataFrame, table: str, by: str) -> DataFrame:
        """As ``write``, with a folder for each value of the integer column ``by``, which comes last when it is read."""
        path = f"{self.root}/{table}"
        self.tables.add(table)
        with shared.settings(self.spark, self.SETTINGS):
            df.write.mode("overwrite").partitionBy(by).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, about ``most`` bytes of strings and binaries at a time."""
    size = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            size += np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1])
    if size.sum() <= most:
        yield batch
        return
    cut = np.flatnonzero(np.diff((np.cumsum(size) - size) // most, prepend=0, append=-1))
    begin = 0
    for end in cut.tolist():
        if end > begin:
            yield batch.slice(begin, end - begin)
            begin = end


def trim() -> None:
    """Give freed memory back to the system: workers live on after a task, and the next one may be another operator's."""
    hashing.forget()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that ends with ``trim``."""

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return whole


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | None], schema: str, most: int = BATCH_BYTES) -> DataFrame:
    """mapInArrow by a function of a batch of about ``most`` bytes; it may return None for no rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most):
                if part.num_rows and (out := f(part)) is not None:
                    yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return df.mapInArrow(trimmed(run), schema)


#: Bits of a bitmap of hashes, as a power of 2, whatever the input is; and shards that make parts of it.
BITS, _SHARDS = 26, 6


def bitmap(scratch: Scratch, hashes: DataFrame, table: str) -> np.ndarray:
    """A bit for the first ``BITS`` bits of each hash (one column of longs), packed: 2**BITS bits, of which each task makes
    a part. A hash that isn't there has a set bit with the share of bits set, and one that is there always."""

    def run(batches):
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch["h"].to_numpy().view(np.uint64) >> np.uint64(64 - BITS)
            shard = (at >> np.uint64(BITS - _SHARDS)).astype(np.int64)
            for s in np.unique(shard).tolist():
                parts.setdefault(s, np.zeros(1 << (BITS - _SHARDS), bool))[at[shard == s] & np.uint64((1 << (BITS - _SHARDS)) - 1)] = True
        for s, bits in parts.items():
            yield pa.record_batch([pa.array([s], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], ["shard", "bits"])

    rows = hashes.toDF("h").withColumn("shard", F.shiftrightunsigned("h", 64 - _SHARDS)).repartition(partitions(scratch.spark), "shard").select("h")
    out, width = np.zeros(1 << (BITS - 3), np.uint8), 1 << (BITS - _SHARDS - 3)
    for row in scratch.write(rows.mapInArrow(run, "shard int, bits binary"), table).collect():
        out[row.shard * width : (row.shard + 1) * width] = np.frombuffer(row.bits, np.uint8)
    scratch.drop(table)
    return out


def in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes.view(np.uint64) >> np.uint64(64 - BITS)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & np.uint8(1) > 0


def strings(column: pa.Array) -> list[str]:
    """Texts of an Arrow column; a null is an empty text."""
    return ["" if x is None else x for x in column.to_pylist()]


def id_or_null(column: str = "did") -> Column:
    return F.when(F.col(column) != NULL_ID, F.col(column))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(did, th, text): the id with nulls coded, a hash of the text, and the text (null: empty).

    (did, th) names a row, or several rows that are equal in both columns; other columns are dropped, so clashing names
    cannot matter.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("did"), F.xxhash64(text).alias("th"), text.alias("text"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
