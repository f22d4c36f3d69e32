"""Intermediate tables in the folder named by ``spark.checkpoint.dir``, which every executor sees."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset in local mode (tests, a laptop), a new temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session with these settings, which are put back afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


class Scratch:
    """Tables of one run of an operator: written once, reread, and so cut off from the plan that made them.

    ``drop`` deletes those that are read no more; what a returned DataFrame reads stays until the folder is cleared.
    """

    #: Set while a table is written: its shuffle files go as soon as it is there.
    SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.tables = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", set()

    def write(self, df: DataFrame, table: str) -> DataFrame:
        path = f"{self.root}/{table}"
        self.tables.add(table)
        with settings(self.spark, self.SETTINGS):
            df.select("*").write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def write_buckets(self, df: DataFrame, table: str, by: list[str]) -> DataFrame:
        """As ``write``, bucketed by a hash of ``by``: joins and aggregations by these columns don't shuffle the table."""
        path, name = f"{self.root}/{table}", f"tessera_{uuid.uuid4().hex}"
        self.tables.add(table)
        with settings(self.spark, self.SETTINGS):
            n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            df.write.bucketBy(n, *by).format("parquet").option("path", path).saveAsTable(name)
        out = self.spark.table(name)
        out.schema  # noqa: B018  the plan has its files now
        self.spark.sql(f"drop table {name}")  # the name only; the files are this run's
        return out

    def drop(self, *tables: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for table in tables:
            self.tables.discard(table)
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def keep(self, *tables: str) -> None:
        """Drop all but these."""
        self.drop(*(self.tables - set(tables)))
