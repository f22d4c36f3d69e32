"""Slices from image files: TIFF pages with 8 or 16 bits, JPG and PNG by Spark's image source. A worker holds an Arrow batch of files,
which ``spark.sql.execution.arrow.maxBytesPerBatch`` bounds, and the pixels of one page."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.sources.volume import ingest, stack

#: TIFF tags and the codes of their integer types.
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, SAMPLES, COUNTS = 256, 257, 258, 259, 273, 277, 279
INTEGERS = {1: "B", 3: "H", 4: "I"}


def tiff_pages(data: bytes) -> Iterator[np.ndarray]:
    """The pages of an uncompressed grey TIFF file, as unsigned 8- or 16-bit integers; any other file raises."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(f"{order}H", data, 2) != (42,):
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack_from(f"{order}I", data, 4)
    while at:
        (n,) = struct.unpack_from(f"{order}H", data, at)
        tags = {}
        for entry in range(at + 2, at + 2 + 12 * n, 12):
            tag, kind, count = struct.unpack_from(f"{order}HHI", data, entry)
            if kind in INTEGERS:
                values = f"{order}{count}{INTEGERS[kind]}"
                place = entry + 8 if struct.calcsize(values) <= 4 else struct.unpack_from(f"{order}I", data, entry + 8)[0]
                tags[tag] = struct.unpack_from(values, data, place)
        bits, packing, samples = (tags.get(tag, (1,))[0] for tag in (BITS, COMPRESSION, SAMPLES))
        if packing != 1 or samples != 1 or bits not in (8, 16) or OFFSETS not in tags:
            raise ValueError(f"TIFF pages must be uncompressed, grey, of 8 or 16 bits in strips: compression {packing}, {samples} samples, {bits} bits")
        pixels = b"".join(data[a : a + size] for a, size in zip(tags[OFFSETS], tags[COUNTS], strict=True))
        yield np.frombuffer(pixels, f"{order}u{bits // 8}").reshape(tags[HEIGHT][0], tags[WIDTH][0])
        (at,) = struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)


def _pixels(files: DataFrame, f: Callable[[dict], Iterable[tuple[int, np.ndarray, str]]]) -> DataFrame:
    """(name, part, y, x, v, kind) of the (part, values, kind) that f gives of each row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch[c][i].as_py() for c in batch.schema.names}
                for part, values, kind in f(row):
                    y, x = (a.ravel().astype(np.int32) for a in np.indices(values.shape))
                    fixed = [pa.repeat(pa.scalar(v, t), len(y)) for v, t in ((row["name"], pa.string()), (part, pa.int32()), (kind, pa.string()))]
                    columns = [fixed[0], fixed[1], pa.array(y), pa.array(x), pa.array(values.ravel().astype(np.int32)), fixed[2]]
                    yield pa.record_batch(columns, ["name", "part", "y", "x", "v", "kind"])

    return files.mapInArrow(run, "name string, part int, y int, x int, v int, kind string")


def tiff_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, part, y, x, v, kind): raw values of the pages (part: from 0) of all .tif and .tiff files in a folder;
    kind is u8 or u16. Other files are ignored; a TIFF file that cannot be read raises."""
    return _pixels(_tiffs(spark, path), lambda row: ((i, page, f"u{8 * page.itemsize}") for i, page in enumerate(tiff_pages(row["content"]))))


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, part, y, x, v, kind) of all .jpg, .jpeg and .png files in a folder: part is 0 in grey images, else red, green,
    blue and opacity as 0 to 3; kind is u8. Images of more bits a channel must be converted before; files that are no images raise."""
    image = spark.read.format("image").option("pathGlobFilter", "*.{jpg,jpeg,png}").load(path).select("image.*")

    def channels(row: dict) -> Iterator[tuple[int, np.ndarray, str]]:
        if row["height"] < 1:
            raise ValueError(f"{row['name']} is not an image")
        values = np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], row["nChannels"])
        for part, at in enumerate([2, 1, 0, 3][: row["nChannels"]] if row["nChannels"] > 1 else [0]):  # stored blue first
            yield part, values[:, :, at], "u8"

    return _pixels(image.select(_name("origin"), "height", "width", "nChannels", "data"), channels)


def _tiffs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{tif,tiff}").load(path).select(_name("path"), "content")


def _name(column: str) -> Column:
    return F.element_at(F.split(column, "/"), -1).alias("name")


def tiff_stack(spark: SparkSession, path: str) -> DataFrame:
    """(z, y, x, v) of a folder of TIFF slices, quantised to the four highest of eight bits; slices are in the order of ``stack``, and of
    their pages in files of several."""
    pixels, files = tiff_files(spark, path), _tiffs(spark, path)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = [sum(1 for _ in tiff_pages(content.as_py())) for content in batch["content"]]
            yield pa.record_batch([batch["name"], pa.array(pages, pa.int32())], ["name", "pages"])

    numbered = stack(files.select("name")).join(files.mapInArrow(count, "name string, pages int"), "name")
    before = F.sum("pages").over(Window.orderBy("z").rowsBetween(Window.unboundedPreceding, -1))
    starts = F.broadcast(numbered.select("name", F.coalesce(before, F.lit(0)).cast("int").alias("start")))  # a row per file
    return ingest(pixels.join(starts, "name").select((F.col("start") + F.col("part")).alias("z"), "y", "x", "v", "kind"))
