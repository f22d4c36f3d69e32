"""Suffix-array dedup: bytes covered by a string that starts at two or more places are removed.

The suffix array is sparse. Every string of ``size`` bytes holds a place that its content alone decides (the leftmost of
its least grams, see ``windows``); suffixes are sorted from such places on, each with the bytes before it that the strings
around it need. A suffix whose leading gram occurs nowhere else holds no repeat and is left out.

1. Splitters, sampled from the suffixes' leading bytes, range-partition the suffixes.
2. Each bucket is put in order by Spark's external sort and is gone through in blocks. Neighbours in that order tell how
   many leading bytes suffixes share; strings that can have an equal one in the block are told apart by a multikey
   quicksort, eight bytes a symbol, outwards from the suffix: groups with an equal symbol go on to the next.
3. Across the boundaries of blocks and buckets only suffixes that share their leading bytes with the boundary (the next
   suffix, or the splitter) can have equal strings; those strings are compared by a table of their digests.

So no group of suffixes has to fit into memory, however many have the same leading bytes.
"""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import windows
from tessera.llm.common import Scratch, id_or_null, keyed, map_batches, partitions
from tessera.llm.hashing import sliding_min, text_bytes

SIZE, GRAM = 200, 16
#: Suffixes of a block.
BLOCK = 8192
#: Sampled suffixes for each splitter (all of them reach the driver), and leading bytes that splitters have.
SAMPLED, LEADING = 32, 64


def places(rows: DataFrame, units: windows.Units, heavy: np.ndarray) -> DataFrame:
    """(m, did, th, at): ``n`` strings from byte ``start`` on have minimiser m, with its leftmost place ``offset`` bytes
    behind ``start``. at: all three in one number, since these rows are many."""
    held = rows.sparkSession.sparkContext.broadcast(heavy)  # bounded: see heavy_grams
    width = units.size - units.gram + 1

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        grams, first = units.grams(batch["text"])
        n = len(grams) - units.size + 1
        if n <= 0:
            return None
        keys = windows.behind(grams, held.value)
        least = sliding_min(keys, width)[:n]
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        whole = row[:n] == row[units.size - 1 :]
        new = np.ones(n, bool)  # the string before begins with its minimiser, or has another one
        new[1:] = (keys[: n - 1] == least[:-1]) | (least[1:] != least[:-1]) | (row[1:n] != row[: n - 1])
        begins = np.flatnonzero(new & whole)
        ends = np.flatnonzero(np.append(new[1:] | ~whole[1:], True) & whole) + 1
        offset = np.concatenate([keys[begins[i : i + 4096, None] + np.arange(width)].argmin(axis=1) for i in range(0, len(begins), 4096)] or [begins])
        doc = row[begins]
        at = (begins - first[doc]) << 24 | offset << 12 | ends - begins
        return pa.record_batch([pa.array(least[begins].view(np.int64)), batch["did"].take(pa.array(doc)), batch["th"].take(pa.array(doc)), pa.array(at)], ["m", "did", "th", "at"])

    return map_batches(rows.select("did", "th", "text"), run, "m long, did long, th long, at long")


def _cut(texts: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(digest, did, th, starts, n, left, right): the suffix at each wanted place, right of it as far as its strings go,
    and the bytes left of it. Equal ones of one text are one row with all their starts."""
    by_text = wanted.groupBy("did", "th").agg(F.collect_set("at").alias("at"))  # as bounded as the text
    kinds = {"digest": pa.binary(), "did": pa.int64(), "th": pa.int64(), "starts": pa.list_(pa.int64()), "n": pa.int64(), "left": pa.binary(), "right": pa.binary()}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for did, th, text, own in zip(batch["did"].to_pylist(), batch["th"].to_pylist(), batch["text"].to_pylist(), batch["at"].to_pylist(), strict=True):
            data, found = text.encode(), {}
            for at in own:
                start, offset, n = at >> 24, at >> 12 & 4095, at & 4095
                found.setdefault((data[start : start + n - 1 + size], offset), []).append(start)
            for (packed, offset), starts in found.items():
                digest = hashlib.blake2b(packed, digest_size=16, salt=offset.to_bytes(4, "little")).digest()
                out.append((digest, did, th, starts, len(packed) - size + 1, packed[:offset], packed[offset:]))
        return pa.record_batch([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds.values(), strict=True)], list(kinds))

    joined = texts.join(by_text, ["did", "th"]).select("did", "th", "text", "at")
    return map_batches(joined, run, "digest binary, did long, th long, starts array<long>, n long, left binary, right binary")


def splitters(suffixes: DataFrame, wanted: int) -> list[bytes]:
    """At most ``wanted`` - 1 strings that deal the suffixes' leading bytes out evenly, in order; from a sample that is
    bounded by ``wanted``."""
    every = max(1, suffixes.count() // (SAMPLED * wanted))
    sample = suffixes.where(F.pmod(F.xxhash64("digest"), F.lit(every)) == 0).select(F.substring("right", 1, LEADING).alias("lead")).limit(4 * SAMPLED * wanted)
    leads = sorted(bytes(r.lead) for r in sample.collect())
    return sorted({leads[len(leads) * i // wanted] for i in range(1, wanted)} - {b""}) if leads else []


def _matrix(column: pa.Array, width: int, backwards: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(a row of bytes for each string, with zeros behind it; the strings' lengths)."""
    data, offsets = text_bytes(column)
    length = np.diff(offsets)
    here = np.arange(width)[None] < length[:, None]
    at = offsets[1:, None] - 1 - np.arange(width)[None] if backwards else offsets[:-1, None] + np.arange(width)[None]
    out = np.zeros((len(length), width), np.uint8)
    out[here] = data[at[here]]
    return out, length


def _common(a: np.ndarray, a_length: np.ndarray, b: np.ndarray, b_length: np.ndarray) -> np.ndarray:
    """The length of the common prefix of each row of a and of b."""
    differ = a != b
    found = np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])
    return np.minimum(found, np.minimum(a_length, b_length))


def multikey(group: np.ndarray, left: np.ndarray, row: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, distance) of those that have an equal one in their group: an equal distance, and as many equal bytes of
    ``left`` (nearest first). All members of a group have one distance."""
    symbols = np.ascontiguousarray(left).view(">u8").astype(np.uint64)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    level = 0
    while len(group):
        order = np.argsort(group, kind="stable")
        group, row, distance = group[order], row[order], distance[order]
        same = group[1:] == group[:-1]
        some = np.zeros(len(group), bool)
        some[1:] |= same
        some[:-1] |= same
        ended = some & (distance <= 8 * level)
        done.append((row[ended], distance[ended]))
        on = some & ~ended
        group, row, distance = group[on], row[on], distance[on]
        if not len(group):
            break
        over = np.maximum(8 * (level + 1) - distance, 0).astype(np.uint64) << np.uint64(3)  # bits beyond the string
        symbol = symbols[row, level] >> over
        order = np.lexsort((symbol, group))
        group, symbol, row, distance = group[order], symbol[order], row[order], distance[order]
        group = np.cumsum(np.concatenate(([True], (group[1:] != group[:-1]) | (symbol[1:] != symbol[:-1]))))
        level += 1
    rows, distances = zip(*done, strict=True) if done else ((), ())
    return (np.concatenate(rows), np.concatenate(distances)) if done else (row, distance)


def _expand(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) for all numbers from low to high of each row."""
    n = np.maximum(high - low + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + low[row]


def _repeated(table: pa.Table, size: int, before: bytes | None, behind: bytes | None) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Of a block of suffixes in order: (suffix, distance of the string's start before it) of strings that repeat within
    the block, and of those that may repeat across its boundaries."""
    left_column, right_column = table["left"].combine_chunks(), table["right"].combine_chunks()
    width = -(-size // 8) * 8
    left, most = _matrix(left_column, width, backwards=True)
    right, length = _matrix(right_column, size)
    least = most - table["n"].to_numpy() + 1
    shared = _common(right[1:], length[1:], right[:-1], length[:-1])
    near = np.zeros(len(most), np.int64)
    near[1:] = shared
    near[:-1] = np.maximum(near[:-1], shared)
    row, distance = _expand(np.maximum(least, size - near), most)
    breaks = np.cumsum(np.concatenate((np.zeros((size + 1, 1), np.int32), shared[None] < size - np.arange(size + 1)[:, None]), axis=1, dtype=np.int32), axis=1, dtype=np.int32)
    inside = multikey(distance * (len(most) + 1) + breaks[distance, row], left, row, distance)
    near = np.zeros(len(most), np.int64)
    for bound in (before, behind):
        if bound is not None:
            other = np.zeros((1, size), np.uint8)
            other[0, : len(bound)] = np.frombuffer(bound, np.uint8)
            near = np.maximum(near, _common(right, length, np.repeat(other, len(most), 0), np.full(len(most), len(bound))))
    return inside, _expand(np.maximum(least, size - near), most)


def _search(size: int, bounds: list[bytes]):
    def spans(table: pa.Table, before: bytes | None, behind: bytes | None):
        (row, distance), (far, reach) = _repeated(table, size, before, behind)
        digest, n, copies = table["digest"].combine_chunks(), table["n"].to_numpy(), table["copies"].to_numpy()
        most = np.diff(text_bytes(table["left"].combine_chunks())[1])
        twice = copies > 1
        row, distance = row[~twice[row]], distance[~twice[row]]
        order = np.lexsort((-distance, row))
        row, begin = row[order], (most[row] - distance)[order]
        new = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (begin[1:] != begin[:-1] + 1)))) if len(row) else row
        end = begin[np.append(new[1:], len(row)) - 1] + 1 if len(row) else begin
        whole = np.flatnonzero(twice)
        of, a, b = np.concatenate((row[new], whole)), np.concatenate((begin[new], np.zeros_like(whole))), np.concatenate((end, n[whole]))
        yield pa.record_batch([digest.take(pa.array(of)), pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.nulls(len(of), pa.binary())], ["digest", "begin", "end", "string"])
        if len(far):
            left, right = table["left"].to_pylist(), table["right"].to_pylist()
            keys = []
            for r, d in zip(far.tolist(), reach.tolist(), strict=True):
                keys.append(hashlib.blake2b(left[r][len(left[r]) - d :] + right[r][: size - d], digest_size=16).digest())
            a = most[far] - reach
            yield pa.record_batch([digest.take(pa.array(far)), pa.array(a.astype(np.int64)), pa.array((a + 1).astype(np.int64)), pa.array(keys, pa.binary())], ["digest", "begin", "end", "string"])

    def blocks(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n > BLOCK:
                table = pa.Table.from_batches(held)
                for at in range(0, n - BLOCK, BLOCK):
                    yield table.slice(at, BLOCK)
                at = (n - 1) // BLOCK * BLOCK
                held, n = table.slice(at).combine_chunks().to_batches(), n - at
        if n:
            yield pa.Table.from_batches(held)

    def run(batches):
        before = block = behind = None
        for table in blocks(batches):
            if block is not None:
                behind = table["right"][0].as_py()
                yield from spans(block, before, behind)
                before = block["right"][-1].as_py()
            else:
                bucket = table["bucket"][0].as_py()
                before = bounds[bucket - 1][:-1] if bucket else None  # a suffix below the splitter does not begin with all of it
            block = table
        if block is not None:
            yield from spans(block, before, bounds[bucket] if bucket < len(bounds) else None)

    return run


def repeated_bytes(docs: DataFrame, size: int = SIZE, gram: int = GRAM, heavy_share: float = windows.HEAVY_SHARE) -> DataFrame:
    """(did, th, a, b): spans of bytes to remove from the texts with that id and hash. size: 4095 at most."""
    spark = docs.sparkSession
    scratch, units, rows = Scratch(spark, "suffix"), windows.Units("bytes", size, min(gram, size)), keyed(docs)
    if not 0 < size < 4096:
        raise ValueError("size must be from 1 to 4095")
    heavy = windows.heavy_grams(rows, units, scratch, heavy_share)
    refs = scratch.write(places(rows, units, heavy), "places")
    shared = scratch.write(refs.groupBy("m").agg(F.count("*").alias("k")).where("k > 1").select("m"), "shared")
    parts = scratch.write(_cut(rows, refs.join(shared, "m"), size), "parts")
    scratch.drop("places", "shared", "heavy")
    bounds = splitters(parts, partitions(spark))
    held = spark.sparkContext.broadcast(bounds)  # LEADING bytes a partition

    def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
        bucket = [bisect.bisect_right(held.value, x) for x in batch["right"].to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(bucket, pa.int32())], [*batch.schema.names, "bucket"])

    distinct = parts.groupBy("digest").agg(F.sum(F.size("starts")).alias("copies"), *[F.first(c).alias(c) for c in ("n", "left", "right")])
    dealt = map_batches(distinct, deal, "digest binary, copies long, n long, left binary, right binary, bucket int")
    ordered = dealt.repartitionById(len(bounds) + 1, F.col("bucket")).sortWithinPartitions("right")
    found = scratch.write(ordered.mapInArrow(_search(size, bounds), "digest binary, begin long, end long, string binary"), "found")
    across = found.where("string is not null")
    again = across.groupBy("string").agg(F.count("*").alias("k")).where("k > 1").select("string")
    spans = found.where("string is null").drop("string").unionByName(across.join(again, "string").drop("string"))
    marks = parts.select("digest", "did", "th", F.explode("starts").alias("start")).join(spans, "digest")
    out = scratch.write(marks.select("did", "th", (F.col("start") + F.col("begin")).alias("a"), (F.col("start") + F.col("end") - 1 + size).alias("b")), "marks")
    scratch.keep("marks")
    return out


def dedup(docs: DataFrame, size: int = SIZE, heavy_share: float = windows.HEAVY_SHARE) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept binary) of every whole text in UTF-8.

    A byte is removed if a string of ``size`` bytes that covers it also starts at any other place, in this document or
    another one; matches never cross documents and are judged on the input. n_spans: maximal removed runs. What is kept
    need not be valid UTF-8. Null text: empty. Rows with null or repeated doc_ids are documents of their own, so a row
    that occurs twice loses every byte that a match can cover. Other columns are ignored. An empty table gives an
    empty result.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for did, text, spans in zip(batch["did"].to_pylist(), batch["text"].to_pylist(), batch["spans"].to_pylist(), strict=True):
            data = text.encode()
            gone = windows.merged([(s["a"], s["b"]) for s in spans or ()])
            kept, at = [], 0
            for a, b in gone:
                kept.append(data[at:a])
                at = b
            kept = b"".join([*kept, data[at:]])
            rows.append((did, len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        return pa.record_batch([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], ["did", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    docs = docs.select("doc_id", "text")
    marked = windows.with_spans(docs, repeated_bytes(docs, size, heavy_share=heavy_share)).select("did", F.coalesce("row.text", F.lit("")).alias("text"), "spans")
    out = map_batches(marked, run, "did long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.select(id_or_null().alias("doc_id"), *out.columns[1:])
