"""Substring dedup by super-k-mers: words that lie in a window of words which an earlier document holds are removed.

Consecutive windows that share a minimiser travel as one packed string to the minimiser's bucket (see ``windows``), where
sorting groups equal windows. Equal packed strings are aggregated before they travel, and what a bucket finds of each is
joined back to its occurrences. A bucket of more than ``BLOCK`` distinct strings isn't sorted in one piece: it passes its
windows on, each by itself, and a grouping by their digests takes the bucket's place. So a worker's memory is bounded.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import windows
from tessera.llm.common import Scratch, id_or_null, keyed, map_batches, partitions

WINDOW, GRAM = 50, 5
#: Distinct strings that are sorted at once.
BLOCK = 8192
_FOUND = "m long, digest binary, begin long, end long, lo long, hi long, string binary"
_NAMES = ["m", "digest", "begin", "end", "lo", "hi", "string"]


def _earliest(size: int):
    def sort(table: pa.Table):
        n, lo, hi = (table[c].to_numpy() for c in ("n", "lo", "hi"))
        words = pc.split_pattern(table["packed"].combine_chunks().cast(pa.string()), " ")
        ids = words.flatten().dictionary_encode().indices.to_numpy()
        first = words.offsets.to_numpy()
        ends = np.repeat(first[1:], np.diff(first))
        rank = windows.ranks(ids, ends, size)
        string = np.repeat(np.arange(len(n)), np.diff(first))
        here = rank >= 0
        rank, string, at = rank[here], string[here], np.flatnonzero(here)
        order = np.argsort(rank, kind="stable")
        begins = np.flatnonzero(np.diff(rank[order], prepend=-1))
        least = np.minimum.reduceat(lo[string[order]], begins) if len(order) else lo[:0]
        values = least[rank]
        a, b = windows.stretches(values, string)
        of = string[a]
        some = values[a] < hi[of]
        a, b, of = a[some], b[some], of[some]
        if len(a):
            begin = at[a] - first[of]
            yield row_batch(table, of, begin, begin + b - a, values[a], pa.nulls(len(a), pa.binary()))

    def each(table: pa.Table):
        of, begin, keys = [], [], []
        for i, packed in enumerate(table["packed"].to_pylist()):
            words = packed.split(b" ")
            for at in range(len(words) - size + 1):
                of.append(i)
                begin.append(at)
                keys.append(hashlib.blake2b(b" ".join(words[at : at + size]), digest_size=16).digest())
        of, begin = np.array(of), np.array(begin)
        yield row_batch(table, of, begin, begin + 1, table["lo"].to_numpy()[of], pa.array(keys, pa.binary()))

    def row_batch(table: pa.Table, of: np.ndarray, begin: np.ndarray, end: np.ndarray, lo: np.ndarray, string: pa.Array) -> pa.RecordBatch:
        digest = table["digest"].combine_chunks().take(pa.array(of))
        return pa.record_batch([pa.array(table["m"].to_numpy()[of]), digest, pa.array(begin.astype(np.int64)), pa.array(end.astype(np.int64)), pa.array(lo), pa.array(table["hi"].to_numpy()[of]), string], _NAMES)

    def run(batches):
        for table, whole in windows.bounded(batches, "m", BLOCK):
            if whole:
                yield from sort(table)
            else:
                for at in range(0, table.num_rows, 256):
                    yield from each(table.slice(at, 256))

    return run


def repeated_words(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, heavy_share: float = windows.HEAVY_SHARE) -> DataFrame:
    """(did, th, a, b): spans of words to remove from the texts with that id and hash."""
    spark = docs.sparkSession
    scratch, units, rows = Scratch(spark, "substring"), windows.Units("words", window, gram), keyed(docs)
    heavy = windows.heavy_grams(rows, units, scratch, heavy_share)
    refs = scratch.write(windows.runs(rows, units, heavy), "runs")
    shared = scratch.write(refs.groupBy("m").agg(F.min("did").alias("lo"), F.max("did").alias("hi")).where("lo < hi").select("m"), "shared")
    parts = scratch.write(windows.cut(rows, refs.join(shared, "m"), units), "parts")
    scratch.drop("runs", "shared", "heavy")
    distinct = parts.groupBy("m", "digest").agg(F.min("did").alias("lo"), F.max("did").alias("hi"), F.first("n").alias("n"), F.first("packed").alias("packed"))
    buckets = distinct.repartition(partitions(spark), "m").sortWithinPartitions("m")
    found = scratch.write(buckets.mapInArrow(_earliest(window), _FOUND), "found")
    alone = found.where("string is not null").select("m", "digest", "begin", "end", "hi", "string", "lo")
    least = alone.groupBy("string").agg(F.min("lo").alias("lo"))
    spans = found.where("string is null").select("m", "digest", "begin", "end", "lo")
    spans = spans.unionByName(alone.drop("lo").join(least, "string").where("lo < hi").select(spans.columns))
    marks = parts.select("m", "digest", "did", "th", "start").join(spans, ["m", "digest"]).where("lo < did")
    out = scratch.write(marks.select("did", "th", (F.col("start") + F.col("begin")).alias("a"), (F.col("start") + F.col("end") - 1 + window).alias("b")), "marks")
    scratch.keep("marks")
    return out


def _kept(text: str, spans) -> tuple[int, list[bytes]]:
    words = text.encode().split()
    if spans is None or not len(spans):
        return len(words), words
    kept, at = [], 0
    for a, b in windows.merged([(s["a"], s["b"]) for s in spans]):
        kept += words[at:a]
        at = b
    return len(words), kept + words[at:]


def dedup(docs: DataFrame, window: int = WINDOW, heavy_share: float = windows.HEAVY_SHARE) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, text): text is the kept words joined by one space.

    Words: ``[^\\x20\\x09-\\x0D]+``. A word is removed if a window of ``window`` words that covers it also starts in a
    document with a smaller doc_id; windows are judged on the input. Null text: no words. A null doc_id is smaller than
    all others; rows with equal doc_ids do not count as earlier than each other. Texts shorter than the window stay.
    Other columns are ignored. An empty table gives an empty result.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, removed, sha, out = [], [], [], []
        for text, spans in zip(batch["text"].to_pylist(), batch["spans"].to_pylist(), strict=True):
            count, kept = _kept(text, spans)
            joined = b" ".join(kept)
            n.append(count)
            removed.append(count - len(kept))
            sha.append(hashlib.sha256(joined).hexdigest())
            out.append(joined.decode())
        return pa.record_batch([batch["did"], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha), pa.array(out)], ["did", "n_words", "n_removed", "kept_sha256", "text"])

    docs = docs.select("doc_id", "text")
    marked = windows.with_spans(docs, repeated_words(docs, window, heavy_share=heavy_share)).select("did", F.coalesce("row.text", F.lit("")).alias("text"), "spans")
    out = map_batches(marked, run, "did long, n_words long, n_removed long, kept_sha256 string, text string")
    return out.select(id_or_null().alias("doc_id"), *out.columns[1:])


def dedup_rows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs, all its columns, with text cut to the kept words and n_chars to its length. Texts without a removed word
    stay as they are."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None else b" ".join(_kept(t, s)[1]).decode() for t, s in zip(texts, spans, strict=True)], dtype=object)

    marked = windows.with_spans(docs, repeated_words(docs, window))
    cuts = marked.select("row", cut("row.text", "spans").alias("kept"))
    return cuts.select(*[F.col("kept").alias(c) if c == "text" else F.char_length("kept").cast("long").alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
