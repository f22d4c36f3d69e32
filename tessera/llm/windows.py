"""Exact repeats of fixed-length windows: what substring and suffix-array dedup share.

A text is a row of units (words or bytes). Every window of ``size`` consecutive units has a minimiser, the least hash of
the short grams in it, which depends on the window's content alone. Consecutive windows with one minimiser are a run.

1. ``heavy_grams``: grams that make up a given share of the corpus, at most 1/share of them. They are ordered behind all
   others, so a window takes one as its minimiser only if all its grams are heavy; what merely touches a frequent
   passage is dealt out by its rarer side, and what lies in it is equal and collapses.
2. ``runs``: (minimiser, document, start, windows). Runs whose minimiser occurs in no other run hold no repeat.
3. ``cut``: the others' units are cut out of the texts, each run as one packed string.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import NULL_ID, Scratch, map_batches
from tessera.llm.hashing import Words, grams_of_bytes, grams_of_words, sliding_min, text_bytes

#: A gram is heavy if it is this share of all grams.
HEAVY_SHARE = 2e-5
#: ... and occurs this often.
HEAVY_LEAST = 64
#: Windows of a run at most.
LONGEST_RUN = 4096


@dataclass(frozen=True)
class Units:
    """What a window is made of: ``words`` or ``bytes``; ``size`` units a window, ``gram`` units a gram."""

    kind: str
    size: int
    gram: int

    def grams(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(hash of the gram from each unit of a batch on, first unit of each text and the end). Grams may run on into
        the next text; windows that would hold such grams are never used."""
        if self.kind == "words":
            words = Words(column)
            return grams_of_words(words.hashes(), self.gram), words.first
        data, offsets = text_bytes(column)
        return grams_of_bytes(data, self.gram), offsets

    def packed(self, text: str, starts: list[int], counts: list[int]) -> list[bytes]:
        """The words of each run of windows."""
        words = text.encode().split()
        return [b" ".join(words[s : s + n - 1 + self.size]) for s, n in zip(starts, counts, strict=True)]


def heavy_grams(rows: DataFrame, units: Units, scratch: Scratch, share: float = HEAVY_SHARE) -> np.ndarray:
    """Sorted hashes of grams that are ``share`` of all or more.

    Each batch reports the grams that are that share of its own; a gram that is a share of the whole is so in some batch.
    No more than 1/share of them reach the driver, whatever the input's size.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        grams, _ = units.grams(batch["text"])
        if not len(grams):
            return None
        n = len(grams)
        grams = np.sort(grams)
        begins = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
        counts = np.diff(np.append(begins, n))
        own = counts >= max(3, share * n)
        return pa.record_batch([pa.array(np.append(grams[begins[own]].view(np.int64), 0)), pa.array(np.append(counts[own], 0)), pa.array(np.append(np.zeros(own.sum(), np.int64), n))], ["gram", "n", "of"])

    found = map_batches(rows.select("text"), run, "gram long, n long, of long").groupBy("gram").agg(F.sum("n").alias("n"), F.sum("of").alias("of"))
    found = scratch.write(found, "heavy")
    total = found.agg(F.sum("of")).collect()[0][0] or 0
    top = found.where(F.col("n") >= max(HEAVY_LEAST, share * total)).select("gram").collect()
    return np.sort(np.array([r.gram for r in top], np.int64).view(np.uint64))


def behind(grams: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """Grams as order keys: the heavy ones above all others."""
    keys = grams >> np.uint64(1)
    if len(heavy):
        filter_ = np.zeros(1 << 20, bool)
        filter_[heavy >> np.uint64(44)] = True
        maybe = np.flatnonzero(filter_[grams >> np.uint64(44)])
        at = np.searchsorted(heavy, grams[maybe])
        hit = heavy[np.minimum(at, len(heavy) - 1)] == grams[maybe]
        keys[maybe[hit]] |= np.uint64(1 << 63)
    return keys


def runs(rows: DataFrame, units: Units, heavy: np.ndarray) -> DataFrame:
    """(m, did, th, at) of each run: n windows from unit ``start`` on have minimiser m. at: both in one number, since
    these rows are many."""
    held = rows.sparkSession.sparkContext.broadcast(heavy)  # bounded: see heavy_grams
    width = units.size - units.gram + 1

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        grams, first = units.grams(batch["text"])
        n = len(grams) - units.size + 1
        if n <= 0:
            return None
        keys = behind(grams, held.value)
        least = sliding_min(keys, width)[:n]
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        whole = row[:n] == row[units.size - 1 :]
        breaks = np.ones(n, bool)
        breaks[1:] = (least[1:] != least[:-1]) | (row[1:n] != row[: n - 1])
        begins = np.flatnonzero(breaks & whole)
        ends = np.flatnonzero(np.append(breaks[1:] | ~whole[1:], True) & whole) + 1
        at, count = begins, ends - begins
        if (count > LONGEST_RUN).any():
            parts = -(-count // LONGEST_RUN)
            which = np.repeat(np.arange(len(at)), parts)
            nth = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
            start = at[which] + nth * LONGEST_RUN
            at, count = start, np.minimum(count[which] - nth * LONGEST_RUN, LONGEST_RUN)
        doc = row[at]
        take = pa.array(doc)
        return pa.record_batch(
            [pa.array(least[at].view(np.int64)), batch["did"].take(take), batch["th"].take(take), pa.array((at - first[doc]) << 13 | count)],
            ["m", "did", "th", "at"],
        )

    return map_batches(rows.select("did", "th", "text"), run, "m long, did long, th long, at long")


def cut(texts: DataFrame, wanted: DataFrame, units: Units) -> DataFrame:
    """(m, did, th, start, n, packed, digest) of each wanted run, for each row of texts (did, th, text).

    wanted: (m, did, th, at).
    """
    by_text = wanted.groupBy("did", "th").agg(F.collect_set(F.struct("m", "at")).alias("runs"))  # as bounded as the text
    kinds = {"m": pa.int64(), "did": pa.int64(), "th": pa.int64(), "start": pa.int64(), "n": pa.int64(), "packed": pa.binary(), "digest": pa.binary()}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [[] for _ in kinds]
        for d, t, text, own in zip(batch["did"].to_pylist(), batch["th"].to_pylist(), batch["text"].to_pylist(), batch["runs"], strict=True):
            m, at = own.values.field(0).to_pylist(), own.values.field(1).to_pylist()
            start, n = [x >> 13 for x in at], [x & 8191 for x in at]
            packed = units.packed(text, start, n)
            digest = [hashlib.blake2b(p, digest_size=16).digest() for p in packed]
            for column, values in zip(out, (m, [d] * len(m), [t] * len(m), start, n, packed, digest), strict=True):
                column += values
        return pa.record_batch([pa.array(x, kind) for x, kind in zip(out, kinds.values(), strict=True)], list(kinds))

    joined = texts.join(by_text, ["did", "th"]).select("did", "th", "text", "runs")
    return map_batches(joined, run, "m long, did long, th long, start long, n long, packed binary, digest binary")


def blocks(batches, key: str, most: int):
    """Tables of whole groups of a key, from batches that are sorted by it; of about ``most`` rows, or one group."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch[key].to_pylist() if not pa.types.is_integer(batch[key].type) else batch[key].to_numpy()
        last = next((i for i in range(batch.num_rows - 1, 0, -1) if values[i] != values[i - 1]), 0)
        if n + last >= most and (last or held):
            if last == 0 and held[-1][key][held[-1].num_rows - 1].as_py() == batch[key][0].as_py():
                held.append(batch)
                n += batch.num_rows
                continue
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held, n = [batch.slice(last)], batch.num_rows - last
        else:
            held.append(batch)
            n += batch.num_rows
    if n:
        yield pa.Table.from_batches(held)


def bounded(batches, key: str, most: int):
    """(table, whole) from batches that are sorted by an integer key: tables of whole groups, of about ``most`` rows; a
    group of more rows than that comes by itself in parts, with ``whole`` False."""
    held: list[pa.RecordBatch] = []
    n = tail = 0  # tail: rows at the end that have the last key
    over = None  # the key of a group that comes in parts
    for batch in batches:
        values = batch[key].to_numpy()
        if over is not None:
            other = np.flatnonzero(values != over)
            same = int(other[0]) if len(other) else len(values)
            if same:
                yield pa.Table.from_batches([batch.slice(0, same)]), False
            batch, values = batch.slice(same), values[same:]
        if not len(values):
            continue
        over = None
        breaks = np.flatnonzero(values[1:] != values[:-1])
        joins = held and held[-1][key][held[-1].num_rows - 1].as_py() == values[0]
        tail = len(values) - int(breaks[-1]) - 1 if len(breaks) else len(values) + (tail if joins else 0)
        held.append(batch)
        n += len(values)
        if n - tail >= most or tail > most:
            table = pa.Table.from_batches(held)
            if n > tail:
                yield table.slice(0, n - tail), True
            held, n = table.slice(n - tail).combine_chunks().to_batches(), tail
            if tail > most:
                yield pa.Table.from_batches(held), False
                held, n, tail, over = [], 0, 0, values[-1]
    if n:
        yield pa.Table.from_batches(held), True


def ranks(first: np.ndarray, ends: np.ndarray, size: int, length: int = 1) -> np.ndarray:
    """Equal numbers for equal windows of ``size`` entries, in the windows' order; -1 where a window doesn't fit.

    first: a number for the ``length`` entries from each on, equal for equal ones, or -1; ends: where each entry's
    string ends. A multikey sort whose symbols double: windows of equal prefix are split by the rank of what follows it.
    """
    here = np.arange(len(first))
    rank = np.full(len(first), -1, np.int64)
    fits = np.flatnonzero(here + length <= ends)
    rank[fits] = np.unique(first[fits], return_inverse=True)[1]
    while length < size:
        step = min(length, size - length)
        fits = np.flatnonzero(here + length + step <= ends)
        out = np.full(len(first), -1, np.int64)
        out[fits] = np.unique(rank[fits] << np.int64(32) | rank[fits + step], return_inverse=True)[1]
        rank, length = out, length + step
    return rank


def stretches(values: np.ndarray, string: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the stretches of windows of one string with one value."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    breaks = np.flatnonzero((values[1:] != values[:-1]) | (string[1:] != string[:-1])) + 1
    return np.concatenate(([0], breaks)), np.append(breaks, len(values))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order; those that overlap or touch are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def with_spans(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """Every row of docs as (did, row, spans): row is a struct of its columns, spans: array<struct<a,b>> of the units of
    its text to remove, or null. marks: (did, th, a, b)."""
    by_text = marks.groupBy("did", "th").agg(F.collect_set(F.struct("a", "b")).alias("spans"))  # as bounded as the text
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    rows = rows.select("row", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(NULL_ID)).alias("did"), F.xxhash64(text).alias("th"))
    return rows.join(by_text, ["did", "th"], "left").select("did", "row", "spans")
