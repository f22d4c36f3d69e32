"""Best-fit packing of documents into sequences of a fixed capacity, by large-item matching.

Tokenising and dealing out are Spark jobs; only the counts of pieces by length (at most ``capacity`` numbers, however
many documents there are) reach the driver, where they are packed as counts:

* pieces above one third of the capacity are matched greedily, longest first, each with the longest partner that fits;
  a sequence holds two of them at most;
* shorter pieces go, longest first, into the smallest gap that holds them, and into new sequences where none does.

The plan says which ranks of each length go to which sequences. A piece's rank among those of its length is counted
in buckets of a hash, so that no length is gathered in one task.
"""

from __future__ import annotations

import bisect
import functools
import json
import os
import zlib
from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm import bpe
from tessera.llm.common import Scratch, id_or_null, keyed, map_batches, strings

CAPACITY = 2048
#: How a byte-level pre-tokenizer splits texts. A fixed value of that format.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces of one length whose ranks are counted in one bucket, about.
BUCKET = 512


@functools.lru_cache(maxsize=1)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are what runs in parallel
    return Tokenizer.from_file(path)


def _bytes_of_letters() -> dict[str, int]:
    """How a byte-level vocabulary spells bytes: printable ones as themselves, the others from U+0100 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(others)}


@functools.lru_cache(maxsize=1)
def ranks(path: str) -> dict[bytes, int] | None:
    """The vocabulary as ranks, if merging by them is known to give the tokenizer's own ids; else None.

    It is, if nothing but byte-level splitting comes before the merges, these are listed by the ids that they make, and
    each token's own letters, merged by lower ids alone, end as the two parts that its merge joins. For when a token can
    be made in a text, its borders have been there all the time, so its letters were merged as if they stood alone.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, split = spec["model"], spec["pre_tokenizer"] or {}
    plain = spec["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
    plain = plain and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain:
        return None
    special, letters = {t["content"] for t in spec["added_tokens"]}, _bytes_of_letters()
    vocabulary = {t: i for t, i in model["vocab"].items() if t not in special}
    merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    made = [vocabulary.get(a + b, -1) for a, b in merges]
    if not all(x < y for x, y in zip([-1, *made], made)) or len(vocabulary) != len(made) + 256 or not all(x in vocabulary for x in letters):
        return None
    for (a, b), rank in zip(merges, made, strict=True):
        parts = list(a + b)
        while True:
            lowest, at = min((vocabulary.get(x + y, rank), i) for i, (x, y) in enumerate(zip(parts, parts[1:])))
            if lowest >= rank:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if parts != [a, b]:
            return None
    return {bytes(letters[c] for c in t): i for t, i in vocabulary.items()}


@functools.lru_cache(maxsize=2)
def _encoder(path: str, by_ranks: bool) -> Callable[[str], list[int]]:
    """Ids of a text. by_ranks: ``ranks`` has found that they may be taken from the vocabulary's ranks, which is faster;
    texts that spell a special token go to the tokenizer all the same."""
    tokenizer = _tokenizer(path)
    slow = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    if not by_ranks:
        return slow
    import tiktoken

    letters = _bytes_of_letters()
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    own = {bytes(letters[c] for c in t): i for t, i in tokenizer.get_vocab(with_added_tokens=False).items() if t not in special}
    fast = tiktoken.Encoding("vocabulary", pat_str=SPLIT, mergeable_ranks=own, special_tokens={})
    return lambda text: slow(text) if any(x in text for x in special) else bpe.ordinary(fast, text, SPLIT)


def token_bytes(text: str, path: str, by_ranks: bool) -> bytes:
    """The ids of one text as little-endian unsigned 32-bit integers."""
    return np.array(_encoder(path, by_ranks)(text), "<u4").tobytes()


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(did, th, piece, start, length, ids_crc32): the pieces of each text's ids with ``end_id`` at the end."""
    end, by_ranks = np.array([end_id], "<u4").tobytes(), ranks(path) is not None

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for did, th, text in zip(batch["did"].to_pylist(), batch["th"].to_pylist(), strings(batch["text"]), strict=True):
            ids = token_bytes(text, path, by_ranks) + end
            n = len(ids) // 4
            at = 0
            for piece in range(-(-n // capacity)):
                size = (n - 1) % capacity + 1 if piece == 0 else capacity
                rows.append((did, th, piece, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])))
                at += size
        return pa.record_batch([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["did", "th", "piece", "start", "length", "ids_crc32"])

    return map_batches(keyed(docs), run, "did long, th long, piece long, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Pack counts of lengths. Rows (length, first rank, end of ranks, first sequence, offset): rank first + i of that
    length lies in sequence first + i at that offset."""
    out: list[tuple[int, int, int, int, int]] = []
    groups: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: (first sequence, sequences) of equal filling
    gaps: list[int] = []  # those with groups, ascending
    rank: dict[int, int] = defaultdict(int)
    left = {k: v for k, v in counts.items() if v > 0}
    sequences = 0

    def give(size: int, n: int, seq: int, offset: int) -> None:
        out.append((size, rank[size], rank[size] + n, seq, offset))
        rank[size] += n
        left[size] -= n

    def gap(size: int, seq: int, n: int) -> None:
        if size and n:
            if size not in groups:
                bisect.insort(gaps, size)
            groups[size].append((seq, n))

    large = sorted(k for k in left if 3 * k > capacity)
    for size in sorted(large, reverse=True):  # a copy, for used-up partners leave the list
        while n := left[size]:
            fits = bisect.bisect_right(large, capacity - size)
            while fits and not left[large[fits - 1]]:
                large.pop(fits - 1)
                fits -= 1
            partner = large[fits - 1] if fits else 0
            m = min(n // 2 or 1, n) if partner == size else min(n, left.get(partner, 0)) if partner else n
            if partner == size and n == 1:
                partner = 0
                smaller = fits - 2
                while smaller >= 0 and not left[large[smaller]]:
                    smaller -= 1
                if smaller >= 0:
                    partner = large[smaller]
                m = 1
            give(size, m, sequences, 0)
            if partner:
                give(partner, m, sequences, size)
            gap(capacity - size - partner, sequences, m)
            sequences += m
    for size in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while n := left[size]:
            at = bisect.bisect_left(gaps, size)
            if at < len(gaps):
                room = gaps[at]
                seq, m = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    gaps.pop(at)
            else:
                room, seq, m = capacity, sequences, -(-n // (capacity // size))
                sequences += m
            each = room // size
            if n < each * m:  # whole sequences first, then one that is filled in part
                full = n // each
                if full < m:
                    gap(room, seq + full + (1 if full * each < n else 0), m - full - (1 if full * each < n else 0))
                if rest := n - full * each:
                    for j in range(rest):
                        give(size, 1, seq + full, capacity - room + j * size)
                    gap(room - rest * size, seq + full, 1)
                m = full
            for j in range(each if m else 0):
                give(size, m, seq, capacity - room + j * size)
            if m:
                gap(room - each * size, seq, m)
    assert not any(left.values()), "pieces without a place"
    return out


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Pack every whole text: (doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row per piece.

    Null and empty texts: one piece, the end id. Null and repeated doc_ids: each row is packed. Only documents above the
    capacity are cut, from their end, so that the first piece may be shorter. Other columns are ignored. An empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    items = scratch.write(pieces(docs, path, capacity, end_id), "pieces")
    counts = {r.length: r.n for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}  # a row per length
    spread = spark.createDataFrame([(k, -(-n // BUCKET)) for k, n in counts.items()], "length long, buckets long")
    items = items.join(F.broadcast(spread), "length")  # a row per length: ``capacity`` rows at most
    items = items.withColumn("bucket", F.pmod(F.xxhash64("did", "th", "piece"), "buckets"))
    by_bucket = items.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = by_bucket.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "bucket").orderBy("did", "th", "piece")
    ranked = items.withColumn("place", F.row_number().over(within) - 1).join(base, ["length", "bucket"])
    ranked = ranked.select("did", "piece", "start", "length", "ids_crc32", (F.col("place") + F.col("base")).alias("rank"))
    slots = np.array(sorted(plan(counts, capacity)), np.int64).reshape(-1, 5)  # bounded by the capacity alone
    keys = slots[:, 0] << np.int64(48) | slots[:, 1]

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
        slot = np.searchsorted(keys, length << np.int64(48) | rank, side="right") - 1
        columns = [batch[c] for c in ("did", "piece", "start", "length", "ids_crc32")]
        return pa.record_batch([*columns, pa.array(slots[slot, 3] + rank - slots[slot, 1]), pa.array(slots[slot, 4])], [*names, "sequence_id", "offset"])

    names = ["did", "piece", "start", "length", "ids_crc32"]
    out = map_batches(ranked, place, ", ".join(f"{c} long" for c in [*names, "sequence_id", "offset"]))
    return out.select(id_or_null().alias("doc_id"), F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", "sequence_id", "offset")
