"""Phrase collocation mining by a minimal perfect hash over Apriori-safe candidates.

1. Candidates, level by level: a phrase is counted only if its parts may be frequent. A level's mappers hash its phrases,
   add equal hashes up and send 32 bits of each to a shard named by the bits before; shards add the counts up. Phrases
   that share those bits are counted as one, so that a count may be too large and never too small: no frequent phrase is
   lost. The hashes that reach the least count become a bitmap of ``BITS`` bits, whatever the input is.
2. The phrases that pass the three bitmaps are sent to shards of some ``SLOTS`` candidates, once a mapper, as the hashes of
   their words (their stored keys) with counts, and nowhere else; where a shard is dealt to several tasks, these are added up
   as a tree. Each shard gets a minimal perfect hash of its keys, and an array of counts by slot.
3. Cuts are read by slot: each frequent phrase asks the shards of its parts, by slot, how often they occur.

Counts are exact: what passes a bitmap by chance is counted as itself, and if two different words, or two phrases of a
shard, have one 64-bit hash, that is seen, and all is done again with another hash. Nothing grows with the input but what
is shuffled: bitmaps and shards are bounded, a common word or phrase is one entry a mapper, and the tables of a shard that
many phrases ask are read by several tasks.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, partitions, slices, trimmed
from tessera.llm.hashing import Words, mix
from tessera.llm.perfect import PerfectHash

#: Occurrences for a candidate, percent of them inside a longer candidate that drop it, phrases a language.
LEAST, COVER, TOP = 10, 50, 2000
#: Bits of a level's bitmap (as a power of 2), keys of a shard on average, entries that a mapper adds up at once, arrays added at once.
BITS, SLOTS, HELD, FAN = 26, 1 << 17, 1 << 20, 16
#: Bytes of a word beyond which a cryptographic hash takes the place of the polynomial one.
LONG_WORD = 64
#: Bytes of texts that a mapper works on at once, or one text: what it makes of them is some eighty times as large.
BATCH = 500_000
#: Keys of a row of the table of candidates: some 256 kB.
BLOB = 8192
#: Such rows that are handed over at once.
ROWS = 8
ATTEMPTS = 8

_SPLIT = np.zeros(256, bool)  # ends a piece
_SPLIT[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_SEPARATOR = _SPLIT.copy()
_SEPARATOR[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class _Scratch(Scratch):
    #: What a function is handed at once: a row holds a shard's part of a mapper's entries.
    SETTINGS = Scratch.SETTINGS | {"spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def _base(attempt: int) -> int:
    return int(mix(np.array([attempt + 77], np.uint64))[0]) | 5


def gram(*words: np.ndarray) -> np.ndarray:
    """A hash of each phrase, given the hashes of its words."""
    out = mix(words[0] + np.uint64(0x632BE59BD9B4E019))
    for w in words[1:]:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + w)
    return out


class Phrases:
    """The words of a batch (lang, text), and which consecutive ones lie in one piece: ``joined`` for each word and the next."""

    def __init__(self, batch: pa.RecordBatch, attempt: int = 0):
        self.words = words = Words(batch["text"], _SEPARATOR, _LOWER)
        piece = np.cumsum(_SPLIT[words.data], dtype=np.int32)
        at = piece[words.start] if len(words.start) else piece[:0]
        self.joined = (words.row[1:] == words.row[:-1]) & (at[1:] == at[:-1])
        self.langs = batch["lang"].to_pylist()
        seeds = {x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in set(self.langs)}
        self.hashes = words.hashes(_base(attempt))
        for i in np.flatnonzero(words.end - words.start > LONG_WORD).tolist():
            data = words.data[words.start[i] : words.end[i]].tobytes()
            self.hashes[i] = int.from_bytes(hashlib.blake2b(data, digest_size=8, salt=attempt.to_bytes(8, "little")).digest(), "little")
        own = mix(self.hashes + np.array([seeds[x] for x in self.langs], np.uint64)[words.row])
        self.hashes = np.maximum(own, np.uint64(1))  # 0 stands for no word

    def text(self, at: np.ndarray) -> pa.Array:
        """The words at these places."""
        start, size = self.words.start[at], (self.words.end - self.words.start)[at]
        ends = np.concatenate(([0], np.cumsum(size)))
        data = self.words.data[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])]
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes()))

    def frequent(self, bitmaps: list[np.ndarray], level: int) -> np.ndarray:
        """Where a phrase of ``level`` words begins whose parts may all be frequent, by the bitmaps of the levels there are."""
        w, ok = self.hashes, np.ones(len(self.hashes), bool)
        for k in range(1, level + 1):
            if k > 1:
                ok = ok[:-1] & ok[1:] & (self.joined if k == 2 else self.joined[:-1] & self.joined[1:])
            if k <= len(bitmaps) and len(ok):
                at = np.flatnonzero(ok)
                ok[at] = _has(bitmaps[k - 1], gram(*(w[at + j] for j in range(k))))
        return np.flatnonzero(ok)


def _has(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes >> np.uint64(64 - BITS)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & np.uint8(1) > 0


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of each run of equal numbers, none of them below 0."""
    cuts = np.flatnonzero(np.diff(x, prepend=-1)).tolist()
    return list(zip(cuts, cuts[1:] + [len(x)] * bool(cuts), strict=True))


def _gathered(make: Callable, merge: Callable, flush: Callable, most: int) -> Callable:
    """A function for mapInArrow: ``make`` gives the entries of a batch, ``merge`` adds those of several up, and ``flush``
    gives their rows, at the end and when adding up leaves more than half of ``most``."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, BATCH) if batch.num_rows else ():
                held.append(make(part))
                size += len(held[-1][0])
                if size >= most:
                    held = [merge(held)]
                    size = len(held[0][0])
                    if 2 * size >= most:
                        yield from flush(*held[0])
                        held, size = [], 0
        if held:
            yield from flush(*merge(held))

    return run


def _added(keys: list[np.ndarray], times: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Keys (columns, the first of which is a hash of all) in the order of the first, equal ones with their counts added up."""
    order, new = np.argsort(keys[0], kind="stable"), np.zeros(len(keys[0]), bool)
    new[:1] = True
    out = []
    for x in keys:
        out.append(x[order])
        new[1:] |= out[-1][1:] != out[-1][:-1]
    begins = np.flatnonzero(new)
    return [x[begins] for x in out], np.add.reduceat(times[order], begins) if len(begins) else times[:0]


def _by(batches, key: list[str], begin: Callable, add: Callable, end: Callable) -> Iterator[pa.RecordBatch]:
    """Rows sorted by ``key``: ``begin`` a group's state, ``add`` each of its rows to it, ``end`` it."""
    now, state = None, None
    for batch in batches:
        for row in zip(*(batch[c].to_pylist() for c in batch.schema.names), strict=True):
            row = dict(zip(batch.schema.names, row, strict=True))
            own = tuple(row[c] for c in key)
            if own != now:
                if now is not None:
                    yield from end(now, state)
                now, state = own, begin()
            add(state, row)
    if now is not None:
        yield from end(now, state)


def _grouped(df: DataFrame, n_tasks: int, key: list[str], begin: Callable, add: Callable, end: Callable, schema: str, *then: str) -> DataFrame:
    return df.repartition(n_tasks, *key).sortWithinPartitions(*key, *then).mapInArrow(trimmed(lambda batches: _by(batches, key, begin, add, end)), schema)


def _level(scratch: Scratch, texts: DataFrame, level: int, bitmaps: list, attempt: int, least: int, shards: int, most: int) -> tuple[np.ndarray, int, list]:
    """(bitmap, candidates, words of each language) of phrases of ``level`` words."""
    low_at = np.uint64(32 - shards)

    def make(batch: pa.RecordBatch) -> tuple:
        phrases = Phrases(batch, attempt)
        at = phrases.frequent([b.value for b in bitmaps], level)
        n: dict[str, int] = {}
        if level == 1:
            for lang, k in zip(phrases.langs, np.diff(phrases.words.first).tolist(), strict=True):
                n[lang] = n.get(lang, 0) + k
        return *np.unique(gram(*(phrases.hashes[at + j] for j in range(level))), return_counts=True), n

    def merge(held: list) -> tuple:
        (values,), times = _added([np.concatenate([x[0] for x in held])], np.concatenate([x[1] for x in held]))
        n = {lang: sum(x[2].get(lang, 0) for x in held) for x in held for lang in x[2]}
        return values, times, n

    def flush(values: np.ndarray, times: np.ndarray, n: dict[str, int]) -> Iterator[pa.RecordBatch]:
        shard, low = (values >> np.uint64(64 - shards)).astype(np.int32), ((values >> low_at) & np.uint64(2**32 - 1)).astype(np.uint32)
        parts = _runs(shard)
        columns = [
            pa.array([int(shard[a]) for a, _ in parts] + [-1] * len(n), pa.int32()),
            pa.array([low[a:b].tobytes() for a, b in parts] + [None] * len(n), pa.binary()),
            pa.array([times[a:b].astype(np.uint32).tobytes() for a, b in parts] + [None] * len(n), pa.binary()),
            pa.array([None] * len(parts) + list(n), pa.string()),
            pa.array([None] * len(parts) + list(n.values()), pa.int64()),
        ]
        yield pa.record_batch(columns, ["shard", "low", "times", "lang", "n"])

    counted = texts.mapInArrow(trimmed(_gathered(make, merge, flush, most)), "shard int, low binary, times binary, lang string, n long")
    if level == 1:  # which is read twice
        counted = scratch.write(counted, "level-1")

    def summed(state: dict) -> None:
        low, at = np.unique(np.concatenate(state["low"]), return_inverse=True)
        state["low"], state["times"], state["size"] = [low], [np.bincount(at, np.concatenate(state["times"]), len(low)).astype(np.int64)], len(low)

    def add(state: dict, row: dict) -> None:
        state["low"].append(np.frombuffer(row["low"], np.uint32))
        state["times"].append(np.frombuffer(row["times"], np.uint32).astype(np.int64))
        state["new"] += len(state["low"][-1])
        if state["new"] > max(HELD, state["size"]):
            summed(state)
            state["new"] = 0

    def end(key: tuple, state: dict) -> Iterator[pa.RecordBatch]:
        summed(state)
        low = state["low"][0][state["times"][0] >= least]
        bits = np.zeros(1 << (BITS - shards), bool)
        bits[low >> np.uint32(32 - (BITS - shards))] = True
        yield pa.record_batch([pa.array(key, pa.int32()), pa.array([len(low)], pa.int64()), pa.array([np.packbits(bits).tobytes()], pa.binary())], ["shard", "found", "bits"])

    begin = lambda: {"low": [], "times": [], "new": 0, "size": 0}
    found = _grouped(counted.where("shard >= 0").select("shard", "low", "times"), partitions(scratch.spark), ["shard"], begin, add, end, "shard int, found long, bits binary")
    found = scratch.write(found, f"found-{level}")
    bitmap, total = np.zeros(1 << (BITS - 3), np.uint8), 0
    for row in found.collect():  # each has its own part of the bitmap's 2**BITS bits
        bitmap[row.shard << (BITS - shards - 3) : (row.shard + 1) << (BITS - shards - 3)] = np.frombuffer(row.bits, np.uint8)
        total += row.found
    n = scratch.write(counted.where("lang is not null").groupBy("lang").agg(F.sum("n").alias("n")), "n") if level == 1 else None
    scratch.drop("level-1", f"found-{level}")
    return bitmap, total, n


def _shard(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(hashes), np.int32)


def _names(texts: DataFrame, bitmap, attempt: int, most: int) -> DataFrame:
    """(w, name, clash): the words that may be frequent by their hashes, once a mapper or oftener; clash: if two in a mapper have one."""

    def make(batch: pa.RecordBatch) -> tuple:
        phrases = Phrases(batch, attempt)
        at = phrases.frequent([bitmap.value], 1)
        values, first, which = np.unique(phrases.hashes[at], return_index=True, return_inverse=True)
        other = phrases.words.hashes(_base(attempt + ATTEMPTS))[at]
        names = pa.table([pa.array(phrases.langs, pa.string()).take(pa.array(phrases.words.row[at[first]])), pa.array(values), phrases.text(at[first])], ["lang", "w", "word"])
        return values, names, bool((other[first[which]] != other).any())

    def merge(held: list) -> tuple:
        names, clash = pa.concat_tables([x[1] for x in held]).combine_chunks(), any(x[2] for x in held)
        values, first, which = np.unique(names["w"].to_numpy(), return_index=True, return_inverse=True)
        clash |= any(not names[c].take(pa.array(first[which])).equals(names[c]) for c in ("lang", "word"))
        return values, names.take(pa.array(first)).combine_chunks(), clash

    def flush(values: np.ndarray, names: pa.Table, clash: bool) -> Iterator[pa.RecordBatch]:
        rows = names.set_column(1, "w", pa.array(values.view(np.int64))).append_column("clash", pa.array(np.full(len(values), clash)))
        yield from rows.to_batches(max_chunksize=BLOB)

    found = texts.mapInArrow(trimmed(_gathered(make, merge, flush, most)), "lang string, w long, word string, clash boolean")
    return found.select("w", F.struct("lang", "word").alias("name"), "clash")


def _counts_bytes(times: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs."""
    return times.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if int(times.max(initial=0)) <= np.iinfo(t).max)).tobytes()


def _sent(keys: np.ndarray, times: np.ndarray, shards: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(shard, words, their hashes, counts) of distinct candidates (hash, then word hashes, 0 for none). What is sent of a
    phrase is the hashes of its own words, by its first word, so that runs of equal ones are compressed."""
    shard, size = _shard(keys[0], shards), 1 + (keys[2] > 0) + (keys[3] > 0)
    order = np.lexsort((keys[1], shard * 4 + size))
    keys, times, kind = keys[1:, order], times[order], (shard * 4 + size)[order]
    for a, b in _runs(kind):
        k = int(kind[a]) % 4
        for i in range(a, b, BLOB):
            j = min(i + BLOB, b)
            yield int(kind[a]) // 4, k, np.ascontiguousarray(keys[:k, i:j]).tobytes(), _counts_bytes(times[i:j])


def _received(size: int, words: bytes, times: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Keys (hash, then word hashes, 0 for none) and counts of a row of ``_sent``."""
    own = np.frombuffer(words, np.uint64).reshape(size, -1)
    keys = np.zeros((4, own.shape[1]), np.uint64)
    keys[0], keys[1 : size + 1] = gram(*own), own
    return keys, np.frombuffer(times, f"<u{len(times) // own.shape[1]}").astype(np.int64)


def _occurrences(texts: DataFrame, bitmaps: list, attempt: int, shards: int, parts: int, most: int) -> DataFrame:
    """(shard, part, size, words, times): candidates with counts by shard, as rows of ``_sent``."""

    def make(batch: pa.RecordBatch) -> tuple:
        phrases, maps = Phrases(batch, attempt), [b.value for b in bitmaps]
        keys: list[list[np.ndarray]] = [[], [], [], []]
        for k in (1, 2, 3):
            at = phrases.frequent(maps, k)
            own = [phrases.hashes[at + j] for j in range(k)]
            for column, x in zip(keys, [gram(*own), *own, *[np.zeros(len(at), np.uint64)] * (3 - k)], strict=True):
                column.append(x)
        keys = [np.concatenate(x) for x in keys]
        keys, times = _added(keys, np.ones(len(keys[0]), np.int64))
        return keys[0], keys, times

    def merge(held: list) -> tuple:
        keys, times = _added([np.concatenate([x[1][i] for x in held]) for i in range(4)], np.concatenate([x[2] for x in held]))
        return keys[0], keys, times

    def flush(_, keys: list[np.ndarray], times: np.ndarray) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() % parts
        yield from _rows(_sent(np.stack(keys), times, shards), part)

    return texts.mapInArrow(trimmed(_gathered(make, merge, flush, most)), _SENT)


_SENT = "shard int, part int, size int, words binary, times binary"


def _rows(sent: Iterator[tuple[int, int, bytes, bytes]], part: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``_SENT``, a few at once."""
    while some := list(itertools.islice(sent, ROWS)):
        shard, size, words, times = zip(*some, strict=True)
        yield pa.record_batch([pa.array(shard, pa.int32()), pa.array([part] * len(some), pa.int32()), pa.array(size, pa.int32()), pa.array(words, pa.binary()), pa.array(times, pa.binary())], ["shard", "part", "size", "words", "times"])


def _tables(sent: DataFrame, n_tasks: int, shards: int, parts: int) -> DataFrame:
    """(shard, hash, stored, counts, clash): each shard's minimal perfect hash, its stored keys and their counts by slot.

    A shard that is dealt to several parts is added up as a tree: each sends its keys on once."""

    def added(state: dict) -> None:
        keys, times = _added(list(np.concatenate(state["keys"], axis=1)), np.concatenate(state["times"]))
        state["keys"], state["times"], state["size"], state["new"] = [np.stack(keys)], [times], len(times), 0

    def add(state: dict, row: dict) -> None:
        keys, times = _received(row["size"], row["words"], row["times"])
        state["keys"].append(keys)
        state["times"].append(times)
        state["new"] += len(times)
        if state["new"] > max(HELD // 4, state["size"]):
            added(state)

    def on(key: tuple, state: dict) -> Iterator[pa.RecordBatch]:
        added(state)
        yield from _rows(_sent(state["keys"][0], state["times"][0], shards), key[1])

    def end(key: tuple, state: dict) -> Iterator[pa.RecordBatch]:
        added(state)
        own = state["keys"][0]
        new = np.concatenate(([True], own[0, 1:] != own[0, :-1]))
        perfect = PerfectHash.of(own[0, new])
        slots = perfect.slots(own[0])
        stored = np.zeros((3, perfect.n), np.uint64)
        stored[:, slots] = own[1:]
        counts = np.zeros(perfect.n, np.int64)
        counts[slots] = state["times"][0]
        columns = [pa.array([key[0]], pa.int32()), *(pa.array([x], pa.binary()) for x in (perfect.to_bytes(), stored.tobytes(), counts.tobytes())), pa.array([not new.all()])]
        yield pa.record_batch(columns, ["shard", "hash", "stored", "counts", "clash"])

    begin = lambda: {"keys": [], "times": [], "new": 0, "size": 0}
    while parts > 1:
        sent = _grouped(sent, n_tasks, ["shard", "part"], begin, add, on, _SENT)
        parts = -(-parts // FAN)
        sent = sent.withColumn("part", F.floor(F.col("part") / FAN).cast("int"))
    return _grouped(sent, n_tasks, ["shard"], begin, add, end, "shard int, hash binary, stored binary, counts binary, clash boolean")


def _frequent(least: int, shards: int, ask: bool) -> Callable:
    """From each shard's table: its frequent phrases of two words or more, or what they ask of other shards."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, stored, counts in zip(*(batch[c].to_pylist() for c in ("shard", "stored", "counts")), strict=True):
                w, a = np.frombuffer(stored, np.uint64).reshape(3, -1), np.frombuffer(counts, np.int64)
                slots = np.flatnonzero((a >= least) & (w[1] > 0))
                w, a, phrase = w[:, slots], a[slots], slots.astype(np.int64) << 32 | shard
                if not ask:
                    for i in range(0, len(slots), 65536):
                        own = [x[i : i + 65536] for x in (phrase, *w.view(np.int64), a)]
                        yield pa.record_batch([pa.array(x) for x in own], ["phrase", "w1", "w2", "w3", "a"])
                    continue
                three = np.flatnonzero(w[2] > 0)
                two = np.flatnonzero(w[2] == 0)
                parts = [  # which: left and right of the cut after one word, and after two
                    (0, np.arange(len(slots)), gram(w[0])), (1, two, gram(w[1][two])),
                    (1, three, gram(w[1][three], w[2][three])), (2, three, gram(w[0][three], w[1][three])), (3, three, gram(w[2][three])),
                ]
                which = np.concatenate([np.full(len(at), k, np.int64) for k, at, _ in parts])
                who, hashes = np.concatenate([phrase[at] for _, at, _ in parts]), np.concatenate([g for *_, g in parts])
                to = _shard(hashes, shards)
                order = np.argsort(to, kind="stable")
                for i, j in _runs(to[order]):
                    own = order[i:j]
                    asked = np.stack([hashes[own], who[own].view(np.uint64), which[own].view(np.uint64)])
                    yield pa.record_batch([pa.array([int(to[order[i]])], pa.int32()), pa.array([shard], pa.int32()), pa.array([asked.tobytes()], pa.binary())], ["shard", "asks", "asked"])

    return run


def _answers(slots: DataFrame, asked: DataFrame, n_tasks: int, parts: int) -> DataFrame:
    """(phrase, which, f): what each part of a frequent phrase occurs, read by its slot."""
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    rows = slots.select("shard", every.alias("part"), F.lit(0).alias("kind"), F.col("hash").alias("a"), F.col("counts").alias("b"))
    rows = rows.unionByName(asked.select("shard", F.pmod("asks", F.lit(parts)).alias("part"), F.lit(1).alias("kind"), F.col("asked").alias("a"), F.lit(None).cast("binary").alias("b")))

    def run(batches) -> Iterator[pa.RecordBatch]:
        perfect = counts = None
        for batch in batches:
            for kind, a, b in zip(*(batch[c].to_pylist() for c in ("kind", "a", "b")), strict=True):
                if kind == 0:
                    perfect, counts = PerfectHash.from_bytes(a), np.frombuffer(b, np.int64)
                    continue
                hashes, who, which = np.frombuffer(a, np.uint64).reshape(3, -1)
                f = counts[perfect.slots(hashes)]  # a part of a frequent phrase is a candidate itself
                for i in range(0, len(f), 65536):
                    j = slice(i, i + 65536)
                    yield pa.record_batch([pa.array(who[j].view(np.int64)), pa.array(which[j].astype(np.int32)), pa.array(f[j])], ["phrase", "which", "f"])

    return rows.repartition(n_tasks, "shard", "part").sortWithinPartitions("shard", "part", "kind").mapInArrow(run, "phrase long, which int, f long")


def _clashes(*tables: DataFrame) -> bool:
    return any(table.where("clash").limit(1).count() for table in tables)


def mine(docs: DataFrame, least: int = LEAST, cover: int = COVER, top: int = TOP, held: int = HELD, keys_a_shard: int = SLOTS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the collocations of two and three words of each language.

    Texts are lower-cased (A-Z), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and at spaces and tabs into words. a: the
    occurrences of the phrase, ``least`` or more; l, r: those of its parts at the cut with the lowest score, floor(10**6 a a
    / (l r)), the first such cut; n: all words of the language. Phrases of which ``cover`` percent of the occurrences or
    more, by count, could lie in one longer phrase with ``least`` occurrences are left out. The ``top`` of each language by
    score, then a, both descending, then phrase (UTF-8 bytes). ``held`` and ``keys_a_shard`` bound memory and change no result.

    Null text: empty; null lang: ``und``, one language with rows that say so. Rows are not told apart by id: repeated ones
    count as often as they occur. Other columns are ignored; no rows, or none with a frequent phrase, give no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    for attempt in range(ATTEMPTS):
        scratch, n_tasks = _Scratch(spark, "collocations"), partitions(spark)
        level_shards = min(12, max(1, (n_tasks - 1).bit_length()))
        bitmaps, candidates = [], 0
        for level in (1, 2, 3):
            bitmap, found, n_words = _level(scratch, texts, level, bitmaps, attempt, least, level_shards, held)
            n = n_words if level == 1 else n
            bitmaps.append(spark.sparkContext.broadcast(bitmap))  # 2**BITS bits
            candidates += found
        shards = max(0, (-(-candidates // keys_a_shard) - 1).bit_length())
        parts = max(1, min(FAN * FAN, n_tasks >> shards))
        slots = scratch.write(_tables(_occurrences(texts, bitmaps, attempt, shards, parts, held // 2), n_tasks, shards, parts), "slots")
        words = _names(texts, bitmaps[0], attempt, held).groupBy("w").agg(F.min("name").alias("name"), (F.max("clash") | (F.min("name") != F.max("name"))).alias("clash"))
        words = scratch.write(words.select("w", "name.lang", "name.word", "clash"), "words")
        for b in bitmaps:
            b.unpersist()
        if not _clashes(slots, words):
            break
        scratch.keep()
    else:
        raise RuntimeError("words or phrases with equal hashes in every attempt")

    frequent = slots.select("shard", "stored", "counts")
    asked = frequent.mapInArrow(_frequent(least, shards, True), "shard int, asks int, asked binary")
    answers = _answers(slots, asked, n_tasks, parts).groupBy("phrase").agg(*[F.max(F.when(F.col("which") == k, F.col("f"))).alias(f"f{k}") for k in range(4)])
    phrases = scratch.write(frequent.mapInArrow(_frequent(least, shards, False), "phrase long, w1 long, w2 long, w3 long, a long"), "phrases")

    big = lambda c: f"cast({c} as decimal(15, 0))"
    score = lambda left, right: F.expr(f"(1000000BD * {big('a')} * {big('a')}) div ({big(left)} * {big(right)})")
    scored = phrases.join(answers, "phrase").withColumns({"s1": score("f0", "f1"), "s2": score("f2", "f3")})
    second = F.coalesce(F.col("s2") < F.col("s1"), F.lit(False))
    pick = lambda x, y: F.when(second, F.col(y)).otherwise(F.col(x))
    scored = scored.select("w1", "w2", "w3", "a", pick("f0", "f2").alias("l"), pick("f1", "f3").alias("r"), pick("s1", "s2").alias("score"))

    # only phrases of two words have longer ones; a null of the outer join is no cover
    longer = phrases.where("w3 <> 0").select(F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("in"), "a")
    longer = longer.groupBy("in").agg(F.max("a").alias("longer")).select("in.w1", "in.w2", F.lit(0).cast("long").alias("w3"), "longer")
    left = scored.join(longer, ["w1", "w2", "w3"], "left").where(F.coalesce(100 * F.col("longer") < cover * F.col("a"), F.lit(True)))

    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    name = lambda k: words.select(F.col("w").alias(f"w{k}"), F.col("word").alias(f"word{k}"))
    left = left.join(words.select(F.col("w").alias("w1"), F.col("word").alias("word1"), "lang"), "w1")
    left = left.withColumn("place", F.rank().over(best)).where(F.col("place") <= top)  # ties stay; Spark limits each task's rows first
    left = left.join(name(2), "w2").join(name(3), "w3", "left")
    out = left.select("lang", F.concat_ws(" ", "word1", "word2", "word3").alias("phrase"), "a", "l", "r", "score").join(n, "lang")
    rank = F.row_number().over(best.orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))).cast("long")
    out = out.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    out = scratch.write(out, "out")
    scratch.keep("out")
    return out
