"""Quality classifier: logistic regression over hashed word n-grams, trained by follow the regularised leader (FTRL).

Features of a text: n-grams of its words, n-grams of its words' shapes (letters and digits collapsed, punctuation kept),
and pairs of words that repeat, each hashed to a place and weighted by its share of the words. A score is the logistic of
a sparse dot product. The fit reads a bounded sample of labelled rows; scoring is one pass over all texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_batches
from tessera.llm.hashing import Words, grams_of_words, mix, powers

BITS = 18
#: Labelled rows that a fit takes at most: those whose ids' hashes are smallest.
SAMPLE = 6000
EPOCHS, ALPHA, BETA, L1, L2 = 4, 0.5, 1.0, 1e-4, 1e-4
#: Bytes of texts that a task works on at once, or one text: what it makes of them is some eighty times as large.
BATCH = 500_000
#: What a share of the words is multiplied by.
SCALE = 12.0

_KIND = np.zeros(256, np.uint8)  # 0: left out; letters and digits collapse to one sign a run; others stay
_KIND[33:127] = np.arange(33, 127)
_KIND[ord("a") : ord("z") + 1] = ord("a")
_KIND[ord("A") : ord("Z") + 1] = ord("A")
_KIND[ord("0") : ord("9") + 1] = ord("0")


def shapes(words: Words) -> np.ndarray:
    """A hash of each word's shape."""
    kind = _KIND[words.data]
    before = np.zeros_like(kind)
    before[1:] = kind[:-1]
    before[words.start[words.start < len(kind)]] = 0
    stays = (kind > 0) & ~((kind == before) & np.isin(kind, [ord("a"), ord("A"), ord("0")]))
    place = np.zeros(len(kind) + 1, np.int64)
    np.cumsum(stays, out=place[1:])
    up, down = powers(len(kind) + 1)
    sums = np.zeros(len(kind) + 1, np.uint64)
    np.cumsum(np.where(stays, (kind.astype(np.uint64) + np.uint64(1)) * up[place[:-1]], np.uint64(0)), out=sums[1:])
    return mix((sums[words.end] - sums[words.start]) * down[place[words.start]])


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, words of the row) of every n-gram in a batch of texts."""
    words = Words(column)
    own, shape = words.hashes(), shapes(words)
    row = words.row
    same = np.zeros(len(row), bool)
    same[:-1] = row[1:] == row[:-1]
    repeats = same.copy()
    repeats[:-1] &= own[1:] == own[:-1]
    kinds = [
        (row, own),
        (row[same], grams_of_words(own, 2)[same]),
        (row, mix(shape + np.uint64(1))),
        (row[same], mix(grams_of_words(shape, 2)[same] + np.uint64(2))),
        (row[repeats], np.full(int(repeats.sum()), 3, np.uint64)),
    ]
    rows = np.concatenate([r for r, _ in kinds])
    places = np.concatenate([h >> np.uint64(64 - BITS) if len(h) and i != 4 else h for i, (_, h) in enumerate(kinds)]).astype(np.int64)
    return rows, places, np.diff(words.first)


def _sparse(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows, places, n = features(batch["text"])
    keys, counts = np.unique(rows << BITS | places, return_counts=True)
    row, place = keys >> BITS, (keys & ((1 << BITS) - 1)).astype(np.int32)
    value = (SCALE * counts / n[row]).astype(np.float32)
    cuts = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
    return pa.record_batch([batch["y"], pa.ListArray.from_arrays(cuts, pa.array(place)), pa.ListArray.from_arrays(cuts, pa.array(value))], ["y", "place", "value"])


class Ftrl:
    """FTRL-proximal for logistic loss (McMahan and others, 2013); place 2**BITS is the bias, without penalty."""

    def __init__(self):
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return -np.sign(z) * np.maximum(np.abs(z) - L1, 0) / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def learn(self, place: np.ndarray, value: np.ndarray, y: int) -> None:
        w = self.weights(place)
        g = (1 / (1 + np.exp(-np.clip(w @ value, -35, 35))) - y) * value
        n = self.n[place]
        self.z[place] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[place] = n + g * g


def _train(batches):
    rows = []
    for batch in batches:
        rows += zip(batch["y"].to_pylist(), (x.values.to_numpy() for x in batch["place"]), (x.values.to_numpy() for x in batch["value"]), strict=True)
    rows = [(y, np.append(place, 1 << BITS), np.append(value, np.float32(1))) for y, place, value in rows]
    rows.sort(key=lambda r: (len(r[1]), r[0], r[1].tobytes(), r[2].tobytes()))  # whatever order they came in
    model, order = Ftrl(), np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            y, place, value = rows[i]
            model.learn(place, value, y)
    yield pa.record_batch([pa.array([model.weights().astype(np.float32).tobytes()])], ["weights"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> np.ndarray:
    """Weights from at most ``sample`` labelled rows (labels: doc_id and a column of 0 and 1; nulls are left out).

    Only ``sample`` ids are broadcast and only 2**18 weights reach the driver. No labelled rows: all weights are 0.
    """
    chosen = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("lid"), F.col(label).cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("lid"), "lid", "y").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("lid"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "lid")
    rows = rows.groupBy("lid", "y").agg(F.min("text").alias("text")).select("y", "text")  # an id that many rows have counts once
    sparse = map_batches(rows, _sparse, "y int, place array<int>, value array<float>", BATCH)
    found = sparse.repartition(1).mapInArrow(_train, "weights binary").collect()
    return np.frombuffer(bytes(found[0].weights), np.float32) if found else np.zeros((1 << BITS) + 1, np.float32)


def score_batch(column: pa.Array, weights: np.ndarray) -> np.ndarray:
    rows, places, n = features(column)
    total = np.bincount(rows, weights=weights[places], minlength=len(n))[: len(n)]
    return 1 / (1 + np.exp(-np.clip(SCALE * total / np.maximum(n, 1) + weights[1 << BITS], -35, 35)))


def score(docs: DataFrame, weights: np.ndarray, threshold: float = 0.7) -> DataFrame:
    """All columns of docs, with score (0 to 1) and predicted (1 if score >= threshold, else 0).

    Null, empty and white-space texts get the score of the bias alone. Columns named score or predicted are replaced.
    """
    docs = docs.drop("score", "predicted")
    held = docs.sparkSession.sparkContext.broadcast(weights)  # 2**18 weights

    def run(batch: pa.RecordBatch) -> pa.Table:
        scores = score_batch(batch["text"], held.value)
        return pa.Table.from_batches([batch]).append_column("score", pa.array(scores)).append_column("predicted", pa.array((scores >= threshold).astype(np.int32)))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return map_batches(docs, run, f"{fields}, score double, predicted int", BATCH)


def held_out(column: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; learns only from labels of ids that aren't held out."""
    weights = fit(docs, labels.where(~held_out()))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return score(rows, weights, threshold).select("doc_id", held_out().alias("held_out"), "score", "predicted")
