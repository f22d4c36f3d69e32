import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa

from tessera.llm import common, hashing, quality
from tessera.llm.hashing import Words


def test_words_match_a_plain_split():
    texts = ["a  bc\nd", "", None, "x", " y", "z ", "é\tß\x0bq\x1cr", "end"]
    words = Words(pa.array(texts))
    data = words.data.tobytes()
    got = [[data[s:e].decode() for s, e in zip(words.start[a:b], words.end[a:b], strict=True)] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
    assert got == [[x.decode() for x in (t or "").encode().split()] for t in texts]
    flat, hashes = [w for g in got for w in g], words.hashes()
    assert len(set(hashes.tolist())) == len(set(flat))


def test_shapes():
    words = Words(pa.array(["Abc Xyz ABC!! abc12 def3 *** x|y"]))
    h = quality.shapes(words).tolist()
    assert h[0] == h[1] and h[3] == h[4] and len(set(h)) == 5


def make(rng, good):
    words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(5, 60))]
    return " ".join(words) if good else " ".join(w.upper() + "!!" for w in words)


def test_learns_and_scores_held_out_rows(spark):
    rng = random.Random(3)
    rows = [(i, make(rng, i % 3 > 0), "en", 0.5) for i in range(600)]
    docs = spark.createDataFrame(rows + [(1000, None, "en", 0.1), (1001, "", "en", 0.2), (None, "a b c", "en", 0.3), (5, rows[5][1], "en", 0.5)], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(500)] + [(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == 604
    held = [r for r in got if r.doc_id is not None and r.doc_id < 600 and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in held) and len(held) > 100
    assert np.mean([r.predicted == int(r.doc_id % 3 > 0) for r in held]) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert {r.score for r in got if r.doc_id == 1000} == {r.score for r in got if r.doc_id == 1001}
    assert quality.classify(docs.limit(0), labels).count() == 0
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_a_worker_holds_little_of_a_large_batch_and_keeps_nothing(spark, monkeypatch):
    handed, real = [], common.map_batches

    def seen(df, f, schema, *most):
        handed.append((f, *(most or [common.BATCH_BYTES])))
        return real(df, f, schema, *most)

    monkeypatch.setattr(quality, "map_batches", seen)
    quality.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), np.zeros((1 << quality.BITS) + 1, np.float32))
    batch = pa.record_batch([pa.array(range(4000)), pa.array(["word " * 300] * 4000)], ["doc_id", "text"])  # 6 MB
    ((f, most),) = handed
    tracemalloc.start()
    n = sum(f(part).num_rows for part in common.slices(batch, most))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 4000 and peak < 100e6
    assert hashing._powers.cache_info().currsize
    list(common.trimmed(lambda batches: iter(batches))([]))
    assert not hashing._powers.cache_info().currsize
