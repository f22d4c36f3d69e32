import hashlib
import random
from collections import Counter

import pyarrow as pa
import pytest

from tessera.llm import suffix, windows


def brute(rows, k):
    seen = Counter()
    data = [(-1 if i is None else i, (t or "").encode()) for i, t in rows]
    for _, d in data:
        seen.update(d[j : j + k] for j in range(len(d) - k + 1))
    out = []
    for i, d in data:
        gone = bytearray(len(d))
        for j in range(len(d) - k + 1):
            if seen[d[j : j + k]] > 1:
                gone[j : j + k] = b"\1" * k
        spans = sum(1 for j in range(len(d)) if gone[j] and not (j and gone[j - 1]))
        out.append((i, len(d), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(d, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("size", "share", "block"), [(20, 1.0, 8192), (20, 1e-9, 7), (7, 1.0, 1), (200, 1e-9, 50), (200, 1.0, 8192)])
def test_against_brute_force(spark, monkeypatch, size, share, block):
    monkeypatch.setattr(suffix, "BLOCK", block)
    monkeypatch.setattr(windows, "HEAVY_LEAST", 4)
    rng = random.Random(7)
    text = lambda n: "".join(rng.choice("abé d") for _ in range(n))
    passage, base = text(3 * size), text(4 * size)
    rows = [(i, text(rng.randint(0, 3 * size))) for i in range(60)]
    rows += [(100 + i, text(rng.randint(0, size)) + passage + text(rng.randint(0, size))) for i in range(20)]
    rows += [(200 + i, base[: (at := rng.randrange(len(base)))] + "X" + base[at:]) for i in range(20)]
    rows += [(300, "ab" * 3 * size), (301, "x" * (size + 1)), (302, "y" * size), (303, None), (None, base), (304, base), (304, base), (305, text(size) + "Q" * size * 2 + text(size))]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, m int")
    got = suffix.dedup(docs, size=size, heavy_share=share)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == brute(rows, size)
    assert suffix.dedup(docs.limit(0), size=size).count() == 0


def test_strings_of_a_block_against_brute_force():
    rng, size = random.Random(3), 20
    for _ in range(100):
        rows = set()
        for _ in range(rng.randint(1, 40)):
            at = rng.randint(0, size - 4)
            n = rng.randint(1, at + 1)
            text = lambda k: "".join(rng.choice("ab") for _ in range(k)) if rng.random() < 0.5 else "a" * k
            rows.add((text(at).encode(), text(size - at + n - 1).encode(), n))
        rows = sorted(rows, key=lambda r: r[1])
        table = pa.table({"left": pa.array([r[0] for r in rows], pa.binary()), "right": pa.array([r[1] for r in rows], pa.binary()), "n": pa.array([r[2] for r in rows], pa.int64())})
        (row, distance), _ = suffix._repeated(table, size, None, None)
        holders = {}
        for i, (left, right, n) in enumerate(rows):
            for k in range(n):
                holders.setdefault((len(left) - k, (left + right)[k : k + size]), set()).add(i)
        assert set(zip(row.tolist(), distance.tolist(), strict=True)) == {(i, d) for (d, _), s in holders.items() if len(s) > 1 for i in s}
