import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import substring, windows


def brute(rows, k):
    first = {}
    words = [(-(2**63) if i is None else i, (t or "").encode().split()) for i, t in rows]
    for i, w in words:
        for j in range(len(w) - k + 1):
            key = tuple(w[j : j + k])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for j in range(len(w) - k + 1):
            if first[tuple(w[j : j + k])] < i:
                gone.update(range(j, j + k))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(rng, n):
    vocab = [f"w{i}" for i in range(40)] + ["é", "the"]
    passage = [rng.choice(vocab) for _ in range(30)]
    base = [rng.choice(vocab) for _ in range(60)]
    rows = []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        kind = rng.random()
        if kind < 0.3:
            words[10:10] = passage
        elif kind < 0.5:
            words = list(base)
            if kind < 0.4:
                words[rng.randrange(60)] = "changed"
        elif kind < 0.6:
            words = ["again"] * rng.randint(0, 50)
        rows.append((i, rng.choice([" ", "\n", "  "]).join(words)))
    return rows


@pytest.mark.parametrize(("share", "block"), [(1.0, 8192), (1e-9, 8192), (1.0, 2)])
def test_against_brute_force(spark, monkeypatch, share, block):
    monkeypatch.setattr(windows, "HEAVY_LEAST", 4)
    monkeypatch.setattr(substring, "BLOCK", block)
    rows = corpus(random.Random(5), 120) + [(200, None), (None, "w1 w2 " * 30), (7, "w1 w2 " * 30), (201, "w1 w2 " * 30), (201, "w1 w2 " * 30)]
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, n int, m string")
    got = substring.dedup(docs, window=12, heavy_share=share)
    assert sorted((-(2**63) if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == brute(rows, 12)
    assert substring.dedup(docs.limit(0), window=12).count() == 0
    kept = substring.dedup_rows(docs, window=12)
    assert kept.columns == docs.columns and kept.count() == len(rows)
    want = defaultdict(list)
    for r in got.collect():
        want[r.doc_id].append(r.text)
    for r in kept.collect():
        assert " ".join((r.text or "").split()) in want[r.doc_id]


def test_ranks_group_equal_windows():
    rng = np.random.default_rng(0)
    x, ends = rng.integers(0, 2, 300), np.repeat([100, 200, 300], 100)
    for size in (1, 2, 3, 5, 8, 13):
        r = windows.ranks(x, ends, size)
        for i in range(300):
            assert (r[i] < 0) == (i + size > ends[i])
        content = {i: tuple(x[i : i + size]) for i in range(300) if r[i] >= 0}
        order = {c: k for k, c in enumerate(sorted(set(content.values())))}
        assert all(r[i] == order[c] for i, c in content.items())


def test_groups_come_whole_or_in_parts():
    rng = np.random.default_rng(1)
    for most in (1, 3, 10):
        for _ in range(50):
            keys = np.sort(rng.integers(0, 6, rng.integers(0, 60)))
            cuts = np.sort(rng.integers(0, len(keys) + 1, 5)).tolist()
            batches = [pa.record_batch([pa.array(keys[a:b])], ["m"]) for a, b in zip([0, *cuts], [*cuts, len(keys)], strict=True)]
            got, counts = [], np.bincount(keys, minlength=6)
            for table, whole in windows.bounded(batches, "m", most):
                own = table["m"].to_numpy()
                got += own.tolist()
                if whole:
                    assert all((own == k).sum() == counts[k] for k in set(own.tolist()))
                else:
                    assert len(set(own.tolist())) == 1 and counts[own[0]] > most
            assert got == keys.tolist()
