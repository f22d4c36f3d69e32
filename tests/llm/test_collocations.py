import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import collocations
from tessera.llm.hashing import mix
from tessera.llm.perfect import PerfectHash


def plain_version(rows, least=10, cover=50, top=2000):
    counts, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                counts.setdefault(lang, Counter()).update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        found = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            longer = [q for q, b in f.items() if len(q) == 3 and b >= least and len(p) == 2 and 100 * b >= cover * a and p in (q[:2], q[1:])]
            if not longer:
                score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def corpus(rng, n):
    vocab = [f"w{i}" for i in range(12)] + ["The", "é", "ÀB", "𝄞", "x" * 200, "\xa0"]
    heads = ["new york city", "of the", "Machine Learning", "a a a a", "\u0085nel"]
    rows = []
    for _ in range(n):
        words = [rng.choice(heads) if rng.random() < 0.4 else rng.choice(vocab) for _ in range(rng.randint(0, 25))]
        rows.append((rng.choice(["en", "de", None, "und", ""]), "".join(w + rng.choice([" ", "  ", "\t", ". ", ",", "\n", " "]) for w in words)))
    return rows


@pytest.mark.parametrize(("held", "slots", "least", "top"), [(1 << 21, 1 << 17, 10, 2000), (50, 8, 3, 25), (7, 64, 4, 2000)])
def test_against_a_plain_version(spark, held, slots, least, top):
    rows = corpus(random.Random(4), 220) + [("en", None), (None, None), ("en", ""), ("en", " . ")] + [("fr", "le chat noir dort")] * 40 + [("es", "sol y mar " * 30_000), ("es", " " * 200_000)]
    docs = spark.createDataFrame([(a, b, "x", 1.5) for a, b in rows], "lang string, text string, phrase string, score double").repartition(5)
    out = collocations.mine(docs, least=least, top=top, held=held, keys_a_shard=slots)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, out.collect())) == plain_version(rows, least, top=top)


def test_nothing_to_find(spark):
    schema = "lang string, text string"
    assert collocations.mine(spark.createDataFrame([], schema)).collect() == []
    assert collocations.mine(spark.createDataFrame([("en", "one two three"), (None, None)], schema)).collect() == []


def test_large_counts_are_exact(spark):
    rows = [("en", "big big " * 60_000)] * 3
    got = collocations.mine(spark.createDataFrame(rows, "lang string, text string")).collect()
    assert sorted(map(tuple, got)) == plain_version(rows)


def test_hashes_tell_languages_and_attempts_apart():
    batch = pa.record_batch([pa.array(["en", "de"]), pa.array(["same word", "same word"])], ["lang", "text"])
    phrases = collocations.Phrases(batch)
    assert len(set(phrases.hashes.tolist())) == 4  # a word of two languages is two
    assert not np.intersect1d(phrases.hashes, collocations.Phrases(batch, attempt=1).hashes).size  # another attempt hashes anew


def test_words_with_one_hash_are_seen_and_hashed_anew(spark, monkeypatch):
    seen, real = [], collocations._clashes

    def clashes(*tables):
        seen.append(real(*tables))
        return len(seen) == 1 or seen[-1]

    monkeypatch.setattr(collocations, "_clashes", clashes)
    rows = [("en", "new york")] * 12
    assert sorted(map(tuple, collocations.mine(spark.createDataFrame(rows, "lang string, text string")).collect())) == plain_version(rows)
    assert seen == [False, False]
    none, two = spark.createDataFrame([(False,)], "clash boolean"), spark.createDataFrame([(False,), (True,)], "clash boolean")
    assert real(none, none, two) and real(none, two, none) and real(two, none, none) and not real(none, none, none)


def test_what_is_sent_of_a_phrase_is_its_words_hashes(spark, monkeypatch):
    words = mix(np.arange(1, 30_001, dtype=np.uint64)).reshape(3, -1)
    words[2, :7000], words[1, :4000] = 0, 0  # of one, two and three words
    size = (words > 0).sum(axis=0)
    keys = np.stack([np.concatenate([collocations.gram(*words[:k, size == k]) for k in (1, 2, 3)]), *words])
    times = np.arange(10_000) % 255 + 1
    times[-1] = 2**33
    rows = list(collocations._sent(keys, times, 2))
    assert sum(len(x) for _, _, x, _ in rows) == 8 * size.sum()  # and not four numbers each
    assert sum(len(x) for *_, x in rows) < 2 * len(times) + 8 * collocations.BLOB
    got = [collocations._received(k, w, t) for _, k, w, t in rows]
    assert all((k[0] >> np.uint64(62) == shard).all() for (shard, *_), (k, _) in zip(rows, got, strict=True))
    assert sorted(x for k, t in got for x in zip(*k.tolist(), t.tolist(), strict=True)) == sorted(zip(*keys.tolist(), times.tolist(), strict=True))

    written, write = [], collocations._Scratch.write
    monkeypatch.setattr(collocations._Scratch, "write", lambda self, df, table: (written.append(table), write(self, df, table))[1])
    assert collocations.mine(spark.createDataFrame([("en", "new york city")] * 12, "lang string, text string")).count() == 1
    assert "slots" in written and not {"occurrences", "level-2", "level-3"} & set(written)  # they go to their shards without a table


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash(n):
    keys = mix(np.arange(1, n + 1, dtype=np.uint64))
    perfect = PerfectHash.from_bytes(PerfectHash.of(keys).to_bytes())
    assert sorted(perfect.slots(keys).tolist()) == list(range(n)) and perfect.n == n
    others = perfect.slots(mix(np.arange(n + 1, 2 * n + 1, dtype=np.uint64)))
    assert ((others >= -1) & (others < max(n, 1))).all()


def test_keys_that_repeat_have_no_perfect_hash():
    with pytest.raises(ValueError, match="repeat"):
        PerfectHash.of(np.array([5, 5], np.uint64))
