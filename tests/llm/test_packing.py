import json
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOK = Tokenizer.from_file(PATH)


def encode(text, by_ranks=True):
    return np.frombuffer(packing.token_bytes(text, PATH, by_ranks), "<u4").tolist()


def test_ranks_are_found_only_where_they_give_the_ids(tmp_path):
    assert packing.ranks(PATH) is not None
    spec = json.loads(Path(PATH).read_text())
    for change in ({"normalizer": {"type": "NFC"}}, {"model": spec["model"] | {"merges": spec["model"]["merges"][::-1]}}, {"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}}):
        path = tmp_path / "changed.json"
        path.write_text(json.dumps(spec | change))
        assert packing.ranks.__wrapped__(str(path)) is None


def test_each_character_has_the_tokenizers_ids():
    """Both libraries sort characters into letters, numbers and white space alike."""
    some = [chr(i) for i in [*range(0x3100), *range(0x3100, 0x110000, 61)] if not 0xD800 <= i < 0xE000]
    texts = [f"a{c}1{c} {c}!{c}\n{c}a {c} 1{c}{c}" for c in some]
    for text, want in zip(texts, TOK.encode_batch_fast(texts, add_special_tokens=False), strict=True):
        assert encode(text) == want.ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert encode(text) == encode(text, False) == TOK.encode(text, add_special_tokens=False).ids


def sequences(counts, capacity):
    """Check a plan; the number of its sequences."""
    filled, ranks = defaultdict(list), Counter()
    for size, first, end, seq, offset in packing.plan(counts, capacity):
        for i in range(end - first):
            filled[seq + i].append((offset, size))
            ranks[size, first + i] += 1
    assert ranks == Counter({(k, i): 1 for k, n in counts.items() for i in range(n)})
    for items in filled.values():
        at = 0
        for offset, size in sorted(items):
            assert offset == at
            at += size
        assert at <= capacity
    assert sorted(filled) == list(range(len(filled)))
    return len(filled)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40), max_size=12))
def test_plan(counts):
    n, total = sequences(counts, 30), sum(k * v for k, v in counts.items())
    assert n >= -(-total // 30)
    assert n <= 11 * total / 30 / 9 * 2 + 2


def test_plan_reaches_lengths_below_used_up_partners():
    assert sequences({1300: 4, 702: 1, 701: 1, 700: 1, 690: 10}, 2048) == 4 + 5  # one 690 is beside a 1300
    rng = random.Random(2)
    for _ in range(300):
        sequences({rng.randint(683, 2048): rng.choice((1, 2, 3, 50)) for _ in range(rng.randint(1, 300))}, 2048)


def test_plan_is_close_to_the_bound():
    rng = random.Random(1)
    counts = Counter(min(2048, max(1, int(rng.lognormvariate(6, 1)))) for _ in range(20_000))
    assert sequences(counts, 2048) <= sum(k * v for k, v in counts.items()) / 2048 * 1.01 + 1
    assert len(packing.plan({k: 10**9 for k in range(1, 2049)})) < 60_000


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab'st\n  \t1é!Ö　 <|endoftext|>"), max_size=60))
def test_ids(text):
    want = TOK.encode(text, add_special_tokens=False).ids
    assert encode(text) == want


def test_rows(spark):
    rows = [(i, "word " * (i % 40), i) for i in range(60)] + [(100, None, 0), (None, "x y", 0), (101, "the cat " * 500 + "end", 1), (101, "the cat " * 500 + "end", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    got = packing.pack(docs, PATH, capacity=64).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    for items in by_seq.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 64
    for doc_id, text, _ in rows[:-1]:
        ids = [*TOK.encode(text or "", add_special_tokens=False).ids, 0]
        mine = sorted(by_doc[doc_id], key=lambda r: r.piece)
        if doc_id == 101:
            assert len(mine) == 2 * -(-len(ids) // 64)
            mine = mine[::2]
        assert [r.piece for r in mine] == list(range(-(-len(ids) // 64)))
        assert mine[0].start == 0 and sum(r.length for r in mine) == len(ids) and all(r.length == 64 for r in mine[1:])
        for r in mine:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    assert len(by_seq) <= sum(r.length for r in got) / 64 * 1.1 + 1
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_ranks_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET", 5)
    docs = spark.createDataFrame([(i, "word " * (i % 3), i) for i in range(100)], "doc_id long, text string, bucket int")
    got = packing.pack(docs, PATH, capacity=16).collect()
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    assert len(got) == 100
    for items in places.values():
        assert [x for x, _ in sorted(items)] == [sum(n for _, n in sorted(items)[:i]) for i in range(len(items))]


def test_very_long_white_space(spark):
    n = 1_500_000
    texts = [" " * n, "\n" * n + "x", "a " * 5 + "\t" * n, "b" + " \n" * (n // 2) + " c"]
    tokenizer = packing._tokenizer(PATH)
    got = {}
    for r in packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH).collect():
        got.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    for i, text in enumerate(texts):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")
        assert packing.token_bytes(text, PATH, True) == ids[:-1].tobytes()
        assert sorted(got[i]) == [(k, a, m, zlib.crc32(ids[a : a + m].tobytes())) for k, a, m, _ in sorted(got[i])] and sum(x[2] for x in got[i]) == len(ids)
