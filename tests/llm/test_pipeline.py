import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline

DATA = "/root/testdata/sf0.001"


def grams(text, n):
    words = text.encode().split()
    return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)], words


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")
def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    seen = [{r.doc_id: r for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(docs.collect() if name == "packing" else {r.doc_id: r for r in docs.collect()})
    raw, good, single, cut, packed = seen
    known = [(i in good) == (q == 1) for i, q in labels.items() if i in raw]
    assert np.mean(known) > 0.9 and all(raw[i] == r for i, r in good.items())

    ids = sorted(good)
    sets = {i: set(grams(good[i].text, 5)[0]) or {tuple(good[i].text.split())} - {()} for i in ids}
    component = {i: i for i in ids}
    links = defaultdict(set)
    for x in ids:
        for y in ids:
            both = len(sets[x] & sets[y])
            if x < y and both and 9 * both >= 4 * (len(sets[x]) + len(sets[y])):
                links[x].add(y)
                links[y].add(x)
    for _ in ids:
        for i in ids:
            component[i] = min([component[i], *(component[j] for j in links[i])])
    assert sorted(single) == [i for i in ids if component[i] == i]

    first = {}
    for i in sorted(single):
        for g in grams(single[i].text, 50)[0]:
            first.setdefault(g, i)
    for i, r in single.items():
        all_grams, words = grams(r.text, 50)
        gone = {k for j, g in enumerate(all_grams) if first[g] < i for k in range(j, j + 50)}
        text = b" ".join(w for j, w in enumerate(words) if j not in gone).decode() if gone else r.text
        assert cut[i].text == text and cut[i].n_chars == len(text) and cut[i].lang == r.lang

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in packed:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert sorted(pieces) == sorted(cut)
    for i, mine in pieces.items():
        tokens = [*tokenizer.encode(cut[i].text, add_special_tokens=False).ids, 0]
        assert sum(r.length for r in mine) == len(tokens)
        for r in mine:
            assert r.ids_crc32 == zlib.crc32(np.array(tokens[r.start : r.start + r.length], "<u4").tobytes())
    for items in sequences.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 2048
    whole = corpus_pipeline.run(spark, DATA)
    assert {(r.doc_id, r.piece, r.ids_crc32) for r in whole.collect()} == {(r.doc_id, r.piece, r.ids_crc32) for r in packed}
