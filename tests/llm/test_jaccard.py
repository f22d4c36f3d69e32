import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import jaccard


def grams(text, n=5):
    words = (text or "").encode().split()
    return {tuple(words[i : i + n]) for i in range(max(len(words) - n + 1, 1))} if words else set()


def test_shingles():
    texts = ["a b c d e f", "a b", "", None, "a b c d e a b c d e a b c d e", "x"]
    row, hashes = jaccard.shingles(pa.array(texts))
    assert np.bincount(row, minlength=6).tolist() == [len(grams(t)) for t in texts]
    assert jaccard.signatures(row, hashes).shape == (4, jaccard.PLACES)


@pytest.mark.parametrize("leaf", [1024, 8])
def test_against_brute_force(spark, leaf):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 120)))))
    base = [rng.choice(vocab) for _ in range(100)]
    for i in range(60, 110):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(100)] = rng.choice(vocab)
        rows.append((i, " ".join(words)))
    rows += [(200, None), (201, ""), (202, " \n"), (203, "a b"), (204, "a  b"), (None, "a b"), (205, "a b c"), (206, rows[3][1]), (207, rows[3][1] + " end")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, digest string")
    got = {r.doc_id: r for r in jaccard.near_duplicates(docs, leaf=leaf, levels=3).collect()}
    assert len(got) == len(rows)
    sets = [grams(t) for _, t in rows]
    ids = [-(2**63) if i is None else i for i, _ in rows]
    links = {i: set() for i in ids}
    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both and 9 * both >= 4 * (len(sets[x]) + len(sets[y])):
                links[ids[x]].add(ids[y])
                links[ids[y]].add(ids[x])
    component = {i: i for i in ids}
    for _ in ids:
        for i in ids:
            component[i] = min([component[i], *(component[j] for j in links[i])])
    for (i, _), key in zip(rows, ids, strict=True):
        assert got[i].n_links == len(links[key]), i
        want = component[key]
        assert got[i].component_id == (None if want == -(2**63) else want)
        assert got[i].kept == (want == key)
    assert jaccard.near_duplicates(docs.limit(0)).count() == 0


def test_pairs_at_the_similarity_are_found_at_the_last_level(spark):
    assert [jaccard.runs_needed(d) for d in (1, 3, 4, 8)] == [6, 10, 11, 18] and jaccard.least_equal(0.8) == 37
    rng = random.Random(5)
    rows = []
    for i in range(3000):  # pairs of 40 words in common and five more each: 40 / 50; no node but one of a single set is a leaf
        words = [f"{i}-{k}" for k in range(50)]
        rng.shuffle(words)
        rows += [(2 * i, " ".join(words[:45])), (2 * i + 1, " ".join(words[5:]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = jaccard.near_duplicates(docs, ngram=1, leaf=1).where("n_links > 0").count()
    assert found >= 2 * 2997, found
