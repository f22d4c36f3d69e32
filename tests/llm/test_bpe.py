import hashlib

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def stitched(text, size, overlap):
    ids, taken = [], 0
    for i, (start, after, end, last) in enumerate(bpe.chunks(text, size, overlap)):
        got, lead_at, lead_ids, cut = bpe.encode_chunk(text[start:end], after - start, i == 0, last, 3 * overlap, PATH, PATTERN)
        ids += got[lead_ids[lead_at.index(taken - start)] if i else 0 :]
        taken = start + cut
    return ids


@settings(max_examples=1000, deadline=None)
@given(st.text(st.sampled_from("ab'st\n  \t1é!Ö　\x1c\x1f\x85"), max_size=300), st.integers(8, 40), st.integers(2, 6))
def test_chunks_give_the_whole_texts_ids(text, size, overlap):
    assert stitched(text, size, overlap) == bpe.encoding(PATH, PATTERN).encode_ordinary(text)


def test_long_runs_are_cut_in_linear_total():
    text = "x" * 5000 + " " + "y" * 5000 + "  z"
    assert sum(end - start for start, _, end, _ in bpe.chunks(text, 100, 10)) < 3 * len(text)
    assert stitched(text, 100, 10) == bpe.encoding(PATH, PATTERN).encode_ordinary(text)


def test_rows(spark):
    long = "The quick  brown fox's tail.\n" * 200
    rows = [(1, "a b", 1), (2, None, 1), (None, "c", 1), (3, "", 1), (3, "", 2), (4, long, 1), (4, long, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, did int")
    got = bpe.encode(docs, PATH, PATTERN, chunk=300, overlap=20, with_ids=True).collect()
    assert len(got) == len(rows)
    want = sorted((r[0] or -1, bpe.encoding(PATH, PATTERN).encode_ordinary(r[1] or "")) for r in rows)
    assert sorted((r.doc_id or -1, r.ids) for r in got) == want
    for r in got:
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest()
    back = bpe.decode(spark.createDataFrame([(r.doc_id, r.ids) for r in got], "doc_id long, ids array<int>"), PATH, PATTERN)
    assert {bytes(r.data).decode() for r in back.collect()} == {r[1] or "" for r in rows}
    assert bpe.encode(docs.limit(0), PATH, PATTERN).count() == 0


def test_production_chunks(spark):
    n = bpe.CHUNK + bpe.OVERLAP
    texts = ["word " * (n // 5) + " " * 2, "x" * (n + 400) + " ", ("Some prose, 12 words.\n" * n)[: 3 * n] + "\n", "a\x1c\x1f b\x85" * n, "y" * n, "y" * (n + 1), "no break" * n]
    rows = [(i, t) for i, t in enumerate(texts)] + [(2, texts[2])] * 3
    got = bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), PATH, PATTERN, with_ids=True).collect()
    assert sorted((r.doc_id, r.ids) for r in got) == sorted((i, bpe.encoding(PATH, PATTERN).encode_ordinary(t)) for i, t in rows)


def plain_ids(text):
    """Merging of each match of the pattern; one of very many spaces is cut between two of them, which no token joins."""
    bpe_, out = bpe.encoding(PATH, PATTERN), []
    for m in bpe._pattern(PATTERN).finditer(text):
        n = len(m[0]) // 3
        assert n < 1000 or m[0][n - 1] == m[0][n] == m[0][2 * n] == m[0][2 * n - 1]
        out += [i for part in ([m[0]] if n < 1000 else [m[0][:n], m[0][n : 2 * n], m[0][2 * n :]]) for i in bpe_.encode_ordinary(part)]
    return out


def test_very_long_white_space(spark):
    n = 1_500_000
    assert not any(t in bpe.encoding(PATH, PATTERN)._mergeable_ranks for t in (b"  ", b"\t\t"))
    texts = [" " * n, "a" + " " * n, "\t" * n + "b c", "word " * 10 + " " * n + "end.", "\x85" * 10 + " " * n + "\u2003 x"]
    for text in texts:
        assert bpe.ordinary(bpe.encoding(PATH, PATTERN), text, PATTERN) == plain_ids(text)
    got = bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH, PATTERN).collect()
    for r in got:
        ids = plain_ids(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_both_ways_give_the_same_ids():
    bpe_ = bpe.encoding(PATH, PATTERN)
    for text in (" " * bpe.LONG_SPACE, "a b  c\n\n" + " " * bpe.LONG_SPACE + "\n" * 300_000 + " x's 12 é", "\r\n" * 200_000):
        assert bpe.ordinary(bpe_, text, PATTERN) == bpe_.encode_ordinary(text)
