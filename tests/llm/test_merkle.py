import hashlib
import random
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import merkle

TEXT = st.text(st.sampled_from("ab \n"), max_size=60)


@settings(max_examples=300, deadline=None)
@given(TEXT, TEXT)
def test_trees(a, b):
    x, y = merkle.Tree(a), merkle.Tree(b)
    assert (x.root == y.root) == (a == b)
    likeness, spans = merkle.compare(x, y)
    assert 0 <= likeness <= 1 and (likeness == 1) == (a == b) or a != b
    assert all(0 <= s <= e <= len(a) for s, e in spans)


def plain_sections(text):
    """Lists of (text, end) of paragraphs, by the rule alone."""
    paragraphs = []
    for line in text.split("\n"):
        words, own = line.split(" "), []
        for i, w in enumerate(words):
            own.append(w)
            if i + 1 == len(words) or (len(words) > 48 and zlib.crc32(w.encode()) % 32 == 0):
                paragraphs.append((" ".join(own), "\n" if i + 1 == len(words) else " ", not line.strip()))
                own = []
    sections = [[]]
    for text_, end, blank in paragraphs:
        before = sections[-1][-1] if sections[-1] else None
        if before and (blank or hashlib.blake2b("".join(before).encode(), digest_size=16).digest()[0] % 8 == 0):
            sections.append([])
        sections[-1].append((text_, end))
    return sections


def plain_likeness(a, b):
    """The share of the larger text in equal sections, else in equal paragraphs, else in equal words at the ends of two."""
    if a == b:
        return 1.0
    left, right = plain_sections(a), plain_sections(b)
    shared = 0
    for size in (lambda s: sum(len(t) + 1 for t, _ in s), lambda p: len(p[0]) + 1):
        key = lambda x: tuple(x)
        common = Counter(map(key, left)) & Counter(map(key, right))
        shared += sum(size(x) * n for x, n in common.items())
        rest = []
        for nodes in (left, right):
            seen, own = Counter(), []
            for x in nodes:
                seen[key(x)] += 1
                if seen[key(x)] > common[key(x)]:
                    own.append(x)
            rest.append(own)
        left, right = ([p for s in x for p in s] for x in rest) if isinstance(rest[0][0] if rest[0] else rest[1][0], list) else rest
    for (p, _), (q, _) in zip(left, right, strict=False):
        x, y = p.split(" "), q.split(" ")
        n = min(len(x), len(y))
        front = next((i for i in range(n) if x[i] != y[i]), n)
        back = next((i for i in range(n - front) if x[-1 - i] != y[-1 - i]), n - front)
        shared += min(sum(len(w) + 1 for w in x[:front] + x[len(x) - back :]), len(p) + 1)
    return min(1.0, shared / (max(len(a), len(b)) + 1))


def prose(rng, n):
    return "".join(f"w{rng.randrange(200)}" + rng.choice([" "] * 40 + ["\n", "\n\n", ". ", "  "]) for _ in range(n))


def test_likeness_is_that_of_a_plain_version():
    rng = random.Random(7)
    for _ in range(150):
        a = prose(rng, rng.randint(0, 700))
        at = rng.randint(0, len(a))
        b = rng.choice([a[:at] + "new " + a[at:], a[:at] + a[at + 40 :], a[len(a) // 2 :] + a[: len(a) // 2], prose(rng, 300), a])
        x, y = merkle.Tree(a), merkle.Tree(b)
        assert merkle.compare(x, y)[0] == pytest.approx(plain_likeness(a, b))
        assert [[p.text for p in s.paragraphs] for s in x.sections] == [[t for t, _ in s] for s in plain_sections(a)]
        assert "".join(t + e for s in plain_sections(a) for t, e in s) == a + "\n"


def test_only_branches_that_differ_are_entered(monkeypatch):
    rng = random.Random(8)
    text = " ".join(f"w{rng.randrange(500)}" for _ in range(4000))  # one line, no blank one
    edited = text[:9000] + "CHANGED" + text[9000:]
    x, y = merkle.Tree(text), merkle.Tree(edited)
    assert len(x.sections) > 5 and len([s for s in x.sections if s.digest not in {t.digest for t in y.sections}]) <= 2
    entered, real = [], merkle._same_ends
    monkeypatch.setattr(merkle, "_same_ends", lambda a, b: entered.append(len(a)) or real(a, b))
    likeness, spans = merkle.compare(x, y)
    assert len(entered) == 1 and likeness > 0.99 and len(spans) == 1 and spans[0][0] <= 9000 <= spans[0][1] and spans[0][1] - spans[0][0] < 12


def test_likenesses_of_the_query(spark):
    rng = random.Random(9)
    texts = [prose(rng, rng.randint(0, 500)) for _ in range(25)] + ["", " ", "\n\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in merkle.edited_and_next(docs).collect():
        own, after = texts[r.doc_id], texts[(r.doc_id + 1) % len(texts)]
        edited = own[: len(own) - len(own) // 4] + after[: len(own) // 4]
        assert r.near_edited == pytest.approx(plain_likeness(own, edited)) and r.near_next == pytest.approx(plain_likeness(own, after))


def test_an_edit_is_located():
    text = "Head\nThe first line here.\nAnother line.\n\nSecond section, with some words in it.\nEnd."
    likeness, spans = merkle.compare(merkle.Tree(text), merkle.Tree(text.replace("some", "few other")))
    assert [text[s:e] for s, e in spans] == ["some "] or [text[s:e].strip() for s, e in spans] == ["some"]
    assert likeness > 0.85


def test_rows(spark):
    texts = {i: " ".join(f"w{(i * 7 + j) % 50}x{i}" for j in range(i * 3)) + "\nline two" * (i % 3) for i in range(40)}
    rows = [(i, t, "x") for i, t in texts.items()] + [(50, None, "x"), (None, "é" * 9, "x"), (51, "", "x"), (52, "same text here, longer", "x"), (52, "same text here, longer", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, did string")
    got = merkle.edited_and_next(docs).collect()
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: -1 if r[0] is None else r[0])
    want = {}
    for (doc_id, text, _), after in zip(order, order[1:] + order[:1], strict=True):
        text, n = text or "", len(text or "")
        want.setdefault(doc_id, []).append((n, hashlib.sha256((text[: n - n // 4] + (after[1] or "")[: n // 4]).encode()).hexdigest()))
    found = {}
    for r in got:
        found.setdefault(r.doc_id, []).append((r.n_chars, r.edited_sha256))
        assert r.fingerprint == merkle.Tree(next(t for i, t, _ in rows if i == r.doc_id) or "").root
        if r.doc_id is not None and 5 < r.doc_id < 39:
            assert r.near_edited > 0.6 > 0.4 > r.near_next
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    assert merkle.edited_and_next(docs.limit(0)).count() == 0
    assert len(merkle.edited_and_next(docs.limit(1)).collect()) == 1
    changed = docs.where("doc_id < 40").withColumn("text", F.concat("text", F.lit("!")))
    assert merkle.edits(docs, changed).count() == 40 and merkle.fingerprints(docs).count() == len(rows)
