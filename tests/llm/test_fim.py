import hashlib
import random
import re

import pytest

from tessera.llm import fim


def plain_version(doc_id, text, seed=42, rate=50, spm=80):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc_id, len(units), "plain", None, None, text, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize(("rate", "spm"), [(50, 80), (100, 0), (100, 100), (0, 50)])
def test_against_a_plain_version(spark, rate, spm):
    rng = random.Random(3)
    parts = ["word", "é𝄞", " ", "\t\n", "\x0b", "\xa0", "<", "<P", ">", "P>", " "]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for i in range(150)]
    rows += [(200, None), (None, None), (None, "null id"), (None, "null id"), (201, ""), (202, "a <M> b"), (203, " \n "), (-5, "below zero")]
    rows += [(204, "same id"), (204, "same id, other text")] + [(205, "a copy of a row")] * 40 + [(206, "long " * 300_000), (207, " " * 1_500_000)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, n string, form int")
    out = fim.transform(docs, rate=rate, spm=spm)
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    assert got(out) == sorted((plain_version(i, t, rate=rate, spm=spm) for i, t in rows), key=repr)


def test_no_rows(spark):
    assert got(fim.transform(spark.createDataFrame([], "doc_id long, text string"))) == []


def test_texts_are_shuffled_once(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame([(i, f"text {i} " * 9) for i in range(40)], "doc_id long, text string").write.parquet(path)
    out = fim.transform(spark.read.parquet(path))
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert len([x for x in final.splitlines() if re.search(r"[-+] Exchange ", x)]) == 1 and final.count("ReusedExchange") >= 2
    assert "Broadcast" not in final
