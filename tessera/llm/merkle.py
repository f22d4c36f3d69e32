"""Merkle-tree fingerprints of documents.

Root: sections. Section: its paragraphs, the leaves. A paragraph is a line; a long line is several, each of which ends
after a word that its hash picks. A section ends before a blank line and after a paragraph that its digest picks. So the
content alone decides where branches begin, texts of any layout have several, and an edit changes the branches that it
lies in and no others. A section's digest and the root cover their children's digests in order, so equal roots mean equal
texts, and two trees are compared from the root down: only branches whose digests differ are entered. In paragraphs that
differ, the words at both ends are compared; what is left is where the texts were edited.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import Scratch, id_or_null, keyed, map_batches, partitions, strings


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


#: Words of a line that is one paragraph at most; words of a paragraph of a longer line, and paragraphs of a section, on average.
LINE, WORDS, PARAGRAPHS = 48, 32, 8


@dataclass(frozen=True, eq=False)
class Paragraph:
    text: str
    start: int  # in the document's characters
    digest: bytes  # of the text and of what ends it, a line's end or a space

    @property
    def weight(self) -> int:
        return len(self.text) + 1

    @cached_property
    def words(self) -> list[str]:
        return self.text.split(" ")


def pieces(line: str) -> list[str]:
    """The paragraphs of a line: joined by spaces they are the line."""
    if line.count(" ") < LINE:
        return [line]
    words = line.split(" ")
    ends = [i for i, w in enumerate(words, 1) if zlib.crc32(w.encode()) % WORDS == 0 and i < len(words)]
    return [" ".join(words[a:b]) for a, b in zip([0, *ends], [*ends, len(words)], strict=True)]


@dataclass(frozen=True, eq=False)
class Section:
    paragraphs: list[Paragraph]
    digest: bytes

    @cached_property
    def weight(self) -> int:
        return sum(p.weight for p in self.paragraphs)


class Tree:
    def __init__(self, text: str):
        groups: list[list[Paragraph]] = [[]]
        at, full = 0, False
        for line in text.split("\n"):
            if groups[-1] and (full or not line.strip()):
                groups.append([])
                full = False
            parts = pieces(line)
            for i, part in enumerate(parts):
                if full:
                    groups.append([])
                own = Paragraph(part, at, _digest(part.encode() + (b" " if i + 1 < len(parts) else b"\n")))
                groups[-1].append(own)
                at += len(part) + 1
                full = own.digest[0] % PARAGRAPHS == 0
        self.sections = [Section(g, _digest(b"".join(p.digest for p in g))) for g in groups]
        self.weight = at
        self.root = hashlib.sha256(b"".join(s.digest for s in self.sections)).hexdigest()


def _unmatched(a: list, b: list) -> tuple[list, list, int]:
    """Nodes of a and b without an equal digest on the other side, in order, and the weight of the others."""
    common = Counter(x.digest for x in a) & Counter(x.digest for x in b)
    rest, shared = [], 0
    for nodes in (a, b):
        left = common.copy()
        own = []
        for x in nodes:
            if left[x.digest]:
                left[x.digest] -= 1
                shared += x.weight
            else:
                own.append(x)
        rest.append(own)
    return rest[0], rest[1], shared // 2


def _same_ends(a: list[str], b: list[str]) -> tuple[int, int]:
    """Equal words at the front and, beyond those, at the back."""
    n = min(len(a), len(b))
    front = 0
    while front < n and a[front] == b[front]:
        front += 1
    back = 0
    while back < n - front and a[-1 - back] == b[-1 - back]:
        back += 1
    return front, back


def compare(a: Tree, b: Tree) -> tuple[float, list[tuple[int, int]]]:
    """Likeness (0 to 1: the share of the larger text's weight in equal branches) and the spans of a that differ."""
    if a.root == b.root:
        return 1.0, []
    sections_a, sections_b, shared = _unmatched(a.sections, b.sections)
    left, right, more = _unmatched([p for s in sections_a for p in s.paragraphs], [p for s in sections_b for p in s.paragraphs])
    shared += more
    spans = [(p.start, p.start + len(p.text)) for p in left[len(right) :]]
    for p, q in zip(left, right, strict=False):
        front, back = _same_ends(p.words, q.words)
        begin, end = sum(len(x) + 1 for x in p.words[:front]), sum(len(x) + 1 for x in p.words[len(p.words) - back :])
        shared += min(begin + end, p.weight)
        begin = min(begin, len(p.text))
        spans.append((p.start + begin, p.start + max(begin, len(p.text) - end)))
    return min(1.0, shared / max(a.weight, b.weight)), sorted(spans)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, sections, paragraphs): the root, and the digests below it in order, as hex.

    Null text: as empty. Rows with null or repeated doc_ids each give a row. Other columns are ignored.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        trees = [Tree(x) for x in strings(batch["text"])]
        sections = [[s.digest.hex() for s in t.sections] for t in trees]
        paragraphs = [[p.digest.hex() for s in t.sections for p in s.paragraphs] for t in trees]
        return pa.record_batch([batch["did"], pa.array([t.root for t in trees]), pa.array(sections, pa.list_(pa.string())), pa.array(paragraphs, pa.list_(pa.string()))], ["did", "fingerprint", "sections", "paragraphs"])

    out = map_batches(keyed(docs).select("did", "text"), run, "did long, fingerprint string, sections array<string>, paragraphs array<string>")
    return out.select(id_or_null().alias("doc_id"), "fingerprint", "sections", "paragraphs")


def edits(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, likeness, spans) of each doc_id in both tables whose texts differ: spans of ``before`` that were edited.

    doc_ids are meant to be unique; repeated ones give a row per pair, null ones none.
    """
    both = before.select("doc_id", F.coalesce("text", F.lit("")).alias("before")).join(after.select("doc_id", F.coalesce("text", F.lit("")).alias("after")), "doc_id").where("before <> after")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [compare(Tree(a), Tree(b)) for a, b in zip(strings(batch["before"]), strings(batch["after"]), strict=True)]
        spans = pa.array([[{"start": s, "end": e} for s, e in x[1]] for x in found], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        return pa.record_batch([batch["doc_id"], pa.array([x[0] for x in found], pa.float64()), spans], ["doc_id", "likeness", "spans"])

    return map_batches(both, run, "doc_id long, likeness double, spans array<struct<start:long,end:long>>")


_OUT = [("did", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]


def _row(did: int, text: str, tree: Tree, after: str, after_tree: Tree) -> tuple:
    n = len(text)
    edited = text[: n - n // 4] + after[: n // 4]
    edited_tree = Tree(edited)
    return did, n, hashlib.sha256(edited.encode()).hexdigest(), tree.root, edited_tree.root, compare(tree, edited_tree)[0], compare(tree, after_tree)[0]


def edited_and_next(docs: DataFrame) -> DataFrame:
    """Fingerprint each whole text, its edited text (its last quarter replaced by the start of the next document's) and
    compare with both: (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    Documents are ordered by doc_id, nulls first; rows with equal ids by a hash of their texts; the first follows the
    last. Null text: as empty. Other columns are ignored. An empty table gives an empty result.

    One range shuffle brings neighbours together; only the first and the last row of each partition meet in a join.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "merkle")
    kinds = [*_OUT, ("part", pa.int32()), ("head", pa.bool_()), ("text", pa.string())]

    def run(batches):
        part, last = TaskContext.get().partitionId(), None
        for batch in batches:
            rows, more = [], []
            for did, text in zip(batch["did"].to_pylist(), strings(batch["text"]), strict=True):
                tree = Tree(text)
                if last is None:
                    more.append((did, None, None, None, None, None, None, part, True, text))
                else:
                    rows.append((*_row(*last, text, tree), None, None, None))
                last = did, text, tree
            if rows or more:
                yield pa.record_batch([pa.array(x, kind) for x, (_, kind) in zip(zip(*rows, *more, strict=True), kinds, strict=True)], [n for n, _ in kinds])
        if last is not None:
            yield pa.record_batch([pa.array([x], kind) for x, (_, kind) in zip((last[0], None, None, None, None, None, None, part, False, last[1]), kinds, strict=True)], [n for n, _ in kinds])

    ordered = keyed(docs).repartitionByRange(partitions(spark), "did", "th").sortWithinPartitions("did", "th").select("did", "text")
    out = "did long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    done = scratch.write(ordered.mapInArrow(run, f"{out}, part int, head boolean, text string"), "rows")

    ends = done.where("part is not null")
    heads = ends.where("head").select("part", F.col("text").alias("after"))
    # a row per partition, without texts
    follows = heads.select("part").withColumn("next", F.lead("part").over(Window.orderBy("part"))).withColumn("next", F.coalesce("next", F.min("part").over(Window.partitionBy())))
    tails = ends.where("not head").select("part", "did", "text").join(follows, "part")
    pairs = tails.join(heads.withColumnRenamed("part", "next"), "next").select("did", "text", "after")

    def finish(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [_row(did, text, Tree(text), after, Tree(after)) for did, text, after in zip(batch["did"].to_pylist(), strings(batch["text"]), strings(batch["after"]), strict=True)]
        return pa.record_batch([pa.array(x, kind) for x, (_, kind) in zip(zip(*rows, strict=True), _OUT, strict=True)], [n for n, _ in _OUT])

    rest = map_batches(pairs, finish, out)
    whole = done.where("part is null").select(rest.columns).unionByName(rest)
    return whole.select(id_or_null().alias("doc_id"), *rest.columns[1:])
