"""Byte-level BPE encoding and decoding by overlapping chunks.

A long text is cut into chunks that overlap. Each chunk is pre-tokenised by itself, in parallel, from an arbitrary first
character, so its first boundaries may be wrong. Two scans that share one boundary agree from there on; a chunk therefore
scans its own overlap a second time the way its successor will, and the first common boundary is where the successor
takes over. The successor encodes the pieces up to there one by one, so that the stitch can drop them, and the rest in
one go. Stitching puts the ids of a document's chunks in order; decoding concatenates the bytes of the ids.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import id_or_null, keyed, map_batches, strings

#: Characters of a chunk, and of what it shares with the next at least.
CHUNK, OVERLAP = 16_384, 256
#: White space, as the pattern's engine has it.
_SPACE = frozenset(regex.findall(r"\s", "".join(map(chr, range(0x3001)))))
#: A boundary in every scan, whatever it began with: no pre-token holds white space after another character.
_BREAK = regex.compile(r"\S(?=\s)")


@functools.lru_cache(maxsize=2)
def encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=2)
def _pattern(pattern: str):
    return regex.compile(pattern)


#: White space beyond this many characters on end is more than the encoding's own scan takes (it gives up at about a million).
LONG_SPACE = 100_000
_LONG_SPACE = regex.compile(rf"\s{{{LONG_SPACE}}}")


def ordinary(bpe, text: str, pattern: str) -> list[int]:
    """The ids of a text. Where white space runs on for very long, the matches of the pattern are found here and merged
    one by one, which gives the same ids."""
    if len(text) >= LONG_SPACE and _LONG_SPACE.search(text):
        return [i for m in _pattern(pattern).finditer(text) for i in bpe._encode_single_piece(m[0])]
    return bpe.encode_ordinary(text)


def chunks(text: str, size: int = CHUNK, overlap: int = OVERLAP) -> Iterator[tuple[int, int, int, bool]]:
    """(start, start of the next chunk or the text's end, end, whether it is the last) of each chunk.

    The part shared with the next chunk is extended until it holds a place where every scan must break; where that lies
    far off (a long run without white space), the next chunk starts just before it, so the total stays linear. Chunks
    have three times ``overlap`` characters at least.
    """
    start, n, size = 0, len(text), max(size, 3 * overlap)
    while True:
        after = start + size
        if after + overlap >= n or (found := _BREAK.search(text, after + overlap)) is None:
            yield start, n, n, True
            return
        end = found.end() + 1  # one white-space character beyond the break, so that the break shows
        after = max(after, end - 2 * overlap)
        yield start, after, end, False
        start = after


def boundaries(text: str, pattern: str) -> list[int]:
    return [0, *(m.end() for m in _pattern(pattern).finditer(text))]


def _safe(text: str, at: int) -> bool:
    """Whether a slice that ends here is scanned by itself as within the text: after it, white space; before, none."""
    return 0 < at < len(text) and text[at - 1] not in _SPACE and text[at] in _SPACE


def encode_chunk(text: str, after: int, first: bool, last: bool, lead: int, path: str, pattern: str) -> tuple[list[int], list[int], list[int], int]:
    """Ids of a chunk from its start to where the next takes over.

    Returns (ids, lead_at, lead_ids, cut): cut is where the next chunk takes over (-1 for the last); at the places
    lead_at, up to about ``lead``, the chunk may itself be taken over from its predecessor, after lead_ids ids.
    """
    bpe, own = encoding(path, pattern), boundaries(text, pattern)
    cut = -1
    if not last:
        ahead = {after + b for b in boundaries(text[after:], pattern)}
        cut = next((b for b in own if b > after and b in ahead and _safe(text, b)), -1)
        if cut < 0:
            raise ValueError("a match of the pattern holds white space after another character")
    stop = len(text) if last else cut
    ids, lead_at, lead_ids, at = [], [], [], 0
    if not first:
        for b in own[1:]:
            if b > stop or (at > lead and lead_at):
                break
            if _safe(text, b):
                ids += ordinary(bpe, text[at:b], pattern)
                lead_at.append(b)
                lead_ids.append(len(ids))
                at = b
    ids += ordinary(bpe, text[at:stop], pattern)
    return ids, lead_at, lead_ids, cut


def _digests(ids: list[int], path: str, pattern: str) -> tuple[int, str, str]:
    names = _names(path, pattern)
    return len(ids), hashlib.sha256(" ".join([names[i] for i in ids]).encode()).hexdigest(), hashlib.sha256(encoding(path, pattern).decode_bytes(ids)).hexdigest()


@functools.lru_cache(maxsize=2)
def _names(path: str, pattern: str) -> list[str]:
    return [str(i) for i in range(encoding(path, pattern).n_vocab)]


def encode(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP, with_ids: bool = False) -> DataFrame:
    """Encode and decode each whole text: (doc_id, n_tokens, ids_sha256, decoded_sha256), and ids with ``with_ids``.

    Null text: as empty (no ids). Null and repeated doc_ids: each row is encoded; rows that are equal in both columns
    give equal rows. Other columns are ignored. An empty table gives an empty result. No match of the pattern may hold
    white space after another character; else texts above a chunk raise ValueError.
    """
    rows = keyed(docs)
    out = "did long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    names = ["did", "n_tokens", "ids_sha256", "decoded_sha256"]

    def result(dids: list[int], all_ids: list[list[int]]) -> pa.RecordBatch:
        columns = list(zip(*(_digests(ids, path, pattern) for ids in all_ids), strict=True))
        arrays = [pa.array(dids, pa.int64()), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())]
        return pa.record_batch(arrays + ([pa.array(all_ids, pa.list_(pa.int32()))] if with_ids else []), names + (["ids"] if with_ids else []))

    def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = encoding(path, pattern)
        return result(batch["did"].to_pylist(), [ordinary(bpe, x, pattern) for x in strings(batch["text"])])

    def cut(batch: pa.RecordBatch) -> pa.Table | None:
        found = []
        for did, text in zip(batch["did"].to_pylist(), strings(batch["text"]), strict=True):
            row = hashlib.blake2b(text.encode(), digest_size=16).digest()
            found += [(did, row, i, start, after - start, last, text[start:end]) for i, (start, after, end, last) in enumerate(chunks(text, chunk, overlap))]
        return pa.table([pa.array(x) for x in zip(*found, strict=True)], ["did", "row", "part", "start", "after", "last", "text"]) if found else None

    def pieces(batch: pa.RecordBatch) -> pa.Table:
        done = [
            encode_chunk(text, after, part == 0, last, 3 * overlap, path, pattern)
            for part, after, last, text in zip(*(batch[c].to_pylist() for c in ("part", "after", "last", "text")), strict=True)
        ]
        kinds = [pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64()]
        arrays = [pa.array(x, kind) for x, kind in zip(zip(*done, strict=True), kinds, strict=True)]
        return pa.table([batch["did"], batch["row"], batch["part"], batch["start"], batch["copies"], *arrays], ["did", "row", "part", "start", "copies", "ids", "lead_at", "lead_ids", "cut"])

    def stitch(batch: pa.RecordBatch) -> pa.RecordBatch:
        all_ids = []
        for parts in batch["parts"].to_pylist():
            ids, taken = [], 0
            for p in sorted(parts, key=lambda p: p["part"]):
                skip = 0
                if p["part"]:
                    skip = p["lead_ids"][p["lead_at"].index(taken - p["start"])]
                ids += p["ids"][skip:]
                taken = p["start"] + p["cut"]
            all_ids.append(ids)
        one = result(batch["did"].to_pylist(), all_ids)
        return one.take(pa.array([i for i, n in enumerate(batch["copies"].to_pylist()) for _ in range(n)]))

    is_long = F.char_length("text") > chunk + overlap
    short = map_batches(rows.where(~is_long).select("did", "text"), whole, out)
    parts = map_batches(rows.where(is_long).select("did", "text"), cut, "did long, row binary, part long, start long, after long, last boolean, text string")
    # rows that are equal, however many, are encoded once
    one = parts.groupBy("did", "row", "part").agg(F.first(F.struct("start", "after", "last", "text")).alias("chunk"), F.count("*").alias("copies"))
    one = one.select("did", "row", "part", "chunk.*", "copies")
    encoded = map_batches(one, pieces, "did long, row binary, part long, start long, copies long, ids array<int>, lead_at array<int>, lead_ids array<int>, cut long")
    # the parts of one document: as bounded as its text is
    gathered = encoded.groupBy("did", "row").agg(F.collect_list(F.struct("part", "start", "ids", "lead_at", "lead_ids", "cut")).alias("parts"), F.max("copies").alias("copies"))
    long = map_batches(gathered, stitch, out)
    done = short.unionByName(long)
    return done.select(id_or_null().alias("doc_id"), *[c for c in done.columns if c != "did"])


def decode(ids: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, data binary): the bytes of each row's ids (array<int>), concatenated. Null ids: no bytes."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = encoding(path, pattern)
        return pa.record_batch([batch["doc_id"], pa.array([bpe.decode_bytes(x or []) for x in batch["ids"].to_pylist()], pa.binary())], ["doc_id", "data"])

    return map_batches(ids.select("doc_id", "ids"), run, "doc_id long, data binary")
