"""Secret scans by a trigram inverted index.

From each rule's pattern a Boolean query over trigrams is derived: an OR of ANDs that holds for every text in which the
pattern can match. Trigrams are of the texts' UTF-8 bytes, with A-Z as a-z, so one index serves rules of either case.
The index holds postings of the trigrams that the queries name: lists by trigram, each cut into shards by document, so
that a common trigram is spread over many tasks. Postings are intersected by counting: a document is a candidate of a
rule if it is in all the lists of one AND. Only candidates are verified, on the whole text. Rules whose pattern has no
mandatory trigram are scanned for in every text.

Queries and terms are small: ``MOST_TERMS`` ANDs a rule at most, of ``MOST_GRAMS`` trigrams at most. A query that would
be longer is weakened, which lets more candidates through and loses none.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from re import _constants as sre
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, id_or_null, keyed, map_batches, partitions, strings
from tessera.llm.hashing import text_bytes

#: Strings that a part of a pattern is expanded to at most, characters of a class that is, ANDs of a query, trigrams of an AND.
MOST_STRINGS, MOST_CLASS, MOST_TERMS, MOST_GRAMS = 64, 4, 64, 60
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of the pattern (letters A-Z in either case if ``any_case``), leftmost and
    non-overlapping, whose group ``group`` has ``least`` characters or more; shorter ones are dropped after matching."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    any_case: bool = False

    def compiled(self) -> re.Pattern:
        return _compiled(self.pattern, self.any_case)


@functools.lru_cache(maxsize=256)
def _compiled(pattern: str, any_case: bool) -> re.Pattern:
    return re.compile(pattern, re.ASCII | (re.IGNORECASE if any_case else 0))


#: The rules of the query. Runs of [0-9a-f] of 16 or more are the matches of [0-9a-f]+ that long.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=12, any_case=True),
    Rule("access", r"AKIA[A-Z0-9]+", least=18),
    Rule("hex", r"[0-9a-f]{16,}", least=16),
)

Query = frozenset  # of frozensets of trigrams (3 bytes): an OR of ANDs; ANY holds always
ANY: Query = frozenset({frozenset()})


def _either(a: Query, b: Query) -> Query:
    """OR; an AND that asks for more than another one is left out."""
    terms = sorted(a | b, key=len)
    out: list[frozenset] = []
    for t in terms:
        if not any(x <= t for x in out):
            out.append(t)
    return frozenset(out) if len(out) <= MOST_TERMS else ANY


def _both(a: Query, b: Query) -> Query:
    """AND; the weaker of the two where the product is too long."""
    if len(a) * len(b) > MOST_TERMS:
        return min(a, b, key=len)
    return functools.reduce(_either, (frozenset({x | y}) for x in a for y in b), frozenset())


def _trigrams(strings_: Iterable[str]) -> Query:
    """What a text that holds one of the strings fulfils."""
    out: Query = frozenset()
    for s in strings_:
        data = s.encode().translate(_LOWER.tobytes())
        out = _either(out, frozenset({frozenset(data[i : i + 3] for i in range(len(data) - 2))}))
    return out


def _class(items: Sequence) -> set[str] | None:
    """The characters of a small class."""
    out: set[str] = set()
    for op, arg in items:
        if op is sre.LITERAL:
            out.add(chr(arg))
        elif op is sre.RANGE and arg[1] - arg[0] < MOST_CLASS:
            out |= {chr(c) for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return {c.lower() if c.isascii() else c for c in out} if len(out) <= MOST_CLASS else None


def _walk(nodes: Sequence) -> tuple[set[str] | None, Query]:
    """(all strings that match, if they are few; else what every match fulfils) of a sequence of parsed parts."""
    query, run, finite = ANY, {""}, True

    def close() -> None:
        nonlocal query, run, finite
        query, run, finite = _both(query, _trigrams(run)), {""}, False

    for op, arg in nodes:
        part: set[str] | None = None
        more: Query = ANY
        if op is sre.LITERAL:
            part = {chr(arg).lower() if arg < 128 else chr(arg)}
        elif op is sre.IN:
            part = _class(arg)
        elif op is sre.SUBPATTERN:
            part, more = _walk(arg[3])
        elif op is sre.ATOMIC_GROUP:
            part, more = _walk(arg)
        elif op is sre.BRANCH:
            found = [_walk(x) for x in arg[1]]
            if all(s is not None for s, _ in found):
                part = set().union(*(s for s, _ in found))
            more = functools.reduce(_either, (q if s is None else _trigrams(s) for s, q in found))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            low, high, inner = arg
            own, more = _walk(inner)
            if own is not None and low == 0 and high == 1:
                part, more = own | {""}, ANY
            elif own is not None and low == high == 1:
                part = own
            elif low == 0:
                more = ANY
            elif own is not None:
                more = _trigrams(own)
        elif op is sre.AT or op is sre.ASSERT_NOT:  # takes no characters
            continue
        if part is not None and len(part) * len(run) <= MOST_STRINGS:
            run = {a + b for a in run for b in part}
            continue
        close()
        query = _both(query, more if part is None else _trigrams(part))
    if finite:
        return run, ANY
    return None, _both(query, _trigrams(run))


def trigram_query(rule: Rule) -> Query:
    """An OR of ANDs of trigrams that every text with a match fulfils; ``ANY`` if the pattern has no mandatory trigram.

    Characters that a pattern takes from a class, a repetition or a reference count as unknown.
    """
    own, query = _walk(_parser.parse(rule.pattern, re.ASCII))
    query = query if own is None else _trigrams(own)
    return functools.reduce(_either, (frozenset({frozenset(sorted(t)[:MOST_GRAMS])}) for t in query), frozenset())


def _code(gram: bytes) -> int:
    return gram[0] << 16 | gram[1] << 8 | gram[2]


def postings(docs: DataFrame, grams: set[int]) -> DataFrame:
    """(did, th, gram): which of the given trigrams each text of ``keyed`` documents holds."""
    wanted = np.zeros(2**24, bool)
    wanted[sorted(grams)] = True
    packed = np.packbits(wanted)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        data, offsets = text_bytes(batch["text"])
        if len(data) < 3:
            return None
        low = _LOWER[data].astype(np.int32)
        codes = low[:-2] << 16 | low[1:-1] << 8 | low[2:]
        at = np.flatnonzero(np.unpackbits(packed).view(bool)[codes])
        row = np.searchsorted(offsets, at, side="right") - 1
        inside = at + 3 <= offsets[row + 1]
        found = np.unique(row[inside].astype(np.int64) << 24 | codes[at[inside]])
        rows = pa.array(found >> 24)
        return pa.record_batch([batch["did"].take(rows), batch["th"].take(rows), pa.array((found & (2**24 - 1)).astype(np.int32))], ["did", "th", "gram"])

    return map_batches(docs, run, "did long, th long, gram int")


def index(docs: DataFrame, rules: Sequence[Rule], scratch: Scratch) -> DataFrame:
    """The inverted index (gram, did, th) for the rules' queries: a folder a trigram, whose list is cut into shards."""
    grams = {_code(g) for r in rules if (q := trigram_query(r)) != ANY for t in q for g in t}
    n_tasks = partitions(docs.sparkSession)
    lists = postings(docs, grams).repartition(n_tasks, F.col("gram"), F.pmod("th", F.lit(n_tasks))).sortWithinPartitions("gram", "did", "th")
    return scratch.write_lists(lists.select("did", "th", "gram"), "postings", by="gram")


def candidates(lists: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(did, th, rules): the documents that fulfil the query of a rule, with the places of those rules."""
    spark, terms = lists.sparkSession, []
    for i, rule in enumerate(rules):
        query = trigram_query(rule)
        if query != ANY:
            terms += [(i, j, _code(g), 1 << k, (1 << len(t)) - 1) for j, t in enumerate(sorted(query, key=sorted)) for k, g in enumerate(sorted(t))]
    wanted = spark.createDataFrame(terms, "rule int, term int, gram int, bit long, full long")
    # as many rows as the rules' queries have trigrams, whatever the documents are
    hits = lists.join(F.broadcast(wanted), "gram").groupBy("did", "th", "rule", "term").agg(F.bit_or("bit").alias("has"), F.first("full").alias("full"))
    return hits.where("has = full").groupBy("did", "th").agg(F.collect_set("rule").alias("rules"))


def matches(text: str, rule: Rule) -> list[tuple[int, int]]:
    """(start, end) of each match, in code points, end exclusive."""
    return [m.span() for m in rule.compiled().finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(doc_id, spans) of every row: spans is an array of (kind, start, end) by start, then kind as listed, in code
    points with the end exclusive.

    Null text: empty. Null and repeated doc_ids: a row each, judged by its own text. Texts are matched whole. Other columns are ignored; no
    rows give no rows, no rules no spans. Kinds must differ; a pattern that does not compile raises re.error.
    """
    rules = tuple(rules)
    if len({r.kind for r in rules}) < len(rules):
        raise ValueError("two rules have one kind")
    queries = [trigram_query(r) for r in rules]
    always = [i for i, q in enumerate(queries) if q == ANY]
    rows = keyed(docs)
    if len(always) < len(rules):
        scratch = Scratch(docs.sparkSession, "secrets")
        some = scratch.write(candidates(index(rows, rules, scratch), rules), "candidates")
        scratch.drop("postings")
        rows = rows.join(some.hint("merge"), ["did", "th"], "left").select("did", "text", "rules")
    else:
        rows = rows.select("did", "text", F.lit(None).cast("array<int>").alias("rules"))

    def verify(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, own in zip(strings(batch["text"]), batch["rules"].to_pylist(), strict=True):
            found = sorted((start, i, end) for i in {*always, *(own or ())} for start, end in matches(text, rules[i]))
            out.append([{"kind": rules[i].kind, "start": start, "end": end} for start, i, end in found])
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        return pa.record_batch([batch["did"], pa.array(out, kind)], ["did", "spans"])

    found = map_batches(rows, verify, "did long, spans array<struct<kind: string, start: long, end: long>>")
    return found.select(id_or_null().alias("doc_id"), "spans")


def digest(found: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``scan``'s rows as counts (n_<kind>) and spans as text, kind:start:end joined by commas, with its sha256."""
    text = F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, r.kind))).cast("long").alias(f"n_{r.kind}") for r in rules]
    return found.select("doc_id", *counts, F.sha2(text, 256).alias("base_sha256"), text.alias("spans"))

