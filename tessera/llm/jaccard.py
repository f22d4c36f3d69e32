"""N-gram Jaccard join by chosen paths.

Each text becomes the set of its word n-grams. From the root of each of several runs, a node of the recursion draws
min-hashes of its own (1/similarity of them on average) and splits its sets by them: the sampled n-grams that sets share.
No two nodes, and so no two runs, have a min-hash in common. A node with few sets is searched by brute force; larger ones
are split again, level by level, as one shuffle for all nodes of a level. Nodes that are still large at the last level are
searched in pairs of blocks, and so is a node that holds most of its parent's sets, such as a large group of near copies,
which would part only after many levels, if at all. Sets that share a leaf are compared by a row of further min-hashes and then, exactly, by
their n-grams.

A pair at the similarity wanted shares a node at level 1 of one run with a probability of 0.84 (at 0.8), at level 4 of
0.58, at level 8 of 0.41. ``runs_needed`` counts the runs after which it is missed with ``MISS`` at most: 10 down to level
3, 18 at level 8. All sets take part in the runs that level ``FIRST`` needs; sets that were in a node too large for a leaf
take part in as many as the deepest level that was reached needs. Of two sets at the similarity, one of which never was in
such a node, level 1 alone decides, and the first runs are enough. Likelier pairs are missed less.

Equal sets are one class before the join. In a leaf, a pair counts only if no smaller leaf has both, so links are counted
once without ever being written as pairs: a leaf gives each set its number of links, and a spanning tree.
"""

from __future__ import annotations

import functools
import hashlib
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import windows
from tessera.llm.common import Scratch, bitmap, id_or_null, in_bitmap, keyed, map_batches, partitions, trimmed
from tessera.operators.components import components
from tessera.llm.hashing import Words, grams_of_words, mix

NGRAM, SIMILARITY = 5, 0.8
PLACES, LEVELS = 64, 8
#: Chances that a pair at the similarity shares no leaf, and that its rows of min-hashes differ too much to be verified.
MISS, FILTERED = 8e-5, 2e-5
#: The level whose number of runs all sets take part in.
FIRST = 3
#: Sets of a node that are searched by brute force.
LEAF = 1024
#: A node that holds a larger share of its parent's sets is not split further: its sets are too alike to part.
PARTS = 0.75


def shingles(column: pa.Array, n: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash), sorted and distinct: the n-grams of each text's words; all its words if it has fewer than n."""
    words = Words(column)
    own, count = words.hashes(), np.diff(words.first)
    last = np.repeat(words.first[1:], count)
    grams = grams_of_words(own, n)
    keep = np.arange(len(own)) + n <= last
    for m in range(1, n):
        short = words.first[:-1][count == m]
        grams[short] = mix(grams_of_words(own, m)[short] + np.uint64(m)) if len(short) else grams[short]
        keep[short] = True
    row, grams = words.row[keep], grams[keep]
    order = np.lexsort((grams, row))
    row, grams = row[order], grams[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (grams[1:] != grams[:-1])
    return row[new], grams[new]


def signatures(row: np.ndarray, grams: np.ndarray, places: int = PLACES) -> np.ndarray:
    """A row of min-hashes for each set that isn't empty, in order: a byte of each, so that unequal ones look equal once
    in 256 times, which lets more pairs through to verification and none less."""
    rng = np.random.default_rng(10)
    begins = np.flatnonzero(np.diff(row, prepend=-1))
    out = np.zeros((len(begins), places), np.uint8)
    for j, (a, b) in enumerate(rng.integers(0, 2**63, (places, 2), np.uint64)):
        hashed = ((grams * (a | np.uint64(1)) + b) >> np.uint64(32)).astype(np.uint32)
        if len(begins):
            out[:, j] = np.minimum.reduceat(hashed, begins) & np.uint32(255)
    return out


def runs_needed(depth: int, similarity: float = SIMILARITY, miss: float = MISS) -> int:
    """Runs after which a pair at the similarity has shared no node at ``depth`` with a probability of ``miss`` at most."""
    more = int(1 / similarity)
    split, rest = 0.0, (1 / similarity - more) * similarity
    for _ in range(depth):  # the chance that one more level leaves the pair no common node
        split = (1 - similarity + similarity * split) ** more * (1 - rest + rest * split)
    return max(1, math.ceil(math.log(miss) / math.log(split))) if split > 0 else 1


def least_equal(similarity: float, places: int = PLACES, filtered: float = FILTERED) -> int:
    """The most equal min-hashes that can be asked for so that a pair at the similarity has fewer with ``filtered`` at most."""
    below = 0.0
    for k in range(places + 1):
        below += math.comb(places, k) * similarity**k * (1 - similarity) ** (places - k)
        if below > filtered:
            return k
    return places


def roots(first: int, end: int) -> np.ndarray:
    """The roots of runs ``first`` to ``end`` - 1."""
    return mix(np.arange(first + 1, end + 1, dtype=np.uint64) * np.uint64(0x51ED2701))


def seeds(keys: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """The seeds of the min-hashes that the given nodes draw, 1/similarity a node on average."""
    u = mix(keys + np.uint64(1))
    more = int(1 / similarity)
    extra = (u >> np.uint64(11)).astype(np.float64) / 2**53 < 1 / similarity - more
    return np.concatenate([mix((u if k < more else u[extra]) + np.uint64(k + 7)) for k in range(more + 1)])


def children(of: np.ndarray, grams: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The nodes that sets (parts of ``grams``) go to by the min-hashes of the given seeds: a row a seed, a column a set."""
    least = [np.minimum.reduceat(mix(grams ^ seed), begins) for seed in of]
    return mix(np.array(least, np.uint64).reshape(len(of), len(begins)) ^ of[:, None])


def _signature_rows(column: pa.Array, places: int = PLACES) -> np.ndarray:
    return np.array([np.frombuffer(x, np.uint8) for x in column.to_pylist()], np.uint8).reshape(-1, places)


def _nodes(similarity: float):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out, above = [], []
        for data, nodes, sizes in zip(batch["set"].to_pylist(), batch["node"].to_pylist(), batch["above"].to_pylist(), strict=True):
            of = [seeds(np.array([x], np.int64).view(np.uint64), similarity) for x in nodes]
            out.append(children(np.concatenate(of), np.frombuffer(data, np.uint64), np.zeros(1, np.int64)).ravel())
            above += [s for s, x in zip(sizes, of, strict=True) for _ in x]
        which = np.repeat(np.arange(len(out)), [len(x) for x in out])
        return pa.record_batch([pa.array(np.concatenate(out).view(np.int64)), batch["digest"].take(pa.array(which)), pa.array(above, pa.int64())], ["node", "digest", "above"])

    return run


def _owned(keys: list[list[int]], node: int) -> np.ndarray:
    """Whether a pair of sets has no leaf below ``node`` in common; keys: the leaves of each set."""
    m = len(keys)
    row = np.repeat(np.arange(m), [len(k) for k in keys])
    flat = np.array([x for k in keys for x in k], np.int64)
    row, flat = row[flat < node], flat[flat < node]
    values, at, times = np.unique(flat, return_inverse=True, return_counts=True)
    some = times[at] > 1
    row, at = row[some], np.unique(at[some], return_inverse=True)[1]
    if not len(at):
        return np.ones((m, m), bool)
    held = np.zeros((m, at.max() + 1), np.float32)
    held[row, at] = 1
    return held @ held.T < 0.5


def _candidates(group: dict, similarity: float) -> np.ndarray:
    """Pairs (as a symmetric matrix) that this node has to decide, by their min-hashes and sizes."""
    sig, n, m = group["sig"], group["n"], len(group["n"])
    places = sig.shape[1]
    equal = np.zeros((m, m), np.int16)
    for j in range(places):
        equal += sig[:, j][:, None] == sig[:, j][None]
    pairs = equal >= least_equal(similarity, places)
    pairs &= np.minimum.outer(n, n) >= similarity * np.maximum.outer(n, n) - 1e-9
    block, pi, pj = group["block"], group["pi"], group["pj"]
    pairs &= ((block == pi)[:, None] & (block == pj)[None]) | ((block == pj)[:, None] & (block == pi)[None])
    np.fill_diagonal(pairs, False)
    if pairs.any():
        pairs &= _owned(group["keys"], group["node"])
    return pairs


def _groups(batches):
    """One dict of columns per (node, pi, pj), from batches sorted by them."""
    for table in windows.blocks(batches, "node", 8192):
        node, pi, pj = (table[c].to_numpy() for c in ("node", "pi", "pj"))
        begins = np.flatnonzero(np.concatenate(([True], (node[1:] != node[:-1]) | (pi[1:] != pi[:-1]) | (pj[1:] != pj[:-1]))))
        ends = np.append(begins[1:], len(node))
        for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
            if b - a > 1:
                part = table.slice(a, b - a)
                yield {
                    "node": int(node[a]), "pi": int(pi[a]), "pj": int(pj[a]), "table": part, "block": part["block"].to_numpy(), "n": part["n"].to_numpy(),
                    "sig": _signature_rows(part["sig"]), "keys": part["keys"].to_pylist(),
                }


def _shortlist(similarity: float):
    def run(batches):
        for group in _groups(batches):
            some = _candidates(group, similarity).any(axis=1)
            if some.any():
                yield from group["table"].take(pa.array(np.flatnonzero(some))).to_batches()

    return run


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    m = len(sets)
    row, values = np.repeat(np.arange(m), [len(s) for s in sets]), np.concatenate(sets)
    _, at, times = np.unique(values, return_inverse=True, return_counts=True)
    some = times[at] > 1
    row, at = row[some], np.unique(at[some], return_inverse=True)[1]
    out = np.zeros((m, m), np.float64)
    width = 8192
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    for low in range(0, int(at.max()) + 1 if len(at) else 0, width):
        a, b = np.searchsorted(at, (low, low + width))
        held = np.zeros((m, min(width, int(at.max()) + 1 - low)), np.float32)
        held[row[a:b], at[a:b] - low] = 1
        out += held @ held.T
    return out


def _verify(similarity: float):
    exact = Fraction(str(similarity))

    def run(batches):
        for group in _groups(batches):
            pairs = _candidates(group, similarity)
            if not pairs.any():
                continue
            table = group["table"]
            both = _intersections([np.frombuffer(x, np.uint64) for x in table["set"].to_pylist()])
            size = np.add.outer(group["n"], group["n"])
            pairs &= both * float(exact.numerator + exact.denominator) >= size * float(exact.numerator)
            linked = np.flatnonzero(pairs.any(axis=1))
            if not len(linked):
                continue
            members, rep = table["members"].to_numpy(), table["rep"].to_numpy()
            root = np.arange(len(rep))
            for i in linked.tolist():  # components within the leaf, smallest place first
                if root[i] == i:
                    todo = [i]
                    while todo:
                        near = np.flatnonzero(pairs[todo].any(axis=0) & (root == np.arange(len(root))) & (np.arange(len(root)) > i))
                        root[near] = i
                        todo = near.tolist()
            yield pa.record_batch(
                [table["digest"].combine_chunks().take(pa.array(linked)), pa.array(rep[linked]), pa.array(rep[root[linked]]), pa.array((pairs[linked] @ members).astype(np.int64))],
                ["digest", "a", "b", "links"],
            )

    return run


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, ngram: int = NGRAM, leaf: int = LEAF, levels: int = LEVELS) -> DataFrame:
    """(doc_id, n_links, component_id, kept) of every row: links are pairs whose sets of word n-grams have a Jaccard
    similarity of ``similarity`` or more.

    n_links: the other rows that a row is linked with; component_id: the smallest doc_id reachable by links; kept:
    doc_id = component_id. Words are ``[^\\x20\\x09-\\x0D]+``; a text of fewer than ``ngram`` words has one n-gram, all
    its words; a null text or one without words links with nothing. A null doc_id is the smallest id. Rows with equal
    doc_ids have one component and stand or fall together. Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch, rows, n_tasks = Scratch(spark, "jaccard"), keyed(docs), partitions(spark)
    runs = runs_needed(min(FIRST, levels), similarity)
    start = seeds(roots(0, runs), similarity)

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, grams = shingles(batch["text"], ngram)
        begins = np.flatnonzero(np.diff(row, prepend=-1))
        ends, of = np.append(begins[1:], len(row)), row[begins]
        sig, digest, n, nodes = [None] * batch.num_rows, [None] * batch.num_rows, np.zeros(batch.num_rows, np.int64), [None] * batch.num_rows
        below = children(start, grams, begins).view(np.int64).T if len(begins) else []
        for i, a, b, s, own in zip(of.tolist(), begins.tolist(), ends.tolist(), signatures(row, grams), below, strict=True):
            sig[i], digest[i], n[i], nodes[i] = s.tobytes(), hashlib.blake2b(grams[a:b].tobytes(), digest_size=16).digest(), b - a, own
        columns = [pa.array(digest, pa.binary()), pa.array(sig, pa.binary()), pa.array(n), pa.array(nodes, pa.list_(pa.int64()))]
        return pa.record_batch([batch["did"], batch["th"], *columns], ["did", "th", "digest", "sig", "n", "nodes"])

    signed = scratch.write(map_batches(rows, sign, "did long, th long, digest binary, sig binary, n long, nodes array<long>"), "signed")
    classes = signed.where("digest is not null").groupBy("digest").agg(
        F.min(F.struct("did", "th")).alias("first"), F.count("*").alias("members"), *[F.first(c).alias(c) for c in ("sig", "n", "nodes")]
    )
    classes = scratch.write(classes.select("digest", F.col("first.did").alias("rep"), "first.th", "members", "sig", "n", "nodes"), "classes")

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, grams = shingles(batch["text"], ngram)
        cuts = np.searchsorted(row, np.arange(batch.num_rows + 1))
        return pa.record_batch([batch["digest"], pa.array([grams[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], ["digest", "set"])

    def sets_of(some: DataFrame) -> DataFrame:
        """(digest, set). Only texts whose id and hash are in a bitmap of those wanted are shuffled."""
        nonlocal looked_up
        looked_up += 1
        wanted = some.select("digest").distinct().join(classes.select("digest", F.col("rep").alias("did"), "th"), "digest")
        wanted = scratch.write(wanted, f"wanted-{looked_up}")
        bits = spark.sparkContext.broadcast(bitmap(scratch, wanted.select(F.xxhash64("did", "th")), f"bits-{looked_up}"))

        bitmaps.append(bits)

        @F.arrow_udf("boolean")
        def maybe(h: pa.Array) -> pa.Array:
            return pa.array(in_bitmap(bits.value, h.to_numpy()))

        texts = rows.where(maybe(F.xxhash64("did", "th"))).join(wanted.hint("shuffle_hash"), ["did", "th"]).select("digest", "text")
        return map_batches(texts, sets, "digest binary, set binary").groupBy("digest").agg(F.first("set").alias("set"))

    looked_up, bitmaps = 0, []
    leaves, split = [], None  # split: the n-grams of the sets that were in a node too large for a leaf

    def descend(level: DataFrame, run: int) -> int:
        """Split (node, digest, above), above: the rows of the node's parent, until nodes are small or hardly part; the
        deepest level."""
        nonlocal split
        for depth in range(1, levels + 1):
            level = scratch.write(level, f"level-{run}-{depth}")
            sizes = level.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
            sized = scratch.write(level.join(sizes, "node"), f"sized-{run}-{depth}")
            scratch.drop(f"level-{run}-{depth}")
            parts = (F.col("size") > leaf) & (F.col("size") <= F.col("above") * PARTS)
            leaves.append(sized if depth == levels else sized.where(~parts))
            large = sized.where(parts)
            if depth == levels or not large.limit(1).count():
                return depth
            if split is None:
                split = scratch.write(sets_of(large), "split")
            nodes = large.groupBy("digest").agg(F.collect_list(F.struct("node", F.col("size").alias("above"))).alias("nodes"))
            level = map_batches(nodes.join(split, "digest").select("digest", "set", "nodes.node", "nodes.above"), _nodes(similarity), "node long, digest binary, above long")

    n_sets = F.lit(classes.count())
    deepest = descend(classes.select(F.explode("nodes").alias("node"), "digest", n_sets.alias("above")), 0)
    while (needed := runs_needed(deepest, similarity)) > runs:
        more = [F.lit(r).cast("long") for r in roots(runs, needed).view(np.int64).tolist()]
        level = split.select("digest", "set", F.array(*more).alias("node"), F.array_repeat(n_sets, len(more)).alias("above"))
        deepest = max(deepest, descend(map_batches(level, _nodes(similarity), "node long, digest binary, above long"), runs))
        runs = needed
    leaves = functools.reduce(DataFrame.unionByName, leaves)

    # a set's leaves: runs * (1 / similarity) ** levels on average
    keys = leaves.groupBy("digest").agg(F.collect_set(F.struct("node", "size")).alias("leaves"))
    spread = classes.join(keys, "digest").select("digest", "rep", "members", "sig", "n", F.col("leaves.node").alias("keys"), F.explode("leaves").alias("at"))
    blocks = F.ceil(F.col("at.size") / leaf)
    block = F.pmod(F.xxhash64("digest"), blocks)
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda x: F.struct(F.least(x, F.col("block")).alias("pi"), F.greatest(x, F.col("block")).alias("pj")))
    spread = spread.withColumn("block", block).select(F.col("at.node").alias("node"), "block", "digest", "rep", "members", "sig", "n", "keys", F.explode(pairs).alias("p"))
    schema = "node long, pi long, pj long, block long, digest binary, rep long, members long, sig binary, n long, keys array<long>"
    spread = spread.select("node", "p.pi", "p.pj", "block", "digest", "rep", "members", "sig", "n", "keys")
    order = ["node", "pi", "pj"]
    short = scratch.write(spread.repartition(n_tasks, *order).sortWithinPartitions(*order).mapInArrow(trimmed(_shortlist(similarity)), schema), "shortlist")

    verify = short.join(sets_of(short), "digest").repartition(n_tasks, *order).sortWithinPartitions(*order)
    links = scratch.write(verify.mapInArrow(trimmed(_verify(similarity)), "digest binary, a long, b long, links long"), "links")

    for bits in bitmaps:
        bits.unpersist()

    groups = components(links.select("a", "b")).withColumnRenamed("id", "rep")
    counts = links.groupBy("digest").agg(F.sum("links").alias("links"))
    by_class = classes.select("digest", "rep", "members").join(counts, "digest", "left").join(groups, "rep", "left")
    by_class = by_class.select("digest", (F.col("members") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    by_class = scratch.write(by_class, "by_class")  # so that Spark can split a digest that many rows have in the join below
    scratch.keep("signed", "by_class")
    found = signed.where("digest is not null").select("did", "digest").join(by_class, "digest").select("did", "n_links", "component")
    out = found.unionByName(signed.where("digest is null").select("did", F.lit(0).cast("long").alias("n_links"), F.col("did").alias("component")))
    return out.select(id_or_null().alias("doc_id"), "n_links", id_or_null("component").alias("component_id"), (F.col("did") == F.col("component")).alias("kept"))
