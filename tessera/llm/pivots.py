"""Embedding near-dedup by a pivot-permutation index.

A vector is described by its nearest reference points (pivots) in order of nearness. The index is inverted: each pivot
has the list of the vectors that have it among their nearest ``PREFIX``. A pair is a candidate if the two share
``SHARED`` pivots or more; it is looked at in the list of the smallest pivot they share, so once, and then verified by
the cosine in double precision. Lists longer than ``BLOCK`` are searched in pairs of blocks. The number of pivots grows
with the square root of the vectors, so lists do too, and the work with their number to the power of 1.5.

Equal vectors are one class before the index. A list gives each vector its number of links and a spanning tree; pairs
are never written.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import windows
from tessera.llm.common import NULL_ID, Scratch, id_or_null, map_batches, partitions
from tessera.operators.components import components

COSINE = 0.95
PREFIX, SHARED = 10, 2
#: Pivots: twice the square root of the vectors, within these bounds (the upper one bounds what reaches the driver).
PIVOTS = (32, 4096)
#: Vectors sampled for each pivot, and the cosine to another pivot at which a vector isn't taken: a large group of near
#: copies must not hold many pivots, or its members would share few.
SAMPLED, APART = 4, 0.9
BLOCK = 2048


def unit(column: pa.Array) -> np.ndarray:
    """Vectors of a batch in double precision, at length 1; zeros fill those that have fewer components than others."""
    rows = [np.frombuffer(v, np.float64) for v in column.to_pylist()]
    x = np.zeros((len(rows), max(map(len, rows), default=0)))
    for i, v in enumerate(rows):
        x[i, : len(v)] = v / np.linalg.norm(v / np.abs(v).max()) / np.abs(v).max()
    return x


def nearest(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest pivots of each vector, nearest first."""
    width = min(x.shape[1], pivots.shape[1])
    near = x[:, :width] @ pivots[:, :width].T
    k = min(prefix, len(pivots))
    some = np.argpartition(-near, k - 1, axis=1)[:, :k]
    order = np.argsort(-np.take_along_axis(near, some, 1), axis=1, kind="stable")
    return np.take_along_axis(some, order, 1)


def spread(x: np.ndarray, wanted: int) -> np.ndarray:
    """The first ``wanted`` vectors in order, without those that are close to one taken before."""
    taken: list[int] = []
    for i in range(len(x)):
        if len(taken) < wanted and (not taken or (x[taken] @ x[i]).max() < APART):
            taken.append(i)
    return x[taken]


def _search(cosine: float, prefix: int, shared: int, n_pivots: int):
    def run(batches):
        for table in windows.blocks(batches, "pivot", 2 * BLOCK):
            pivot, pi, pj = (table[c].to_numpy() for c in ("pivot", "pi", "pj"))
            begins = np.flatnonzero(np.concatenate(([True], (pivot[1:] != pivot[:-1]) | (pi[1:] != pi[:-1]) | (pj[1:] != pj[:-1]))))
            for a, b in zip(begins.tolist(), np.append(begins[1:], len(pivot)).tolist(), strict=True):
                if b - a < 2:
                    continue
                part = table.slice(a, b - a)
                block, rep, members = (part[c].to_numpy() for c in ("block", "rep", "members"))
                x, wide = unit(part["vector"]), pc.binary_length(part["vector"]).to_numpy()
                prefixes = np.array(part["prefix"].to_pylist(), np.int64)
                hot = np.zeros((b - a, n_pivots), np.float32)
                np.put_along_axis(hot, prefixes, 1, 1)
                below = hot[:, : pivot[a]]
                links, root = np.zeros(b - a, np.int64), np.arange(b - a)
                edges: list[tuple[np.ndarray, np.ndarray]] = []
                for low in range(0, b - a, 256):
                    rows = slice(low, min(low + 256, b - a))
                    pairs = (x[rows] @ x.T >= cosine) & (wide[rows, None] == wide[None])
                    pairs &= hot[rows] @ hot.T >= min(shared, prefixes.shape[1])
                    pairs &= below[rows] @ below.T < 0.5
                    if pi[a] != pj[a]:
                        pairs &= block[rows][:, None] != block[None]
                    pairs[np.arange(rows.stop - low), np.arange(low, rows.stop)] = False
                    links[rows] = pairs @ members
                    edges.append(np.nonzero(pairs))
                    edges[-1] = (edges[-1][0] + low, edges[-1][1])
                i, j = (np.concatenate([e[k] for e in edges]) for k in (0, 1))
                changed = True
                while changed and len(i):  # the smallest place that is reachable within the list
                    least = root.copy()
                    np.minimum.at(least, i, root[j])
                    least = np.minimum(least, least[least])
                    changed = bool((least != root).any())
                    root = least
                some = np.flatnonzero(links)
                if len(some):
                    yield pa.record_batch([pa.array(rep[some]), pa.array(rep[root[some]]), pa.array(links[some])], ["a", "b", "links"])

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, prefix: int = PREFIX, shared: int = SHARED, pivots: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row: links are pairs of rows found with cosine >= ``cosine``.

    n_links: the other rows that a row is linked with; component_id: the smallest vec_id reachable by links; kept:
    vec_id = component_id. Vectors that are null, empty, zero, or hold null or non-finite components link with nothing;
    those of different numbers of components don't link with each other. A null vec_id is the smallest id;
    rows with equal vec_ids have one component. Other columns (labels) are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    scratch, n_tasks = Scratch(spark, "pivots"), partitions(spark)
    e = F.col("embedding").cast("array<double>")
    sound = F.coalesce(F.forall(e, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NULL_ID)).alias("did"), F.when(sound, F.transform(e, lambda x: x + F.lit(0.0))).alias("e"))

    def code(batch: pa.RecordBatch) -> pa.RecordBatch:
        coded = [None if x is None else np.array(x, np.float64).tobytes() for x in batch["e"].to_pylist()]
        return pa.record_batch([batch["did"], pa.array(coded, pa.binary())], ["did", "vector"])

    coded = scratch.write(map_batches(rows, code, "did long, vector binary").withColumn("digest", F.sha2("vector", 256)), "coded")
    classes = coded.where("vector is not null").groupBy("digest").agg(F.min("did").alias("rep"), F.count("*").alias("members"), F.first("vector").alias("vector"))
    classes = scratch.write(classes, "classes")
    n = classes.count()
    wanted = pivots or int(min(max(PIVOTS[0], 2 * n**0.5), PIVOTS[1]))
    # a bounded sample: the classes with the smallest digests
    chosen = [bytes(r.vector) for r in classes.orderBy("digest").limit(SAMPLED * wanted).select("vector").collect()]
    reference = spread(unit(pa.array(chosen, pa.binary())), wanted) if chosen else np.zeros((1, 1))
    held = spark.sparkContext.broadcast(reference)  # PIVOTS[1] vectors at most

    def describe(batch: pa.RecordBatch) -> pa.RecordBatch:
        near = nearest(unit(batch["vector"]), held.value, prefix)
        return pa.record_batch([batch["rep"], batch["members"], batch["vector"], pa.array(near.tolist(), pa.list_(pa.int64()))], ["rep", "members", "vector", "prefix"])

    described = map_batches(classes.select("rep", "members", "vector"), describe, "rep long, members long, vector binary, prefix array<long>")
    described = scratch.write(described, "described")
    posted = described.select("*", F.explode("prefix").alias("pivot"))
    sizes = described.select(F.explode("prefix").alias("pivot")).groupBy("pivot").agg(F.count("*").alias("size"))
    blocks = F.ceil(F.col("size") / BLOCK)
    posted = posted.join(F.broadcast(sizes), "pivot").withColumn("block", F.pmod(F.xxhash64("rep", "vector"), blocks))  # PIVOTS[1] rows at most
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda x: F.struct(F.least(x, F.col("block")).alias("pi"), F.greatest(x, F.col("block")).alias("pj")))
    columns = ["pivot", "pi", "pj", "block", "rep", "members", "vector", "prefix"]
    posted = posted.withColumn("p", F.explode(pairs)).select("pivot", "p.pi", "p.pj", *columns[3:])
    order = ["pivot", "pi", "pj"]
    lists = posted.repartition(n_tasks, *order).sortWithinPartitions(*order)
    links = scratch.write(lists.mapInArrow(_search(cosine, prefix, shared, len(reference)), "a long, b long, links long"), "links")
    groups = components(links.select("a", "b")).withColumnRenamed("id", "rep")
    counts = links.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    by_class = classes.select("digest", "rep", "members").join(counts, "rep", "left").join(groups, "rep", "left")
    by_class = by_class.select("digest", (F.col("members") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    by_class = scratch.write(by_class, "by_class")  # so that Spark can split a digest that many rows have in the join below
    scratch.keep("coded", "by_class")
    found = coded.where("vector is not null").select("did", "digest").join(by_class, "digest").select("did", "n_links", "component")
    out = found.unionByName(coded.where("vector is null").select("did", F.lit(0).cast("long").alias("n_links"), F.col("did").alias("component")))
    return out.select(id_or_null().alias("vec_id"), "n_links", id_or_null("component").alias("component_id"), (F.col("did") == F.col("component")).alias("kept"))
