"""Fill-in-middle transformation by relational units, in DataFrame functions only.

A text is cut into units, ``posexplode`` makes a row of each unit's length, a window's running sum gives where each unit
ends, and the cut requests of a document (the numbers of units before and up to its middle) are joined by the unit's
ordinal. The offsets found, two at most, are aggregated per document, and ``substring`` takes the parts.

Only documents with a cut request are exploded and shuffled: their texts once, by document, and all that follows (units,
window, join, aggregation, substring) keeps that partitioning. Rows equal in id and text are one on the way, counted
before the shuffle, so that many copies are no hot key. A unit's row carries a length and no text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import id_or_null, keyed

#: Fixed values of the output's format.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A word with the white space before it, or white space that no word follows; possessive, for nothing has to be given back.
UNIT = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++"
#: Documents in a hundred that are transformed, and of these, in a hundred, those that put the suffix first.
RATE, SPM = 50, 80


def draws(doc_id: Column, seed: int = 42) -> list[Column]:
    """Four numbers below 2**32 that follow from the seed and the decimal id (a null id: nothing after the colon)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def assemble(form: Column, prefix: Column, middle: Column, suffix: Column) -> Column:
    marked = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return F.when(form == "psm", marked(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)).otherwise(marked(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))


def restore(output: Column, form: Column) -> Column:
    """The text, from output and form alone. The parts hold no marker, and none arises where they meet."""
    marks = F.substring_index(F.substr(output, F.lit(4)), MIDDLE, 1)  # what is before the middle, without its first marker
    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(F.substring_index(marks, SUFFIX, 1), middle, F.substring_index(marks, SUFFIX, -1))
    spm = F.concat(F.substring_index(marks, PREFIX, -1), middle, F.substring_index(marks, PREFIX, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def units(docs: DataFrame) -> DataFrame:
    """(did, th, ordinal from 1, end): where each unit of ``text`` ends, in code points from its start."""
    lengths = F.transform(F.regexp_extract_all("text", F.lit(UNIT), F.lit(0)), lambda x: F.length(x))
    rows = docs.select("did", "th", F.posexplode(lengths).alias("at", "length"))
    so_far = Window.partitionBy("did", "th").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("did", "th", (F.col("at") + 1).alias("ordinal"), F.sum("length").over(so_far).alias("end"))


def transform(docs: DataFrame, seed: int = 42, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output, restored) of every row.

    n: the units of the text. form: plain, psm or spm; plain texts are left as they are (the numbers of characters are
    null), empty ones and those that hold a marker among them. restored: the text rebuilt from output and form.

    Null text: empty. Null doc_id: drawn from the seed alone, and named null. Repeated doc_ids: a row each, by the same
    draws; rows equal in both columns give equal rows, as many. Other columns are ignored; no rows give no rows.
    """
    h1, h2, h3, h4 = draws(id_or_null(), seed)
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    form = F.when((F.col("text") == "") | marked | (h3 % 100 >= rate), "plain").when(h4 % 100 < spm, "spm").otherwise("psm")
    rows, is_plain = keyed(docs), form == "plain"
    n = F.size(F.regexp_extract_all("text", F.lit(UNIT), F.lit(0))).cast("long")

    none = F.lit(None).cast("long")
    plain = rows.where(is_plain).select("did", n.alias("n"), F.lit("plain").alias("form"), none.alias("prefix_chars"), none.alias("middle_chars"), F.col("text").alias("output"))

    # each of the three uses below reads text and copies, so that Spark shuffles the texts once and reuses that exchange
    cut = rows.where(~is_plain).groupBy("did", "th").agg(F.first("text").alias("text"), F.count("*").alias("copies")).where("copies > 0")
    first, second = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    requests = cut.withColumn("n", n).select("did", "th", "n", F.least(first, second).alias("before"), F.greatest(first, second).alias("upto")).alias("r")
    # the ordinals are a condition beside the key, so that both sides stay partitioned by document; no unit ends at 0.
    # Merged, never broadcast: Spark does not see how many rows the units are
    ends, same = units(cut).alias("u"), (F.col("r.did") == F.col("u.did")) & (F.col("r.th") == F.col("u.th"))
    found = requests.join(ends.hint("merge"), same & ((F.col("ordinal") == F.col("before")) | (F.col("ordinal") == F.col("upto"))), "left")
    end_at = lambda c: F.coalesce(F.max(F.when(F.col("ordinal") == F.col(c), F.col("end"))), F.lit(0)).cast("int")
    offsets = found.groupBy("r.did", "r.th").agg(F.first("n").alias("n"), end_at("before").alias("a"), end_at("upto").alias("b"))
    parts = cut.join(offsets.hint("merge"), ["did", "th"]).withColumn("form", form)
    part = lambda begin, length: F.substr("text", begin, length)
    output = assemble(F.col("form"), part(F.lit(1), F.col("a")), part(F.col("a") + 1, F.col("b") - F.col("a")), F.substr("text", F.col("b") + 1))
    done = parts.select("did", "n", "form", F.col("a").cast("long").alias("prefix_chars"), (F.col("b") - F.col("a")).cast("long").alias("middle_chars"), output.alias("output"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    out = plain.unionByName(done.drop("copy"))
    return out.select(id_or_null().alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", "output", restore(F.col("output"), F.col("form")).alias("restored"))
