"""WARC archives with revisit records, resolved by payload digest.

Headers (id, digest, length; no payloads) are shuffled by digest, and each digest's smallest id becomes its response.
Pages then meet the revisits among them by (id, digest), which no group of copies shares. Archives are written by Spark's
text writer, one record a row, whose separator is the record's end: so its commit protocol keeps files of failed or
repeated tasks out, and any file system that Spark writes to will do. They are read by its text reader, which streams a
file in parts that begin where a record may begin; lengths tell which parts are one record. A file has one gzip stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch

#: Payloads below this many bytes are never revisited.
LEAST = 100
#: Records of a file at most.
RECORDS = 4096
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BEGIN, _END = "WARC/1.1\r\n", "\r\n\r\n"


def _record_id(page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat(F.lit("page:"), page_id.cast("string"), F.lit(":"), digest))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-"), part(13, 4), F.lit("-"), part(17, 4), F.lit("-"), part(21, 12), F.lit(">"))


def resolve(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """pages(page_id, url, html) with payload, payload_bytes, payload_digest, record_type and refers_to.

    Of equal payloads of ``least`` bytes or more, the one with the smallest page_id is the response; repeated rows with
    that page_id are responses too. Null html: an empty payload. Rows with a null page_id are responses and are never
    referred to. Extra columns are dropped.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    headers = rows.where((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull()).groupBy("payload_digest", "page_id").agg(F.lit(1).alias("one"))
    first = headers.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = headers.join(first, "payload_digest").where("refers_to < page_id").select("page_id", "payload_digest", "refers_to")
    return rows.join(revisits, ["page_id", "payload_digest"], "left").select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(F.col("refers_to").isNotNull(), "revisit").otherwise("response").alias("record_type"), "refers_to",
    )


def write(resolved: DataFrame, path: str, records: int = RECORDS) -> None:
    """Write the archives as gzip files of WARC/1.1 records; revisits have fresh headers and no payload. A record's id
    follows from its page_id and payload (rows equal in both share it); without a page_id it is a random one."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    revisit = F.col("record_type") == "revisit"
    uri = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    record = F.concat(
        F.lit(_BEGIN),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.coalesce(_record_id(F.col("page_id"), F.col("payload_digest")), F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        line("Page-ID", F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _record_id(F.col("refers_to"), F.col("payload_digest"))), line("Refers-To-Page-ID", F.col("refers_to").cast("string")))).otherwise(""),
        F.lit("Content-Type: text/html; charset=utf-8\r\n"),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
        F.lit("\r\n"),
        F.when(revisit, F.lit("")).otherwise(F.col("payload")),
    )
    resolved.select(record.alias("value")).write.mode("overwrite").option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", records).text(path)


def parse(parts: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, payload) of each record of archives that come in parts: one after another, cut wherever a record's end
    is followed by ``WARC/1.1``. Lengths, not separators, tell where a record ends."""
    begin, end = _BEGIN.encode(), _END.encode()
    parts = iter(parts)
    for part in parts:
        data = part.removeprefix(begin)  # the first record of a file keeps it
        head = data.find(end)
        while head < 0:
            data += end + begin + next(parts, b"")
            head = data.find(end)
        headers = dict(x.split(": ", 1) for x in data[:head].decode().split("\r\n"))
        size = head + 4 + int(headers["Content-Length"])
        pieces, n = [data], len(data)
        while n < size:
            more = next(parts, None)
            if more is None:
                raise ValueError(f"record {headers.get('WARC-Record-ID')} ends too early")
            pieces += [end, begin, more]
            n += len(end) + len(begin) + len(more)
        data = b"".join(pieces)
        if data[size:] not in (b"", end):  # the last record of a file keeps its end
            raise ValueError(f"record {headers.get('WARC-Record-ID')} does not end where its length says")
        yield headers, data[head + 4 : size]


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record_type, refers_to, payload_bytes, payload_digest) of each record in the archives at a path.

    Lengths and digests of responses are taken from the payloads read (a digest that differs from its header raises);
    those of revisits come from the response that they refer to. A worker holds one record at a time.
    """
    parts = spark.read.option("pathGlobFilter", "*.gz").option("lineSep", _END + _BEGIN).text(path).select("value")

    def run(batches):
        rows = []
        for h, payload in parse(x.as_buffer().to_pybytes() for batch in batches for x in batch["value"]):
            digest = h["WARC-Payload-Digest"].removeprefix("sha256:")
            response = h["WARC-Type"] == "response"
            if response and hashlib.sha256(payload).hexdigest() != digest:
                raise ValueError(f"payload of {h['WARC-Record-ID']} does not match its digest")
            rows.append((int(h["Page-ID"]) if h["Page-ID"] else None, h["WARC-Type"], None if response else int(h["Refers-To-Page-ID"]), len(payload) if response else None, digest))
            if len(rows) == 4096:
                yield batch_of(rows)
                rows = []
        if rows:
            yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)
        return pa.record_batch([pa.array(x, kind) for x, kind in columns], ["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest"])

    return parts.mapInArrow(run, "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string")


def resolved_lengths(records: DataFrame) -> DataFrame:
    """Records as ``read`` gives them, revisits with the length of the response that they refer to: that of the page and
    the digest, for a repeated page_id may have responses with several payloads."""
    key = ["page_id", "payload_digest"]
    responses = records.where("record_type = 'response' and page_id is not null").groupBy(*key).agg(F.max("payload_bytes").alias("found"))
    responses = responses.withColumnRenamed("page_id", "refers_to")
    joined = records.where("record_type = 'revisit'").join(responses, ["refers_to", "payload_digest"], "left")
    revisits = joined.select("page_id", F.coalesce("payload_bytes", "found").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    return records.where("record_type = 'response'").select(revisits.columns).unionByName(revisits)


def round_trip(pages: DataFrame, least: int = LEAST, keep_archives: bool = True) -> DataFrame:
    """Write the pages' archives to the shared folder, read them back: a row per page."""
    scratch = Scratch(pages.sparkSession, "warc")
    write(resolve(pages, least), f"{scratch.root}/archives")
    records = scratch.write(read(pages.sparkSession, f"{scratch.root}/archives"), "records")
    if not keep_archives:
        scratch.drop("archives")
    return resolved_lengths(records)
