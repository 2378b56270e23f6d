"""WARC archives: writing captures, reading records, assembling transactions.

A capture is written as three records: its request, its response (or a revisit
of an equal payload captured elsewhere) and its metadata; the first and the last
name the response in ``WARC-Concurrent-To``.  Archives are Spark text folders
whose line separator is the blank line that ends a WARC record, so executors
write them through the cluster's file system, in gzip.  Reading takes whole
archive files and walks them by ``Content-Length``; a payload may hold anything.
"""

import gzip
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from radloom.functions.joins import join_side
from radloom.llm.common import stored

CRLF = "\r\n"
BLANK = CRLF + CRLF
#: Payloads below this many bytes are always written in full.
REVISIT_BYTES = 1000

RECORD = "record_id string, type string, concurrent_to string, refers_to string, uri string, date string, digest string, block binary"


def _id(kind: str, page: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(kind), F.coalesce(page.cast("string"), F.lit("")), digest).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4),
                    F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def _record(kind: str, record_id: Column, fields: list[tuple[str, Column]], media: str, block: Column) -> Column:
    """One record as text, without the blank line that follows it; fields with a null value are left out."""
    head = [F.lit(f"WARC/1.1{CRLF}WARC-Type: {kind}{CRLF}WARC-Record-ID: "), record_id,
            *[F.coalesce(F.concat(F.lit(f"{CRLF}{name}: "), value), F.lit("")) for name, value in fields],
            F.lit(f"{CRLF}Content-Type: {media}{CRLF}Content-Length: "), F.octet_length(block).cast("string")]
    return F.concat(*head, F.lit(BLANK), block)


def deduplicated(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """key, url, body, digest (SHA-1, hex) and ``original``: the key of the capture that a revisit refers to, else null.

    Of equal payloads of at least ``least`` bytes the one with the largest key is
    the original.  Rows that repeat its key and payload are originals too, and so are all if every key is null.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), body.alias("body"), F.sha1(body.cast("binary")).alias("digest"))
    large = F.octet_length("body") >= least
    # Written first, so that Spark knows the size of this side when it plans how the pages meet it.
    first = stored(rows.where(large).groupBy("digest").agg(F.max("key").alias("original"), F.count("*").alias("n"))
                   .where("n > 1").select(F.col("digest").alias("of"), "original"), "originals")
    met = rows.join(join_side(first, "of"), F.col("digest") == F.col("of"), "left")
    same = F.col("original").isNull() | F.col("original").eqNullSafe(F.col("key"))
    return met.select("key", "url", "body", "digest", F.when(~same, F.col("original")).alias("original"))


def write_archives(captures: DataFrame, folder: str, date: str = "2020-01-01T00:00:00Z", archive_bytes: int = 64 << 20) -> None:
    """Write the rows of :func:`deduplicated` as archives in a new folder of the cluster's file system.

    An archive holds as many captures as come to about ``archive_bytes`` at the
    mean size of their bodies, since a reader takes a whole archive at a time.
    """
    mean = captures.agg(F.avg(F.octet_length("body"))).first()[0] or 0
    records_per_file = max(1, int(archive_bytes / (mean + 2_000)))
    url = F.coalesce(F.regexp_replace("url", "[\\r\\n]", ""), F.lit("urn:absent"))
    own = lambda kind: _id(kind, F.col("key"), F.col("digest"))
    main = F.when(F.col("original").isNull(), own("response")).otherwise(own("revisit"))
    common = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", url)]
    digest = [("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest"))]
    status = F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{BLANK}")
    response = _record("response", main, common + digest, "application/http; msgtype=response", F.concat(status, "body"))
    revisit = _record("revisit", main, [
        *common, *digest, ("WARC-Refers-To", _id("response", F.col("original"), F.col("digest"))),
        ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))], "application/http; msgtype=response", status)
    beside = [*common, ("WARC-Concurrent-To", main)]
    request = _record("request", own("request"), beside, "application/http; msgtype=request",
                      F.concat(F.lit("GET "), url, F.lit(f" HTTP/1.1{BLANK}")))
    metadata = _record("metadata", own("metadata"), beside, "application/warc-fields",
                       F.concat(F.lit("fetch-status: 200"), F.coalesce(F.concat(F.lit(f"{CRLF}page-id: "), F.col("key").cast("string")), F.lit("")), F.lit(CRLF)))
    line = F.concat_ws(BLANK, request, F.when(F.col("original").isNull(), response).otherwise(revisit), metadata)
    captures.select(line.alias("value")).write.option("lineSep", BLANK).option("compression", "gzip").option(
        "maxRecordsPerFile", records_per_file).text(folder)


def parse(content: bytes) -> Iterator[tuple]:
    """Records of one archive, gzipped or not, in the order of ``RECORD``; an archive cut off ends at its last whole record."""
    data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    at = 0
    while True:
        while data[at:at + 2] == b"\r\n":
            at += 2
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or data[at:at + 5] != b"WARC/":
            return
        fields = {}
        for line in data[at:end].decode("utf-8", "replace").split(CRLF)[1:]:
            name, _, value = line.partition(":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        block = data[end + 4:end + 4 + size]
        if len(block) < size:
            return
        yield (fields.get("warc-record-id"), fields.get("warc-type"), fields.get("warc-concurrent-to"), fields.get("warc-refers-to"),
               fields.get("warc-target-uri"), fields.get("warc-date"), fields.get("warc-payload-digest"), block)
        at = end + 4 + size


def read_records(spark: SparkSession, folder: str, kinds: tuple[str, ...]) -> DataFrame:
    """The records of some kinds in a folder's archives.  A task holds one archive at a time, bounded by ``archive_bytes``."""
    columns = [c.split()[0] for c in RECORD.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                some: list[tuple] = []
                for record in parse(content):
                    if record[1] in kinds:
                        some.append(record)
                    if len(some) == 2_000:
                        yield pd.DataFrame(some, columns=columns)
                        some = []
                yield pd.DataFrame(some, columns=columns)

    return spark.read.format("binaryFile").load(folder).select("content").mapInPandas(run, RECORD)


def assemble(spark: SparkSession, folder: str) -> DataFrame:
    """One nested row per capture: uri, date, ``response`` and the ``request`` and ``metadata`` concurrent to it.

    ``response`` is a struct of record_id, type (response or revisit), digest,
    refers_to and payload (null for a revisit).  A capture without request or metadata has null there; repeated
    requests or metadata of one capture count once.
    """
    split = F.locate(BLANK, F.col("block").cast("string"))
    payload = F.substring(F.col("block"), split + len(BLANK), F.octet_length("block"))
    main = read_records(spark, folder, ("response", "revisit")).select(
        "uri", "date", F.struct("record_id", "type", F.regexp_replace("digest", "^sha1:", "").alias("digest"), "refers_to",
                                F.when(F.col("type") == "response", payload).alias("payload")).alias("response"))

    def beside(kind: str) -> DataFrame:
        return join_side(read_records(spark, folder, (kind,)).groupBy(F.col("concurrent_to").alias(f"{kind}_of")).agg(
            F.min(F.struct("record_id", "block")).alias(kind)), f"{kind}_of")

    target = F.col("response.record_id")
    return (main.join(beside("request"), target == F.col("request_of"), "left").join(beside("metadata"), target == F.col("metadata_of"), "left")
            .select("uri", "date", "response", "request", "metadata"))


def page_id(capture: str = "metadata") -> Column:
    """The key noted in a capture's metadata block."""
    return F.nullif(F.regexp_extract(F.col(f"{capture}.block").cast("string"), r"(?m)^page-id: (-?[0-9]+)\r?$", 1), F.lit("")).cast("long")


def resolved(captures: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of assembled captures; revisits take the size of the response they refer to."""
    rows = stored(captures.select(page_id().alias("page_id"), "response.record_id", F.col("response.type").alias("record_type"), "response.refers_to",
                           F.col("response.digest").alias("payload_digest"), F.octet_length("response.payload").cast("long").alias("bytes")), "captures")
    originals = rows.where("record_type = 'response'").groupBy(F.col("record_id").alias("of")).agg(
        F.min("page_id").alias("original"), F.min("bytes").alias("original_bytes"))
    met = rows.join(join_side(originals, "of"), F.col("refers_to") == F.col("of"), "left")
    return met.select("page_id", F.coalesce("bytes", "original_bytes").alias("payload_bytes"), "payload_digest", "record_type",
                      F.col("original").alias("refers_to"))
