"""WARC archives with revisit records in place of repeated payloads.

Only headers (page id, digest, size) are shuffled to find repeated payloads: one record per digest stays a
response, the others become revisits that refer to it. Archives are written by Spark's text writer, each
record ended by the two line breaks that the format asks for, and read back by Content-Length. A revisit's
size is joined from the response it refers to.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierline.llm.common import byte_count, small_batches
from tierline.sources.sink import fresh_path

#: The base32 alphabet, and the profile of revisits of an identical payload.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n"
#: Rows in an archive file: a task reads a file as a whole.
ROWS_PER_FILE = 1000


def base32_sha1(text: Column) -> Column:
    """Upper-case base32 of the SHA-1 of the UTF-8 text: 40 hexadecimal digits, five at a time, are 32 letters."""
    digest = F.sha1(text.cast("binary"))
    letters = []
    for at in range(0, 40, 5):
        bits = F.conv(F.substring(digest, at + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            index = F.shiftright(bits, shift).bitwiseAND(31) + 1
            letters.append(F.lit(BASE32).substr(index, F.lit(1)))
    return F.concat(*letters)


def resolve(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """`pages` (page_id, url, html) with payload, payload_bytes, payload_digest, original.

    `original` is the page_id whose record is the response, null for a row that is a response itself. Of equal
    payloads of at least `least_bytes` bytes the largest page_id is the response; rows that repeat it are
    responses too, and so are rows without page_id if no equal one has any. A null html is an empty payload.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"),
    )
    headers = rows.select(
        "page_id", byte_count(F.col("payload")).alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest")
    )
    latest = (
        headers.where(F.col("payload_bytes") >= least_bytes)
        .groupBy("payload_digest")
        .agg(F.max("page_id").alias("latest"), F.count("*").alias("equal"))
        .where("equal > 1 and latest is not null")
        .select("payload_digest", "latest")
    )
    return (
        rows.withColumn("payload_digest", base32_sha1(F.col("payload")))
        .withColumn("payload_bytes", byte_count(F.col("payload")))
        .join(latest, "payload_digest", "left")
        .withColumn("original", F.when(F.coalesce(F.col("page_id") != F.col("latest"), F.col("latest").isNotNull()), F.col("latest")))
        .drop("latest")
    )


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def _line(name: str, value: Column | str) -> Column:
    return F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value, F.lit(END))


def records(resolved: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """One text per record, without the two line breaks after it."""
    revisit = F.col("original").isNotNull()
    # line breaks cannot stand in a header
    target = F.regexp_replace("url", r"[\x00-\x20\x7F]", "")
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{END}"),
        _line("Content-Type", "text/html; charset=utf-8"),
        _line("Content-Length", F.col("payload_bytes").cast("string")),
        F.lit(END),
    )
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    head = F.concat(
        F.lit(f"WARC/1.1{END}"),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", _urn(F.col("page_id"))),
        _line("WARC-Date", date),
        _line("WARC-Target-URI", target),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(
            revisit, F.concat(_line("WARC-Profile", PROFILE), _line("WARC-Refers-To", _urn(F.col("original"))))
        ).otherwise(F.lit("")),
        _line("Content-Type", "application/http; msgtype=response"),
        _line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(END),
    )
    return resolved.select(F.concat(head, block).alias("value"))


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Gzipped archives of all pages in the folder `path`."""
    (
        records(resolve(pages, least_bytes))
        .write.option("lineSep", END + END)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", ROWS_PER_FILE)
        .text(path)
    )


def parse(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the records of an archive. Content-Length decides where a block ends."""
    at = 0
    while at < len(raw):
        stop = raw.index(b"\r\n\r\n", at)
        first, *lines = raw[at:stop].decode().split(END)
        if first != "WARC/1.1":
            raise ValueError(f"not a record at byte {at}")
        head = dict(line.split(": ", 1) for line in lines)
        start = stop + 4
        end = start + int(head["Content-Length"])
        if raw[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} does not end where its length says")
        yield head, raw[start:end]
        at = end + 4


def _number(urn: str | None) -> int | None:
    text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text not in ("", "none") else None


_FIELDS = {
    "page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "payload_digest": pa.string(), "refers_to": pa.int64(),
    "own_bytes": pa.int64(), "own_digest": pa.string(), "payload": pa.binary(),
}


def _read(with_payload: bool):
    names = [n for n in _FIELDS if with_payload or n != "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                raw = content.as_buffer().to_pybytes()
                raw = zlib.decompress(raw, wbits=31) if path.endswith(".gz") and raw else raw
                rows = []
                for head, block in parse(raw):
                    body = block[block.index(b"\r\n\r\n") + 4 :]
                    own = head["WARC-Type"] == "response"
                    digest = base64.b32encode(hashlib.sha1(body).digest()).decode() if own else None
                    rows.append(
                        (
                            _number(head["WARC-Record-ID"]), head["WARC-Target-URI"], head["WARC-Type"],
                            head["WARC-Payload-Digest"].removeprefix("sha1:"), _number(head.get("WARC-Refers-To")),
                            len(body) if own else None, digest, body,
                        )[: len(names)]
                    )
                columns = zip(*rows) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, _FIELDS[n]) for n, c in zip(names, columns)], names=names
                )

    return run


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """page_id, url, record_type, payload_digest, refers_to, own_bytes, own_digest of each record below `path`
    (and payload); the last ones are computed from the payload of a response and null for a revisit."""
    small_batches(spark, 4)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    schema = "page_id long, url string, record_type string, payload_digest string, refers_to long, own_bytes long, own_digest string"
    return files.mapInArrow(_read(with_payload), schema + (", payload binary" if with_payload else ""))


def archived(pages: DataFrame, least_bytes: int = 0, path: str | None = None) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to as found in the archives of `pages`
    (page_id, url, html), which are written to `path` (default: the shared folder).

    Bytes and digest of a response come from its payload, those of a revisit from the response it refers
    to. A null or empty html is an empty payload; a null url is written as an empty one. Rows that repeat a
    page_id are records of their own. No pages give no rows.
    """
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    write_archives(pages, path, least_bytes)
    found = read_archives(spark, path)
    originals = (
        found.where("record_type = 'response'")
        .groupBy(F.col("page_id").alias("refers_to"), F.col("own_digest").alias("payload_digest"))
        .agg(F.max("own_bytes").alias("original_bytes"))
    )
    return found.join(originals, ["refers_to", "payload_digest"], "left").select(
        "page_id",
        F.coalesce("own_bytes", "original_bytes").alias("payload_bytes"),
        F.coalesce("own_digest", "payload_digest").alias("payload_digest"),
        "record_type",
        "refers_to",
    )
