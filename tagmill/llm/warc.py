"""WARC: writes pages as archives with revisit records, and reads archives back by boundary-chain verification.

Writing. Pages whose payloads (UTF-8 of the html; null: empty) are equal share one response, that of the smallest
page_id; the others become revisit records that refer to it and carry the HTTP header alone. Spark's own text writer
makes the files: a record is a row and the blank lines between records are its line separator, so any store that Spark
writes to will do and a lost task is written anew. Pages are written by classes of size, each with as many records to a
file as keep it below FILE_BYTES; only a record that is larger than that makes a larger file, alone in it.

Reading. Whatever looks like the start of a record, at the start of the file or past the blank lines that close another,
is a candidate; for each, a task emits its offset and that of the record its Content-Length leads to. Headers may be of any
length: those of two candidates never overlap, so a file is scanned once. Pointer jumping from offset 0 (every round doubles the distance that all rows
look ahead, two equi-joins on file and offset) keeps the candidates that the chain of records reaches; a magic inside a
payload isn't among them. A record that runs past the end of its file, or isn't followed by another record or the
end, is not returned and ends its chain.

Defined results: an empty table gives no record; rows with a null page_id are written, read back with a null id and
are smallest only where all ids of their payload are null; rows that repeat the smallest page_id of a payload are all
responses; a null url gives no WARC-Target-URI; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagmill.llm.common import remove, shared_path, stage, table

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Payloads below so many bytes are never revisited.
MIN_PAYLOAD = 0
#: What a file holds at most, before compression, unless a single record is larger. A reader holds a file at once.
FILE_BYTES = 64 << 20
#: Pages of the smallest class have so many bytes at most, those of each next class GROWTH times as many.
SMALL, GROWTH, CLASSES = 32 << 10, 8, 5
PAGE_URN = "urn:tagmill:page:"
MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
FIELD = re.compile(rb"\r\n([!-9;-~]+):[ \t]*([^\r\n]*)")


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: twenty bits, five hex digits, make four letters."""
    part = lambda g: F.conv(F.substring(F.sha1(payload), F.lit(1) + g * 5, F.lit(5)), 16, 10).cast("int")
    letter = lambda bits, k: F.substring(F.lit(BASE32), (F.shiftright(bits, 15 - 5 * k).bitwiseAND(F.lit(31))) + 1, F.lit(1))
    groups = F.transform(F.transform(F.sequence(F.lit(0), F.lit(7)), part), lambda bits: F.concat(*(letter(bits, k) for k in range(4))))
    return F.array_join(groups, "")


def planned(pages: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """page_id, url, html, first: first is the page_id of the response that a page revisits, null for responses."""
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    keyed = rows.withColumn("same", F.sha2(F.col("html").cast("binary"), 256))
    shared = keyed.filter(F.octet_length("html") >= min_payload).groupBy("same").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND first IS NOT NULL").select("same", "first")
    # written first: a join with a table is split by adaptive execution where one payload holds many of the pages
    shared = stage(shared, "warc-shared")
    return keyed.join(shared, "same", "left").select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("first"))


def record(page_id: Column, url: Column, html: Column, first: Column) -> Column:
    """The record's text without the two line ends that close it."""
    urn = lambda c: F.concat(F.lit(f"<{PAGE_URN}"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"\r\n{name}: "), value)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(first.isNull(), html).otherwise(F.lit("")))
    uri = F.regexp_replace(F.regexp_replace(url, "\r", "%0D"), "\n", "%0A")
    return F.concat(
        F.lit("WARC/1.1"),
        line("WARC-Type", F.when(first.isNull(), "response").otherwise("revisit")),
        line("WARC-Record-ID", urn(page_id)),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        F.when(url.isNull(), F.lit("")).otherwise(line("WARC-Target-URI", uri)),
        F.when(first.isNull(), F.lit("")).otherwise(F.concat(line("WARC-Refers-To", urn(first)), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_sha1(html.cast("binary")))),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n\r\n"),
        block,
    )


def size_class(html: Column, url: Column) -> Column:
    """0 for what has SMALL bytes at most with its header, one more for each GROWTH times as many; the last has no bound."""
    size = F.coalesce(F.octet_length(html), F.lit(0)) + F.coalesce(F.octet_length(url), F.lit(0)) + F.lit(1024)
    return sum((F.when(size > SMALL * GROWTH**k, 1).otherwise(0) for k in range(CLASSES - 1)), F.lit(0)).cast("int")


def write_archives(pages: DataFrame, path: str, min_payload: int = MIN_PAYLOAD, file_bytes: int = FILE_BYTES) -> None:
    """gzipped archives, below file_bytes each before compression unless a single record is larger."""
    text = lambda name: F.col(name).cast("string")
    there = sorted(r[0] for r in pages.select(size_class(text("html"), text("url")).alias("c")).distinct().collect())
    rows = planned(pages, min_payload).withColumn("class", size_class(F.col("html"), F.col("url")))
    for k in there or [0]:
        some = rows if len(there) < 2 else rows.filter(F.col("class") == k)
        made = some.select(record(F.col("page_id"), F.col("url"), F.col("html"), F.col("first")).alias("value"))
        most = max(1, file_bytes // (SMALL * GROWTH**k)) if k < CLASSES - 1 else 1
        made.write.mode("append").option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", most).text(path)


def unzipped(content: bytes) -> bytes:
    """Plain bytes of a file of any number of gzip members, or of a plain one."""
    out = []
    while content[:2] == b"\x1f\x8b":
        one = zlib.decompressobj(31)
        out.append(one.decompress(content))
        content = one.unused_data
    return b"".join(out) if out else content


def candidates_of(data: bytes) -> Iterator[tuple]:
    """(at, after, whole, type, record id, refers to, url, payload digest, payload bytes, payload) of all that looks like a record.

    after is where its successor would start, null at the end of the file or where no length can be read."""
    for m in MAGIC.finditer(data):
        if m.start() and data[max(0, m.start() - 4) : m.start()] != b"\r\n\r\n":
            continue  # no chain leads here
        end = data.find(b"\r\n\r\n", m.start())
        fields = {k.lower(): v.strip() for k, v in FIELD.findall(data, m.end() - 2, end)} if end >= 0 else {}
        length = fields.get(b"content-length", b"")
        if not (length.isdigit() and len(length) < 16):
            yield (m.start(), None, False, None, None, None, None, None, None, None)
            continue
        after = end + 8 + int(length)
        whole = data[after - 4 : after] == b"\r\n\r\n" and (after == len(data) or MAGIC.match(data, after) is not None)
        kind, told = (fields.get(k, b"").decode("utf-8", "replace") for k in (b"warc-type", b"warc-payload-digest"))
        digest, size, payload = told.removeprefix("sha1:") or None, None, None
        if whole:
            block = data[end + 4 : after - 4]
            head = block.find(b"\r\n\r\n") if block.startswith(b"HTTP/") else -4
            if kind == "revisit":
                sent = re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d{1,15})", block[: head + 2])
                size = int(sent[1]) if sent else None
            else:
                payload = block[head + 4 :]
                size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        text = lambda k: fields[k].decode("utf-8", "replace") if k in fields else None  # noqa: E731, B023
        yield (m.start(), None if after >= len(data) else after, whole, kind or None, text(b"warc-record-id"), text(b"warc-refers-to"), text(b"warc-target-uri"), digest, size, payload)


def candidates(spark, path: str, payloads: bool = False) -> DataFrame:
    """A row per candidate of each file under path; the chain of a file is judged later, over all rows."""
    schema = "file string, at long, after long, whole boolean, record_type string, record_id string, refers_to string, url string, payload_digest string, payload_bytes long, payload binary"
    types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), *[pa.string()] * 5, pa.int64(), pa.binary()]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1), strict=True):
                rows, held = [], 0
                for row in candidates_of(unzipped(content.as_py())):
                    rows.append((file.as_py(), *(row if payloads else row[:-1] + (None,))))
                    held += 1000 + len(row[6] or "") + (len(row[-1] or b"") if payloads else 0)
                    if held > 16 << 20:
                        yield made(rows)
                        rows, held = [], 0
                yield made(rows)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    found = files.mapInArrow(run, schema)
    return found if payloads else found.drop("payload")


def reachable(links: DataFrame) -> DataFrame:
    """file, at of the links (file, at, after) that the chain from offset 0 of each file reaches.

    Pointer jumping: after round k, seen holds all within 2^k steps of the start, and after of jump is 2^k steps ahead. Every
    round is written: each of the two tables is made from both."""
    most = links.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    jump, seen = links.select("file", "at", "after"), links.filter("at = 0").select("file", "at")
    rounds = max(0, most - 1).bit_length()
    for k in range(rounds):
        ahead = seen.join(jump.filter("after IS NOT NULL"), ["file", "at"]).select("file", F.col("after").alias("at"))
        there = jump.select("file", F.col("at").alias("after"), F.col("after").alias("beyond"))
        further = jump.filter("after IS NOT NULL").join(there, ["file", "after"]).select("file", "at", F.col("beyond").alias("after"))
        seen = stage(seen.union(ahead), "warc-seen")
        if k + 1 < rounds:
            jump = stage(further, "warc-jump")
    return seen


def read_archives(spark, path: str, payloads: bool = False) -> DataFrame:
    """The verified records under path; payloads adds the payload itself (of responses)."""
    found = stage(candidates(spark, path, payloads), "warc-candidates")
    # a successor that can't be read ends the chain: nothing after it is reached
    seen = reachable(found.select("file", "at", F.when(F.col("whole"), F.col("after")).alias("after")))
    return found.filter("whole").join(seen, ["file", "at"]).drop("whole", "after")


def op4_warc_archive(spark, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    page = lambda c: F.regexp_extract(c, rf"^<{PAGE_URN}(-?\d+)>$", 1).try_cast("long")
    found = read_archives(spark, path)
    remove(spark, path)
    return found.select(page(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.when(F.col("record_type") == "revisit", page(F.col("refers_to"))).alias("refers_to"))


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p GROUP BY html),
h AS (SELECT page_id, strlen(html) AS n, sha1(html) AS h, first FROM p JOIN f USING (html)),
b AS (SELECT *, list_transform(range(0, 8), lambda g: CAST('0x' || substr(h, CAST(5 * g + 1 AS INTEGER), 5) AS INTEGER)) AS bits FROM h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((bits[CAST(k // 4 + 1 AS INTEGER)] >> CAST(15 - 5 * (k % 4) AS INTEGER)) & 31) + 1 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM b
"""
