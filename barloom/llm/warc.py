"""A content-addressed WARC archive.

An archive is two tables: ``heads`` keeps the exact head of every record (WARC fields and, after a
blank line, the HTTP head) with the digest of its payload; ``payloads`` keeps the bytes of each
different payload once, under its SHA-256. A record is put together again by joining the two. Of
records with equal payloads the one with the smallest id is a response and the others revisit it,
if the payload has at least ``REVISIT_BYTES``; shorter payloads are all responses. ``write_warc``
makes plain WARC files of the two tables, ``read_warc`` reads such files.

Null html is an empty payload; a null url leaves its field out, and characters that would end a
field are percent-encoded; rows with a null id come after all others and write an empty id; rows
that repeat an id are separate records; an empty table makes two empty tables; other columns are
not read, whatever their names. A task that writes holds a page. A file has the payloads
of one bucket by digest, about ``FILE_BYTES`` before compression, or one larger page; a task that reads holds a file's compressed bytes
and some chunks of a MB of what they hold, however large a record is: payloads are hashed as they pass.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import shared_path, small_batches, table, written
from barloom.llm.textblock import tidied

REVISIT_BYTES = 100
#: Payload of a bucket, which makes a file or more: there are as many buckets as that takes, as far as Spark writes so many (``spark.sql.sources.bucketing.maxBuckets``).
FILE_BYTES, MOST_BUCKETS = 64 << 20, 100_000
URN = "urn:x-page:"
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_of(payload: Column) -> Column:
    return F.sha2(payload.cast("binary"), 256)


def _line(name: str, value: Column) -> Column:
    """A head's field; none if the value is null."""
    safe = value
    for char, code in (("\r", "%0D"), ("\n", "%0A")):
        safe = F.replace(safe, F.lit(char), F.lit(code))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit(CRLF)), F.lit(""))


def planned(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Every page with its digest, size, and the id that holds its payload (``first``)."""
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), digest_of(body).alias("digest"), F.octet_length(body).cast("long").alias("size"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "file", "row")
    first = rows.groupBy("digest").agg(F.min(order).alias("first"))
    return rows.join(first, "digest")


def heads(plan: DataFrame, date: str) -> DataFrame:
    """``id, digest, size, head`` of each record."""
    holds = (F.col("file") == F.col("first.file")) & (F.col("row") == F.col("first.row"))
    revisit = (F.col("size") >= REVISIT_BYTES) & ~holds
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("size").cast("string"), F.lit(CRLF * 2))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("size"))
    name = lambda x: F.concat(F.lit(f"<{URN}"), F.coalesce(x.cast("string"), F.lit("")), F.lit(">"))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", name(F.col("id"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _line("WARC-Refers-To", F.when(revisit, name(F.col("first.id")))),
        _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", length.cast("string")),
        F.lit(CRLF),
        http,
    )
    return plan.select("id", "digest", "size", head.alias("head"))


PAYLOADS = "digest string, payload binary"


def write_archive(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", key: str = "page_id", url: str = "url", html: str = "html") -> str:
    """Writes ``heads`` and ``payloads`` below ``path`` for ``pages``, a table read straight from files.

    Equal payloads are dropped where they are read, before the one shuffle of payloads, so a payload
    that very many pages share is no load for a task. They are written in buckets by digest, which a
    join on the digest reads as they are; returns the name of that table in the session's catalog.
    """
    spark = pages.sparkSession
    planned(pages, key, url, html).write.parquet(f"{path}/plan")
    heads(spark.read.parquet(f"{path}/plan"), date).write.option("compression", "zstd").parquet(f"{path}/heads")
    body = F.coalesce(F.col(html), F.lit(""))
    once = pages.select(digest_of(body).alias("digest"), body.cast("binary").alias("payload")).dropDuplicates(["digest"])
    name = f"warc_payloads_{uuid.uuid4().hex}"
    size = spark.read.parquet(f"{path}/plan").agg(F.sum("size")).first()[0] or 0  # of copies too: a bucket, and so a file, has fewer bytes
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    try:
        once.write.option("compression", "zstd").option("path", f"{path}/payloads").bucketBy(min(buckets, MOST_BUCKETS), "digest").sortBy("digest").saveAsTable(name)
    except BaseException:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        raise
    return name


def records(spark: SparkSession, path: str) -> DataFrame:
    """``id, head, payload, verified`` of each record, put together by a join on the digest.

    Revisits come with the payload that they refer to. ``verified``: the stored bytes have the
    digest under which they are stored.
    """
    stored = spark.read.schema(PAYLOADS).parquet(f"{path}/payloads").withColumn("verified", digest_of(F.col("payload")) == F.col("digest"))
    return spark.read.parquet(f"{path}/heads").join(stored, "digest")


def field(name: str, head: str = "head") -> Column:
    """A WARC field of a record's head; null if it has none."""
    got = F.regexp_extract(F.col(head), rf"\r\n{name}: ([^\r\n]*)", 1)
    return F.when(got != "", got)


def write_warc(spark: SparkSession, path: str, out: str, per_file: int = 10_000, payloads: str | None = None) -> None:
    """``payloads`` names the bucketed table, if the session has it. The archive as compressed WARC files, a record for each head; revisits have no payload, so only responses meet theirs. The text sink ends every record with the two line ends that WARC asks for. Bytes that don't have the digest under which they are stored are an error."""
    own = spark.read.parquet(f"{path}/heads")
    revisit = field("WARC-Type") == "revisit"
    plain = spark.read.schema(PAYLOADS).parquet(f"{path}/payloads")
    long = F.col("size") >= REVISIT_BYTES
    checked = F.when(digest_of(F.col("payload")) == F.col("digest"), F.col("payload").cast("string")).otherwise(F.raise_error(F.concat(F.lit("a record's head and payload don't agree: "), "digest")))
    # a long payload has one response; a short one may have very many, which adaptive execution splits where both sides are shuffled
    pairs = [own.filter(long & ~revisit).join(spark.table(payloads) if payloads else plain, "digest", "left"), own.filter(~long).join(plain.filter(F.octet_length("payload") < 2 * REVISIT_BYTES), "digest", "left")]
    both = own.filter(revisit).select(F.col("head").alias("value"))
    for met in pairs:
        both = both.unionByName(met.select(F.concat("head", checked).alias("value")))
    both.write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", per_file).option("compression", "gzip").text(out)


def warc_records(chunks: Iterator[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """Head and block of each record of a file, by the lengths that the heads say."""
    held, gap = bytearray(), CRLF.encode() * 2
    for chunk in chunks:
        held += chunk
        while (end := held.find(gap)) >= 0:
            head = bytes(held[: end + 4])
            length = re.search(rb"\r\nContent-Length: (\d+)\r\n", head)
            if not head.startswith(b"WARC/1.1\r\n") or not length:
                raise ValueError("a record's head and payload don't agree: no WARC head where one should be")
            past = end + 4 + int(length[1])
            if len(held) < past + 4:
                break
            if held[past : past + 4] != gap:
                raise ValueError("a record's head and payload don't agree: no line ends after a block")
            yield head, bytes(held[end + 4 : past])
            del held[: past + 4]
    if held:
        raise ValueError("a record's head and payload don't agree: the file ends within a record")


#: A head, and the HTTP head that follows it, have fewer bytes.
HEAD_BYTES = 1 << 20


@dataclass
class Scanned:
    """A record without its payload: what its heads say, and the payload's size and SHA-256."""

    head: bytes
    http: bytes
    size: int
    digest: str


def scanned(chunks: Iterator[bytes]) -> Iterator[Scanned]:
    """The records of a file, of which some chunks are held at a time, however large a record is."""
    gap, held, wrong = CRLF.encode() * 2, bytearray(), "a record's head and payload don't agree: "

    def more() -> bool:
        chunk = next(chunks, None)
        if chunk is not None:
            held.extend(chunk)
        return chunk is not None

    def up_to_gap(most: int, what: str) -> bytes:
        seen = 0
        while (end := held.find(gap, seen)) < 0:
            seen = max(0, len(held) - 3)
            if len(held) > most or not more():
                raise ValueError(wrong + what)
        found = bytes(held[: end + 4])
        del held[: end + 4]
        return found

    while held or more():
        if not held:
            continue
        head = up_to_gap(HEAD_BYTES, "no WARC head where one should be")
        length = re.search(rb"\r\nContent-Length: (\d+)\r\n", head)
        if not head.startswith(b"WARC/1.1\r\n") or not length:
            raise ValueError(wrong + "no WARC head where one should be")
        http = up_to_gap(HEAD_BYTES, "the file ends within a record")
        left, digest = int(length[1]) - len(http), hashlib.sha256()
        if left < 0:
            raise ValueError(wrong + "a block is shorter than its HTTP head")
        size = left
        while left:
            if not held and not more():
                raise ValueError(wrong + "the file ends within a record")
            some = held[:left]
            digest.update(some)
            left -= len(some)
            del held[: len(some)]
        while len(held) < 4 and more():
            pass
        if held[:4] != gap:
            raise ValueError(wrong + "no line ends after a block")
        del held[:4]
        yield Scanned(head, http, size, digest.hexdigest())


def _inflated(raw: bytes | memoryview, step: int = 1 << 16, most: int = 1 << 20) -> Iterator[bytes]:
    """What a file of gzip members holds, ``most`` bytes at a time, however well it was compressed."""
    view, reader = memoryview(raw), zlib.decompressobj(31)
    for k in range(0, len(view), step):
        rest: bytes | memoryview = view[k : k + step]
        while len(rest):
            if reader.eof:
                reader = zlib.decompressobj(31)
            if out := reader.decompress(rest, most):
                yield out
            rest = reader.unused_data if reader.eof else reader.unconsumed_tail
        while not reader.eof and (out := reader.decompress(b"", most)):
            yield out
    if len(view) and not reader.eof:
        raise ValueError("a record's head and payload don't agree: the file ends within its compressed bytes")


READ = "page_id long, record_type string, refers_to long, digest string, says long, payload_bytes long, payload_digest string"


def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the records of some files say, and size and digest of the payloads that they hold."""
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
    number = re.compile(rf"<{URN}(-?\d+)>")

    def rows(raw: bytes) -> Iterator[tuple]:
        for record in scanned(_inflated(raw)):
            said = dict(line.split(": ", 1) for line in record.head.decode().split(CRLF)[1:] if line)
            page, to = (number.fullmatch(said.get(f, "")) for f in ("WARC-Record-ID", "WARC-Refers-To"))
            says = re.search(rb"\r\nContent-Length: (\d+)", record.http)
            own = (None, None) if said["WARC-Type"] == "revisit" else (record.size, record.digest)
            yield (page and int(page[1]), said["WARC-Type"], to and int(to[1]), said["WARC-Payload-Digest"].removeprefix("sha256:"), says and int(says[1]), *own)

    for batch in batches:
        for k in range(batch.num_rows):
            found = rows(memoryview(batch.column(0)[k].as_buffer()))
            while some := list(islice(found, 4096)):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*some, strict=True), kinds, strict=True)], names=[x.split()[0] for x in READ.split(", ")])


def read_warc(spark: SparkSession, out: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every record of the WARC files in ``out``.

    Size and digest of a response are taken from its bytes and those of a revisit from the response
    that it refers to, found by a join on the digest. Where these aren't what a head says, an error
    is raised when read.
    """
    small_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(out)
    said = written(files.select("content").mapInArrow(tidied(parsed), READ), "warc-read")
    wrong = F.raise_error(F.concat(F.lit("a record's head and payload don't agree: "), "digest")).cast("long")
    whole = said.filter("record_type = 'response'")
    good = (F.col("payload_digest") == F.col("digest")) & (F.col("payload_bytes") == F.col("says"))
    responses = whole.select("page_id", F.when(good, F.col("payload_bytes")).otherwise(wrong).alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    held = whole.filter(F.col("payload_bytes") >= REVISIT_BYTES).select(F.col("payload_digest").alias("digest"), F.col("page_id").alias("_holder"), F.col("payload_bytes").alias("_bytes"))
    same = F.col("_holder").eqNullSafe(F.col("refers_to")) & (F.col("_bytes") == F.col("says"))
    revisits = said.filter("record_type = 'revisit'").drop("payload_bytes", "payload_digest").join(held, "digest", "left")
    return responses.unionByName(revisits.select("page_id", F.when(same, F.col("_bytes")).otherwise(wrong).alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to"))


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """What each record says, with size and digest taken from the payload's bytes.

    An error is raised when read where stored bytes don't have the digest under which they are
    stored, or a head's digest or lengths aren't those of its payload.
    """
    page = lambda name: F.regexp_extract(field(name), rf"<{URN}(-?\d+)>", 1)
    number = lambda x: F.when(x != "", x).cast("long")
    size = F.octet_length("payload").cast("long")
    http = F.substring_index("head", CRLF * 2, -2)  # what stands between the head's blank line and its last one
    block = F.octet_length(http) + F.when(field("WARC-Type") == "revisit", 0).otherwise(size)
    right = F.col("verified") & (field("WARC-Payload-Digest") == F.concat(F.lit("sha256:"), "digest")) & (field("Content-Length").cast("long") == block) & (F.regexp_extract(http, r"\r\nContent-Length: (\d+)\r\n", 1) == size.cast("string"))
    return records(spark, path).select(
        F.col("id").alias("page_id"),
        F.when(right, size).otherwise(F.raise_error(F.concat(F.lit("a record's head and payload don't agree: "), "digest")).cast("long")).alias("payload_bytes"),
        digest_of(F.col("payload")).alias("payload_digest"),
        field("WARC-Type").alias("record_type"),
        number(page("WARC-Refers-To")).alias("refers_to"),
    )


def op2_warc_archive(spark, sf_dir) -> DataFrame:
    path = shared_path(spark, "warc")
    payloads = write_archive(table(spark, sf_dir, "pages"), path)
    try:
        write_warc(spark, path, f"{path}/warc", payloads=payloads)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {payloads}")  # the catalog's entry; the files stay
    return read_warc(spark, f"{path}/warc")


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
q AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM q GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id <> first_id THEN first_id END AS refers_to
FROM q JOIN f USING (payload_digest)
"""
