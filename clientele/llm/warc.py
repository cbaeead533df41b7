"""WARC archives: write pages as segmented, chunked records; read them back by segment reassembly.

Writing is one Spark text write whose line separator is the blank lines that
end a WARC record.  A response's block is an HTTP message with chunked
transfer framing; a block over ``segment_bytes`` becomes a first record
(WARC-Segment-Number 1) and continuation records that name its record id as
WARC-Segment-Origin-ID, the last with WARC-Segment-Total-Length.  Of pages with
equal payloads of ``revisit_bytes`` or more only the one with the largest id is
stored; the others are revisit records that refer to it.

Reading parses each archive file in its own task (files are rotated by number
of records, so their size is bounded), groups segments by origin, orders them
by number, checks that none is missing and that their lengths add up to the
total, and takes the chunk framing off.  Whole records never leave their task.

Skew: equal payloads meet only as (digest, largest id) aggregates, which are
joined back by broadcast if counted to be small and by an adaptive join
otherwise; a payload's segments are its own group, no larger than the payload.

Defined results: a null payload is empty; pages that repeat an id, or have
none, are records of their own; control characters in a URL are
percent-encoded and a null URL is empty; an empty table gives an empty
archive; a record with missing segments, a wrong length, a broken chunk or a
wrong digest is returned with ``valid`` false and a null payload; an archive
that is cut short or whose framing is broken gives the records before the
break and one row of type ``broken`` with the reason; very long payloads are
cut into segments and joined again; other columns are ignored.
"""
from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import if_small

SEGMENT_BYTES = 32 << 10
CHUNK_BYTES = 8 << 10
REVISIT_BYTES = 1000
RECORDS_PER_FILE = 1024
_CRLF, _END = "\r\n", "\r\n\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
# Fixed value: the date every record carries (the pages have none).
_DATE = "2020-01-01T00:00:00Z"


def _text(data) -> F.col:
    """Bytes as they are, in a string column."""
    return data.cast("string")


def _cuts(n, size):
    """0-based numbers of the parts of ``size`` bytes that ``n`` bytes need (one at least)."""
    return F.sequence(F.lit(0), F.greatest(F.ceil(n / size) - 1, F.lit(0)).cast("int"))


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
          segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES, revisit_bytes: int = REVISIT_BYTES) -> None:
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("n", F.octet_length("payload").cast("long")).withColumn("sha1", F.sha1("payload")).withColumn(
        "check", F.xxhash64("payload"))
    shared = rows.where((F.col("n") >= revisit_bytes) & F.col("id").isNotNull()).groupBy("n", "sha1", "check").agg(
        F.max("id").alias("origin"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    repeated = rows.where("id is not null").groupBy("id").count().where("count > 1").select("id", F.lit(True).alias("again"))
    rows = rows.join(if_small(shared), ["n", "sha1", "check"], "left").join(if_small(repeated), "id", "left")
    revisit = F.col("origin").isNotNull() & ~F.col("id").eqNullSafe(F.col("origin"))
    own = F.coalesce(F.col("id").cast("string"), F.lit("none"))
    alone = F.col("id").isNotNull() & F.col("again").isNull()
    record_id = F.concat(F.lit("<urn:page:"), own, F.when(alone, "").otherwise(
        F.concat(F.lit(":"), F.monotonically_increasing_id().cast("string"))), F.lit(">"))
    uri = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A"), r"[\x00-\x20\x7F]", "%20")
    rows = rows.select("*", record_id.alias("record_id"), uri.alias("uri"), revisit.alias("revisit"))

    size = F.lit(chunk_bytes)
    chunks = F.transform(_cuts(F.col("n"), size), lambda i: F.concat(
        F.lower(F.hex(F.least(size, F.col("n") - i * size))), F.lit(_CRLF),
        _text(F.substring("payload", i * size + 1, size)), F.lit(_CRLF)))
    body = F.when(F.col("n") == 0, "").otherwise(F.array_join(chunks, ""))
    block = F.concat(F.lit(_HTTP), F.when(F.col("revisit"), "").otherwise(F.concat(body, F.lit("0" + _END))))
    whole = rows.select("id", "n", "sha1", "record_id", "uri", "origin", "revisit", block.cast("binary").alias("block"))
    total = F.octet_length("block")
    parts = whole.select("*", total.alias("total"), F.explode(_cuts(total, F.lit(segment_bytes))).alias("k"))
    last = F.ceil(F.col("total") / segment_bytes).cast("int")
    piece = F.substring("block", F.col("k") * segment_bytes + 1, F.lit(segment_bytes))
    split, first = F.col("total") > segment_bytes, F.col("k") == 0
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit(_CRLF))
    only = lambda when, value: F.when(when, value).otherwise("")
    header = F.concat(
        F.lit("WARC/1.1" + _CRLF),
        line("WARC-Type", F.when(~first, "continuation").when(F.col("revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", F.when(first, F.col("record_id")).otherwise(
            F.concat(F.translate(F.col("record_id"), ">", ""), F.lit("/"), (F.col("k") + 1).cast("string"), F.lit(">")))),
        line("WARC-Date", F.lit(_DATE)),
        line("WARC-Target-URI", F.col("uri")),
        only(first, F.concat(
            line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
            line("X-Payload-Length", F.col("n").cast("string")),
            F.when(F.col("id").isNull(), "").otherwise(line("X-Page-ID", F.col("id").cast("string"))))),
        only(first & F.col("revisit"), F.concat(
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("origin").cast("string"), F.lit(">"))))),
        only(split, line("WARC-Segment-Number", (F.col("k") + 1).cast("string"))),
        only(split & ~first, line("WARC-Segment-Origin-ID", F.col("record_id"))),
        only(split & (F.col("k") + 1 == last), line("WARC-Segment-Total-Length", F.col("total").cast("string"))),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length(piece).cast("string")),
        F.lit(_CRLF))
    parts.select(F.concat(header, _text(piece)).alias("value")).write.option("lineSep", _END).option(
        "maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def parse(content: bytes):
    """Yield (headers with lower-case names, block) of each record of an archive; raises ValueError on broken framing."""
    at = 0
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        if end < 0 or content[at:at + 5] != b"WARC/":
            raise ValueError(f"no record header at byte {at}")
        lines = content[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        start = end + 4
        length = headers.get("content-length", "")
        if not length.isdecimal():
            raise ValueError(f"record at byte {at} names no length")
        stop = start + int(length)
        if content[stop:stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} does not end where its length says")
        yield headers, content[start:stop]
        at = stop + 4


def dechunk(body: bytes) -> bytes | None:
    """Payload of a chunked message body, None if the framing is broken."""
    out, at = [], 0
    while True:
        eol = body.find(b"\r\n", at)
        try:
            n = int(body[at:eol].split(b";")[0], 16) if eol >= 0 else -1
        except ValueError:
            n = -1
        if n < 0 or body[eol + 2 + n:eol + 4 + n] != b"\r\n":
            return None
        if n == 0:
            return b"".join(out)
        out.append(body[eol + 2:eol + 2 + n])
        at = eol + 4 + n


def payload_of(block: bytes) -> bytes | None:
    """Payload of an HTTP response block."""
    head, _, body = block.partition(b"\r\n\r\n")
    chunked = any(k.strip().lower() == b"transfer-encoding" and v.strip().lower() == b"chunked"
                  for k, _, v in (line.partition(b":") for line in head.split(b"\r\n")[1:]))
    return dechunk(body) if chunked else body


_FIELDS = {"record_id": "warc-record-id", "type": "warc-type", "uri": "warc-target-uri", "page_id": "x-page-id",
           "digest": "warc-payload-digest", "length": "x-payload-length", "refers_to": "warc-refers-to",
           "reason": "x-reason", "number": "warc-segment-number", "origin": "warc-segment-origin-id", "total": "warc-segment-total-length"}
_BATCH_BYTES = 4 << 20
BROKEN = "broken"


def records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives below ``path``: the header fields as strings and the block.

    An archive with broken framing gives its records up to there, then one of type ``broken`` that names the reason;
    the next archive goes on as usual.
    """
    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                found = parse(content.as_buffer().to_pybytes())
                while True:
                    try:
                        headers, block = next(found)
                    except StopIteration:
                        break
                    except ValueError as error:
                        headers, block = {"warc-type": BROKEN, "x-reason": str(error)}, b""
                    rows.append((*[headers.get(f) for f in _FIELDS.values()], block))
                    held += len(block)
                    if held >= _BATCH_BYTES:
                        yield _record_batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _record_batch(rows)

    files = spark.read.format("binaryFile").load(path).select("content").where(F.length("content") > 0)
    return files.mapInArrow(run, ", ".join(f"{f} string" for f in _FIELDS) + ", block binary")


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([*[pa.array(c, pa.string()) for c in columns[:-1]], pa.array(columns[-1], pa.binary())],
                                      names=[*_FIELDS, "block"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, record_type, uri, page_id, refers_to, payload, payload_bytes, payload_digest, valid, reason) per
    response, revisit or archive that breaks off.

    ``payload`` is null for revisits; their length and digest are those their header gives.
    """
    found = records(spark, path)
    kept = ["record_id", "type", "uri", "page_id", "digest", "length", "refers_to", "reason"]
    alone = found.where("number is null").select(*kept, "block", F.lit(True).alias("whole"))
    segments = found.where("number is not null").groupBy(F.coalesce("origin", "record_id").alias("record_id")).agg(
        *[F.max(F.when(F.col("origin").isNull(), F.col(c))).alias(c) for c in kept[1:]],
        F.max(F.col("total").try_cast("long")).alias("total"),
        F.sort_array(F.collect_list(F.struct(F.col("number").try_cast("int").alias("number"), "block"))).alias("parts"))
    complete = ((F.transform("parts", lambda p: p["number"]) == F.sequence(F.lit(1), F.size("parts")))
                & (F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + F.octet_length(p["block"])) == F.col("total"))
                & F.col("type").isNotNull())
    joined = segments.select(*kept, F.array_join(F.transform("parts", lambda p: _text(p["block"])), "").cast("binary").alias("block"),
                             F.coalesce(complete, F.lit(False)).alias("whole"))

    def decode(batches):
        for batch in batches:
            payloads, sizes, digests, valid = [], [], [], []
            for kind, digest, length, block, whole in zip(*(batch.column(c).to_pylist() for c in ("type", "digest", "length", "block", "whole"))):
                declared = (digest or "").partition(":")[2]
                payload = payload_of(block) if whole and kind == "response" else None
                own = hashlib.sha1(payload).hexdigest() if payload is not None else None
                ok = whole if kind == "revisit" else own is not None and own == declared
                length = length if (length or "").isdecimal() else None
                payloads.append(payload if ok else None)
                sizes.append(len(payload) if ok and payload is not None else int(length) if ok and length else None)
                digests.append(declared if ok else None)
                valid.append(ok)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("record_id", "type", "uri", "page_id", "refers_to")], pa.array(payloads, pa.binary()),
                 pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(valid, pa.bool_()), batch.column("reason")],
                names=["record_id", "record_type", "uri", "page_id", "refers_to", "payload", "payload_bytes", "payload_digest", "valid", "reason"])

    out = alone.union(joined).where(F.col("type").isin("response", "revisit", BROKEN)).mapInArrow(
        decode, "record_id string, record_type string, uri string, page_id string, refers_to string, payload binary, "
                "payload_bytes long, payload_digest string, valid boolean, reason string")
    return out.withColumn("page_id", F.col("page_id").try_cast("long")).withColumn(
        "refers_to", F.regexp_extract("refers_to", r"^<urn:page:(-?\d+)>$", 1).try_cast("long"))
