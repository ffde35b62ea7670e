"""WARC archives of pages: written with revisits and segments, read back by segment reassembly.

Writing. A page's block is an HTTP response whose body, the page in UTF-8, has chunked transfer framing. Of pages with
equal payloads of at least ``least`` bytes the one with the largest page_id is a response; the others become revisits
that refer to it and carry no body. A block of more than ``segment`` characters is cut: the first piece is the response
with segment number 1, the rest are continuations that name it as their origin, and the last gives the total length. The
archives are text files in the shared folder, written by Spark's writer (each record ends with two line ends, which is
its line separator); a file has at most FILE_RECORDS records, so that a reader's task holds a bounded piece.

Reading. Files are split into records by their headers' lengths. Records that stand alone are decoded at once; of the
others the pieces of one origin are brought together, ordered by number, checked to be gapless and of the stated total
length, and joined in one pass; then the HTTP head is cut off and the chunks are decoded. What is incomplete or damaged is reported
with a null payload and ``complete`` false; what cannot be read of an archive stops no other record.

Defined cases: a null html is an empty payload; pages of equal page_id and payload are all responses or all revisits; rows
without page_id count as smaller than any other; an empty table gives no row; columns other than page_id, url and html
are ignored. A page is one value: its digest needs its whole payload, so its pieces meet in one row.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, new_folder, small_join

SEGMENT, CHUNK, FILE_RECORDS = 16_384, 4096, 2048
END = "\r\n"
RECORDS = "record_id string, page_id long, kind string, digest string, refers_to string, segment int, total long, block binary, whole boolean"
HTTP_HEAD = END.join(("HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", "Transfer-Encoding: chunked", "", ""))


def base32_sha1(text: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a text: each five hex digits become four letters."""
    digest = F.sha1(text.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_id(page: Column, digest: Column) -> Column:
    """A record's name, made from its page and payload."""
    h = F.md5(F.concat_ws(":", F.coalesce(page.cast("string"), F.lit("none")), digest).cast("binary"))
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in cuts]), F.lit(">"))


def pieces_of(text: Column, n: int) -> Column:
    """text in pieces of n characters, in one pass over it. The quantifier is possessive: any other recurses for each character
    where some take two code units and others one."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{n}}}+"), F.lit(0))


def framed(text: Column) -> Column:
    """text in chunks of CHUNK characters, each after its length in bytes."""
    chunks = F.transform(pieces_of(text, CHUNK), lambda x: F.concat(F.lower(F.hex(F.octet_length(x))), F.lit(END), x, F.lit(END)))
    return F.concat(F.concat_ws("", chunks), F.lit("0" + END + END))


def write(pages: DataFrame, path: str, least: int = 0, segment: int = SEGMENT) -> None:
    """Archives of all pages in the folder ``path``."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    # pages with a body are read twice rather than shuffled: only ids and digests are grouped
    digests = pages.select(F.col("page_id").cast("long").alias("page_id"), base32_sha1(html).alias("digest"), F.octet_length(html).alias("bytes")).where(F.col("bytes") >= least)
    groups = cut(digests.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), html.alias("html"), base32_sha1(html).alias("digest"))
    rows = small_join(rows, groups, ["digest"])
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = rows.select(
        "page_id", "digest", "first", revisit.alias("revisit"), F.regexp_replace("url", r"[\r\n]", " ").alias("url"),
        F.when(revisit, F.lit(HTTP_HEAD.replace("Transfer-Encoding: chunked" + END, ""))).otherwise(F.concat(F.lit(HTTP_HEAD), framed(F.col("html")))).alias("block"),
    )
    rows = rows.select("*", record_id(F.col("page_id"), F.col("digest")).alias("origin"), F.octet_length("block").alias("total"), pieces_of(F.col("block"), segment).alias("parts"))
    rows = rows.select("page_id", "digest", "first", "revisit", "url", "origin", "total", F.size("parts").alias("pieces"), F.posexplode("parts").alias("at", "body")).withColumn("nth", F.col("at") + 1)
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit(END))
    kind = F.when(F.col("nth") > 1, "continuation").when(F.col("revisit"), "revisit").otherwise("response")
    own = F.when(F.col("nth") > 1, record_id(F.col("page_id"), F.concat_ws("/", F.col("digest"), F.col("nth").cast("string")))).otherwise(F.col("origin"))
    none = F.lit("")
    head = F.concat(
        F.lit("WARC/1.1" + END), line("WARC-Type", kind), line("WARC-Record-ID", own), F.lit("WARC-Date: 1970-01-01T00:00:00Z" + END),
        F.when(F.col("nth") == 1, F.concat(line("WARC-Target-URI", F.col("url")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), F.coalesce(line("X-Page-ID", F.col("page_id").cast("string")), none))).otherwise(none),
        F.when(F.col("revisit"), F.concat(line("WARC-Refers-To", record_id(F.col("first"), F.col("digest"))), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" + END))).otherwise(none),
        F.when(F.col("pieces") > 1, line("WARC-Segment-Number", F.col("nth").cast("string"))).otherwise(none),
        F.when(F.col("nth") > 1, line("WARC-Segment-Origin-ID", F.col("origin"))).otherwise(none),
        F.when((F.col("nth") > 1) & (F.col("nth") == F.col("pieces")), line("WARC-Segment-Total-Length", F.col("total").cast("string"))).otherwise(none),
        F.lit("Content-Type: application/http; msgtype=response" + END), line("Content-Length", F.octet_length("body").cast("string")),
    )
    rows.select(F.concat(head, F.lit(END), F.col("body")).alias("value")).write.option("lineSep", END + END).option("maxRecordsPerFile", FILE_RECORDS).option("compression", "gzip").text(path)


def parse(data: bytes) -> Iterator[dict]:
    """The records of one archive file. What has no whole head, no id or no length is reported with its type, if there is one,
    and without a block; a block that ends early is not whole; names of fields are read in any case."""
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        stop = data.find(b"\r\n\r\n", at)
        lines = data[at : stop if stop >= 0 else len(data)].decode("utf-8", "replace").split(END)[1:]
        fields = {name.strip().lower(): value.strip() for name, sep, value in (x.partition(":") for x in lines) if sep}
        number = lambda name, most=2**63: int(v) if (v := fields.get(name, "")).isascii() and v.isdigit() and int(v) < most else None  # noqa: B023, E731
        size, segment, page = number("content-length"), number("warc-segment-number", 2**31) or 0, fields.get("x-page-id", "")
        name = fields.get("warc-segment-origin-id", fields.get("warc-record-id"))
        known = stop >= 0 and size is not None and name is not None
        begin = stop + 4 if stop >= 0 else len(data)
        at = min(begin + size, len(data)) if known else begin
        yield {
            "record_id": name, "page_id": int(page) if re.fullmatch(r"-?[0-9]{1,18}", page) else None, "kind": fields.get("warc-type"), "digest": fields.get("warc-payload-digest"), "refers_to": fields.get("warc-refers-to"),
            "segment": segment, "total": number("warc-segment-total-length"), "block": data[begin:at] if known else None, "whole": known and begin + size <= len(data),
        }


def inflate(data: bytes) -> bytes:
    """What gzip members hold, one after the other, as far as they can be read."""
    out = []
    while data:
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(data))
        except zlib.error:
            break
        data = member.unused_data if member.eof else b""
    return b"".join(out)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives in a folder, as they stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                data = content.as_buffer().to_pybytes()
                rows = [*parse(inflate(data) if name.endswith(".gz") else data)]
                schema = schema or pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("kind", pa.string()), ("digest", pa.string()), ("refers_to", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("block", pa.binary()), ("whole", pa.bool_())])
                for k in range(0, len(rows), 512):
                    yield pa.RecordBatch.from_pylist(rows[k : k + 512], schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").load(path).select("path", "content")
    return files.mapInArrow(run, RECORDS)


def reassemble(records: DataFrame) -> DataFrame:
    """Whole records, as ``parts`` in order: those that stand alone, and those whose segments 1 to n are all there and add up to
    the stated length; ``complete`` is false for others. Rows that repeat a segment make as many records as there are firsts."""
    alone = records.where("segment = 0").select("record_id", "page_id", "kind", "digest", "refers_to", F.array("block").alias("parts"), F.col("whole").alias("complete"))
    first = lambda c: F.max(F.when(F.col("segment") == 1, F.col(c)))
    groups = records.where("segment > 0").groupBy("record_id").agg(
        first("page_id").alias("page_id"), first("kind").alias("kind"), first("digest").alias("digest"), first("refers_to").alias("refers_to"),
        F.array_sort(F.collect_set(F.struct("segment", "block"))).alias("pieces"), F.max("total").alias("total"), F.count_if(F.col("segment") == 1).alias("copies"), F.min("whole").alias("whole"),
    )
    gapless = F.transform("pieces", lambda x: x["segment"]) == F.sequence(F.lit(1), F.greatest(F.size("pieces"), F.lit(1)))
    size = F.aggregate("pieces", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x["block"]))
    joined = groups.withColumn("parts", F.transform("pieces", lambda x: x["block"])).withColumn("complete", F.coalesce(F.col("whole") & gapless & (size == F.col("total")), F.lit(False)))
    return alone.unionByName(joined.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*alone.columns))


def dechunk(body: bytes) -> bytes | None:
    """What a chunked transfer carries; None if the framing is broken or ends early."""
    out, at = [], 0
    while True:
        stop = body.find(b"\r\n", at)
        try:
            n = int(body[at:stop].split(b";")[0], 16) if stop >= 0 else -1
        except ValueError:
            return None
        if n <= 0:
            return b"".join(out) if n == 0 else None
        at = stop + 2 + n + 2
        if body[at - 2 : at] != b"\r\n":
            return None
        out.append(body[stop + 2 : at - 2])


def payload(block: bytes) -> bytes | None:
    """The body of an HTTP response."""
    head, sep, body = block.partition(b"\r\n\r\n")
    if not sep:
        return None
    chunked = any(x.split(b":", 1)[0].strip().lower() == b"transfer-encoding" and b"chunked" in x.lower() for x in head.split(b"\r\n")[1:])
    return dechunk(body) if chunked else body


def read_payloads(whole: DataFrame) -> DataFrame:
    """record_id, page_id, kind, refers_to, complete, payload_bytes, payload_digest (both null for a revisit, and for a
    record whose payload is not whole or not of its digest) and payload."""
    schema = "record_id string, page_id long, kind string, refers_to string, complete boolean, payload_bytes long, payload_digest string, payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, digests, bodies, good = [], [], [], []
            for parts, kind, said, complete in zip(b.column("parts"), b.column("kind").to_pylist(), b.column("digest").to_pylist(), b.column("complete").to_pylist(), strict=True):
                body = payload(b"".join(p.as_py() for p in parts.values)) if complete and kind == "response" else None
                digest = base64.b32encode(hashlib.sha1(body).digest()).decode() if body is not None else None
                ok = complete and (kind != "response" or digest is not None and said in (None, f"sha1:{digest}"))
                good.append(ok)
                bodies.append(body if ok else None)
                digests.append(digest if ok else None)
                sizes.append(len(body) if ok and body is not None else None)
            yield pa.RecordBatch.from_arrays([b.column("record_id"), b.column("page_id"), b.column("kind"), b.column("refers_to"), pa.array(good, pa.bool_()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(bodies, pa.binary())], ["record_id", "page_id", "kind", "refers_to", "complete", "payload_bytes", "payload_digest", "payload"])

    return whole.mapInArrow(run, schema)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, all read back from archives of the pages."""
    path = new_folder(pages.sparkSession, "warc")
    write(pages, path, least)
    back = cut(read_payloads(reassemble(read_records(pages.sparkSession, path))).drop("payload"))
    responses = back.where("kind = 'response'")
    named = responses.groupBy("record_id").agg(F.max("page_id").alias("refers_page"), F.max("payload_bytes").alias("b"), F.max("payload_digest").alias("d"))
    revisits = back.where("kind = 'revisit'").drop("record_id").join(named, F.col("refers_to") == F.col("record_id"), "left")
    cols = ("page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"))
    return responses.select(*cols, F.lit(None).cast("long").alias("refers_to")).unionByName(
        revisits.select("page_id", F.col("b").alias("payload_bytes"), F.col("d").alias("payload_digest"), F.col("kind").alias("record_type"), F.col("refers_page").alias("refers_to"))
    )
