"""WARC archives: writing captures, reading them back, and assembling the request, response (or
revisit) and metadata records of a capture into one nested row.

Records are strings made by DataFrame functions. Small batches of Python make each a gzip member of its
own, as the format advises, so that a reader can seek to a record; members are joined to pieces of about
PIECE_BYTES, and FILE_PIECES pieces to a file, which bounds files by bytes whatever the pages' sizes.
(Spark's text writer puts a separator after each piece: the zero byte with which every piece ends.) Of
captures with equal payloads the one with the smallest page_id is the response and the others revisit
it. Reading hands each file to Python compressed and inflates it record by record. Records are joined
through WARC-Concurrent-To and WARC-Refers-To.

Defined results: null html is an empty payload; a null url gives no target; repeated rows are
captures of their own (numbered, so that record ids stay unique): the first is the response, the
others revisit it; rows with a null page_id are responses and are never referred to; an empty table
gives archives without records and no captures. Records without a main record are dropped, a capture
without request or metadata has null there. Extra columns are not archived. Archives of other writers
may be plain, or gzip of any number of members; what is no WARC raises ValueError.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import core

END = "\r\n"
MIN_BYTES = 0
#: Compressed bytes of a piece, and pieces of a file; a piece ends with the record that fills it.
PIECE_BYTES, FILE_PIECES = 8 << 20, 16
#: What is inflated at once.
STEP_BYTES = 1 << 20
DATE = "2024-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
RECORD = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("concurrent_to", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("digest", T.StringType()),
        T.StructField("found_digest", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("fields", T.StringType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def base32_sha1(payload: Column) -> Column:
    """SHA-1 as 32 upper-case base32 letters: each five hex digits are four letters."""
    hexes = F.sha1(payload)
    letters = []
    for i in range(8):
        n = F.conv(F.substring(hexes, 5 * i + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), F.shiftright(n, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def urn(*parts: Column) -> Column:
    digits = F.md5(F.concat_ws("\x1f", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(digits, "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), F.lit(">"))


def _record(kind: str, record_id: Column, block: Column, media: str, uri: Column, *more: tuple[str, Column]) -> Column:
    """One record but for its last blank line; a header whose value is null is left out."""
    heads = [("WARC-Type", F.lit(kind)), ("WARC-Record-ID", record_id), ("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", uri), *more, ("Content-Type", F.lit(media)), ("Content-Length", F.octet_length(block).cast("string"))]
    lines = [F.concat(F.lit(f"{k}: "), v) for k, v in heads]
    return F.concat(F.concat_ws(END, F.lit("WARC/1.1"), *lines), F.lit(END + END), block)


def write_captures(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, zipped: bool = True) -> None:
    """Archives of pages (page_id long, url, html) under path: three records a page. Plain archives
    (zipped=False) are for small data; nothing bounds their files."""
    spark = pages.sparkSession
    held = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    held = held.withColumn("key", F.unhex(F.sha2(F.encode("html", "UTF-8"), 256)))
    # rows without an id stay apart: their own content stands for it
    held = held.withColumn("pid", F.coalesce(F.col("page_id").cast("string"), F.concat(F.lit("row-"), F.md5(F.concat_ws("\x1f", F.hex("key"), "url")))))
    ids = held.where((F.octet_length("html") >= min_bytes) & F.col("page_id").isNotNull()).select("page_id", "pid", "key")
    firsts = core.cut(ids.groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "firsts")
    twins = core.cut(ids.join(firsts, "key").select("pid", "key", "first").dropDuplicates(["pid", "key"]), "twins")
    nth = F.row_number().over(W.partitionBy("pid", "key").orderBy("url"))
    rows = held.withColumn("nth", nth).join(twins, ["pid", "key"], "left")
    ident = lambda what, pid, n: urn(F.lit(what), pid, F.hex("key"), n.cast("string"))
    first = F.col("first").cast("string")
    revisit = F.col("first").isNotNull() & ~((F.col("pid") == first) & (F.col("nth") == 1))
    uri = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    rows = rows.select("page_id", "url", "html", uri.alias("uri"), revisit.alias("revisit"), ident("main", F.col("pid"), F.col("nth")).alias("main"), ident("request", F.col("pid"), F.col("nth")).alias("request"), ident("metadata", F.col("pid"), F.col("nth")).alias("metadata"), F.when(revisit, ident("main", first, F.lit(1))).alias("refers"), F.concat(F.lit("sha1:"), base32_sha1(F.encode("html", "UTF-8"))).alias("digest"))
    u, main = F.col("uri"), F.col("main")
    response = _record("response", main, F.concat(F.lit(HTTP), "html"), "application/http; msgtype=response", u, ("WARC-Payload-Digest", F.col("digest")))
    again = _record("revisit", main, F.lit(HTTP), "application/http; msgtype=response", u, ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), ("WARC-Refers-To", F.col("refers")), ("WARC-Payload-Digest", F.col("digest")))
    asked = F.concat(F.lit("GET "), F.coalesce(F.nullif(F.regexp_extract("uri", r"^[^:/]+://[^/]*([^#]*)", 1), F.lit("")), F.lit("/")), F.lit(" HTTP/1.1\r\nHost: "), F.coalesce(F.regexp_extract("uri", r"^[^:/]+://([^/?#]*)", 1), F.lit("")), F.lit("\r\n\r\n"))
    request = _record("request", F.col("request"), asked, "application/http; msgtype=request", u, ("WARC-Concurrent-To", main))
    fields = F.concat(F.lit("page: "), F.to_json(F.struct("page_id", "url")), F.lit(END))
    about = _record("metadata", F.col("metadata"), fields, "application/warc-fields", u, ("WARC-Concurrent-To", main))
    out = rows.select(F.explode(F.array(F.when(F.col("revisit"), again).otherwise(response), request, about)).alias("value"))
    if zipped:
        core.small_batches(spark)
        most = PIECE_BYTES
        pieces = out.mapInArrow(lambda batches: _pieces(batches, most), "value binary").select(F.col("value").cast("string"))
        pieces.write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", FILE_PIECES).text(path)
    else:
        out.write.option("lineSep", END + END).option("compression", "none").text(path)
    core.drop_cut(twins)
    core.drop_cut(firsts)


def _pieces(batches: Iterator[pa.RecordBatch], most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Records to joined gzip members, without the zero byte that the writer adds. A member ends with its
    size's highest byte, zero below 16 MB; a larger one is followed by an empty member."""

    def member(data: bytes) -> bytes:
        z = zlib.compressobj(wbits=31)
        return z.compress(data) + z.flush()

    held, size = [], 0
    for batch in batches:
        for record in batch.column(0):
            data = member(record.as_py().encode("utf-8", "surrogatepass") + b"\r\n\r\n")
            if data[-1]:
                data += member(b"")
            held.append(data)
            size += len(data)
            if size >= most:
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], ["value"])
                held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], ["value"])


def inflated(data: bytes) -> Iterator[bytes]:
    """The content of an archive file in steps: gzip members one after another, or plain."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    view, at, member = memoryview(data), 0, zlib.decompressobj(31)
    while at < len(view):
        step = view[at : at + STEP_BYTES]
        at += len(step)
        yield member.decompress(step)
        if member.eof:
            at -= len(member.unused_data)
            while at < len(view) and not view[at]:
                at += 1
            member = zlib.decompressobj(31)


class Reader:
    """Bytes that arrive in steps, taken from the front."""

    def __init__(self, steps: Iterator[bytes]):
        self.steps, self.held, self.at = steps, bytearray(), 0

    def more(self) -> bool:
        step = next(self.steps, None)
        if step is None:
            return False
        if self.at > STEP_BYTES or self.at == len(self.held):
            del self.held[: self.at]
            self.at = 0
        self.held += step
        return True

    def until(self, mark: bytes) -> bytes | None:
        """What comes before the next mark, which is passed; None where there is none."""
        seen = 0
        while (end := self.held.find(mark, self.at + max(0, seen - len(mark)))) < 0:
            seen = len(self.held) - self.at
            if not self.more():
                return None
        out, self.at = bytes(self.held[self.at : end]), end + len(mark)
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) - self.at < n and self.more():
            pass
        out = bytes(self.held[self.at : self.at + n])
        self.at += len(out)
        return out

    def skip_lines(self) -> bool:
        """Past empty lines; whether anything is left."""
        while True:
            if len(self.held) - self.at < 2 and self.more():
                continue
            if self.held[self.at : self.at + 2] != b"\r\n":
                return self.at < len(self.held)
            self.at += 2


def parse(data: bytes, payload: bool) -> Iterator[tuple]:
    """The records of one archive, in order, as rows of RECORD."""
    source = Reader(inflated(data))
    while source.skip_lines():
        head = source.until(b"\r\n\r\n")
        lines = (head or b"").decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no record begins where one should")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        block = source.take(int(head["content-length"]))
        if len(block) < int(head["content-length"]):
            raise ValueError("an archive ends within a record")
        kind, fields, found, size, body = head.get("warc-type"), None, None, None, None
        if kind == "response":
            http = block.find(b"\r\n\r\n")
            body = block[http + 4 :] if http >= 0 else block
            size, found = len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()
        elif kind == "metadata":
            fields = block.decode("utf-8", "replace")
        digest = head.get("warc-payload-digest")
        yield (head.get("warc-record-id"), kind, head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("warc-target-uri"), head.get("warc-date"), digest and digest.removeprefix("sha1:"), found, size, fields, body if payload else None)


def read_records(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of all archives under path; payload=False leaves the payloads' bytes out once they are measured."""
    names = [f.name for f in RECORD.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for row in parse(content.as_py(), payload):
                    rows.append(row)
                    held += len(row[-1] or b"")
                    if len(rows) >= 2000 or held > 16 << 20:
                        yield _batch(rows, names)
                        rows, held = [], 0
                yield _batch(rows, names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, RECORD)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string() for n in names]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row a capture: main (response or revisit), request and metadata, joined through
    concurrent-to. records is scanned once for each, so hand in a written table."""
    nest = lambda kind: F.struct(*[c for c in records.columns if c != "concurrent_to"]).alias(kind)
    main = records.where("type in ('response', 'revisit')").select(F.col("record_id").alias("capture"), nest("main"))
    asked = records.where("type = 'request'").select(F.col("concurrent_to").alias("capture"), nest("request"))
    about = records.where("type = 'metadata'").select(F.col("concurrent_to").alias("capture"), nest("metadata"))
    return main.join(asked, "capture", "left").join(about, "capture", "left")


def digest_rows(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write all pages to archives, read them back, and tell what each page's record was."""
    spark = pages.sparkSession
    path = core.new_path(spark, "warc")
    write_captures(pages, path, min_bytes)
    records = core.cut(read_records(spark, path, payload=False), "records")
    page = F.from_json(F.regexp_extract("metadata.fields", r"page: (\{.*\})\r\n", 1), "page_id long, url string")
    captures = core.cut(assemble(records).select("capture", page["page_id"].alias("page_id"), F.col("main.type").alias("record_type"), F.col("main.refers_to").alias("refers"), F.col("main.digest").alias("digest"), F.col("main.found_digest").alias("found"), F.col("main.payload_bytes").alias("bytes")), "captures")
    core.drop_cut(records)
    core.drop_path(spark, path)
    # what a revisit refers to: many may refer to one response, and Spark may split them
    origin = captures.where("record_type = 'response'").select(F.col("capture").alias("refers"), F.col("page_id").alias("origin"), F.col("bytes").alias("origin_bytes"), F.col("found").alias("origin_found"))
    revisits = captures.where("record_type = 'revisit'").drop("bytes", "found").join(origin, "refers", "left")
    found = revisits.select("page_id", "record_type", "origin", F.col("origin_bytes").alias("bytes"), F.col("origin_found").alias("found"), "digest")
    found = found.unionByName(captures.where("record_type = 'response'").select("page_id", "record_type", F.lit(None).cast("long").alias("origin"), "bytes", "found", "digest"))
    return found.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("found").alias("payload_digest"), "record_type", F.col("origin").alias("refers_to"), (F.col("found") == F.col("digest")).alias("digest_ok"))
