"""WARC archives: writing, and reading back with segment reassembly.

Writing: each row becomes an HTTP response record with chunked transfer framing. Rows whose payloads are
equal and of SHORTEST bytes or more have one response, that with the smallest id; the others become
revisit records that refer to it by its record id and keep the response's HTTP head, with the length of the
payload. Which row is first is found from digests and ids alone, without payloads. A block longer than
`segment_bytes` is split into a first record and continuation records that name their origin, and the last
states the total length. Each record is a gzip member of its own, so it can be read from its offset; no more
than `records_per_file` of them share a file, the first of which is a warcinfo record. Spark's own writer puts
the files into the shared folder.

Reading: archives, gzipped by record or whole or not at all, are split into records by their Content-Length, in
one pass. Continuations are grouped by origin and ordered by segment number, the stated total length is
verified, the chunked framing is decoded, and a response's payload is held against its digest. Only segmented
records are shuffled.

Record ids are a function of the row: `<urn:page:ID:DIGEST>`, the digest's first 16 digits, and a number behind
them where rows repeat id and payload.

Defined results: ids are whole numbers; null html is an empty payload; a null url is empty; white space and
control characters in a url are percent-encoded; a null id is carried as null and never refers or is referred to
as smallest while another id exists; rows with equal ids and equal payloads (ties) are alike responses or alike
revisits; a very long payload is one row's string of bytes while it is framed, and segments of it afterwards; an
empty table gives an empty result; extra columns are ignored. A missing, repeated or torn segment, a wrong total
length and a wrong digest fail the read rather than give a wrong payload.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.operators.skew import salted_join
from vellum.session import cut, drop_path, shared_path, ship

SHORTEST = 100
SEGMENT_BYTES = 16_384
CHUNK_BYTES = 4_096
RECORDS_PER_FILE = 2_048
LEVEL = 5
HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
CHUNKED = "Transfer-Encoding: chunked\r\n\r\n"
END = "\r\n\r\n"
INFO = b"software: vellum\r\nformat: WARC File Format 1.1\r\n"


def _bytes(text: str) -> Column:
    return F.lit(text).cast("binary")


def _pieces(data: Column, size: int, made) -> Column:
    """made(piece, index) of each run of `size` bytes; bytes travel as strings, which concatenate in one pass."""
    n = F.ceil(F.octet_length(data) / size).cast("int")
    index = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(index, lambda i: made(F.substring(data, i * size + 1, F.lit(size)), i))


def chunked(payload: Column) -> Column:
    """An HTTP body in chunked framing, as a string of bytes."""
    part = _pieces(payload, CHUNK_BYTES, lambda p, _: F.concat(F.lower(F.hex(F.octet_length(p).cast("long"))), F.lit("\r\n"), p.cast("string"), F.lit("\r\n")))
    return F.concat(F.array_join(part, ""), F.lit("0\r\n\r\n"))


def mark_revisits(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(id, url, payload, digest, first, number): first is the id whose record holds the payload, null for itself; number tells rows of equal id and payload apart."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    pairs = cut(rows.groupBy("digest", "id").agg(F.count("*").alias("n"), F.first(F.octet_length("payload")).alias("size")))
    firsts = pairs.where(F.col("size") >= SHORTEST).groupBy("digest").agg(F.min("id").alias("least"), F.sum("n").alias("all")).where("all > 1").drop("all")
    known = salted_join(pairs, firsts, ["digest"], ["id"], "left")
    first = F.when(F.col("id").eqNullSafe(F.col("least")), None).otherwise(F.col("least"))
    known = known.select(F.col("digest").alias("of"), F.col("id").alias("of_id"), first.alias("first"), "n").where("first IS NOT NULL OR n > 1")
    # of the ids of a hot payload each goes its own way, and the few columns of `known` are what a task holds
    joined = rows.join(known.hint("shuffle_hash"), (F.col("digest") == F.col("of")) & F.col("id").eqNullSafe(F.col("of_id")), "left").drop("of", "of_id")
    number = F.lit(0)
    if not pairs.where("n > 1").isEmpty():
        again = F.row_number().over(Window.partitionBy("digest", "id", "n").orderBy("url")) - 1
        number = F.when(F.col("n") > 1, again).otherwise(0)
    return joined.select("id", "url", "payload", "digest", "first", number.alias("number"))


def _encoded(url: Column) -> Column:
    """White space and control characters percent-encoded."""
    url = F.coalesce(url, F.lit(""))
    odd = r"[\x00-\x20\x7F]"
    each = F.transform(F.split(url, ""), lambda c: F.when(F.rlike(c, F.lit(odd)), F.concat(F.lit("%"), F.lpad(F.hex(c), 2, "0"))).otherwise(c))
    return F.when(F.rlike(url, F.lit(odd)), F.array_join(each, "")).otherwise(url)


def records(marked: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """(record): every record's header and block, without the terminator."""
    name = lambda id_: F.concat(F.lit("<urn:page:"), F.coalesce(id_.cast("string"), F.lit("null")), F.lit(":"), F.substring("digest", 1, 16))
    number = F.when(F.col("number") > 0, F.concat(F.lit(":"), F.col("number").cast("string"))).otherwise("")
    length = F.concat(F.lit(HEAD + "Content-Length: "), F.octet_length("payload").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(F.col("first").isNull(), F.concat(F.lit(HEAD + CHUNKED), chunked(F.col("payload")))).otherwise(length)
    rows = marked.select(F.concat(name(F.col("id")), number, F.lit(">")).alias("rid"), F.concat(name(F.col("first")), F.lit(">")).alias("refers"), _encoded(F.col("url")).alias("url"), "digest", "first", block.cast("binary").alias("block"))
    pieces = _pieces(F.col("block"), segment_bytes, lambda p, i: F.struct(p.alias("piece"), i.alias("i")))
    rows = rows.select("*", F.octet_length("block").alias("total"), F.explode(pieces).alias("p"))
    n = F.ceil(F.col("total") / segment_bytes)
    i = F.col("p.i")
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    kind = F.when(i > 0, "continuation").when(F.col("first").isNotNull(), "revisit").otherwise("response")
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", F.when(i > 0, F.concat(F.lit("<urn:segment:"), i.cast("string"), F.lit(":"), F.substring("rid", 2, 1 << 20))).otherwise(F.col("rid"))),
        line("WARC-Target-URI", F.col("url")),
        F.lit("WARC-Date: 2000-01-01T00:00:00Z\r\n"),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(F.col("first").isNotNull(), F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"), line("WARC-Refers-To", F.col("refers")))).otherwise(F.lit("")),
        F.when(n > 1, line("WARC-Segment-Number", (i + 1).cast("string"))).otherwise(F.lit("")),
        F.when(i > 0, line("WARC-Segment-Origin-ID", F.col("rid"))).otherwise(F.lit("")),
        F.when((n > 1) & (i == n - 1), line("WARC-Segment-Total-Length", F.col("total").cast("string"))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length(F.col("p.piece")).cast("string")),
        F.lit("\r\n"),
    )
    return rows.select(F.concat(header, F.col("p.piece").cast("string")).alias("record"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", segment_bytes: int = SEGMENT_BYTES, records_per_file: int = RECORDS_PER_FILE) -> None:
    """A gzip member's last byte is the highest of its length, zero below 16 MiB: the writer's line separator puts it there."""
    if segment_bytes > 8 << 20:
        raise ValueError("a segment may have 8 MiB at most")
    ship(pages.sparkSession)

    def member(record: bytes) -> bytes:
        packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        return (packer.compress(record + END.encode()) + packer.flush())[:-1]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, task = 0, TaskContext.get().partitionId()
        for batch in batches:
            out = []
            for record in batch.column(0):
                if at % records_per_file == 0:  # a file begins
                    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:info:{task}:{at}>\r\nWARC-Date: 2000-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(INFO)}\r\n\r\n"
                    out.append(member(head.encode() + INFO))
                    at += 1
                out.append(member(record.as_py()))
                at += 1
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    made = records(mark_revisits(pages, id_col, url_col, html_col), segment_bytes).select(F.col("record").cast("binary").alias("record"))
    packed = made.mapInArrow(pack, "value binary").select(F.col("value").cast("string").alias("value"))
    packed.write.option("lineSep", "\0").option("maxRecordsPerFile", records_per_file).option("compression", "none").text(path)


_FIELD = re.compile(rb"([A-Za-z-]+): *([^\r]*)\r\n")


def members(data: bytes) -> Iterator[bytes]:
    """What each gzip member holds; the whole of plain data."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    view, at = memoryview(data), 0
    while at < len(data):
        opened, parts = zlib.decompressobj(31), []
        while not opened.eof:
            if at >= len(data):
                raise ValueError("the archive ends inside a record")
            parts.append(opened.decompress(view[at : at + 65_536]))
            at = min(at + 65_536, len(data))
        at -= len(opened.unused_data)
        yield b"".join(parts)


def parse(data: bytes) -> Iterator[tuple[dict[bytes, bytes], memoryview]]:
    """The records of one archive, plain or gzipped: headers by lower-case name, and the block."""
    for part in members(data):
        view, at = memoryview(part), 0
        while at < len(part):
            if part[at : at + 5] != b"WARC/":
                raise ValueError(f"no record starts at byte {at}")
            end = part.index(b"\r\n\r\n", at)
            start = part.index(b"\r\n", at) + 2
            fields = {k.lower(): v for k, v in _FIELD.findall(part[start : end + 2])}
            size = int(fields[b"content-length"])
            if end + 4 + size > len(part):
                raise ValueError("the archive ends inside a record")
            yield fields, view[end + 4 : end + 4 + size]
            at = end + 4 + size
            while part[at : at + 2] == b"\r\n":
                at += 2


def decode_body(block: bytes) -> bytes:
    """The payload of an HTTP response, with its transfer framing taken off."""
    head, _, body = bytes(block).partition(b"\r\n\r\n")
    if not re.search(rb"\r\ntransfer-encoding: *chunked", head, re.I):
        return body
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(parts)
        if body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk's length is wrong")
        parts.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def _id_in(name: bytes) -> int | None:
    found = name.split(b":")[2].rstrip(b">")
    return None if found == b"null" else int(found)


_RECORD = "record_id string, id long, record_type string, refers_record string, refers_to long, digest string"
_READ = f"{_RECORD}, payload_bytes long, payload binary"
_PARSED = f"{_READ}, number int, total long, segment binary"
_LENGTH = re.compile(rb"\r\ncontent-length: *(\d+)", re.I)


def _finish(kind: str, digest: str, block: bytes, payloads: bool) -> tuple[int | None, bytes | None]:
    """The length of a whole block's payload, which for a revisit its HTTP head tells, and the payload itself where it is wanted."""
    if kind == "revisit":
        stated = _LENGTH.search(bytes(block).partition(b"\r\n\r\n")[0])
        return int(stated[1]) if stated else None, None
    payload = decode_body(block)
    if hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError("a payload's digest is wrong")
    return len(payload), payload if payloads else None


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    names, types = zip(*(x.split(" ") for x in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, k in zip(zip(*rows, strict=True), types, strict=True)], list(names))


def read_records(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """(record_id, id, record_type, refers_record, refers_to, digest, payload_bytes, payload) of every response and revisit in archives read as binary files.

    Archives are parsed once, into a table in the shared folder; without `payloads` it holds those of segmented records only.
    """
    ship(archives.sparkSession)

    def common(fields: dict) -> tuple:
        refers = fields.get(b"warc-refers-to")
        name = fields[b"warc-record-id"]
        return name.decode(), _id_in(name), fields[b"warc-type"].decode(), refers and refers.decode(), refers and _id_in(refers), fields[b"warc-payload-digest"].partition(b":")[2].decode()

    def read(files: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in files:
            for content in batch.column(0):
                held, size = [], 0
                for fields, block in parse(content.as_py()):
                    if fields[b"warc-type"] not in (b"response", b"revisit", b"continuation"):
                        continue
                    if b"warc-segment-number" in fields:
                        number, total = int(fields[b"warc-segment-number"]), fields.get(b"warc-segment-total-length")
                        names = common(fields) if number == 1 else (fields[b"warc-segment-origin-id"].decode(), *[None] * 5)
                        held.append((*names, None, None, number, int(total) if total else None, bytes(block)))
                    else:
                        names = common(fields)
                        held.append((*names, *_finish(names[2], names[5], block, payloads), None, None, None))
                    size += len(held[-1][-1] or held[-1][7] or b"")
                    if len(held) >= 512 or size >= 1 << 22:
                        yield _batch(held, _PARSED)
                        held, size = [], 0
                if held:
                    yield _batch(held, _PARSED)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                *names, block = (c[0].as_py() for c in batch.slice(at, 1).columns)
                yield _batch([(*names, *_finish(names[2], names[5], block, payloads))], _READ)

    parsed = cut(archives.select("content").mapInArrow(read, _PARSED))
    names = _READ.replace(", payload binary", "").replace(", payload_bytes long", "").split(", ")
    firsts = [F.max(n).alias(n) for n in (x.split(" ")[0] for x in names[1:])]  # the first segment alone has them
    parts = parsed.where("number IS NOT NULL").groupBy("record_id").agg(*firsts, F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("number", "segment"))).alias("parts"))
    numbers = F.transform("parts", lambda p: p["number"])
    block = F.array_join(F.transform("parts", lambda p: p["segment"].cast("string")), "").cast("binary")
    torn = F.raise_error(F.concat(F.lit("segments are missing, repeated or torn: "), F.col("record_id")))
    sound = (numbers == F.sequence(F.lit(1), F.size("parts"))) & F.coalesce(F.octet_length(block) == F.col("total"), F.lit(False))
    whole = parts.select(*(x.split(" ")[0] for x in names), F.when(sound, block).otherwise(torn.cast("binary")).alias("block"))
    columns = [x.split(" ")[0] for x in _READ.split(", ")]
    return parsed.where("number IS NULL").select(columns).unionByName(whole.mapInArrow(join, _READ))


def unresolved(read: DataFrame) -> DataFrame:
    """Revisits whose reference names no response."""
    responses = read.where("record_type = 'response'").select(F.col("record_id").alias("refers_record"))
    return read.where("record_type = 'revisit'").join(responses, "refers_record", "left_anti")


def archive(spark: SparkSession, pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", payloads: bool = True) -> DataFrame:
    """Writes pages to archives under `path` and returns the records read back; without a path the archives go once they are read."""
    place = path or shared_path(spark, "warc")
    write_archives(pages, place, id_col, url_col, html_col)
    read = read_records(spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(place), payloads)
    if path is None:
        drop_path(spark, place)
    return read


def summary(read: DataFrame, id_col: str = "page_id") -> DataFrame:
    """What the contract asks of each record; a response's digest has been held against its payload."""
    return read.select(F.col("id").alias(id_col), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS size, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT *, CASE WHEN size >= {SHORTEST} THEN min(page_id) OVER (PARTITION BY digest) END AS least FROM p)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN least IS NULL OR least = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN least <> page_id THEN least END AS refers_to
FROM f
"""
