r"""WARC archives: writing, and reading back with segment reassembly.

``write_archive`` lays out one record per row: equal payloads of at least ``LEAST_REVISIT`` bytes become a ``response`` of the
smallest id and ``revisit`` records that name it and the digest of the payload, since an id may stand for several payloads. A response holds an HTTP message whose body is framed in chunks; a block longer than
``segment_bytes`` is cut into a first record and ``continuation`` records.
The files are written by Spark's text writer, gzip-compressed, with at most ``records_per_file`` records each, so one file is
bounded by records_per_file * (segment_bytes + headers).

``read_archive`` parses the files by Content-Length, file by file. Records in one piece pass straight on. Only segments are
shuffled: ``reassemble`` groups the continuation records by origin identifier, orders them by segment
number, checks that none is missing and that the total length is as declared, and decodes the chunk framing of the joined
block. A revisit takes size and digest of the payload from the response of its id and digest; without one it has neither.

Defined results: null payload is empty; null ids sort last and a group of null ids only has responses; rows that repeat the
smallest id are responses as well, rows that repeat another id repeat its record; a record that lacks segments, fails its length or its framing comes back with ``ok`` false and a
null payload, and so does one without a readable length or segment number; of a broken or cut-off gzip file the records before the damage are read. Other columns are not archived. An empty table gives an empty archive.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.checks.registry import Checks
from barloom.llm.common import sliced, stored, table
from barloom.operators.layout import scratch_path

checks = Checks()

LEAST_REVISIT = 100
SEGMENT_BYTES = 32_768
CHUNK_BYTES = 8_192
RECORDS_PER_FILE = 1_024
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
RECORDS = "record_id string, type string, origin string, segment int, total long, target string, key string, refers_to string, block binary"
READ = RECORDS + ", digest string, whole boolean"
HEX = re.compile(rb"[0-9A-Fa-f]{1,15}")
PAYLOADS = "record_id string, type string, target string, key string, refers_to string, ok boolean, payload binary, digest string"


# ---- writing


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(body[i:i + size]), body[i:i + size]) for i in range(0, len(body), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return b"WARC/1.1\r\n" + head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def _urn() -> str:
    return f"<urn:uuid:{uuid.uuid4()}>"


def _target(url: str | None) -> str:
    """One line without control characters, as a header value needs it."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def records_of(key: int | None, url: str | None, html: str | None, refers_to: int | None, segment_bytes: int, digest: str | None = None) -> list[bytes]:
    name = "" if key is None else str(key)
    common = [("WARC-Date", DATE), ("WARC-Target-URI", _target(url)), ("X-Key", name)]
    if refers_to is not None:
        fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", _urn()), *common, ("X-Refers-To-Key", str(refers_to)),
                  *([("WARC-Payload-Digest", f"sha256:{digest}")] if digest else []),
                  ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        return [_record(fields, b"")]
    block = HTTP + chunked((html or "").encode("utf-8"))
    pieces = [block[i:i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    origin = _urn()
    first = [("WARC-Type", "response"), ("WARC-Record-ID", origin), *common, ("Content-Type", "application/http; msgtype=response")]
    if len(pieces) == 1:
        return [_record(first, block)]
    out = [_record([*first, ("WARC-Segment-Number", "1")], pieces[0])]
    for n, piece in enumerate(pieces[1:], 2):
        fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", _urn()), ("WARC-Date", DATE), ("WARC-Target-URI", _target(url)),
                  ("WARC-Segment-Origin-ID", origin), ("WARC-Segment-Number", str(n))]
        out.append(_record([*fields, *([("WARC-Segment-Total-Length", str(len(block)))] if n == len(pieces) else [])], piece))
    return out


def revisits(pages: DataFrame, key: str = "page_id", payload: str = "html") -> DataFrame:
    """(key, digest, refers_to) of the rows whose payload another row with a smaller key holds. Only digests and keys are shuffled."""
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    sums = pages.select(F.col(key).alias("key"), F.sha2(body, 256).alias("digest"), F.length(body).alias("bytes")).filter(F.col("bytes") >= LEAST_REVISIT)
    sums = stored(sums.select("key", "digest"), "digests")
    first = stored(sums.groupBy("digest").agg(F.min("key").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND refers_to IS NOT NULL").drop("n"), "firsts")
    return sums.join(first, "digest").filter(~F.col("key").eqNullSafe(F.col("refers_to"))).select("key", "digest", "refers_to").distinct()


def write_archive(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html",
                  segment_bytes: int = SEGMENT_BYTES, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write the archive below ``path`` (a folder that all executors share)."""
    again = stored(revisits(pages, key, payload).withColumnsRenamed({"key": "_key", "digest": "_digest"}), "revisits")
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(payload).alias("html"), F.sha2(F.coalesce(F.col(payload), F.lit("")).cast("binary"), 256).alias("digest"))
    rows = rows.join(again, F.col("key").eqNullSafe(F.col("_key")) & (F.col("digest") == F.col("_digest")), "left")
    # a revisit needs no payload, so it is dropped before it reaches Python
    rows = rows.select("key", "url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), "refers_to", "_digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, 64):
            # the writer ends each value with the last line feed of the record
            out = [r[:-1] for row in zip(*[c.to_pylist() for c in part.columns], strict=True) for r in records_of(*row[:4], segment_bytes, row[4])]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    made = rows.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    made.write.option("maxRecordsPerFile", records_per_file).option("lineSep", "\n").option("compression", "gzip").text(path)


# ---- reading


def inflated(content: bytes) -> bytes:
    """Content of the gzip members up to the first that is broken or cut off, of that what can be read."""
    out = []
    while content[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(wbits=31)
        try:
            out.append(member.decompress(content))
        except zlib.error:
            break
        content = member.unused_data if member.eof else b""
    return b"".join(out)


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes, bool]]:
    """(headers, block, whole) of every record, by its Content-Length; a record without a length, or with less than that, is not whole."""
    if content[:2] == b"\x1f\x8b":
        content = inflated(content)
    at, view = 0, memoryview(content)
    while (at := content.find(b"WARC/", at)) >= 0:
        end = content.find(b"\r\n\r\n", at)
        if end < 0:
            return
        lines = content[at:end].decode("utf-8", "replace").split("\r\n")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = _number(head.get("content-length"))
        if size is None:  # the next record starts wherever its version line stands
            yield head, b"", False
            at = end + 4
            continue
        block = bytes(view[end + 4:end + 4 + size])
        yield head, block, len(block) == size
        at = end + 4 + size + 4


def _number(text: str | None, most: int = 18) -> int | None:
    return int(text) if text and len(text) <= most and text.isascii() and text.isdigit() else None


def unchunked(block: bytes) -> bytes | None:
    """Payload of an HTTP message; None if its framing is broken."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        return None
    if b"transfer-encoding: chunked" not in head.lower():
        return body
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            return None
        digits = body[at:line].split(b";")[0].strip()
        if not HEX.fullmatch(digits):
            return None
        size = int(digits, 16)
        if size == 0:
            return b"".join(out)
        piece = body[line + 2:line + 2 + size]
        if len(piece) < size or body[line + 2 + size:line + 4 + size] != b"\r\n":
            return None
        out.append(piece)
        at = line + 4 + size


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Raw records of all files below ``path``."""
    names = [x.split()[0] for x in READ.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, 1):
            rows = []
            for head, block, whole in parse(part.column(0)[0].as_py()):
                number, total = _number(head.get("warc-segment-number"), 9), _number(head.get("warc-segment-total-length"))
                whole = whole and (number is not None or not head.get("warc-segment-number"))
                # a broken segment stands alone, and its group lacks it
                number = number if whole else None
                rows.append((head.get("warc-record-id"), head.get("warc-type"), head.get("warc-segment-origin-id"), number, total, head.get("warc-target-uri"), head.get("x-key"), head.get("x-refers-to-key"), block,
                             head.get("warc-payload-digest", "").removeprefix("sha256:") or None, whole))
                if len(rows) >= 128:
                    yield _batch(rows, names)
                    rows = []
            if rows:
                yield _batch(rows, names)

    # one file per split: a batch must not hold several archives
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, READ)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.string(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def reassemble(records: DataFrame) -> DataFrame:
    """Segmented records joined: one group per origin identifier, in order of segment number, whole and of the declared length."""
    parts = records.filter(F.col("segment").isNotNull()).withColumn("_of", F.coalesce("origin", "record_id"))
    head = F.col("segment") == 1
    one = parts.groupBy("_of").agg(
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("_s"), F.max("total").alias("total"),
        *[F.max(F.when(head, F.col(c))).alias(c) for c in ("type", "target", "key", "refers_to")])
    # bytes pass as strings without being checked or changed
    joined = F.array_join(F.transform("_s", lambda s: s["block"].cast("string")), "").cast("binary")
    one = one.withColumn("block", joined)
    whole = (F.col("_s")[F.size("_s") - 1]["segment"] == F.size("_s")) & (F.col("_s")[0]["segment"] == 1) & (F.length("block") == F.col("total"))
    return one.select(F.col("_of").alias("record_id"), "type", "target", "key", "refers_to", F.coalesce(whole, F.lit(False)).alias("ok"), "block",
                      F.lit(None).cast("string").alias("digest"))


def decoded(blocks: DataFrame) -> DataFrame:
    """Blocks (record_id, type, target, key, refers_to, ok, block, digest) to payloads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, 64):
            whole, kinds = part.column(5).to_pylist(), part.column(1).to_pylist()
            body = [b"" if k == "revisit" else unchunked(b.as_py()) if ok else None for b, ok, k in zip(part.column(6), whole, kinds, strict=True)]
            ok = pa.array([x is not None for x in body])
            yield pa.RecordBatch.from_arrays([*part.columns[:5], ok, pa.array(body, pa.binary()), part.column(7)], names=[x.split()[0] for x in PAYLOADS.split(", ")])

    return blocks.select("record_id", "type", "target", "key", "refers_to", "ok", "block", "digest").mapInArrow(run, PAYLOADS)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every page of the archive with its payload; a revisit has an empty one and names the key and the digest of its response."""
    records = read_records(spark, path)
    single = records.filter(F.col("segment").isNull()).withColumn("ok", F.col("whole"))
    columns = ["record_id", "type", "target", "key", "refers_to", "ok", "block", "digest"]
    return decoded(single.select(*columns).unionByName(reassemble(records).select(*columns)))


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS n FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p WHERE n >= {LEAST_REVISIT} GROUP BY digest)
SELECT page_id, n::BIGINT AS payload_bytes, p.digest AS payload_digest, CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM p LEFT JOIN f USING (digest)"""


@checks.add("op5_warc_reassembly", ORACLE)
def op5_warc_reassembly(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archive(table(spark, d, "pages"), path)
    back = read_archive(spark, path)
    # payloads go no further than their size and digest
    got = back.select(F.col("type").alias("record_type"), F.expr("try_cast(nullif(key, '') AS bigint)").alias("page_id"), F.col("refers_to").cast("long").alias("refers_to"),
                      F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "digest")
    got = stored(got, "read")
    again = F.col("record_type") == "revisit"
    named = got.filter(again).select(F.col("refers_to").alias("_key"), F.col("digest").alias("_digest")).distinct()
    full = got.filter("record_type = 'response'").select(F.col("page_id").alias("_key"), F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest"))
    known = stored(full.join(named, ["_key", "_digest"], "left_semi").groupBy("_key", "_digest").agg(F.max("_bytes").alias("_bytes")), "named")
    out = got.join(known, (got["refers_to"] == known["_key"]) & (got["digest"] == known["_digest"]), "left")
    return out.select("page_id", F.when(again, F.col("_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
                      F.when(again, F.col("_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to")
