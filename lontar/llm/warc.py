"""WARC archives: a writer, and a splittable reader of compressed archives.

Writer: each task writes one file of gzip members, a member for each record. Of equal payloads
of at least `least` bytes the one with the smallest id becomes the response, the others
revisit it.

Reader: an archive is cut into byte ranges and each task takes some. In its range a task looks
for the gzip magic, takes a place for a record only if a member that decodes to a WARC header starts
there (compressed data may hold the magic by chance), and owns the records that start inside the
range; the last of them is read on beyond its end. Ranges can thus be read in any order and on
any machine.

Files are opened with pyarrow's file systems by URI, in the shared folder, so any store that they
know can hold them. Only files whose tasks succeeded are listed: the list is written once to the
shared folder, and a lost task's file is left unread.

Null text is an empty payload. A null id is written as such and never becomes the target of a revisit
unless all equal payloads have null ids. Equal ids are separate records.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lontar.llm import textscan
from lontar.llm.common import materialise, scratch

MAGIC = b"\x1f\x8b\x08"
LEVEL = 4
#: A member is taken for a record if so many bytes of it decode to the start of a WARC header.
PROBE = 1024
DATE = "2026-01-01T00:00:00Z"
#: A payload is hot with more than one in so many of all rows. The most tasks that read.
HOT, MOST_TASKS = 1000, 50_000


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri else pafs.FileSystem.from_uri("file://" + uri[uri.startswith("file:") * 5 :])


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, uncompressed. A revisit keeps the HTTP header, with the length of the full payload, and no body."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    name = "null" if page_id is None else page_id
    clean = "".join(c if c.isprintable() else " " for c in url or "")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least: int = 100) -> DataFrame:
    """Write archives below `folder`; the list of them: (path, bytes, records)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), text.alias("text"), F.sha2(text.cast("binary"), 256).alias("digest"))
    # Only digests that occur twice are needed beside the pages: partial counts first, so a hot payload costs a row a task.
    twice = rows.filter(F.octet_length("text") >= least).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).filter("n > 1")
    twice = materialise(twice.select(F.col("digest").alias("__digest"), "first", "n"))
    # Payloads with more than one in HOT of all rows are fewer than HOT, so they may be broadcast; their rows are dealt by id.
    hot = F.col("n") * HOT > rows.count()
    rows = rows.join(F.broadcast(twice.filter(hot).select(F.col("__digest").alias("__hot"), F.col("first").alias("__first"))), F.col("digest") == F.col("__hot"), "left")
    dealt = F.when(F.col("__hot").isNull(), F.col("digest")).otherwise(F.concat("digest", F.lit(":"), F.coalesce(F.col("id").cast("string"), F.lit("null"))))
    marked = rows.withColumn("__dealt", dealt).join(twice.filter(~hot).drop("n"), F.col("__dealt") == F.col("__digest"), "left")
    marked = marked.select("id", "url", "text", "digest", F.coalesce("__first", "first").alias("first"))
    target, _ = _open(folder)
    target.create_dir(_open(folder)[1], recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        name, out, size, count, kept = f"{uuid.uuid4().hex}.warc.gz", None, 0, 0, set()
        for whole in batches:
            for batch in textscan.pieces(whole, "text"):
                for page_id, url, html, digest, first in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "text", "digest", "first"))):
                    refers = first if first is not None and first != page_id else None
                    data = member(record(page_id, url, html.encode(), digest, refers))
                    if out is None:
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    out.write(data)
                    size, count = size + len(data), count + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([size], pa.int64()), pa.array([count], pa.int64())], names=["path", "bytes", "records"])

    return materialise(marked.mapInArrow(run, "path string, bytes long, records long"))


class Source:
    """Random access to a file; the last block read is kept, so neighbouring records cost one read."""

    def __init__(self, uri: str, block: int = 1 << 20):
        fs, path = _open(uri)
        self.file, self.block = fs.open_input_file(path), block
        self.size = self.file.size()
        self.start, self.held = 0, b""

    def at(self, start: int, n: int) -> bytes:
        n = min(n, max(0, self.size - start))
        if not self.start <= start <= start + n <= self.start + len(self.held):
            self.start, self.held = start, self.file.read_at(min(max(n, self.block), self.size - start), start) if n else b""
        return self.held[start - self.start : start - self.start + n]


def is_record(source: Source, at: int) -> bool:
    """Whether a gzip member that decodes to a WARC header starts here."""
    try:
        return zlib.decompressobj(31).decompress(source.at(at, PROBE), 64).startswith(b"WARC/1.")
    except zlib.error:
        return False


def _whole(source: Source, at: int) -> tuple[bytes, int]:
    """The decoded member that starts here, and where the next one starts."""
    decoder, parts, pos, step = zlib.decompressobj(31), [], at, 1 << 12
    while not decoder.eof:
        data = source.at(pos, step)
        step = min(2 * step, source.block)
        if not data:
            raise ValueError(f"truncated gzip member at byte {at}")
        parts.append(decoder.decompress(data))
        pos += len(data)
    return b"".join(parts), pos - len(decoder.unused_data)


def records_in(source: Source, low: int, high: int) -> Iterator[tuple[int, bytes]]:
    """(start, decoded record) of the records that start in [low, high)."""
    at = low
    while at < high:
        window = source.at(at, min(source.block, high - at) + len(MAGIC) - 1)
        hit = window.find(MAGIC)
        if hit < 0:
            at += max(1, len(window) - len(MAGIC) + 1)
            continue
        at += hit
        if not is_record(source, at):
            at += 1
            continue
        while at < high and is_record(source, at):  # members follow each other
            data, end = _whole(source, at)
            yield at, data
            at = end


def parse(data: bytes) -> tuple[dict[str, str], int, bytes]:
    """Header fields, the length of the full payload by the HTTP header, and the payload held here."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next((int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")), len(payload))
    return fields, length, payload


FIELDS = "path string, start long, record_type string, record_id string, refers_to string, url string, payload_digest string, payload_bytes long, intact boolean"


def read(spark: SparkSession, files: DataFrame, split: int = 4 << 20, keep_payload: bool = False) -> DataFrame:
    """The records of the listed files (columns path, bytes), one row each; intact: the payload has the length and digest stated.

    A revisit holds no payload and counts as intact.
    """
    ranges = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split).cast("long"))).alias("low"), F.col("bytes")).filter("bytes > 0")
    number = files.agg(F.sum(F.ceil(F.col("bytes") / split))).first()[0] or 1
    ranges = ranges.repartition(max(1, min(int(number), MOST_TASKS)))  # a number that is given is not coalesced: a task for each range
    wanted = [f.split()[0] for f in FIELDS.split(", ")] + ["payload"] * keep_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, low in zip(batch.column("path").to_pylist(), batch.column("low").to_pylist()):
                source, rows, held = Source(path), [], 0
                for start, data in records_in(source, low, low + split):
                    fields, length, payload = parse(data)
                    kind, digest = fields.get("warc-type"), fields.get("warc-payload-digest", "").removeprefix("sha256:")
                    intact = kind == "revisit" or (length == len(payload) and hashlib.sha256(payload).hexdigest() == digest)
                    rows.append((path, start, kind, fields.get("warc-record-id"), fields.get("warc-refers-to"), fields.get("warc-target-uri"), digest, length, intact, payload)[: len(wanted)])
                    held += len(payload)
                    if held > 8 << 20:
                        yield _batch(rows, wanted)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, wanted)

    return ranges.mapInArrow(run, FIELDS + ", payload binary" * keep_payload)


_KIND = {"start": pa.int64(), "payload_bytes": pa.int64(), "intact": pa.bool_(), "payload": pa.binary()}


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _KIND.get(n, pa.string())) for i, n in enumerate(names)], names=names)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write the pages as archives in the shared folder and read every record back."""
    files = write(pages, scratch(spark, "warc"))
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?[0-9]+)>$", 1)
    page_id = lambda c: F.when(number(c) != "", number(c)).cast("long")
    return read(spark, files).select(page_id("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_id("refers_to").alias("refers_to"), "intact")
