"""Zstandard WARC archives: writing, and reading by frames.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary of all
later frames; each record is one frame of its own with its size in the frame header. The reader
takes the dictionary from that frame, finds each frame's end from its block headers, decodes
frame by frame into a buffer of the declared size, and checks record headers and lengths.

Archives are rolled by bytes: a task closes one when it has ``ARCHIVE_BYTES`` or more and begins the next, with
a dictionary of its own. They are written through Spark's text writer, one row and one file for each archive, so
they go to any file system with Spark's task commit: a lost executor's part is written again and no half
file stays. The separator that this writer puts after a row is an empty skippable frame, which decoders
pass over. Reading takes whole files (``binaryFile``), so a worker holds one archive at a time.

Defined results: a null payload is written as an empty one; empty payloads are payloads like
others; rows without an id are written with the id "null" and read back as null; equal payloads
make one response (that of the largest id) and revisits of it; repeated rows (same id and payload)
are all response when theirs is the largest id; an empty table gives archives without
records. What can't be read gives a row with ``error`` and the frame's offset, and reading goes
on at the next frame if the frame's end is known.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import as_bytes
from .common import shared_path, table

DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
#: An empty skippable frame, all of it ASCII, so that a text writer can use it as its separator.
SEPARATOR = "P*M\x18\x00\x00\x00\x00"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The dictionary is a compression aid fitted on the first payloads of each archive, at most so many.
DICTIONARY_SAMPLES, DICTIONARY_BYTES, LEVEL = 200, 16 << 10, 3
ARCHIVE_BYTES = 32 << 20
#: The largest record that is read: more than a row of a table can hold.
MAX_RECORD = (1 << 31) - 1
SALTS = 16

RECORD = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("record_type", T.StringType()),
    T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_digest", T.StringType()),
    T.StructField("refers_to", T.LongType()),
    T.StructField("payload", T.BinaryType()),
    T.StructField("offset", T.LongType()),
    T.StructField("error", T.StringType()),
])


class BadArchive(ValueError):
    """What the bytes hold isn't a valid archive."""


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---- frames


def skippable(payload: bytes, magic: int = DICTIONARY_MAGIC) -> bytes:
    return struct.pack("<II", magic, len(payload)) + payload


def frame_end(data: memoryview, at: int) -> int:
    """The end of the Zstandard frame that begins at ``at``, from its header and block headers."""
    if len(data) < at + 5 or struct.unpack_from("<I", data, at)[0] != FRAME_MAGIC:
        raise BadArchive("no frame here")
    descriptor = data[at + 4]
    single, checksum = descriptor >> 5 & 1, descriptor >> 2 & 1
    content = (1 if single else 0, 2, 4, 8)[descriptor >> 6]
    at += 5 + (not single) + (0, 1, 2, 4)[descriptor & 3] + content
    while True:
        if len(data) < at + 3:
            raise BadArchive("the frame is cut off")
        head = data[at] | data[at + 1] << 8 | data[at + 2] << 16
        kind, size = head >> 1 & 3, head >> 3
        if kind == 3:
            raise BadArchive("reserved block type")
        at += 3 + (1 if kind == 1 else size)
        if head & 1:
            break
    at += 4 * checksum
    if at > len(data):
        raise BadArchive("the frame is cut off")
    return at


def frames(data: memoryview) -> Iterator[tuple[int, memoryview, bool]]:
    """(offset, bytes, skippable) of each frame. A broken end raises BadArchive after the whole ones."""
    at = 0
    while at < len(data):
        if len(data) < at + 8:
            raise BadArchive(f"the frame at {at} is cut off")
        magic, size = struct.unpack_from("<II", data, at)
        if magic >> 4 == 0x184D2A5:
            end = at + 8 + size
            if end > len(data):
                raise BadArchive(f"the skippable frame at {at} is cut off")
            yield at, data[at:end], True
        else:
            end = frame_end(data, at)
            yield at, data[at:end], False
        at = end


def load_dictionary(frame: memoryview) -> zstandard.ZstdCompressionDict | None:
    """The dictionary in a leading skippable frame, itself compressed or not."""
    if struct.unpack_from("<I", frame)[0] != DICTIONARY_MAGIC:
        return None
    raw = bytes(frame[8:])
    if raw[:4] == struct.pack("<I", FRAME_MAGIC):
        raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=MAX_RECORD)
    return zstandard.ZstdCompressionDict(raw) if raw else None


# ---- records


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record with its payload, or a revisit record with the HTTP head alone."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to is not None else head + payload
    name = "null" if page_id is None else str(page_id)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {(url or '').translate({10: '%0A', 13: '%0D'})}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _number(value: str | None, what: str) -> int:
    if value is None or not value.isascii() or not value.isdigit():
        raise BadArchive(f"{what} isn't a length")
    return int(value)


def _page(value: str | None) -> int | None:
    if value is None or not value.startswith("<urn:page:") or not value.endswith(">"):
        raise BadArchive("no record id")
    name = value[10:-1]
    return None if name == "null" else int(name)


def parse(data: bytes) -> dict:
    """The fields of one record. Raises BadArchive where headers, lengths or digests don't agree."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or version not in ("WARC/1.0", "WARC/1.1"):
        raise BadArchive("no WARC header")
    fields: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise BadArchive("a header line without a name")
        if fields.setdefault(name.lower(), value.strip()) != value.strip():
            raise BadArchive(f"two values of {name}")
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise BadArchive(f"no {name}")
    n = _number(fields["content-length"], "Content-Length")
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise BadArchive("the block hasn't the length that its header gives")
    block = rest[:n]
    if (digest := fields.get("warc-block-digest")) and digest != f"sha1:{base32_sha1(block)}":
        raise BadArchive("the block hasn't its digest")
    http, gap, payload = block.partition(b"\r\n\r\n")
    said = dict((a.strip().lower(), b.strip()) for a, _, b in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:]))
    length = _number(said.get("content-length"), "the payload's length")
    kind, digest = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha1:")
    out = {"page_id": _page(fields["warc-record-id"]), "url": fields.get("warc-target-uri") or None, "record_type": kind, "payload_bytes": length, "payload_digest": digest, "refers_to": None, "payload": None}
    if kind == "response":
        if len(payload) != length or base32_sha1(payload) != digest:
            raise BadArchive("the payload hasn't its length or digest")
        out["payload"] = payload
    elif kind == "revisit":
        if payload:
            raise BadArchive("a revisit with a payload")
        out["refers_to"] = _page(fields.get("warc-refers-to"))
    return out


def decode(data: bytes) -> Iterator[dict]:
    """Every record of an archive, and a row with ``error`` for each that isn't valid."""
    none = dict.fromkeys(RECORD.names)
    view, opener, first = memoryview(data).cast("B"), zstandard.ZstdDecompressor(), True
    offset = 0
    try:
        for offset, frame, skip in frames(view):
            if skip:
                if first and (found := load_dictionary(frame)):
                    opener = zstandard.ZstdDecompressor(dict_data=found)
            else:
                try:
                    size = zstandard.frame_content_size(frame)
                    if not 0 <= size <= MAX_RECORD:
                        raise BadArchive("the frame doesn't say its size, or one too large")
                    body = opener.decompress(frame, max_output_size=size)
                    if len(body) != size:
                        raise BadArchive("the frame hasn't the size that its header gives")
                    yield none | parse(body) | {"offset": offset}
                except (BadArchive, zstandard.ZstdError, ValueError) as e:
                    yield none | {"offset": offset, "error": str(e)}
            first = False
    except BadArchive as e:
        yield none | {"offset": offset, "error": str(e)}


# ---- distributed


def _compress(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows (page_id, url, payload, refers_to) -> archives, the dictionary first."""
    writer, out, size = None, [], 0

    def archive() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], names=["archive"])

    for batch in batches:
        ids, urls, refers = (batch.column(i).to_pylist() for i in (0, 1, 3))
        payloads = as_bytes(batch.column(2))
        for k, row in enumerate(zip(ids, urls, payloads, refers)):
            if writer is None:
                out, raw = [], _fit(payloads[k : k + DICTIONARY_SAMPLES])
                out.append(skippable(raw))
                size = len(out[0])
                writer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw) if raw else None, write_content_size=True, write_checksum=True)
            out.append(writer.compress(record(*row)))
            size += len(out[-1])
            if size >= most:
                yield archive()
                writer = None
    if writer:
        yield archive()


def _fit(samples: list[bytes]) -> bytes:
    """A dictionary from samples; where there are too few to fit one, their first bytes as they are."""
    samples = [s[: 64 << 10] for s in samples if s]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) >= 20 else b"".join(samples)[:DICTIONARY_BYTES]
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def _read(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(f, {"LongType()": pa.int64(), "StringType()": pa.string(), "BinaryType()": pa.binary()}[str(RECORD[f].dataType)]) for f in names])
    for batch in batches:
        for i in range(batch.num_rows):
            rows, size = [], 0
            for r in decode(batch.column(0)[i].as_buffer()):
                rows.append({n: r[n] for n in names})
                size += len(r["payload"] or b"")
                if size > 16 << 20 or len(rows) >= 8192:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)


def revisits(pages: DataFrame) -> DataFrame:
    """``page_id, url, payload`` rows with ``refers_to``: the largest id of an equal payload, null for itself.

    Only payloads that occur more than once are joined back, and each of these is dealt over
    SALTS keys, so a payload of a third of all rows is no single task's.
    """
    digest = F.sha1(F.coalesce("payload", F.lit("")))
    hashed = pages.withColumn("__rl_digest", digest).withColumn("__rl_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    shared = pages.groupBy(digest.alias("__rl_d")).agg(F.max("page_id").alias("__rl_last"), F.count("*").alias("n")).filter("n > 1")
    shared = shared.select("__rl_d", "__rl_last", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("__rl_s"))
    out = hashed.join(shared, (F.col("__rl_digest") == F.col("__rl_d")) & (F.col("__rl_salt") == F.col("__rl_s")), "left")
    return out.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("__rl_last")), F.col("__rl_last")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """``page_id, url, payload`` rows -> archives of about ``archive_bytes`` at most, or one larger record, below ``path``."""
    found = revisits(pages).mapInArrow(functools.partial(_compress, most=archive_bytes), "archive binary")
    found.select(F.col("archive").cast("string").alias("value")).write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", 1).text(path)


def read_archives(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The records of all archives below ``path``."""
    names = columns or RECORD.names
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(functools.partial(_read, names=names), T.StructType([RECORD[n] for n in names]))


def op1_warc(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").alias("payload"))
    path = shared_path(spark, "warc")
    write_archives(pages, path)
    return read_archives(spark, path, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error"])
