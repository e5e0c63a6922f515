"""WARC records in seekable Zstandard bundles.

Records are grouped into independent frames; a skippable frame at the end of a bundle holds the seek
table (compressed and plain size of every frame).  The index maps a record to its bundle, frame and
the offset inside the plain frame, so one record costs one frame.  Of records with equal payloads the
one with the largest id carries them, the others are revisit records that refer to it.

Bundles lie in the shared folder under names no other attempt of a task uses; the index, written when
the tasks are done, names those that count, so a lost executor leaves unused files and nothing else.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from journeyloom.config import SkewConfig
from journeyloom.llm.common import prepare_workers, table
from journeyloom.operators.skew import lookup_join
from journeyloom.sources.workspace import scratch_folder, settle

# Fixed values of the formats.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
_SHA1_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
INDEX = "record_id string, bundle string, frame int, offset bigint, length bigint"
READ = "record_id string, target_uri string, record_type string, refers_to string, payload_digest string, payload_bytes bigint, payload binary"


@dataclass(frozen=True)
class BundleLayout:
    frame_bytes: int = 1 << 20  # plain size from which a frame is closed
    bundle_bytes: int = 256 << 20  # compressed size from which a bundle is closed
    level: int = 3


def base32_sha1(digest_hex: Column) -> Column:
    """Upper-case base32 of a hexadecimal SHA-1: five hexadecimal digits are four letters."""
    letters = []
    for at in range(1, 41, 5):
        number = F.conv(F.substring(digest_hex, at, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            letters.append(F.substring(F.lit(_SHA1_BASE32), F.shiftright(number, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*letters)


def with_revisits(records: DataFrame, key: str, payload: str, skew: SkewConfig = SkewConfig(), min_bytes: int = 0) -> DataFrame:
    """Adds ``digest`` (base32) and ``carrier``: the largest key with the same payload, null if it is alone.

    Payloads under ``min_bytes`` carry themselves.  A null key is smaller than any other.
    """
    marked = records.withColumn("_sha", F.sha2(payload, 256)).withColumn("digest", base32_sha1(F.sha1(payload)))
    shared = (
        marked.where(F.length(payload) >= min_bytes).groupBy("_sha").agg(F.max(key).alias("carrier"), F.count("*").alias("_copies")).where("_copies > 1")
    )
    return lookup_join(marked, shared, "_sha", "_copies", F.coalesce(F.col(key).cast("string"), F.lit("")), skew).drop("_sha", "_copies")


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _local_uri(uri: str) -> str:
    """``file:/x`` as Spark writes it, as a full URI."""
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri


class BundleWriter:
    """One open bundle; add() returns where a record went."""

    def __init__(self, folder: str, layout: BundleLayout):
        import zstandard

        self.layout, self.folder = layout, folder
        self.compress = zstandard.ZstdCompressor(level=layout.level).compress
        self.out = None

    def add(self, record: bytes) -> tuple[str, int, int, int]:
        if self.out is None:
            self.name = f"{self.folder}/{uuid.uuid4().hex}.warc.zst"
            system, path = _file_system(self.name)
            system.create_dir(path.rpartition("/")[0], recursive=True)
            self.out, self.sizes, self.frame, self.plain = system.open_output_stream(path, compression=None), [], [], 0
        place = (self.name, len(self.sizes), self.plain, len(record))
        self.frame.append(record)
        self.plain += len(record)
        if self.plain >= self.layout.frame_bytes:
            self._close_frame()
            if sum(c for c, _ in self.sizes) >= self.layout.bundle_bytes:
                self.close()
        return place

    def _close_frame(self) -> None:
        packed = self.compress(b"".join(self.frame))
        self.out.write(packed)
        self.sizes.append((len(packed), self.plain))
        self.frame, self.plain = [], 0

    def close(self) -> None:
        if self.out is None:
            return
        if self.frame:
            self._close_frame()
        entries = b"".join(struct.pack("<II", c, p) for c, p in self.sizes)
        footer = struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer)
        self.out.close()
        self.out = None


class BundleReader:
    """Random access to the frames of one bundle, over its seek table."""

    def __init__(self, uri: str):
        import zstandard

        system, path = _file_system(uri)
        self.file = system.open_input_file(path)
        self.expand = zstandard.ZstdDecompressor().decompress
        end = self.file.size()
        count, _, magic = struct.unpack("<IBI", self.file.read_at(9, end - 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"{uri} has no seek table")
        sizes = struct.unpack(f"<{2 * count}I", self.file.read_at(8 * count, end - 9 - 8 * count))
        self.frames, at = [], 0
        for packed, plain in zip(sizes[::2], sizes[1::2]):
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, number: int) -> bytes:
        at, packed, plain = self.frames[number]
        return self.expand(self.file.read_at(packed, at), max_output_size=plain)


def record_bytes(record_id: str, uri: str | None, digest: str, size: int, payload: bytes, refers_to: str | None) -> bytes:
    """One WARC record; a revisit has no block, its payload's size and digest are in the header."""
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:record:{record_id}>"]
    if uri:
        lines.append(f"WARC-Target-URI: {''.join(uri.splitlines())}")
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:record:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = payload if refers_to is None else b""
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode()
    return head + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(frame: bytes, offset: int) -> dict:
    end = frame.index(b"\r\n\r\n", offset)
    lines = frame[offset:end].decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    size = int(fields["Content-Length"])
    return fields | {"block": frame[end + 4 : end + 4 + size]}


def write_bundles(records: DataFrame, folder: str, layout: BundleLayout = BundleLayout()) -> DataFrame:
    """Write (record_id, uri, payload, digest, refers_to) to bundles under ``folder``; the index, written down."""
    prepare_workers(records.sparkSession)
    folder = _local_uri(folder)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = BundleWriter(folder, layout)
        rows: list[tuple] = []
        for batch in batches:
            for record_id, uri, payload, digest, refers_to in zip(*[c.to_pylist() for c in batch.columns]):
                rows.append((record_id, *writer.add(record_bytes(record_id, uri, digest, len(payload), payload, refers_to))))
        writer.close()
        for at in range(0, len(rows), 10_000):
            columns = list(zip(*rows[at : at + 10_000]))
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [x.split()[0] for x in INDEX.split(", ")])

    chosen = records.select("record_id", "uri", "payload", "digest", "refers_to")
    return settle(chosen.mapInArrow(run, INDEX), "warc_index")


FRAMES_A_TASK = 32


def read_records(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records an index names, read frame by frame; a response whose digest does not fit is an error."""
    prepare_workers(index.sparkSession)
    # One row per frame.  It weighs a hundred bytes and stands for a megabyte, so frames are dealt out by number.
    frames = index.groupBy("bundle", "frame").agg(F.sort_array(F.collect_list("offset")).alias("offsets"))
    tasks = 1 + index.select("bundle", "frame").distinct().count() // FRAMES_A_TASK
    frames = frames.repartition(tasks, "bundle", "frame")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, reader = [x.split()[0] for x in READ.split(", ")], (None, None)
        kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary())
        for batch in batches:
            for bundle, number, offsets in sorted(zip(*[c.to_pylist() for c in batch.columns])):
                if reader[0] != bundle:
                    reader = (bundle, BundleReader(bundle))
                frame, rows = reader[1].frame(number), []
                for offset in offsets:
                    r = parse_record(frame, offset)
                    digest = r["WARC-Payload-Digest"].removeprefix("sha1:")
                    response = r["WARC-Type"] == "response"
                    if response and base64.b32encode(hashlib.sha1(r["block"]).digest()).decode() != digest:
                        raise ValueError(f"{bundle}: digest of {r['WARC-Record-ID']} does not fit")
                    name = lambda f: r[f][len("<urn:record:") : -1] if f in r else None
                    rows.append(
                        (name("WARC-Record-ID"), r.get("WARC-Target-URI"), r["WARC-Type"], name("WARC-Refers-To"), digest, int(r["X-Payload-Length"]), r["block"] if with_payload and response else None)
                    )
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return frames.mapInArrow(run, READ)


def archive_pages(pages: DataFrame, folder: str, layout: BundleLayout = BundleLayout(), skew: SkewConfig = SkewConfig()) -> DataFrame:
    """Write one record per ``pages`` row (page_id, url, html) and return the index.

    A null html is an empty payload; a null url leaves out the target.  Rows that repeat page_id and
    payload are equal records, so all copies of the carrier are responses.  A null page_id is written
    as an empty id and is smaller than any other.  Further columns are not archived.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    marked = with_revisits(pages.select("page_id", F.col("url").alias("uri"), payload.alias("payload")), "page_id", "payload", skew)
    own = F.col("carrier").isNull() | F.col("page_id").eqNullSafe(F.col("carrier"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = marked.select(text("page_id").alias("record_id"), "uri", "payload", "digest", F.when(~own, text("carrier")).alias("refers_to"))
    return write_bundles(rows, folder, layout)


def op1_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{scratch_folder(spark)}/warc-{uuid.uuid4().hex}"
    records = read_records(archive_pages(table(spark, sf_dir, "pages"), folder), with_payload=False)
    number = lambda c: F.when(F.col(c) != "", F.col(c).cast("bigint"))
    return records.select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to")
    )


def oracle_sql() -> str:
    letter = lambda k, shift: f"substr('{_SHA1_BASE32}', ((('0x' || substr(h, {5 * k + 1}, 5))::INT >> {shift}) & 31) + 1, 1)"
    digest = " || ".join(letter(k, s) for k in range(8) for s in (15, 10, 5, 0))
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, body, sha1(body) AS h, max(page_id) OVER (PARTITION BY body) AS carrier FROM p)
SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes, {digest} AS payload_digest,
       CASE WHEN page_id = carrier THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = carrier THEN NULL ELSE carrier END AS refers_to
FROM h"""
