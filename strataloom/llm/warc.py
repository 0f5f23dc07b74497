"""WARC records in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a bundle ends with a skippable frame that holds the seek table
(compressed and decompressed size of each frame, then the footer). An index maps each record identifier to its frame and
to its offset in the decompressed frame, so one record is read by decompressing one frame. Bundles are rows of a binary
table that Spark's own writer commits, so a lost executor or a repeated task leaves no half bundle.

Equal payloads of at least ``MIN_REVISIT`` bytes are stored once: the record with the largest page_id is the response and
the others are revisits that name it. Defined results: a null html is an empty payload; rows that share the largest
page_id of their payload are all responses; a null page_id never becomes the response while another id exists; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bounded_batches, materialize

MIN_REVISIT = 1000
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 8 << 20

# Fixed values of the Zstandard seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

BUNDLE_SCHEMA = "bundle string, n_records long, content binary, index binary"
RECORD_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, bundle string, frame int, frame_offset long"


def record_urn(page_id: int | None) -> str:
    """Record identifier of a page: a urn that holds its id."""
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def render_record(page_id, url, kind: str, digest: str, size: int, refers_to, payload: bytes) -> bytes:
    """One WARC/1.1 record. A revisit has an empty block and carries the length and digest of the full payload in its header."""
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_urn(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + " ".join(url.split()))
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_urn(refers_to)}"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}", "", ""]
    return "\r\n".join(lines).encode() + payload + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(header fields, block, place after the record)."""
    end = data.index(b"\r\n\r\n", at)
    first, *rest = data[at:end].decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record here")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in rest)
    size = int(fields["Content-Length"])
    block = data[end + 4 : end + 4 + size]
    if len(block) != size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
        raise ValueError("the record is cut short")
    return fields, block, end + 8 + size


class BundleWriter:
    """Collects records into frames and frames into one seekable bundle."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.frame_bytes, self.compress = frame_bytes, zstandard.ZstdCompressor(level=level).compress
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.open: list[bytes] = []
        self.at = 0
        self.index: list[tuple[int, int, int]] = []

    def add(self, record: bytes) -> None:
        self.index.append((len(self.frames), self.at, len(record)))
        self.open.append(record)
        self.at += len(record)
        if self.at >= self.frame_bytes:
            self._close()

    def _close(self) -> None:
        if self.open:
            packed = self.compress(b"".join(self.open))
            self.frames.append(packed)
            self.sizes.append((len(packed), self.at))
            self.open, self.at = [], 0

    @property
    def size(self) -> int:
        return sum(x for x, _ in self.sizes)

    def finish(self) -> bytes:
        self._close()
        table = b"".join(struct.pack("<II", *x) for x in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(place, compressed size, decompressed size) of each frame, from the footer alone."""
    count, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    base, at, out = len(bundle) - 9 - width * count, 0, []
    if struct.unpack("<II", bundle[base - 8 : base]) != (SKIPPABLE_MAGIC, width * count + 9):
        raise ValueError("the seek table's frame is damaged")
    for k in range(count):
        packed, size = struct.unpack_from("<II", bundle, base + width * k)
        out.append((at, packed, size))
        at += packed
    return out


def read_frame(bundle: bytes, frame: tuple[int, int, int]) -> bytes:
    at, packed, size = frame
    return zstandard.ZstdDecompressor().decompress(bundle[at : at + packed], max_output_size=size)


def read_at(bundle: bytes, index: bytes, k: int) -> tuple[dict[str, str], bytes]:
    """Record ``k`` of a bundle through the index: one frame is decompressed."""
    frame, offset, _ = struct.unpack_from("<IQQ", index, 20 * k)
    fields, block, _ = parse_record(read_frame(bundle, seek_table(bundle)[frame]), offset)
    return fields, block


def classify_records(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_digest, payload_bytes, record_type, refers_to for each page."""
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload")
    ).select("*", F.sha1("payload").alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    narrow = base.filter(F.col("payload_bytes") >= MIN_REVISIT).groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("copies"))
    # The join key is another expression than the grouping key: both sides are then dealt out anew and AQE may split a hot payload.
    keepers = narrow.filter("copies > 1").select(F.concat_ws(":", "payload_digest", "payload_bytes").alias("payload_key"), "keeper")
    keyed = base.withColumn("payload_key", F.concat_ws(":", "payload_digest", "payload_bytes"))
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return (
        keyed.join(keepers, "payload_key", "left")
        .withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
        .withColumn("refers_to", F.when(revisit, F.col("keeper")))
        .withColumn("payload", F.when(revisit, F.lit(b"")).otherwise(F.col("payload")))
        .select("page_id", "url", "payload", "payload_digest", "payload_bytes", "record_type", "refers_to")
    )


def write_bundles(records: DataFrame, bundle_bytes: int = BUNDLE_BYTES, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Archives of classified records: one row per bundle with its content and the index of its records."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made, writer = TaskContext.get().partitionId(), 0, BundleWriter(frame_bytes)

        def done() -> pa.RecordBatch:
            nonlocal made, writer
            content, index = writer.finish(), b"".join(struct.pack("<IQQ", *x) for x in writer.index)
            row = [[f"pages-{task:06d}-{made:06d}.warc.zst"], [len(writer.index)], [content], [index]]
            made, writer = made + 1, BundleWriter(frame_bytes)
            return pa.RecordBatch.from_arrays([pa.array(row[0]), pa.array(row[1], pa.int64()), pa.array(row[2], pa.binary()), pa.array(row[3], pa.binary())], ["bundle", "n_records", "content", "index"])

        for batch in batches:
            for r in zip(*(batch.column(k) for k in range(7)), strict=True):
                page_id, url, payload, digest, size, kind, refers = (x.as_py() for x in r)
                writer.add(render_record(page_id, url, kind, digest, size, refers, payload))
                if writer.size >= bundle_bytes:
                    yield done()
        if writer.index:
            yield done()

    return records.mapInArrow(pack, BUNDLE_SCHEMA)


def _page(urn: str | None) -> int | None:
    return None if urn is None or urn == "<urn:page:null>" else int(urn[len("<urn:page:") : -1])


def read_bundles(bundles: DataFrame) -> DataFrame:
    """Every record of the archives, by the seek tables and the index; digests and lengths of responses are those of the bytes read."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("bundle", pa.string()), ("frame", pa.int32()), ("frame_offset", pa.int64())])
        for batch in batches:
            for name, content, index in zip(batch.column(0), batch.column(2), batch.column(3), strict=True):
                name, content, index, rows = name.as_py(), content.as_py(), index.as_py(), []
                frames, last, data = seek_table(content), -1, b""
                for frame, offset, length in struct.iter_unpack("<IQQ", index):
                    if frame != last:
                        last, data = frame, read_frame(content, frames[frame])
                    fields, block, end = parse_record(data, offset)
                    if end - offset != length:
                        raise ValueError("the index does not fit the records")
                    kind, digest, size = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
                    if kind == "response":
                        if hashlib.sha1(block).hexdigest() != digest:
                            raise ValueError("a payload does not fit its digest")
                        size = len(block)
                    rows.append((_page(fields["WARC-Record-ID"]), size, digest, kind, _page(fields.get("WARC-Refers-To")), fields.get("WARC-Target-URI"), name, frame, offset))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return bundles.mapInArrow(unpack, RECORD_SCHEMA)


def archive(pages: DataFrame, bundle_bytes: int = BUNDLE_BYTES, frame_bytes: int = FRAME_BYTES) -> tuple[DataFrame, DataFrame]:
    """(bundles, records read back). The bundles are written to the shared folder first."""
    bounded_batches(pages.sparkSession)
    bundles = materialize(write_bundles(classify_records(pages), bundle_bytes, frame_bytes), "warc")
    return bundles, read_bundles(bundles)
