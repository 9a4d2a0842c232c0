"""WARC archives in seekable Zstandard bundles.

Records are grouped into frames that decompress independently; a bundle ends in
the seek table of the Zstandard seekable format (a skippable frame that lists
the frames' sizes). The index maps a record's id to its bundle, frame and offset
within the decompressed frame, so one record costs one range read.

Of payloads with equal bytes and at least ``least_revisit`` of them, the record
with the largest key is a response and the others are revisits that name it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import make_folder, materialize, new_folder
from .common import lean
from .files import open_input, open_output, task_file

# Fixed values of the Zstandard seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUMS = 0x80

INDEX_SCHEMA = (
    "record_id string, key long, bundle string, frame long, frame_at long, frame_size long, offset long, length long"
)


def record_id(key: int | None) -> str:
    return f"<urn:record:{'null' if key is None else key}>"


def key_of(record: str) -> int | None:
    value = record.rpartition(":")[2].rstrip(">")
    return None if value == "null" else int(value)


def build_record(key, url, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """A response with its payload, or a revisit with the HTTP head alone."""
    sha1 = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(key)}"]
    if url is not None:
        safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
        lines.append(f"WARC-Target-URI: {safe}")
    lines += [f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{sha1}"]
    if revisit:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(refers_to)}",
        ]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(WARC headers, HTTP head, payload) of each record."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        size = int(headers["Content-Length"])
        block = data[end + 4 : end + 4 + size]
        head, _, payload = block.partition(b"\r\n\r\n")
        yield headers, head, payload
        at = end + 4 + size + 4


class BundleWriter:
    def __init__(self, uri: str, frame_bytes: int, level: int):
        self.uri, self.most = uri, frame_bytes
        self.out, self.pack = open_output(uri), zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int, int]] = []
        self.records: list[tuple] = []
        self.waiting: list[bytes] = []
        self.held = self.at = self.listed = 0

    def add(self, key, data: bytes) -> None:
        self.records.append((record_id(key), key, self.uri, len(self.frames), self.at, self.held, len(data)))
        self.waiting.append(data)
        self.held += len(data)
        if self.held >= self.most:
            self.flush()

    def flush(self) -> None:
        if self.waiting:
            raw = b"".join(self.waiting)
            data = self.pack.compress(raw)
            self.out.write(data)
            self.frames.append((len(data), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.at += len(data)
            self.waiting, self.held = [], 0

    def ready(self) -> list[tuple]:
        """Index rows of finished frames that were not given yet."""
        rows = self.records[self.listed :]
        n = sum(r[3] < len(self.frames) for r in rows)
        self.records = rows[n:]
        self.listed = 0
        return [(*r[:5], self.frames[r[3]][0], *r[5:]) for r in rows[:n]]

    def close(self) -> None:
        self.flush()
        body = b"".join(struct.pack("<III", *f) for f in self.frames)
        tail = struct.pack("<IBI", len(self.frames), CHECKSUMS, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(body) + len(tail)) + body + tail)
        self.out.close()


def read_seek_table(source) -> list[tuple[int, int, int, int]]:
    """(offset, compressed size, size, checksum) of each frame, from the end of the bundle."""
    size = source.size()
    source.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE_MAGIC or flags != CHECKSUMS:
        raise ValueError("no seek table")
    source.seek(size - 9 - 12 * n)
    body, at, frames = source.read(12 * n), 0, []
    for i in range(n):
        packed, raw, check = struct.unpack_from("<III", body, 12 * i)
        frames.append((at, packed, raw, check))
        at += packed
    return frames


def read_frame(source, frame: tuple[int, int, int, int], unpack: zstandard.ZstdDecompressor) -> bytes:
    at, packed, raw, check = frame
    source.seek(at)
    data = unpack.decompress(source.read(packed), max_output_size=raw)
    if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
        raise ValueError("damaged frame")
    return data


def read_record(bundle: str, frame_at: int, frame_size: int, offset: int, length: int) -> tuple[dict[str, str], bytes, bytes]:
    """One record by its index row, with one range read."""
    with open_input(bundle) as source:
        source.seek(frame_at)
        data = zstandard.ZstdDecompressor().decompressobj().decompress(source.read(frame_size))
    return next(parse_records(data[offset : offset + length]))


def plan_revisits(df: DataFrame, payload: str, key: str, least: int) -> DataFrame:
    """``df`` (columns kept) with ``_response``: the key of the record that holds equal bytes.

    Groups are found on narrow rows (two digests, length, key); only groups of
    several records are joined back, and adaptive skew joins split hot ones.
    """
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    marks = {"_sha1": F.sha1(body), "_x": F.xxhash64(body), "_size": F.octet_length(body).cast("long")}
    narrow = df.select(F.col(key).alias("_key"), *[c.alias(n) for n, c in marks.items()]).filter(F.col("_size") >= least)
    groups = narrow.groupBy(*marks).agg(F.max("_key").alias("_response"), F.count(F.lit(1)).alias("_n"))
    groups = groups.filter("_n > 1").drop("_n")
    return df.withColumns(marks).join(groups, list(marks), "left").drop(*marks)


def write_warc(
    df: DataFrame,
    key: str = "page_id",
    url: str = "url",
    payload: str = "html",
    least_revisit: int = 1000,
    frame_bytes: int = 256 << 10,
    bundle_bytes: int = 1 << 30,
    level: int = 3,
    date: str = "2000-01-01T00:00:00Z",
) -> DataFrame:
    """Write a record for every row; returns the index (see ``INDEX_SCHEMA``).

    Null payloads are empty, a null url is left out, null keys are written as
    ``null`` and never hold a payload for others. Rows that repeat the largest
    key of their group are all responses. An empty table gives an empty index.
    """
    spark = df.sparkSession
    folder = make_folder(spark, new_folder(spark, "warc"))
    rows = df.select(F.col(key).cast("long").alias("k"), F.col(url).cast("string").alias("u"), F.col(payload).cast("string").alias("p"))
    rows = plan_revisits(rows, "p", "k", least_revisit)
    names = [f.split()[0] for f in INDEX_SCHEMA.split(", ")]
    types = [pa.string() if " string" in f else pa.int64() for f in INDEX_SCHEMA.split(", ")]

    def pack(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in found], t) for i, (n, t) in enumerate(zip(names, types))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, number = None, 0
        for batch in batches:
            for i in range(len(batch)):
                k, u, p, response = (batch.column(c)[i].as_py() for c in ("k", "u", "p", "_response"))
                if writer is None:
                    writer, number = BundleWriter(task_file(folder, number, ".warc.zst"), frame_bytes, level), number + 1
                revisit = response is not None and response != k
                writer.add(k, build_record(k, u, (p or "").encode("utf-8", "surrogatepass"), response, revisit, date))
                if writer.at >= bundle_bytes:
                    writer.close()
                    yield pack(writer.ready())
                    writer = None
            if writer is not None:
                yield pack(writer.ready())
        if writer is not None:
            writer.close()
            yield pack(writer.ready())

    return materialize(rows.mapInArrow(lean(run), INDEX_SCHEMA), "warc-index")


def read_warc(index: DataFrame, with_payload: bool = False) -> DataFrame:
    """All records of the index's bundles, each read through its seek table.

    ``key, url, record_type, refers_to, payload_bytes, payload_digest`` (bare
    hex) and, on request, ``payload`` (null for revisits). Digests of responses
    are computed from the payload that was read and must equal the header's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for bundle in batch.column("bundle").to_pylist():
                with open_input(bundle) as source:
                    for frame in read_seek_table(source):
                        rows = [read_one(*r) for r in parse_records(read_frame(source, frame, unpack))]
                        yield pack(rows)

    def read_one(headers, head, payload):
        revisit = headers["WARC-Type"] == "revisit"
        digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
        if not revisit and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
            raise ValueError(f"damaged record {headers['WARC-Record-ID']}")
        refers = key_of(headers["WARC-Refers-To"]) if revisit else None
        return (
            key_of(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), headers["WARC-Type"], refers, size, digest,
            None if revisit or not with_payload else payload,
        )

    fields = [("key", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
    fields += [("payload", pa.binary())] * with_payload

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(fields)})

    schema = "key long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"
    bundles = materialize(index.select("bundle").distinct(), "warc-bundles")
    width = max(1, min(bundles.count(), 20_000))
    return bundles.repartition(width, "bundle").mapInArrow(lean(run), schema + ", payload binary" * with_payload)
