"""Media columns: content-addressed payloads in tar shards, and metadata from range reads."""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.llm._shared import settle, shared_path

#: A payload is rows of 576 pixels, one row at least: its size is a multiple of 576 bytes.
SIDE, UNIT, PAD = 576, 576, 255
#: Bytes of a PNG's signature and header chunk, all that metadata needs.
HEADER = 33
#: Bytes after which a task starts another shard.
SHARD_BYTES = 1 << 30
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload(raw: bytes) -> bytes:
    """The text's bytes, padded with 255 to a positive multiple of 576."""
    size = max(UNIT, -(-len(raw) // UNIT) * UNIT)
    return raw + bytes([PAD]) * (size - len(raw))


def encode(data: bytes) -> bytes:
    """A grey 8-bit PNG, 576 pixels wide, of the payload; the same payload gives the same file."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = np.frombuffer(data, np.uint8).reshape(-1, SIDE)
    lines = np.zeros((len(rows), SIDE + 1), np.uint8)  # each line begins with filter type 0
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", SIDE, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 9)) + chunk(b"IEND", b"")


def header(start: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from the first 33 bytes."""
    if start[:8] != SIGNATURE or start[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">IIB", start[16:25])


def decode(stored: bytes) -> bytes:
    """The payload of a PNG that encode made; checks every chunk's sum."""
    width, height, _ = header(stored[:HEADER])
    at, data = 8, b""
    while at < len(stored):
        size, kind = struct.unpack(">I4s", stored[at : at + 8])
        body = stored[at + 8 : at + 8 + size]
        if struct.unpack(">I", stored[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + body):
            raise ValueError("damaged PNG")
        data += body if kind == b"IDAT" else b""
        at += 12 + size
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def feature(data: bytes) -> str:
    """Size, mean, deviation and an 8-bin histogram of the samples, and a 64-bit difference hash."""
    x = np.frombuffer(data, np.uint8)
    bins = np.bincount(x >> 5, minlength=8)
    cells = np.add.reduceat(x.astype(np.int64), (np.arange(72) * len(x)) // 72).reshape(8, 9)
    bits = np.packbits(cells[:, 1:] > cells[:, :-1]).tobytes().hex()
    return f"{SIDE}x{len(x) // SIDE};mean={x.mean():.4f};std={x.std():.4f};hist={'/'.join(map(str, bins))};dhash={bits}"


def _store(root: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(root)


def _member(name: str, size: int) -> bytes:
    info = tarfile.TarInfo(name)
    info.size = size
    return info.tobuf(tarfile.USTAR_FORMAT)


class ShardWriter:
    """Tar shards of one task attempt; a digest is stored once in each shard."""

    def __init__(self, root: str, name: str):
        self.fs, self.base = _store(root)
        self.fs.create_dir(self.base, recursive=True)
        self.name, self.number, self.out = name, -1, None

    def add(self, digest: str, body: bytes) -> tuple[str, int, int]:
        """Shard, offset and length at which the body lies."""
        if self.out is None or self.at >= SHARD_BYTES:
            self.close()
            self.number += 1
            self.shard, self.at, self.held = f"{self.name}-{self.number:04d}.tar", 0, {}
            self.out = self.fs.open_output_stream(f"{self.base}/{self.shard}")
        if digest not in self.held:
            head = _member(f"{digest}.png", len(body))
            self.out.write(head + body + bytes(-len(body) % 512))
            self.held[digest] = self.at + len(head)
            self.at += len(head) + len(body) + -len(body) % 512
        return self.shard, self.held[digest], len(body)

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(1024))
            self.out.close()
            self.out = None


def write_shards(spark: SparkSession, docs: DataFrame, root: str) -> DataFrame:
    """Store the payload of each text; doc_id, n_bytes, digest (binary), shard, offset and length.

    Every task attempt writes shards of its own name below root, and only
    attempts that end well are in the manifest, a table in the shared folder.
    Within a shard a digest is stored once; across shards the manifest's first
    place is the one that readers use. root is a URI that pyarrow can open.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("digest", pa.binary()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        writer = ShardWriter(root, f"{task.partitionId():06d}-{task.taskAttemptId()}")
        for batch in batches:
            made = []
            for key, cell in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = cell.as_py() or b""
                body = encode(payload(raw))
                digest = hashlib.sha256(body)
                shard, at, size = writer.add(digest.hexdigest(), body)
                made.append({"doc_id": key, "n_bytes": len(raw), "digest": digest.digest(), "shard": shard, "offset": at, "length": size})
            yield pa.RecordBatch.from_pylist(made, schema)
        writer.close()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return settle(spark, rows.mapInArrow(work, "doc_id long, n_bytes long, digest binary, shard string, offset long, length long"), "manifest")


def places(manifest: DataFrame) -> DataFrame:
    """One place (shard, offset, length) for each digest."""
    first = F.min(F.struct("shard", "offset", "length")).alias("at")
    return manifest.groupBy("digest").agg(first).select("digest", "at.*")


class RangeReader:
    """Reads stretches of shards; the last shard stays open."""

    def __init__(self, root: str):
        self.fs, self.base = _store(root)
        self.name, self.source = None, None

    def read(self, shard: str, at: int, size: int) -> bytes:
        if shard != self.name:
            self.name, self.source = shard, self.fs.open_input_file(f"{self.base}/{shard}")
        self.source.seek(at)
        return self.source.read(size)


def metadata(found: DataFrame, root: str) -> DataFrame:
    """digest, width, height and depth of each place, from a range read of its header alone."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = RangeReader(root)
        for batch in batches:
            heads = [header(reader.read(s, a, HEADER)) for s, a in zip(batch.column("shard").to_pylist(), batch.column("offset").to_pylist())]
            cols = [pa.array([h[k] for h in heads], pa.int32()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), *cols], names=["digest", "width", "height", "depth"])

    return found.mapInArrow(work, "digest binary, width int, height int, depth int")


def read_back(found: DataFrame, root: str) -> DataFrame:
    """What the stored bytes of each place decode to, and columns filled from its header; a wrong digest raises.

    The metadata columns come from a range read of the header; the whole is read
    after it.
    """
    kinds = {"digest": pa.binary(), "shard": pa.string(), "offset": pa.int64(), "length": pa.int64(), "width": pa.int32(), "height": pa.int32(), "depth": pa.int32(), "payload_bytes": pa.int64(), "payload_sha256": pa.binary(), "tail_crc32": pa.int64(), "feature": pa.string()}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = RangeReader(root)
        for batch in batches:
            rows = []
            for digest, shard, at, size in zip(*(batch.column(c).to_pylist() for c in ("digest", "shard", "offset", "length"))):
                head = header(reader.read(shard, at, HEADER))
                body = reader.read(shard, at, size)
                if hashlib.sha256(body).digest() != digest:
                    raise ValueError(f"stored bytes are not those of {digest.hex()}")
                data = decode(body)
                rows.append((digest, shard, at, size, *head, len(data), hashlib.sha256(data).digest(), zlib.crc32(data[-32:]), feature(data)))
            cols = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds.values())], names=list(kinds))

    return found.mapInArrow(work, "digest binary, shard string, offset long, length long, width int, height int, depth int, payload_bytes long, payload_sha256 binary, tail_crc32 long, feature string")


def media_columns(spark: SparkSession, docs: DataFrame, root: str | None = None) -> DataFrame:
    """doc_id, n_bytes and what lies in the store for each row of docs, with the place it lies at.

    Null texts count as empty and have a payload of 576 bytes of 255; equal
    texts share a stored file, so their columns are equal; repeated rows each
    get a row; an empty table gives none.
    """
    root = root or shared_path(spark, "media")
    manifest = write_shards(spark, docs, root)
    found = settle(spark, places(manifest), "places")
    columns = read_back(found.repartition("shard").sortWithinPartitions("shard", "offset"), root)
    columns = settle(spark, columns, "columns")
    out = manifest.select("doc_id", "n_bytes", "digest").join(columns, "digest")
    hexed = lambda c: F.lower(F.hex(c))
    return out.select(
        "doc_id",
        "n_bytes",
        "payload_bytes",
        hexed("payload_sha256").alias("payload_sha256"),
        "tail_crc32",
        F.col("length").alias("media_bytes"),
        hexed("digest").alias("media_sha256"),
        "feature",
        "width",
        "height",
        "depth",
        "shard",
        "offset",
        "length",
    )
