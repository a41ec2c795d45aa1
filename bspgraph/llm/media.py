"""Operator 8: media columns with content-addressed payloads in tar shards.

Each task writes the payloads of its rows into tar shards of bounded size in the shared folder; a member is named by the SHA-256
of its payload and stands once in a shard. Rows carry digest, shard, offset and length of their member, so reading needs no tar
scan: metadata columns come from range reads of the header alone, samples from a range read of one member.

A payload is stored as an 8-bit greyscale PNG of 64 samples a row, losslessly. Shards are written under a temporary name and
renamed; the name holds the attempt, so a retried or doubled task never changes a shard that rows already point to. The rows
(not the payloads) are written as a table, which is the only thing that is shuffled: it is dealt out by shard for reading.

Cases: null and empty texts give a payload of 64 zero bytes; equal texts give equal values; a hot text is stored once a shard,
not once a row; repeated rows each get their row; an empty table writes no shard; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import os
import struct
import tarfile
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bspgraph.llm.shared import Scratch, bounded_batches, fresh_path, open_filesystem
from bspgraph.llm.textops import chunks, trimmed

WIDTH = 64
PNG = b"\x89PNG\r\n\x1a\n"
#: Signature and image header: what a header-only read fetches.
HEADER = 33


def payload_of(text: str | None) -> bytes:
    data = (text or "").encode()
    return data + b"\0" * ((-len(data)) % WIDTH or (0 if data else WIDTH))


def _part(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes) -> bytes:
    rows = len(payload) // WIDTH
    lines = bytearray((WIDTH + 1) * rows)
    view = memoryview(lines)
    import numpy as np

    np.frombuffer(view, np.uint8).reshape(rows, WIDTH + 1)[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, WIDTH)
    return PNG + _part(b"IHDR", struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)) + _part(b"IDAT", zlib.compress(lines, 1)) + _part(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int, int]:
    """(width, height, bit depth, colour type) from the first ``HEADER`` bytes."""
    if head[:8] != PNG or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("no PNG header")
    return struct.unpack(">IIBB", head[16:26])


def decode_png(data: bytes) -> bytes:
    """The samples of a PNG that ``encode_png`` wrote, every part's checksum verified."""
    width, height, depth, colour = read_header(data)
    at, packed, parts = 8, [], []
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError(f"checksum of {kind!r}")
        parts.append(kind)
        if kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    if (width, depth, colour) != (WIDTH, 8, 0) or parts[-1] != b"IEND":
        raise ValueError("not a payload image")
    import numpy as np

    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, WIDTH + 1)
    if lines[:, 0].any():
        raise ValueError("a filtered row")
    return lines[:, 1:].tobytes()


class ShardWriter:
    """Tar shards of about ``most`` bytes; ``add`` gives (shard, offset, length) of the member that holds a payload."""

    def __init__(self, root: str, prefix: str, most: int):
        self.filesystem, self.folder = open_filesystem(root)
        self.prefix, self.most, self.n, self.out = prefix, most, 0, None

    def add(self, digest: str, media) -> tuple[str, int, int]:
        if self.out is None:
            self.name = f"{self.prefix}-{self.n:05d}.tar"
            self.filesystem.create_dir(self.folder, recursive=True)
            self.out, self.held = self.filesystem.open_output_stream(f"{self.folder}/_{self.name}", compression=None), {}
        if digest not in self.held:
            data = media()
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(data)
            head = info.tobuf(tarfile.USTAR_FORMAT)
            self.held[digest] = (self.name, self.out.tell() + len(head), len(data))
            self.out.write(head + data + b"\0" * (-len(data) % 512))
        return self.held[digest]

    def full(self) -> bool:
        return self.out is not None and self.out.tell() >= self.most

    def close(self) -> None:
        if self.out is not None:
            self.out.write(b"\0" * 1024)
            self.out.close()
            self.filesystem.move(f"{self.folder}/_{self.name}", f"{self.folder}/{self.name}")
            self.out, self.n = None, self.n + 1


def write_media(spark: SparkSession, docs: DataFrame, root: str, id_column: str = "doc_id", text_column: str = "text", shard_bytes: int = 32 << 20) -> DataFrame:
    """Rows (id, n_bytes, digest, shard, offset, length), lazily: to be written once, as evaluating them writes shards."""
    def rows(batches):
        task = TaskContext.get()
        out = ShardWriter(root, f"{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}", shard_bytes)
        for batch in chunks(batches, 1):
            found = []
            for text in batch.column(1).to_pylist():
                payload = payload_of(text)
                digest = hashlib.sha256(payload).hexdigest()
                found.append((len((text or "").encode()), digest, *out.add(digest, lambda p=payload: encode_png(p))))
            if out.full():
                out.close()
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True))], ["id", "n_bytes", "digest", "shard", "offset", "length"])
        out.close()

    schema = T.StructType([T.StructField("id", docs.schema[id_column].dataType), *(T.StructField(n, t) for n, t in (("n_bytes", T.LongType()), ("digest", T.StringType()), ("shard", T.StringType()), ("offset", T.LongType()), ("length", T.LongType())))])
    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(trimmed(rows), schema)


def by_shard(rows: DataFrame) -> DataFrame:
    """Rows dealt out so that a shard is read in one place, in the order of its members; a hot member is in many shards."""
    return rows.repartition("shard").sortWithinPartitions("shard", "offset")


class Reader:
    """Range reads of shard members; the last member's value is kept, as rows come in member order."""

    def __init__(self, root: str):
        self.filesystem, self.folder = open_filesystem(root)
        self.name = self.file = None

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard != self.name:
            if self.file is not None:
                self.file.close()
            self.name, self.file = shard, self.filesystem.open_input_file(os.path.join(self.folder, shard))
        return self.file.read_at(length, offset)


def media_metadata(rows: DataFrame, root: str) -> DataFrame:
    """``rows`` with width, height and bit_depth, filled from header-only range reads."""
    def read(batches):
        reader, last, value = Reader(root), None, None
        for batch in batches:
            got = []
            for shard, offset in zip(batch["shard"].to_pylist(), batch["offset"].to_pylist(), strict=True):
                if (shard, offset) != last:
                    last, value = (shard, offset), read_header(reader.read(shard, offset, HEADER))[:3]
                got.append(value)
            columns = [pa.array([x[k] for x in got], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "width", "height", "bit_depth"])

    schema = T.StructType([*rows.schema.fields, *(T.StructField(n, T.LongType()) for n in ("width", "height", "bit_depth"))])
    return by_shard(rows).mapInArrow(trimmed(read), schema)


def media_features(rows: DataFrame, root: str) -> DataFrame:
    """``rows`` with what the stored bytes say: payload size, digest, tail checksum, stored size and digest, and a feature.

    The feature is the image's size and depth from its header, the mean sample and the number of distinct samples.
    """
    def read(batches):
        import numpy as np

        reader, last, value = Reader(root), None, None
        for batch in batches:
            got = []
            for shard, offset, length, digest in zip(*(batch[c].to_pylist() for c in ("shard", "offset", "length", "digest")), strict=True):
                if (shard, offset) != last:
                    data = reader.read(shard, offset, length)
                    width, height, depth, _ = read_header(data[:HEADER])
                    payload = decode_png(data)
                    sha = hashlib.sha256(payload).hexdigest()
                    if sha != digest:
                        raise ValueError(f"{shard}@{offset} holds {sha}, not {digest}")
                    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
                    mean = int((counts * np.arange(256)).sum()) * 1000 // len(payload)
                    feature = f"png {width}x{height}x{depth} mean={mean // 1000}.{mean % 1000:03d} values={int((counts > 0).sum())}"
                    last, value = (shard, offset), (len(payload), sha, zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature)
                got.append(value)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array([x[k] for x in got], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    new = [("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType())]
    return by_shard(rows).mapInArrow(trimmed(read), T.StructType([*rows.schema.fields, *(T.StructField(n, t) for n, t in new)]))


def media_columns(spark: SparkSession, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", root: str | None = None) -> DataFrame:
    """Write every payload, store the rows, read the payloads back: (id, n_bytes, digest, shard, offset, length, ...)."""
    bounded_batches(spark)
    root = root or fresh_path(spark, "media")
    rows = Scratch(spark, "media-rows").save(write_media(spark, docs, root, id_column, text_column), "rows")
    return media_features(rows, root).withColumnRenamed("id", id_column)
