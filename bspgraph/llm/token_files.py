"""Operator 9: token ids in binary files of independent zstandard frames with a trailing seek table.

File layout, readable by any zstandard decoder: one frame per document, its ids as little-endian unsigned 32-bit integers; then a
skippable frame with the document ids; then the seek table, a skippable frame of (compressed size, content size, checksum) per
document and a footer (number of frames, descriptor, magic). Checksums are the low 32 bits of XXH64 of the content. A reader
fetches the seek table from the end of the file and then only the frames it wants.

A range partitioning by (document id, hash of the text) puts the texts in order before they are encoded, so finding its bounds
samples the scan and not the encoder, and rows that share an id still part. Each partition is encoded straight into one file under
a temporary name, which is then renamed; the stored list of files keeps their order. ``start`` of a document is the sum of all ids
before it: an offset per file (as many numbers as files) plus a running sum within the file.

Cases: a null or empty text has the end id alone; a null document id sorts first; repeated rows follow each other; an empty table
writes no file; other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bspgraph.llm.pretokens import CASELESS_WORDS, ODD, library, special_tokens
from bspgraph.llm.shared import Scratch, bounded_batches, fresh_path, open_filesystem
from bspgraph.llm.textops import chunks, trimmed

SKIPPABLE, IDS_FRAME, SEEKABLE = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
NO_ID = -(2**63)


class WordEncoder:
    """Ids of texts as bytes; words seen lately are kept, all others are encoded by the tokenizers library."""

    def __init__(self, path: str, cache_size: int = 400_000):
        self.path, self.most, self.marks = path, cache_size, list(special_tokens(path))
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        vocabulary = library(path).get_vocab()
        #: whether an id ends a word
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.words) > self.most:
            self.old, self.words = self.words, {}
        words, old = self.words, self.old
        pieces = [None if ODD.search(x) or any(m in x for m in self.marks) else CASELESS_WORDS.findall(x.lower()) for x in texts]
        new = set(itertools.chain.from_iterable(p for p in pieces if p is not None)).difference(words)
        words.update((w, old[w]) for w in new if w in old)
        self._learn([w for w in new if w not in words])
        whole = [x for x, p in zip(texts, pieces, strict=True) if p is None]
        rest = iter([np.array(x.ids, "<u4").tobytes() for x in library(self.path).encode_batch_fast(whole, add_special_tokens=False)] if whole else [])
        get = words.__getitem__
        return [next(rest) if p is None else b"".join(map(get, p)) for p in pieces]

    def _learn(self, words: list[str], run: int = 200) -> None:
        """Encode words that are pre-tokens, many in one text: they stay apart there, and the ids that end words tell them apart again."""
        runs = [words[k : k + run] for k in range(0, len(words), run)]
        tokenizer = library(self.path)
        for own, got in zip(runs, tokenizer.encode_batch_fast([" ".join(x) for x in runs], add_special_tokens=False), strict=True):
            ids = np.array(got.ids, "<u4")
            ends = ((np.flatnonzero(self.last[ids]) + 1) * 4).tolist()
            if len(ends) == len(own):
                data = ids.tobytes()
                self.words.update(zip(own, [data[a:b] for a, b in itertools.pairwise([0, *ends])], strict=True))
            else:  # a word whose last id ends none
                for w in own:
                    self.words[w] = np.array(tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes()


@functools.lru_cache(2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def frame_of(content: bytes, compressor: zstandard.ZstdCompressor) -> tuple[bytes, int]:
    return compressor.compress(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF


def file_tail(ids: list[int], entries: list[tuple[int, int, int]]) -> bytes:
    """The id frame and the seek table."""
    packed = zstandard.compress(np.array(ids, "<i8").tobytes(), 3)
    table = b"".join(struct.pack("<III", *e) for e in entries)
    body = table + struct.pack("<IBI", len(entries), 0x80, SEEKABLE)
    return struct.pack("<II", IDS_FRAME, len(packed)) + packed + struct.pack("<II", SKIPPABLE, len(body)) + body


class TokenFile:
    """Random access to one file: ``ids`` of its documents and ``read(k)``, which fetches and verifies one frame."""

    def __init__(self, filesystem, path: str):
        self.file = filesystem.open_input_file(path)
        size = self.file.size()
        n, descriptor, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE or descriptor != 0x80:
            raise ValueError(f"{path} has no seek table")
        at = size - 9 - 12 * n
        entries = np.frombuffer(self.file.read_at(12 * n, at), "<u4").reshape(n, 3).astype(np.int64)
        self.sizes, self.contents, self.checks = entries.T
        self.starts = np.cumsum(self.sizes) - self.sizes
        tail = int(self.sizes.sum())
        kind, length = struct.unpack("<II", self.file.read_at(8, tail))
        if kind != IDS_FRAME:
            raise ValueError(f"{path} has no id frame")
        self.ids = np.frombuffer(zstandard.decompress(self.file.read_at(length, tail + 8)), "<i8")

    def read(self, k: int) -> bytes:
        return self.check(k, self.file.read_at(int(self.sizes[k]), int(self.starts[k])))

    def check(self, k: int, frame: bytes) -> bytes:
        content = zstandard.decompress(frame)
        if len(content) != self.contents[k] or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != self.checks[k]:
            raise ValueError(f"frame {k} is damaged")
        return content

    def frames(self, block: int = 4 << 20):
        """Contents of all frames in order, read in runs of about ``block`` bytes."""
        k = 0
        while k < len(self.sizes):
            to = max(k + 1, int(np.searchsorted(self.starts, self.starts[k] + block)))
            data = self.file.read_at(int(self.sizes[k:to].sum()), int(self.starts[k]))
            base = self.starts[k]
            for j in range(k, to):
                yield self.check(j, data[self.starts[j] - base : self.starts[j] - base + self.sizes[j]])
            k = to


def encoded_frames(batches, tokenizer: str, end_id: int, level: int = 1):
    """(id, frame, content size, checksum) of every row (id, text) of the batches, as lists."""
    compressor, encoder, end = zstandard.ZstdCompressor(level=level, write_checksum=True), word_encoder(tokenizer), struct.pack("<I", end_id)
    for batch in chunks(batches, 1):
        for i, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).fill_null("").to_pylist()), strict=True):
            frame, check = frame_of(ids + end, compressor)
            yield i, frame, len(ids) + 4, check


def write_token_files(spark: SparkSession, docs: DataFrame, root: str, tokenizer: str, end_id: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Write the files; returns their stored list (part, file, documents, ids)."""
    def write(batches):
        task = TaskContext.get()
        filesystem, folder = open_filesystem(root)
        name = f"tokens-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.zst"
        out, ids, entries = None, [], []
        for i, frame, content, check in encoded_frames(batches, tokenizer, end_id):
            if out is None:
                filesystem.create_dir(folder, recursive=True)
                out = filesystem.open_output_stream(f"{folder}/_{name}", compression=None)
            out.write(frame)
            ids.append(i)
            entries.append((len(frame), content, check))
        if out is not None:
            out.write(file_tail(ids, entries))
            out.close()
            filesystem.move(f"{folder}/_{name}", f"{folder}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int64()), pa.array([name]), pa.array([len(ids)], pa.int64()), pa.array([sum(e[1] for e in entries) // 4], pa.int64())], ["part", "file", "documents", "ids"])

    bounded_batches(spark)
    keyed = docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_column).alias("text"), F.xxhash64(text_column).alias("h"))
    ordered = keyed.repartitionByRange("id", "h").sortWithinPartitions("id", "h").select("id", "text")
    return Scratch(spark, "token-files").save(ordered.mapInArrow(trimmed(write), "part long, file string, documents long, ids long"), "files")


def read_token_files(spark: SparkSession, files: DataFrame, root: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    listed = sorted((r["part"], r["file"], r["ids"]) for r in files.collect())  # one row a file
    jobs, total = [], 0
    for part, file, ids in listed:
        jobs.append((part, file, total))
        total += ids

    def read(batches):
        filesystem, folder = open_filesystem(root)
        for batch in batches:
            for file, start in zip(batch["file"].to_pylist(), batch["start"].to_pylist(), strict=True):
                held = TokenFile(filesystem, f"{folder}/{file}")
                n = held.contents // 4
                starts = start + np.cumsum(n) - n
                crc = np.fromiter(map(zlib.crc32, held.frames()), np.int64, len(n))
                yield pa.RecordBatch.from_arrays([pa.array(held.ids, mask=held.ids == NO_ID), pa.array(starts), pa.array(n), pa.array(crc)], ["id", "start", "n_tokens", "ids_crc32"])

    work = spark.createDataFrame(jobs, "part long, file string, start long").repartition(max(1, len(jobs)), "part")
    return work.mapInArrow(trimmed(read), "id long, start long, n_tokens long, ids_crc32 long")


def token_files(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int, id_column: str = "doc_id", text_column: str = "text", root: str | None = None) -> DataFrame:
    root = root or fresh_path(spark, "token-files")
    files = write_token_files(spark, docs, root, tokenizer, end_id, id_column, text_column)
    return read_token_files(spark, files, root).withColumnRenamed("id", id_column)
