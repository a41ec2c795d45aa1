"""Operator 6: exact removal of repeated passages by Rabin-Karp hashes of every fixed-length word window.

1. Each task cuts its documents into chunks, hashes every window (80 bits) and keeps, per hash, the first window of the
   chunk; the others are repeats already. Windows that a chunk holds twice are remembered for the task's later chunks, with the
   smallest id met, so a hot window sends an entry for each task and new minimum and its bucket is no larger than others.
2. The kept entries (hash, word, id) go, packed and compressed, to buckets of the hash range. There each hash that came from several
   chunks is counted and every entry but that of the smallest id is a repeat.
3. Repeats return to their chunk, where the windows of each document merge into maximal removal intervals.
4. Intervals meet the texts by a join on (id, hash of the text); a Bloom filter of fixed size keeps texts without any from moving.

The number of buckets follows the bytes of the corpus, so a bucket always holds about ``bucket_bytes`` of text.

The packing pays while a chunk (1.3 million windows) meets fewer buckets than it has windows; an entry takes about 12 bytes up to
some 30 GB of text and tends to one small row a window in the far end of many terabytes.

Cases: null and empty texts and texts shorter than a window lose nothing; a null id counts as one id before all others; rows
that share an id are judged each, none being a repeat of another; an empty table gives an empty result; all other columns, whatever
their names, pass through ``remove_repeats`` unread.

Windows count as equal if two hashes, of 64 and 16 bits, are: among n different windows some n * n / 2 ** 81 pairs are taken for
equal by chance (1e-5 at 30 GB of text). Tasks that are repeated must meet their rows in the same order, as scans do.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bspgraph.llm.bloom import bloom, with_maybe
from bspgraph.llm.shared import Scratch, bounded_batches, few_files, files_for
from bspgraph.llm.textops import Words, chunks, gathered, mix, trim, trimmed

NO_ID = -(2**63)
SECOND_BASE = np.uint64(0xC2B2AE3D27D4EB4F)


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _from_planes(data: memoryview, n: int, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * size).reshape(size, n).T).view(kind).reshape(n)


def pack_entries(h: np.ndarray, extra: np.ndarray, at: np.ndarray, ids: np.ndarray) -> bytes:
    """Ascending hashes with their extra bits, word numbers and document ids; byte planes of deltas compress to about 12 bytes each."""
    steps, base = np.diff(h, prepend=np.uint64(0)), ids.min()
    near = ids.view(np.uint64) - base.view(np.uint64)
    return len(h).to_bytes(4, "little") + base.tobytes() + zstandard.compress(_planes(steps) + _planes(extra) + _planes(at.astype(np.uint32)) + _planes(near), 1)


def unpack_entries(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, base = int.from_bytes(blob[:4], "little"), np.frombuffer(blob, np.uint64, 1, 4)
    data = memoryview(zstandard.decompress(blob[12:]))
    ids = (_from_planes(data[14 * n :], n, np.uint64) + base).view(np.int64)
    return np.cumsum(_from_planes(data, n, np.uint64), dtype=np.uint64), _from_planes(data[8 * n :], n, np.uint16), _from_planes(data[10 * n :], n, np.uint32), ids


def pack_docs(ids: np.ndarray, first: np.ndarray, key: np.ndarray) -> bytes:
    """Ids, first words and text hashes of a chunk's documents."""
    return len(ids).to_bytes(4, "little") + zstandard.compress(_planes(np.diff(ids.view(np.uint64), prepend=np.uint64(0))) + _planes(first.astype(np.uint32)) + key.tobytes(), 1)


def unpack_docs(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:4], "little")
    data = memoryview(zstandard.decompress(blob[4:]))
    ids = np.cumsum(_from_planes(data, n, np.uint64), dtype=np.uint64).view(np.int64)
    return ids, _from_planes(data[8 * n :], n, np.uint32).astype(np.int64), np.frombuffer(data[12 * n :], np.int64, n)


def pack_numbers(x: np.ndarray) -> bytes:
    return len(x).to_bytes(4, "little") + zstandard.compress(_planes(np.diff(x.astype(np.uint32), prepend=np.uint32(0))), 1)


def unpack_numbers(blob: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(memoryview(zstandard.decompress(blob[4:])), int.from_bytes(blob[:4], "little"), np.uint32), dtype=np.uint32).astype(np.int64)


def chunk_entries(batch: pa.RecordBatch, window: int, seen: "Seen | None" = None):
    """Of one chunk (id, text hash, text): its name and document table, its first windows as (hash, extra, word, id), its repeats.

    ``seen`` holds what earlier chunks of the task had often: a window that it knows from a smaller id is a repeat at once.
    """
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    key = batch.column(1).to_numpy(zero_copy_only=False)
    order = np.lexsort((key, ids))
    ids, key, texts = ids[order], key[order], batch.column(2).take(pa.array(order))
    words = Words(texts)
    # Chunks of equal rows get equal names; a sum, so that repeated rows count.
    name = int(mix(mix(ids.view(np.uint64)) + key.view(np.uint64)).sum(dtype=np.uint64)) & (2**63 - 1)
    table = (ids, words.first[:-1], key)
    word_hash = words.hashes()
    h, at = words.windows(word_hash, window)
    doc = words.doc
    del words, texts
    if not len(h):
        return name, table, None, np.zeros(0, np.int64)
    second = word_hash[: len(word_hash) - window + 1].copy()
    for k in range(1, window):
        second *= SECOND_BASE
        second += word_hash[k : k + len(second)]
    del word_hash
    extra = (mix(second[at]) >> np.uint64(48)).astype(np.uint16)
    del second
    if len(np.unique(ids)) == len(ids):
        by = np.argsort(h, kind="stable")  # equal hashes stay in (id, start) order
        hs, es = h[by], extra[by]
        # equal 64-bit hashes of differing extra bits may alternate; sort those few again
        if ((hs[1:] == hs[:-1]) & (es[1:] != es[:-1])).any():
            by = np.lexsort((at, extra, h))
            hs, es = h[by], extra[by]
        new = group = _heads(hs, es)
    else:  # rows share ids: of the smallest id, each row keeps its first window
        by = np.lexsort((at, ids[doc[at]], extra, h))
        hs, es, i, row = h[by], extra[by], ids[doc[at[by]]], doc[at[by]]
        group = _heads(hs, es)
        new = i == i[_head_of(group)]
        new[1:] &= group[1:] | (row[1:] != row[:-1])
    del h, extra
    own = ids[doc[at[by]]]
    if seen is not None:
        new = new & ~seen.earlier(hs, es, own)
        seen.learn(hs, es, own, group)
    return name, table, (hs[new], es[new], at[by[new]], own[new]), np.sort(at[by[~new]])


def _heads(h: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """Where a new hash begins in a sorted list."""
    out = np.ones(len(h), bool)
    out[1:] = (h[1:] != h[:-1]) | (extra[1:] != extra[:-1])
    return out


def _head_of(heads: np.ndarray) -> np.ndarray:
    return np.maximum.accumulate(np.where(heads, np.arange(len(heads)), 0))


class Seen:
    """Of windows that some chunk of this task held twice or more: the smallest id met so far, for ``most`` of them.

    A hot window so sends one entry a task and new minimum, not one a chunk. What is forgotten is sent again; results don't change.
    """

    def __init__(self, most: int = 1 << 17):
        self.most = most
        self.h, self.extra, self.ids, self.count = np.zeros(0, np.uint64), np.zeros(0, np.uint16), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def earlier(self, h: np.ndarray, extra: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Whether each of the ascending windows is known from a smaller id."""
        if not len(self.h):
            return np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return (self.h[at] == h) & (self.extra[at] == extra) & (self.ids[at] < ids)

    def learn(self, h: np.ndarray, extra: np.ndarray, ids: np.ndarray, heads: np.ndarray) -> None:
        start = np.flatnonzero(heads)
        count = np.diff(np.append(start, len(h)))
        start, count = start[count > 1], count[count > 1]
        h, extra = np.concatenate([self.h, h[start]]), np.concatenate([self.extra, extra[start]])
        ids, count = np.concatenate([self.ids, ids[start]]), np.concatenate([self.count, count])
        by = np.lexsort((ids, extra, h))
        h, extra, ids, count = h[by], extra[by], ids[by], count[by]
        first = np.flatnonzero(_heads(h, extra))
        if len(first):
            h, extra, ids, count = h[first], extra[first], ids[first], np.add.reduceat(count, first)
        if len(h) > self.most:  # the most frequent stay, half as many as may be
            keep = np.sort(np.argpartition(count, len(h) - self.most // 2)[-(self.most // 2) :])
            h, extra, ids, count = h[keep], extra[keep], ids[keep], count[keep]
        self.h, self.extra, self.ids, self.count = h, extra, ids, count


def _entry_rows(window: int, buckets: int, chunk_bytes: int = 4 << 20):
    def rows(batches):
        seen = Seen()
        for batch in chunks(gathered(batches, 2, chunk_bytes), 2, chunk_bytes):
            name, table, first, repeats = chunk_entries(batch, window, seen)
            if first is None:
                continue
            h, extra, at, own = first
            where = ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            cut = np.flatnonzero(np.diff(where, prepend=-1))
            blobs = [pack_entries(h[a:b], extra[a:b], at[a:b], own[a:b]) for a, b in itertools.pairwise([*cut, len(h)])]
            # One more row for the chunk itself: its documents and its repeats so far.
            keys, docs = [*where[cut].tolist(), name % buckets], [None] * len(cut) + [pack_docs(*table)]
            blobs.append(pack_numbers(repeats))
            del first, h, extra, at, own, where, table, repeats, batch
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([name] * len(keys), pa.int64()), pa.array(docs, pa.binary()), pa.array(blobs, pa.binary())], ["bucket", "chunk", "docs", "entries"])

    return rows


def _later(table: pa.Table) -> pa.Table:
    """Of one bucket: the entries of each chunk whose window stands in a document of smaller id; known repeats pass through."""
    names = table["chunk"].to_pylist()
    own = table["docs"].is_null().to_pylist()
    blobs = [x.as_buffer() for x in table["entries"]]
    out: list[tuple[int, bytes | None, bytes]] = [(names[k], x.as_py(), blobs[k].to_pybytes()) for k, x in enumerate(table["docs"]) if not own[k]]
    mine = [k for k, x in enumerate(own) if x]
    n = np.array([int.from_bytes(memoryview(blobs[k])[:4], "little") for k in mine], np.int64)
    ends = np.cumsum(n)
    size = int(n.sum())
    h, extra, at, ids = np.empty(size, np.uint64), np.empty(size, np.uint16), np.empty(size, np.uint32), np.empty(size, np.int64)
    for k, a, b in zip(mine, ends - n, ends, strict=True):
        h[a:b], extra[a:b], at[a:b], ids[a:b] = unpack_entries(memoryview(blobs[k]))
    if size:
        by = np.argsort(h)
        hs = h[by]
        same = hs[1:] == hs[:-1]
        del hs
        twice = np.zeros(size, bool)
        twice[1:] |= same
        twice[:-1] |= same
        pick = by[twice]
        del by, same, twice
        pick = pick[np.lexsort((ids[pick], extra[pick], h[pick]))]
        if len(pick):
            i = ids[pick]
            pick = pick[i != i[_head_of(_heads(h[pick], extra[pick]))]]
            source, at = np.searchsorted(ends, pick, side="right"), at[pick]
            by = np.lexsort((at, source))
            source, at = source[by], at[by]
            cut = np.flatnonzero(np.diff(source, prepend=-1))
            for a, b in itertools.pairwise([*cut, len(source)]):
                out.append((names[mine[source[a]]], None, pack_numbers(at[a:b])))
    del h, extra, ids, blobs
    trim()
    return pa.table({"chunk": pa.array([x[0] for x in out], pa.int64()), "docs": pa.array([x[1] for x in out], pa.binary()), "words": pa.array([x[2] for x in out], pa.binary())})


def _spans(window: int):
    def spans(table: pa.Table) -> pa.Table:
        """Of one chunk: each affected document's removal intervals as [from, to, from, to, ...] word numbers."""
        ids, first, key = unpack_docs(table["docs"].drop_null()[0].as_py())
        at = np.unique(np.concatenate([unpack_numbers(x) for x in table["words"].to_pylist()]))
        doc = np.searchsorted(first, at, side="right") - 1
        new = np.ones(len(at), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + window)
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(at))[: len(heads)] - 1
        owner = doc[heads]
        flat = np.stack([at[heads] - first[owner], at[tails] - first[owner] + window], 1).reshape(-1).astype(np.int32)
        cut = np.flatnonzero(np.diff(owner, prepend=-1))
        offsets = np.append(cut * 2, len(flat)).astype(np.int32)
        own = owner[cut]
        return pa.table({"k_id": pa.array(ids[own]), "k_text": pa.array(key[own]), "spans": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))})

    return spans


def text_bytes(docs: DataFrame, text_column: str) -> int:
    return docs.agg(F.sum(F.octet_length(text_column).cast("long")).alias("n")).first()["n"] or 0


def repeated_spans(spark: SparkSession, docs: DataFrame, window: int, id_column: str, text_column: str, total: int, bucket_bytes: int = 12 << 20) -> DataFrame:
    """(k_id, k_text, spans): removal intervals in words of each affected (id, hash of text); ``total`` is the bytes of all texts."""
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // bucket_bytes))
    keyed = docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("i"), F.xxhash64(text_column).alias("k"), F.coalesce(text_column, F.lit("")).alias("t"))
    entries = keyed.mapInArrow(trimmed(_entry_rows(window, buckets)), "bucket long, chunk long, docs binary, entries binary")
    late = entries.groupBy("bucket").applyInArrow(_later, "chunk long, docs binary, words binary")
    spans = late.groupBy("chunk").applyInArrow(_spans(window), "k_id long, k_text long, spans array<int>")
    return few_files(spans.dropDuplicates(["k_id", "k_text"]), total, 256 << 20, 1)


def _split(spark, docs, window, id_column, text_column, columns):
    """(rows with spans, rows surely without, bytes of text), rows as ``columns``; only rows that may have spans are shuffled."""
    bounded_batches(spark)
    total = text_bytes(docs, text_column)
    spans = Scratch(spark, "substring").save(repeated_spans(spark, docs, window, id_column, text_column, total), "spans")
    left = docs.select(*columns, F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("k_id"), F.xxhash64(text_column).alias("k_text"))
    marked = with_maybe(left, bloom(spans, F.xxhash64("k_id", "k_text")), F.xxhash64("k_id", "k_text"))
    joined = marked.where("_maybe").join(spans, ["k_id", "k_text"], "left").drop("k_id", "k_text", "_maybe")
    whole = marked.where("NOT _maybe").drop("k_id", "k_text", "_maybe").withColumn("spans", F.lit(None).cast("array<int>"))
    return joined, whole, total


def kept_words(text: bytes, spans) -> tuple[int, list[bytes]]:
    words = text.split()
    if spans is None:
        return len(words), words
    out, at = [], 0
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        out += words[at:a]
        at = b
    return len(words), out + words[at:]


def cut_spans(text: str, spans) -> str:
    """The text without the words of the spans and the white space after them; everything else stays as it was."""
    if not spans:
        return text
    data = text.encode()
    words = Words(pa.array([text]))
    start, out, at = words.start, [], 0
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        out.append(data[at : start[a]])
        at = start[b] if b < len(start) else len(data)
    return b"".join([*out, data[at:]]).decode()


def removal_digest(spark: SparkSession, docs: DataFrame, window: int = 20, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) of every document."""
    cut, whole, total = _split(spark, docs, window, id_column, text_column, [F.col(id_column).alias("id"), F.col(text_column).alias("text")])

    def digest(batches):
        for batch in chunks(batches, 1):
            n, gone, sha = [], [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                total, kept = kept_words((text or "").encode(), spans)
                n.append(total)
                gone.append(total - len(kept))
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], ["id", "n_words", "n_removed", "kept_sha256"])

    schema = T.StructType([T.StructField("id", docs.schema[id_column].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    out = cut.mapInArrow(trimmed(digest), schema).unionByName(whole.mapInArrow(trimmed(digest), schema)).withColumnRenamed("id", id_column)
    # The digests are a few hundredths of the texts: dealt anew, so that as few files come of them.
    return out.repartition(files_for(total, 256 << 20))


def remove_repeats(spark: SparkSession, docs: DataFrame, window: int = 20, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with the repeated passages cut out of the texts; rows, columns and their order stay."""
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    cut, whole, total = _split(spark, docs, window, id_column, text_column, [row])

    @F.arrow_udf(T.StringType())
    def removed(text: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([None if x is None else cut_spans(x, s) for x, s in zip((t.as_py() for t in text), (t.as_py() for t in spans), strict=True)], pa.string())

    text = F.when(F.col("spans").isNull(), F.col("row")[text_column]).otherwise(removed(F.col("row")[text_column], F.col("spans")))
    changed = cut.select(*[(text if c == text_column else F.col("row")[c]).alias(c) for c in docs.columns])
    return few_files(changed.unionByName(whole.select(*[F.col("row")[c].alias(c) for c in docs.columns])), total, 64 << 20)


#: The query op6 in DuckDB SQL.
ORACLE = r"""
WITH t AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM t),
late AS (SELECT doc_id, s FROM (SELECT doc_id, s, array_to_string(w[s : s + 19], ' ') AS g FROM win) QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, s) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM late),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM t),
kept AS (SELECT words.doc_id, string_agg(x, ' ' ORDER BY p) AS text, count(*) AS n FROM words ANTI JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p GROUP BY 1)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM t LEFT JOIN kept ON t.doc_id = kept.doc_id
"""
