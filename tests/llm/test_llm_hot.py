"""What hot keys send: a window that stands everywhere, a pre-token that is everywhere."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from llm_fixtures import collected, documents, prose, repeats

from bspgraph.llm.shared import few_files, stored_bytes
from bspgraph.llm.substring import Seen, _entry_rows, removal_digest, unpack_entries
from bspgraph.llm.token_counts import frequent_table, token_counts


def skewed(seed: int, n: int) -> list[tuple[int, str]]:
    """A third of the documents hold one passage, half of those twice; ids are dealt at random."""
    rng = random.Random(seed)
    hot = prose(rng, 60)
    rows = []
    for k in range(n):
        words = prose(rng, rng.randrange(5, 80), 10**6)
        for _ in range((k % 3 == 0) + (k % 6 == 0)):
            at = rng.randrange(len(words))
            words[at:at] = hot
        rows.append(" ".join(words))
    ids = rng.sample(range(10 * n), n)
    return list(zip(ids, rows, strict=True))


@pytest.mark.parametrize("chunk", [1 << 10, 1 << 14, 4 << 20])
def test_hot_windows_against_brute_force(spark, monkeypatch, chunk):
    import bspgraph.llm.substring as module

    monkeypatch.setattr(module, "_entry_rows", lambda window, buckets: _entry_rows(window, buckets, chunk))
    rows = skewed(chunk, 400)
    got = collected(removal_digest(spark, documents(spark, rows).repartition(3), 20), "doc_id", "n_words", "n_removed", "kept_sha256")
    for i, (words, gone) in repeats(rows, 20).items():
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        assert got[i] == (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())


def test_a_hot_window_sends_an_entry_for_each_new_minimum():
    """Chunks of one task in ascending order of ids: after the first, none sends the hot windows again."""
    rows = sorted(skewed(7, 900))
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array(range(len(rows)), pa.int64()), pa.array([t for _, t in rows])], ["i", "k", "t"])
    hashes = []
    for out in _entry_rows(20, 1, 1 << 14)(iter([batch])):
        for docs, entries in zip(out["docs"].to_pylist(), out["entries"].to_pylist(), strict=True):
            if docs is None:
                hashes.append(unpack_entries(entries)[0])
    assert len(hashes) > 20
    _, times = np.unique(np.concatenate(hashes), return_counts=True)
    assert times.max() <= len(hashes) // 4  # those that a chunk never held twice; the passage's own would be in every chunk


def test_what_is_remembered_is_bounded():
    seen, rng = Seen(most=64), np.random.default_rng(1)
    for _ in range(20):
        h = np.sort(rng.integers(0, 1000, 400).astype(np.uint64))
        heads = np.ones(len(h), bool)
        heads[1:] = h[1:] != h[:-1]
        seen.learn(h, np.zeros(len(h), np.uint16), np.arange(len(h)), heads)
        assert len(seen.h) <= 64
        assert (np.diff(seen.h.astype(np.int64)) > 0).all()
    assert seen.earlier(seen.h, seen.extra, seen.ids + 1).all()
    assert not seen.earlier(seen.h, seen.extra, seen.ids).any()


def test_files_follow_the_text(spark, tmp_path):
    df = spark.range(1000).repartition(300)
    assert few_files(df, 100, 64).rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
    assert few_files(df, 100, 64, 1).rdd.getNumPartitions() == 2
    assert few_files(df, 1 << 40, 64).rdd.getNumPartitions() == 300
    df.coalesce(1).write.parquet(f"{tmp_path}/t")
    size = sum(f.stat().st_size for f in tmp_path.glob("t/*.parquet"))
    assert stored_bytes(spark.read.parquet(f"{tmp_path}/t")) == size


def test_frequent_table_counts_the_whole_corpus(spark, tokenizer):
    """A pre-token that only late rows hold is found as well, rare ones are left out, and the bound holds."""
    path = tokenizer("byte_bpe_50k.json")
    rows = [(k, f"rare{k}" + " first" * 3 if k < 200 else f"rare{k}" + " late" * 3) for k in range(400)]
    rows += [(1000, None), (1001, "")]
    docs = documents(spark, rows)
    table = frequent_table(spark, docs, "text", path, 16)
    assert {" first", " late"} <= set(table)
    assert len(table) <= 16
    assert table[" late"] == 1
    assert not any(x.startswith("rare") and x != "rare" for x in table)
    assert frequent_table(spark, documents(spark, []), "text", path, 16) == {}
    assert token_counts(spark, docs, path, table_size=16).count() == len(rows)
