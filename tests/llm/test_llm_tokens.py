"""Operators 2, 9 and 10 against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_fixtures import collected, documents

from bspgraph.llm.bpe import automaton, bpe_decode, bpe_encode, bpe_round_trip, encoder
from bspgraph.llm.pretokens import library
from bspgraph.llm.shared import open_filesystem
from bspgraph.llm.token_counts import token_counts
from bspgraph.llm.token_files import TokenFile, read_token_files, token_files, word_encoder, write_token_files

ODD_TEXTS = [
    "", " ", "\n\n\t ", "plain words, and more words.", "don't we'll I'M 'S", "  leading  and trailing  ", "naïve café ÀÉÎ ß", "123 4567 89a b1", "日本語のテキスト", "한국어 텍스트", "emoji 🎉👩‍👩‍👧 x",
    "<|endoftext|>", "a<|endoftext|>b <|endoftext|>", "<|ENDOFTEXT|> <|startoftext|>", "é Å Å ﬁ", "\u0000\u0001 control \u007f", " nbsp em　wide", "مرحبا بالعالم", "क्षत्रिय", "x" * 3000, "ab" * 2000,
    "İstanbul ẞ Σς", "\r\nline\r\nline", "a​b﻿c", "''''s  's", "…—“quoted”", "\U0001d54f\U0001d550", "a" + " " * 500 + "b",
]


def rows_of(sf, spark):
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in table]
    rows += [(1_000_000 + k, t) for k, t in enumerate(ODD_TEXTS)]
    return [*rows, (2_000_000, None), (2_000_001, "repeated row"), (2_000_001, "repeated row"), (None, "no id"), (2_000_002, " ".join(f"long{k % 911}" for k in range(60_000)))]


def true_ids(path, text):
    return library(path).encode(text or "", add_special_tokens=False).ids


def test_counts(spark, sf, tokenizer):
    path, rows = tokenizer("byte_bpe_50k.json"), rows_of(sf, spark)
    got = collected(token_counts(spark, documents(spark, rows), path, limit=1024), "doc_id", "n_bytes", "n_tokens", "over_limit")
    for i, t in rows:
        n = len(true_ids(path, t))
        assert got[i] == (len((t or "").encode()), n, n > 1024), t


def test_counts_do_not_depend_on_the_tiers(spark, tokenizer):
    path = tokenizer("byte_bpe_50k.json")
    rows = [(k, f"word{k} " * (k % 7) + "common text") for k in range(300)]
    docs = documents(spark, rows)
    wide = collected(token_counts(spark, docs, path), "doc_id", "n_tokens")
    assert wide == collected(token_counts(spark, docs, path, table_size=1, cache_size=2), "doc_id", "n_tokens")


def test_empty_tables(spark, tokenizer):
    empty = documents(spark, [])
    path = tokenizer("byte_bpe_50k.json")
    assert token_counts(spark, empty, path).count() == 0
    assert bpe_round_trip(spark, empty, path).count() == 0
    assert bpe_encode(spark, empty, path).count() == 0
    assert token_files(spark, empty, tokenizer("word_bpe_49k.json"), 1).count() == 0


def test_automaton_round_trip(spark, sf, tokenizer):
    path, rows = tokenizer("byte_bpe_50k.json"), rows_of(sf, spark)
    docs = documents(spark, rows)
    got = collected(bpe_round_trip(spark, docs, path), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    ids = collected(bpe_encode(spark, docs, path), "doc_id", "ids")
    back = collected(bpe_decode(spark, bpe_encode(spark, docs, path), path), "doc_id", "text")
    for i, t in rows:
        true = true_ids(path, t)
        decoded = library(path).decode(true, skip_special_tokens=False)
        assert ids[i][0] == true, t
        assert back[i][0] == decoded
        assert got[i] == (len(true), hashlib.sha256(",".join(map(str, true)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_automaton_on_any_text(text):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    assert encoder(path).ids(text) == true_ids(path, text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_word_encoder_on_any_text(text):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    assert np.frombuffer(word_encoder(path).encode([text])[0], "<u4").tolist() == true_ids(path, text)


def test_automaton_on_joined_vocabulary(tokenizer):
    """Words made of vocabulary pieces reach the merges that compete for their borders."""
    path = tokenizer("byte_bpe_50k.json")
    auto, rng = automaton(path), random.Random(5)
    pieces = [x for x in auto.arcs if x.isalpha() and x.isascii()]
    for _ in range(3000):
        word = b"".join(rng.choices(pieces, k=rng.randint(1, 4)))
        assert list(auto.encode(word)) == true_ids(path, word.decode())


def test_states_follow_the_gadgets(tokenizer):
    """Every label of the vocabulary is read back as one arc, and no path of two arcs spells what one arc spells."""
    auto = automaton(tokenizer("byte_bpe_50k.json"))
    for t, (_, u, v) in list(auto.made.items())[::37]:
        assert auto.encode(auto.label[t]) == (t,)
        assert not auto.step(u, v)


def test_token_files(spark, sf, tokenizer, tmp_path):
    path, rows = tokenizer("word_bpe_49k.json"), rows_of(sf, spark)
    root = f"file://{tmp_path}/ids"
    files = write_token_files(spark, documents(spark, rows), root, path, 1)
    got = sorted(((r.doc_id is not None, r.doc_id or 0), r.start, r.n_tokens, r.ids_crc32) for r in read_token_files(spark, files, root).withColumnRenamed("id", "doc_id").collect())
    ids = {i: [*true_ids(path, t), 1] for i, t in rows}
    want, at = [], 0
    for key, i in sorted(((i is not None, i or 0), i) for i, _ in rows):
        crc = zlib.crc32(np.array(ids[i], "<u4").tobytes())
        want.append((key, at, len(ids[i]), crc))
        at += len(ids[i])
    assert got == want
    # Random access: one document's frame alone, whichever file holds it.
    filesystem, folder = open_filesystem(root)
    seen = 0
    for name in [r["file"] for r in files.collect()]:
        held = TokenFile(filesystem, f"{folder}/{name}")
        for k in range(0, len(held.ids), 17):
            content = held.read(k)
            if held.ids[k] >= 0:
                assert np.frombuffer(content, "<u4").tolist() == ids[int(held.ids[k])]
                seen += 1
    assert seen


def test_damaged_frame_is_found(spark, tokenizer, tmp_path):
    path, root = tokenizer("word_bpe_49k.json"), f"file://{tmp_path}/ids"
    files = write_token_files(spark, documents(spark, [(k, f"some words {k}") for k in range(20)]), root, path, 1)
    name = files.first()["file"]
    file = tmp_path / "ids" / name
    data = bytearray(file.read_bytes())
    data[10] ^= 0xFF
    file.write_bytes(data)
    held = TokenFile(open_filesystem(root)[0], f"{tmp_path}/ids/{name}")
    with pytest.raises(Exception):  # noqa: B017, PT011  the frame's own check or the table's
        held.read(0)
    assert held.read(1)


def test_any_zstandard_reader_reads_a_file(spark, tokenizer, tmp_path):
    import io

    import zstandard

    path, root = tokenizer("word_bpe_49k.json"), f"file://{tmp_path}/ids"
    files = write_token_files(spark, documents(spark, [(k, f"some words {k}") for k in range(20)]), root, path, 1)
    whole = b"".join(zstandard.ZstdDecompressor().stream_reader(io.BytesIO((tmp_path / "ids" / r["file"]).read_bytes()), read_across_frames=True).read() for r in files.orderBy("part").collect())
    want = [x for k in range(20) for x in [*true_ids(path, f"some words {k}"), 1]]
    assert np.frombuffer(whole, "<u4").tolist() == want
