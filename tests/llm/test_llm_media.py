"""Operator 8: exact round trips, content addressing, range reads."""

import hashlib
import io
import tarfile
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_fixtures import documents

from bspgraph.llm.media import decode_png, encode_png, media_columns, media_metadata, payload_of, read_header, write_media
from bspgraph.llm.shared import Scratch


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=300))
def test_payloads(text):
    payload = payload_of(text)
    assert len(payload) % 64 == 0 and payload and payload.rstrip(b"\0") == text.encode().rstrip(b"\0")
    assert len(payload) - len(text.encode()) < 64 or not text
    assert decode_png(encode_png(payload)) == payload


def test_damage_is_found():
    data = bytearray(encode_png(payload_of("some text " * 30)))
    for at in (3, 20, 30, 45, len(data) - 20):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            decode_png(bytes(bad))


def test_png_is_well_formed():
    data = encode_png(payload_of("x" * 200))
    assert read_header(data[:33]) == (64, 4, 8, 0)
    assert data.endswith(b"\0\0\0\0IEND\xaeB`\x82")


def rows_of(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    return [*rows, (-1, None), (-2, ""), (-3, "é" * 100_000), (-4, "twice"), (-4, "twice"), (None, "twice"), (-5, "a" * 64), (-6, "\0" * 64), (-7, "\0")]


def test_round_trip(spark, sf, tmp_path):
    rows = rows_of(spark, sf)
    got = media_columns(spark, documents(spark, rows), root=f"file://{tmp_path}/media").collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    by_payload: dict[str, set] = {}
    for r in got:
        data = (texts[r.doc_id] or "").encode()
        payload = payload_of(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        by_payload.setdefault(r.payload_sha256, set()).add((r.media_bytes, r.media_sha256, r.feature))
        stored = (tmp_path / "media" / r["shard"]).read_bytes()[r.offset : r.offset + r.length]
        assert hashlib.sha256(stored).hexdigest() == r.media_sha256 and decode_png(stored) == payload
    assert all(len(x) == 1 for x in by_payload.values())


def test_shards_are_tar_files(spark, tmp_path):
    root = f"file://{tmp_path}/media"
    docs = documents(spark, [(k, f"text {k % 7} " * 300) for k in range(200)]).coalesce(1)
    rows = Scratch(spark, "test").save(write_media(spark, docs, root, shard_bytes=2048), "rows")
    found = {}
    for file in (tmp_path / "media").iterdir():
        if file.name.endswith(".tar"):
            for member in (tar := tarfile.open(fileobj=io.BytesIO(file.read_bytes()))).getmembers():
                payload = decode_png(tar.extractfile(member).read())
                assert member.name == hashlib.sha256(payload).hexdigest() + ".png"
                found[file.name, member.name, member.offset_data] = member.size
    for r in rows.collect():
        assert found[r["shard"], f"{r.digest}.png", r.offset] == r.length
    heads = media_metadata(rows, root).collect()
    assert {(r.width, r.height, r.bit_depth) for r in heads} == {(64, -(-len("text 0 " * 300) // 64), 8)}


def test_hot_text_is_stored_once_a_shard(spark, tmp_path):
    docs = documents(spark, [(k, "the same text") for k in range(500)]).coalesce(1)
    rows = Scratch(spark, "test").save(write_media(spark, docs, f"file://{tmp_path}/media"), "rows")
    assert rows.select("shard", "offset").distinct().count() == 1


def test_empty(spark, tmp_path):
    assert media_columns(spark, documents(spark, []), root=f"file://{tmp_path}/media").count() == 0
