import hashlib
import io
import tarfile
import zlib

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyarrow import fs as pafs
from pyspark.sql import functions as F

from strataweave.llm import media
from strataweave.llm.queries import op6_media_columns
from strataweave.llm.shared import new_folder

TEXTS = [None, "", "a", "x" * 64, "x" * 65, "é😀" * 5000, "a", "line\n" * 40000]


@given(st.binary(max_size=300))
def test_png_round_trip(raw):
    payload = media.padded(raw)
    assert len(payload) % 64 == 0 and len(payload) > 0 and payload.startswith(raw) and not any(payload[len(raw) :])
    assert media.png_payload(media.png(payload)) == payload
    assert media.png_header(media.png(payload)[: media.HEADER_BYTES]) == (64, len(payload) // 64, 8)


def test_damage_is_noticed():
    data = bytearray(media.png(media.padded(b"hello")))
    data[50] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        media.png_payload(bytes(data))


def test_query(spark, docs, table_dir):
    df = docs(TEXTS).withColumns({"shard": F.lit("z"), "payload": F.lit(1)})
    got = {r.doc_id: r for r in op6_media_columns(spark, table_dir(df)).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        payload = media.padded(raw)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert r.media_bytes == len(media.png(payload)) and r.media_sha256 == hashlib.sha256(media.png(payload)).hexdigest()
        assert (r.width, r.height) == (64, len(payload) // 64)
    assert got[2][1:] == got[6][1:]


def test_shards_are_tar_files_and_addresses_hold(spark, docs, monkeypatch):
    folder = new_folder(spark, "media-test")
    df = docs([f"text {i % 7}" for i in range(30)]).coalesce(1).select("doc_id", F.rpad(F.col("text"), 64, " ").cast("binary").alias("payload"))
    index = media.store(df, folder).collect()
    files, path = pafs.FileSystem.from_uri(folder)
    shards = {r.shard for r in index}
    assert len(shards) == 1 and len({r.offset for r in index}) == 7
    data = files.open_input_file(f"{path}/{shards.pop()}").read()
    members = tarfile.open(fileobj=io.BytesIO(data)).getmembers()
    assert sorted((m.name, m.offset_data, m.size) for m in members) == sorted({(f"{r.digest}.png", r.offset, r.length) for r in index})


def test_writer_begins_another_shard(spark, monkeypatch):
    monkeypatch.setattr(media, "SHARD_BYTES", 1000)
    writer = media.ShardWriter(new_folder(spark, "media-test"))
    at = [writer.put(f"n{i}", bytes(600)) for i in range(5)]
    writer.close()
    assert len({s for s, _, _ in at}) > 1
    reader = media.ShardReader(new_folder(spark, "x"))
    assert reader.file is None


def test_no_rows(spark, docs):
    assert media.text_media(docs([])).count() == 0


def decoded(data):
    """Samples of a grey PNG by the format's rules: chunks with checksums, one zlib stream, a filter byte for each row."""
    assert data[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10])
    at, chunks = 8, []
    while at < len(data):
        size = int.from_bytes(data[at : at + 4])
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        assert int.from_bytes(data[at + 8 + size : at + 12 + size]) == zlib.crc32(kind + body)
        chunks.append((kind, body))
        at += 12 + size
    width, height = (int.from_bytes(chunks[0][1][k : k + 4]) for k in (0, 4))
    assert [k for k, _ in chunks] == [b"IHDR", b"IDAT", b"IEND"] and chunks[0][1][8:] == bytes([8, 0, 0, 0, 0])
    lines = zlib.decompress(chunks[1][1])
    rows = [lines[k : k + width + 1] for k in range(0, len(lines), width + 1)]
    assert len(rows) == height and all(len(x) == width + 1 and x[0] == 0 for x in rows)
    return b"".join(x[1:] for x in rows)


def test_addresses_lead_to_the_payload_stored_once(spark, docs, monkeypatch):
    texts = [*TEXTS, *(f"text {i % 5}" * 30 for i in range(60))]
    monkeypatch.setattr(media, "new_folder", lambda spark, name: folder)
    folder = new_folder(spark, "media-test")
    got = media.text_media(docs(texts).repartition(6)).collect()
    files, path = pafs.FileSystem.from_uri(folder)
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        data = files.open_input_file(f"{path}/{r.shard}").read()[r.offset : r.offset + r.length]
        payload = decoded(data)
        assert payload[: len(raw)] == raw and not any(payload[len(raw) :]) and len(payload) == max(64, -(-len(raw) // 64) * 64)
        assert hashlib.sha256(payload).hexdigest() == r.digest == r.payload_sha256 and hashlib.sha256(data).hexdigest() == r.media_sha256
    assert len({(r.shard, r.offset) for r in got}) == len({r.digest for r in got}) == len(set(t or "" for t in texts))
    stored = [m.name for x in files.get_file_info(pafs.FileSelector(path)) for m in tarfile.open(fileobj=io.BytesIO(files.open_input_file(x.path).read())).getmembers()]
    assert sorted(stored) == sorted({f"{r.digest}.png" for r in got})
