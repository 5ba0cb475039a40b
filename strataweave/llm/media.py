"""Media columns: content-addressed payloads in tar shards.

Payloads are addressed by their SHA-256. Which row of equal payloads stores them is settled by digest and
row name alone; a task then appends the payloads of its storing rows to tar shards in the shared folder, so a
payload is stored once, whatever its copies, and no payload crosses the network. All rows of equal content carry
its one address: digest, shard, offset and length. A shard has a name of its own for each attempt of a task, and
the index is written with the attempt that succeeded, so a lost executor leaves unreferenced files at most.
The shards are the result and stay; who no longer needs them removes their folder.

Metadata columns are filled from range reads of the file header alone; the payload is read
back, by one range read of its whole file, only for features. Both are read once for each payload, by tasks
that hold a range of a shard of bounded bytes.

Payloads of texts are the UTF-8 bytes with zeros up to a positive multiple of 64. They are stored
as PNG images of 8-bit grey samples, 64 wide, which is lossless.

The shared folder is reached through pyarrow's file systems (file, hdfs, s3, gs).

Defined results for odd input: a null text is empty, and an empty text is 64 zeros; equal texts
give equal values; repeated rows each get a row; an empty table gives an empty result and no
shard; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from strataweave.llm.shared import bounded, lean, new_folder, numbered, staged, with_small_batches, without_rows

WIDTH, HEADER_BYTES = 64, 33
#: A task begins another shard beyond this size.
SHARD_BYTES = 256 << 20
#: Bytes of a shard that one task reads back.
READ_BYTES = 16 << 20
LEVEL = 6
SIGNATURE = b"\x89PNG\r\n\x1a\n"
BLOCK = 512


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def png(payload: bytes) -> bytes:
    """A grey image, WIDTH samples a row, each row unfiltered."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits of a sample, from the first HEADER_BYTES bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", head[16:25])


def png_payload(data: bytes) -> bytes:
    """The samples; raises where a checksum or the layout doesn't hold."""
    width, height, bits = png_header(data)
    at, packed = 8, b""
    while at < len(data):
        (size,) = struct.unpack(">I", data[at : at + 4])
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"checksum of {kind!r} doesn't hold")
        if kind == b"IDAT":
            packed += body
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, width + 1)
    if bits != 8 or lines[:, 0].any():
        raise ValueError("only unfiltered 8-bit samples are read")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Statistics of the samples in whole numbers: sum, distinct values, largest step, and a histogram of 16 bins."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    step = int(np.abs(np.diff(x.astype(np.int16))).max())
    bins = ".".join(map(str, counts.reshape(16, 16).sum(1).tolist()))
    return f"sum={int(x.sum(dtype=np.int64))};distinct={int((counts > 0).sum())};step={step};hist={bins}"


class ShardWriter:
    """Appends named members to tar shards in a folder; a name stands once in a shard."""

    def __init__(self, folder: str):
        self.store, self.folder = pafs.FileSystem.from_uri(folder)
        self.out = None
        self.begin()

    def begin(self) -> None:
        self.close()
        self.shard, self.size, self.known = f"shard-{uuid.uuid4().hex}.tar", 0, {}

    def put(self, name: str, data: bytes) -> tuple[str, int, int]:
        """Shard, offset and length of the member's data."""
        if name in self.known:
            return self.known[name]
        if self.size > SHARD_BYTES:
            self.begin()
        if self.out is None:
            self.store.create_dir(self.folder, recursive=True)
            self.out = self.store.open_output_stream(f"{self.folder}/{self.shard}")
        info = tarfile.TarInfo(name)
        info.size = len(data)
        head = info.tobuf(tarfile.GNU_FORMAT)
        self.out.write(head + data + bytes(-len(data) % BLOCK))
        at = self.known[name] = self.shard, self.size + len(head), len(data)
        self.size += len(head) + len(data) + -len(data) % BLOCK
        return at

    def get(self, name: str) -> tuple[str, int, int] | None:
        return self.known.get(name)

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(2 * BLOCK))
            self.out.close()
            self.out = None


class ShardReader:
    """Range reads; the file read last stays open."""

    def __init__(self, folder: str):
        self.store, self.folder = pafs.FileSystem.from_uri(folder)
        self.shard, self.file = None, None

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard != self.shard:
            self.close()
            self.shard, self.file = shard, self.store.open_input_file(f"{self.folder}/{shard}")
        self.file.seek(offset)
        return self.file.read(length)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _appended(df: DataFrame, fields: str, make, large: str) -> DataFrame:
    """``df`` with the columns that ``make()(batch)`` gives for each slice by the bytes of column ``large``."""
    at = df.columns.index(large)
    with_small_batches(df.sparkSession)
    added = T.StructType.fromDDL(fields)
    names, kinds = df.columns, to_arrow_schema(added)
    schema = T.StructType([*df.schema.fields, *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, close = make()
        try:
            for batch in bounded(batches, at):
                cols = list(zip(*own(batch), strict=True)) or [()] * len(kinds)
                made = [pa.array(c, f.type) for c, f in zip(cols, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*names, *kinds.names])
        finally:
            close()

    return df.mapInArrow(lean(run), schema)


def store(payloads: DataFrame, folder: str, payload_col: str = "payload") -> DataFrame:
    """Writes the payloads (binary, already padded) and returns the index: the other columns with
    digest, shard, offset and length. The index is itself a written table."""

    def make():
        writer = ShardWriter(folder)

        def one(raw: bytes) -> tuple:
            name = hashlib.sha256(raw).hexdigest()
            at = writer.get(f"{name}.png") or writer.put(f"{name}.png", png(raw))
            return name, *at

        return lambda batch: map(one, batch.column(batch.schema.names.index(payload_col)).to_pylist()), writer.close

    out = _appended(payloads, "digest string, shard string, offset long, length long", make, payload_col)
    return staged(out.drop(payload_col), "media-index")


def metadata(index: DataFrame, folder: str) -> DataFrame:
    """The index with width, height and sample_bits, from header-only range reads."""

    def make():
        reader = ShardReader(folder)

        def own(batch):
            cols = (batch.column(batch.schema.names.index(c)).to_pylist() for c in ("shard", "offset"))
            return (png_header(reader.read(s, o, HEADER_BYTES)) for s, o in zip(*cols, strict=True))

        return own, reader.close

    return _appended(index, "width long, height long, sample_bits int", make, "digest")


def features(index: DataFrame, folder: str) -> DataFrame:
    """The index with what the stored bytes, read back, give: payload_bytes, payload_sha256, tail_crc32, media_sha256, feature.

    Raises if a payload is not what its digest says.
    """

    def make():
        reader = ShardReader(folder)

        def one(s: str, o: int, n: int, digest: str) -> tuple:
            data = reader.read(s, o, n)
            payload = png_payload(data)
            found = hashlib.sha256(payload).hexdigest()
            if found != digest:
                raise ValueError(f"{s} at {o} holds {found}, not {digest}")
            return len(payload), found, zlib.crc32(payload[-WIDTH:]), hashlib.sha256(data).hexdigest(), feature(payload)

        def own(batch):
            cols = (batch.column(batch.schema.names.index(c)).to_pylist() for c in ("shard", "offset", "length", "digest"))
            return (one(*r) for r in zip(*cols, strict=True))

        return own, reader.close

    return _appended(index, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_sha256 string, feature string", make, "digest")


def by_ranges(index: DataFrame) -> DataFrame:
    """The index dealt out by ranges of READ_BYTES within a shard, however few rows it has."""
    total = index.agg(F.sum("length")).first()[0] or 0
    return index.repartition(int(total // READ_BYTES) + 1, "shard", F.expr(f"offset div {READ_BYTES}"))


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document with its address, header metadata and features; real files stay in the shared folder."""
    own, row = numbered(docs)
    own = own.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(row))
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    n_bytes = F.octet_length(raw).cast("long")
    missing = F.when(n_bytes == 0, F.lit(WIDTH)).otherwise(F.pmod(-n_bytes, F.lit(WIDTH)))
    payload = F.concat(raw, F.substring(F.lit(bytes(WIDTH)), F.lit(1), missing.cast("int")))
    rows = staged(own.select("doc_id", n_bytes.alias("n_bytes"), F.unhex(F.sha2(payload, 256)).alias("key"), F.col(row).alias("row")), "media-rows")
    # Written, so that the join has an exchange on either side and a hot digest can be read in slices.
    several = staged(rows.groupBy("key").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "media-copies")
    copies = rows.join(several, "key").filter("row <> first").select("row")
    folder = new_folder(docs.sparkSession, "media")
    index = store(without_rows(own.select(payload.alias("payload"), row), row, copies).select("payload"), folder)
    found = features(metadata(by_ranges(index), folder), folder).withColumn("key", F.unhex("digest"))
    return rows.drop("row").join(staged(found, "media-features"), "key").drop("key").withColumn("media_bytes", F.col("length"))
