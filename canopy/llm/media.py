"""Media columns: content-addressed payloads in tar shards, metadata by header-only range reads.

Each text becomes a payload: its UTF-8 bytes, blanks appended up to a positive multiple of 192. The payload is stored
losslessly as an 8-bit grey PNG image, 192 samples a row. Tasks append images to tar shards of the shared folder, one
member for each digest a task has seen, named by the SHA-256 of the payload; a shard is closed at ``SHARD_BYTES``.
Rows carry digest, shard, offset and length. Of the copies that several tasks have written of the same payload, the
least (shard, offset) becomes the address of that digest, so equal texts share one address. No text is shuffled.

Shards have names of their own for each attempt of a task, and a row only ever names a shard that its own attempt has
closed: a lost executor or a task run twice leaves at most a shard that no row names.

Metadata come from range reads: ``headers()`` reads the 33 bytes of signature and IHDR chunk of each image, and
``features()`` reads back whole images, checks their CRCs and computes digests and features of what is stored.

Nulls count as empty texts (a payload of 192 blanks). Repeated rows repeat. One payload is in memory at a time, besides
the batch it came in. Other columns are ignored. An empty table gives an empty result.
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
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.shared import as_id, materialize, new_path, pick

ROW, SHARD_BYTES, HEADER = 192, 256 << 20, 33
PNG = b"\x89PNG\r\n\x1a\n"
INDEX = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8")
    return raw + b" " * (-len(raw) % ROW if raw else ROW), len(raw)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, level: int = 4) -> bytes:
    rows = len(payload) // ROW
    lines = np.zeros((rows, ROW + 1), np.uint8)  # each row begins with filter type 0
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, ROW)
    head = struct.pack(">IIBBBBB", ROW, rows, 8, 0, 0, 0, 0)
    return PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits of a sample, from the first HEADER bytes."""
    if head[:8] != PNG or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("not an image of this store")
    return struct.unpack(">IIB", head[16:25])


def from_png(data: bytes) -> bytes:
    width, height, bits = png_header(data[:HEADER])
    at, body = HEADER, []
    while True:
        (n,) = struct.unpack(">I", data[at : at + 4])
        kind, chunk = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + chunk) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged image")
        if kind == b"IDAT":
            body.append(chunk)
        if kind == b"IEND":
            break
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width * bits // 8 + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows")
    return lines[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Rows, mean and standard deviation of the samples, and the most frequent sample (the least of equals)."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    mean = float(counts @ np.arange(256)) / x.size
    spread = (float(counts @ np.arange(256) ** 2) / x.size - mean * mean) ** 0.5
    return f"png8 {ROW}x{x.size // ROW} mean={mean:.4f} std={spread:.4f} mode={int(counts.argmax())}"


def _files(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _Shards:
    """Tar files that one task attempt writes."""

    def __init__(self, folder: str):
        self.folder, self.name, self.out = folder, "", None
        self.fs, self.root = _files(folder)

    def add(self, digest: str, data: bytes) -> tuple[str, int, int]:
        """Shard, offset of the data in it, and their length."""
        if self.out is None:
            self.name = f"shard-{uuid.uuid4().hex}.tar"
            self.fs.create_dir(self.root, recursive=True)
            self.out, self.at = self.fs.open_output_stream(f"{self.root}/{self.name}"), 0
        info = tarfile.TarInfo(f"{digest[:2]}/{digest}.png")
        info.size = len(data)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        self.out.write(head)
        self.out.write(data)
        self.out.write(b"\0" * (-len(data) % 512))
        place = self.at + len(head)
        self.at = place + len(data) + (-len(data) % 512)
        return self.name, place, len(data)

    def full(self) -> bool:
        return self.out is not None and self.at >= SHARD_BYTES

    def close(self) -> None:
        if self.out is not None:
            self.out.write(b"\0" * 1024)
            self.out.close()
            self.out = None


def store(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the payloads to tar shards of ``folder``; a row for each document with digest, shard, offset and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, seen = _Shards(folder), {}
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "n_bytes", "digest", "shard", "offset", "length"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                payload, n = payload_of(text.as_py())
                digest = hashlib.sha256(payload).hexdigest()
                if digest not in seen:
                    if shards.full():
                        shards.close()
                        yield out()  # rows leave only after their shard is closed
                        rows.clear()
                        seen.clear()
                    seen[digest] = shards.add(digest, to_png(payload))
                rows.append((doc_id, n, digest, *seen[digest]))
        shards.close()
        yield out()

    source = pick(docs, id=id_col, text=text_col).select(as_id(F.col("id")).alias("id"), F.col("text").cast("string"))
    index = materialize(source.mapInArrow(run, INDEX), "media-index")
    address = index.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("a"))
    return index.select("doc_id", "n_bytes", F.col("digest").alias("d")).join(address, F.col("d") == F.col("digest")).select("doc_id", "n_bytes", "digest", "a.shard", "a.offset", "a.length")


def _ranged(media: DataFrame, folder: str, schema: str, make, head_only: bool) -> DataFrame:
    """``make(bytes)`` for each row of ``media(digest, shard, offset, length)``, read by ranges in the order of shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _files(folder)
        name, f = None, None
        for batch in batches:
            got = []
            for digest, shard, offset, length in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if shard != name:
                    if f is not None:
                        f.close()
                    name, f = shard, fs.open_input_file(f"{root}/{shard}")
                data = f.read_at(HEADER if head_only else length, offset)
                got.append((digest, *make(data)))
            if got:
                yield pa.RecordBatch.from_pandas(_frame(got, schema), preserve_index=False)

    placed = media.select("digest", "shard", "offset", "length").repartitionByRange("shard", "offset").sortWithinPartitions("shard", "offset")
    return placed.mapInArrow(run, schema)


def _frame(rows: list[tuple], schema: str):
    import pandas as pd

    return pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])


def headers(media: DataFrame, folder: str) -> DataFrame:
    """Width, height and bits of every stored image, from header-only range reads."""
    return _ranged(media, folder, "digest string, width long, height long, bits long", png_header, True)


def features(media: DataFrame, folder: str) -> DataFrame:
    """Sizes, digests and features of every stored image, read back whole."""

    def make(data: bytes) -> tuple:
        payload = from_png(data)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature_of(payload)

    return _ranged(media, folder, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", make, False)


def op4_media(spark, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "media")
    rows = store(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    rows = materialize(rows, "media-rows")
    distinct = rows.groupBy("digest").agg(F.first("shard").alias("shard"), F.first("offset").alias("offset"), F.first("length").alias("length"))
    distinct = materialize(distinct, "media-distinct")
    sizes = headers(distinct, folder).select(F.col("digest").alias("hd"), "width", "height")
    read = features(distinct, folder)
    slim = rows.select("doc_id", "n_bytes", F.col("digest").alias("d"))
    return (
        slim.join(read, F.col("d") == F.col("digest"))
        .join(sizes, F.col("d") == F.col("hd"))
        .select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height")
    )
