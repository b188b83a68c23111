"""Texts as PNG images in a binary column, and low-frequency hashes of what is read back.

A payload is the text in UTF-8, padded with spaces to rows of ``WIDTH`` RGB
pixels.  Each row takes the filter (none, sub or up) that leaves the least sum of
absolute values; rows are compressed by zlib, chunks carry their checksums.  The
reader tests the signature, every chunk's checksum and zlib's own, and undoes all
five filters of the format.  The hash compares the 63 lowest frequencies of the
cosine transform of the picture, shrunk to 32 by 32, with their median.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import portions, shared_dir

WIDTH = 64
ROW = 3 * WIDTH
SIGNATURE = b"\x89PNG\r\n\x1a\n"
LEVEL = 1
CHUNK = 1 << 20
PORTION = 8_000_000


def payload_of(text: bytes) -> bytes:
    """Bytes 32 up to a positive multiple of a row."""
    return text.ljust(max(1, -(-len(text) // ROW)) * ROW)


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(payload: bytes) -> bytes:
    """A PNG of 8-bit RGB whose samples are ``payload``, a whole number of rows."""
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, ROW)
    left = rows.copy()
    left[:, 3:] -= rows[:, :-3]
    above = rows.copy()
    above[1:] -= rows[:-1]
    cost = np.stack([np.abs(x.view(np.int8).astype(np.int16)).sum(axis=1) for x in (rows, left, above)])
    best = cost.argmin(axis=0)
    lines = np.empty((len(rows), ROW + 1), dtype=np.uint8)
    lines[:, 0] = best
    lines[:, 1:] = np.where((best == 0)[:, None], rows, np.where((best == 1)[:, None], left, above))
    data = zlib.compress(lines.tobytes(), LEVEL)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + b"".join(chunk(b"IDAT", data[i : i + CHUNK]) for i in range(0, len(data), CHUNK)) + chunk(b"IEND", b"")


def chunks(png: bytes) -> Iterator[tuple[bytes, bytes]]:
    if png[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at = 8
    while at < len(png):
        (size,), kind = struct.unpack(">I", png[at : at + 4]), png[at + 4 : at + 8]
        data = png[at + 8 : at + 8 + size]
        if len(data) < size or png[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + data)):
            raise ValueError(f"chunk {kind!r} at {at} is damaged")
        yield kind, data
        at += 12 + size


def unfilter(lines: np.ndarray, step: int = 3) -> np.ndarray:
    """Samples of filtered rows (first column: the filter), ``step`` bytes a pixel."""
    kind, out = lines[:, 0], lines[:, 1:].copy()
    alone = kind == 1
    if alone.any():
        out[alone] = out[alone].reshape(alone.sum(), -1, step).cumsum(axis=1, dtype=np.uint8).reshape(alone.sum(), -1)
    at, change = 0, np.flatnonzero(np.concatenate((kind[1:] != kind[:-1], [True]))) + 1
    for end in change.tolist():
        if kind[at] == 2:
            first = out[at - 1] if at else np.uint8(0)
            out[at] += first
            out[at:end] = out[at:end].cumsum(axis=0, dtype=np.uint8)
        elif kind[at] in (3, 4):
            for r in range(at, end):
                up = out[r - 1].astype(np.int16) if r else np.zeros(out.shape[1], np.int16)
                row = out[r].astype(np.int16)
                for x in range(0, len(row), step):
                    a = row[x - step : x] if x else np.zeros(step, np.int16)
                    b = up[x : x + step]
                    if kind[at] == 3:
                        guess = (a + b) >> 1
                    else:
                        c = up[x - step : x] if x else np.zeros(step, np.int16)
                        pa_, pb, pc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
                        guess = np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))
                    row[x : x + step] = (row[x : x + step] + guess) & 255
                out[r] = row
        elif kind[at] > 4:
            raise ValueError("unknown filter")
        at = end
    return out


def decode(png: bytes) -> np.ndarray:
    """The samples by row; raises ValueError or zlib.error on damage."""
    head, body = None, []
    for kind, data in chunks(png):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            body.append(data)
    if head is None or head[2:] != (8, 2, 0, 0, 0):
        raise ValueError("not plain 8-bit RGB")
    raw = np.frombuffer(zlib.decompress(b"".join(body)), dtype=np.uint8)
    return unfilter(raw.reshape(head[1], 1 + 3 * head[0]))


def cosine_basis(size: int = 32, kept: int = 8) -> np.ndarray:
    k, n = np.arange(kept)[:, None], np.arange(size)[None, :]
    return np.cos(np.pi * k * (2 * n + 1) / (2 * size))


BASIS = cosine_basis()


def shrink(picture: np.ndarray, size: int = 32) -> np.ndarray:
    """Mean over ``size`` equal parts of the first axis, parts of rows counted in proportion."""
    total = np.concatenate((np.zeros((1, picture.shape[1])), picture.cumsum(axis=0)))
    edge = np.linspace(0, len(picture), size + 1)
    low = np.minimum(edge.astype(np.int64), len(picture) - 1)
    at = total[low] + (edge - low)[:, None] * picture[low]
    return np.diff(at, axis=0) * (size / len(picture))


def cosine_hash(samples: np.ndarray) -> str:
    grey = samples.reshape(len(samples), -1, 3).sum(axis=2, dtype=np.int64).astype(np.float64)
    small = shrink(shrink(grey).T).T
    low = np.round(BASIS @ small @ BASIS.T, 6).ravel()[1:]
    bits = low > np.median(low)
    return f"{int.from_bytes(np.packbits(np.append(False, bits)).tobytes(), 'big'):016x}"


def to_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes and the PNG in the binary column ``media``. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for some in portions(batch.column(1).cast(pa.binary()).to_pylist(), lambda x: len(x or b""), PORTION):
                some = [x or b"" for x in some]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(some)), pa.array([len(x) for x in some], pa.int64()), pa.array([encode(payload_of(x)) for x in some], pa.binary())], names=["doc_id", "n_bytes", "media"])
                at += len(some)

    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def features(media: DataFrame) -> DataFrame:
    """What is read back from the column ``media`` of ``to_media``'s table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for png in batch.column(2).to_pylist():
                samples = decode(png)
                payload = samples.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(png), hashlib.sha256(png).hexdigest(), cosine_hash(samples)))
            columns = list(zip(*rows)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=schema.names)

    names = [("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType())]
    schema = T.StructType([media.schema["doc_id"], media.schema["n_bytes"], *(T.StructField(*x) for x in names)])
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def media_features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Stores every text as a PNG in a table of the shared folder, reads that back and returns its features.

    Null and empty texts are one row of spaces (n_bytes 0).  Repeated rows and
    null ids stay; other columns are ignored; an empty table gives an empty one.
    A damaged image fails the job.
    """
    import uuid

    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/llm/media-{uuid.uuid4().hex}"
    stored = to_media(docs, doc_id, text)
    stored.write.option("compression", "none").parquet(path)
    return features(spark.read.schema(stored.schema).parquet(path))
