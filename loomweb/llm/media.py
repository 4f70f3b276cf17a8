"""Media columns: byte payloads stored as lossless WebP images, read back as pixel arrays, with features of the samples."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import webp
from .common import bounded_batches

#: A payload is filled up with bytes 0 to a positive multiple of this.
UNIT = 64


def padded(payload: bytes) -> bytes:
    return payload + bytes(max(UNIT, -(-len(payload) // UNIT) * UNIT) - len(payload))


def features(images: list[np.ndarray]) -> str:
    """Sizes, mean, spread, mean step along rows, and shares of eight levels, in thousandths of the samples."""
    n = sum(a.size for a in images)
    hist = sum(np.bincount(a.ravel() >> 5, minlength=8) for a in images) * 1000 // n
    total = sum(int(a.sum(dtype=np.int64)) for a in images)
    squares = sum(int(np.square(a, dtype=np.int64).sum()) for a in images)
    steps = sum(int(np.abs(np.diff(a.astype(np.int16), axis=1)).sum(dtype=np.int64)) for a in images) * 1000 // n
    sizes = "+".join(f"{a.shape[1]}x{a.shape[0]}" for a in images)
    return f"{sizes};mean={total * 1000 // n};var={squares // n - (total // n) ** 2};step={steps};hist={','.join(map(str, hist.tolist()))}"


def _rows(df: DataFrame, keys: list[str], schema: str, f) -> DataFrame:
    """mapInArrow over the key columns and one binary column, the last; f(bytes, row of keys) gives a dict of new columns."""
    names = keys

    def run(batches):
        for b in batches:
            held, size, first = [], 0, 0
            values = b.column(b.num_columns - 1)
            for i in range(b.num_rows):
                held.append(f(values[i].as_py()))
                size += len(held[-1].get("media", b"")) + 256
                if size > 8_000_000 or i == b.num_rows - 1:
                    part = b.slice(first, i + 1 - first)
                    new = {k: [h[k] for h in held] for k in held[0]}
                    yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], *[pa.array(v) for v in new.values()]], names=[*names, *new])
                    held, size, first = [], 0, i + 1

    types = {f_.name: f_.dataType.simpleString() for f_ in df.schema.fields}
    return df.mapInArrow(run, ", ".join([*(f"`{k}` {types[k]}" for k in keys), schema]))


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media of every row of docs (doc_id, text); a null text is an empty payload.

    media is a lossless WebP file, or several in a row for a payload above 256 MiB, the most that one image holds.
    """

    bounded_batches(docs.sparkSession)

    def put(payload: bytes | None) -> dict:
        payload = payload or b""
        return {"n_bytes": len(payload), "media": webp.encode_payload(padded(payload))}

    return _rows(docs.select("doc_id", F.col("text").cast("binary").alias("payload")), ["doc_id"], "n_bytes bigint, media binary", put)


def pixel_arrays(images: DataFrame, column: str = "media") -> DataFrame:
    """The other columns of images with width, height and pixels (ARGB, row by row) of the lossless WebP file in a column.

    A null or a file that isn't a whole lossless WebP image gives nulls; of several files in a row the first is read.
    """
    keys = [c for c in images.columns if c not in (column, "width", "height", "pixels")]

    def take(data: bytes | None) -> dict:
        try:
            p = webp.decode(data or b"")
        except (webp.BadImage, IndexError):
            return {"width": None, "height": None, "pixels": None}
        return {"width": p.shape[1], "height": p.shape[0], "pixels": p.ravel().astype(np.int64).tolist()}

    out = _rows(images.select(*keys, column), keys, "width bigint, height bigint, pixels array<bigint>", take)
    return out


def read_back(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes and what the stored files hold: payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256 and feature. All but n_bytes come from the files, the payload's length too: it is the image's size, or
    stands in a chunk of its own.
    """
    names = ["doc_id", "n_bytes"]

    def run(batches):
        for b in batches:
            rows = []
            for data in b.column(2):
                data = data.as_py()
                payload, images = webp.decode_payload(data)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), features(images)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            new = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=[*names, *new])

    id_type = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "n_bytes", "media").mapInArrow(
        run, f"doc_id {id_type}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    )
