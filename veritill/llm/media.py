"""Operator 8: media columns of lossless WebP images.

`store` turns binary payloads into WebP files of 8-bit samples, `pixels` reads any lossless WebP column back
into pixel arrays; both keep rows independent, so a task holds one image at a time. A payload of more than
16,384 rows of samples is stored as several images, one file behind the other.

Edge cases of the query: a null or empty text is one row of padding; repeated rows give equal rows; an empty
table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import webp
from .textops import documents, in_arrow

ROW = 576
TAIL = 32

RESULT = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def padded(data: bytes, row: int = ROW) -> bytes:
    return data + b"\xff" * (-len(data) % row if data else row)


def to_media(payload: bytes, row: int = ROW) -> bytes:
    """A payload of whole rows as WebP files of samples."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, row)
    return b"".join(webp.encode_samples(samples[k : k + webp.MAX_SIDE]) for k in range(0, len(samples), webp.MAX_SIDE))


def from_media(media: bytes) -> list[np.ndarray]:
    """The ARGB pixels of each image of the files."""
    out = []
    while media:
        image, end = webp.decode(media)
        out.append(image)
        media = media[end:]
    return out


def feature(samples: np.ndarray) -> str:
    """Size, mean and deviation in thousandths, and a histogram of 16 bins of the samples."""
    flat = samples.reshape(-1)
    n, total = flat.size, int(flat.sum(dtype=np.int64))
    square = int((flat.astype(np.int64) ** 2).sum())
    bins = np.bincount(flat >> 4, minlength=16)
    return f"{samples.shape[1]}x{samples.shape[0]};mean={1000 * total // n};var={(square * n - total * total) // (n * n)};hist={'.'.join(map(str, bins.tolist()))}"


def _round_trip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in RESULT.split(", ")]
    for batch in batches:
        rows = []
        for text in batch["text"]:
            data = (text.as_py() or "").encode()
            media = to_media(padded(data))
            samples = np.concatenate([((x >> 8) & 255).astype(np.uint8) for x in from_media(media)])
            back = samples.tobytes()
            rows.append((len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-TAIL:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)))
        kinds = [pa.string() if n in ("payload_sha256", "media_sha256", "feature") else pa.int64() for n in names[1:]]
        columns = list(zip(*rows, strict=True)) or [()] * 7
        yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            part = batch.slice(i, 64)
            yield pa.RecordBatch.from_arrays([part["id"], pa.array([None if x.as_py() is None else to_media(padded(x.as_py())) for x in part["payload"]], pa.binary())], ["id", "media"])


def _pixels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, index, heights, widths, arrays = [], [], [], [], []
        for k, media in zip(batch["id"].to_pylist(), batch["media"], strict=True):
            for n, image in enumerate(from_media(media.as_py() or b"")):
                ids.append(k)
                index.append(n)
                heights.append(image.shape[0])
                widths.append(image.shape[1])
                arrays.append(image.astype("<u4").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(index, pa.int32()), pa.array(heights, pa.int32()), pa.array(widths, pa.int32()), pa.array(arrays, pa.binary())], ["id", "image", "height", "width", "argb"])


def store(df: DataFrame, id_column: str, payload_column: str) -> DataFrame:
    """(id, media) per row: each binary payload, padded to whole rows, as lossless WebP; null stays null."""
    return in_arrow(df.selectExpr(f"cast(`{id_column}` as bigint) id", f"cast(`{payload_column}` as binary) payload"), _store, "id bigint, media binary")


def pixels(df: DataFrame, id_column: str, media_column: str) -> DataFrame:
    """(id, image, height, width, argb) per image of each row: pixels as little-endian 32-bit ARGB."""
    return in_arrow(df.selectExpr(f"cast(`{id_column}` as bigint) id", f"`{media_column}` media"), _pixels, "id bigint, image int, height int, width int, argb binary")


def op8_media_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_arrow(documents(spark, sf_dir).selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text"), _round_trip, RESULT)
