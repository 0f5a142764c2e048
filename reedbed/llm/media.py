"""Media columns: bytes stored as progressive JPEGs, read back as coefficients and RGB tensors."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import jpeg
from .tables import table

BLOCK = 64
#: Payload bytes that are coded side by side (a longer payload is a group of its own).
GROUP_BYTES = 400_000


def padded(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of ``BLOCK``."""
    return data + bytes(-len(data) % BLOCK or (0 if data else BLOCK))


def groups(sizes: list[int]):
    """Ranges of neighbours of about ``GROUP_BYTES``."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > GROUP_BYTES:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def media_column(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, media): each row's UTF-8 text, padded, as a progressive JPEG. A null text counts as empty; repeated rows
    give equal media."""

    def store(batches):
        for b in batches:
            payloads = [padded((t or "").encode("utf-8", "surrogatepass")) for t in b.column("t").to_pylist()]
            for a, z in groups([len(p) for p in payloads]):
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(a, z - a), pa.array(jpeg.write(payloads[a:z]), pa.binary())], ["doc_id", "media"])

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("t")).mapInArrow(store, "doc_id long, media binary")


def tensor_column(media: DataFrame) -> DataFrame:
    """(doc_id, height, width, rgb): full-resolution tensors as bytes in rows of (red, green, blue); nulls stay null."""

    def load(batches):
        for b in batches:
            files = b.column("media").to_pylist()
            for a, z in groups([len(f or b"") for f in files]):
                there = [i for i in range(a, z) if files[i] is not None]
                found = dict(zip(there, jpeg.read([files[i] for i in there]), strict=True)) if there else {}
                rgb = [found[i][2] if i in found else None for i in range(a, z)]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(a, z - a), pa.array([None if x is None else x.shape[0] for x in rgb], pa.int32()), pa.array([None if x is None else x.shape[1] for x in rgb], pa.int32()), pa.array([None if x is None else x.tobytes() for x in rgb], pa.binary())],
                    ["doc_id", "height", "width", "rgb"],
                )

    return media.select("doc_id", "media").mapInArrow(load, "doc_id long, height int, width int, rgb binary")


def feature(tensor: np.ndarray) -> str:
    """Size, mean colour, and the share of each eighth of the green range."""
    mean = tensor.reshape(-1, 3).mean(0)
    shares = np.bincount(tensor[:, :, 1].ravel() >> 5, minlength=8) / tensor[:, :, 1].size
    return f"{tensor.shape[1]}x{tensor.shape[0]} " + ",".join(f"{m:.3f}" for m in mean) + " " + ",".join(f"{s:.4f}" for s in shares)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")

    def digest(batches):
        for b in batches:
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in b.column("text").to_pylist()]
            for a, z in groups([len(r) for r in raw]):
                files = jpeg.write([padded(r) for r in raw[a:z]])
                rows = []
                for i, f, (image, found, tensor) in zip(range(a, z), files, jpeg.read(files), strict=True):
                    back = jpeg.payload(image, found)
                    rows.append((len(raw[i]), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(f), hashlib.sha256(f).hexdigest(), feature(tensor)))
                columns = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(a, z - a), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(digest, schema)
