"""Operator 6, packing along a space-filling curve.

A document's hashed token counts are projected to three dimensions; documents are range-sorted by
the Hilbert key of that point and laid end to end along the curve. Sequences are the stretches of 2048 ids of
that line, so neighbours on the curve share sequences and only the very last sequence has padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hybridqa.llm.common import byte_count, discard, documents_only, materialise, mix64, partitions, table, tune
from hybridqa.llm.encoding import GROUP, encoder

VOCABULARY = "word_bpe_49k.json"
LENGTH, END = 2048, 1
DIMS, BITS, BUCKETS = 3, 10, 256


@cache
def _projection() -> tuple[np.ndarray, np.ndarray]:
    """For each id: its bucket, and its signed bucket's row of a fixed random projection."""
    h = mix64(np.arange(1, 65537, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    bucket = (h % np.uint64(BUCKETS)).astype(np.int64)
    rows = mix64(np.arange(1, BUCKETS * DIMS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)).reshape(BUCKETS, DIMS)
    return bucket, rows.astype(np.float64) / 2.0**63 - 1


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position along the Hilbert curve of each row of non-negative coordinates below 2 ** bits (J. Skilling's published transform)."""
    x = points.astype(np.int64).T.copy()
    n, q = len(x), 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | x[i] >> b & 1
    return key


def curve_keys(ids: list[np.ndarray]) -> np.ndarray:
    """The Hilbert key of each document: counts in hashed buckets, centred, of length one, projected, cut into cells."""
    bucket, rows = _projection()
    at = np.empty((len(ids), DIMS))
    for k, a in enumerate(ids):
        v = np.bincount(bucket[a], minlength=BUCKETS).astype(float)
        v -= v.mean()
        at[k] = (v / max(1e-9, np.sqrt((v * v).sum()))) @ rows
    cells = np.clip((np.tanh(at) + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1)
    return hilbert(cells.astype(np.int64)) if len(ids) else np.zeros(0, np.int64)


def joined(batches: Iterator[pa.RecordBatch], size: int = GROUP) -> Iterator[pa.RecordBatch]:
    """The same rows in fewer batches: those below that many bytes wait for others, larger ones stay as they are."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if held and sum(x.nbytes for x in held) + b.nbytes > size:
            yield pa.concat_batches(held)
            held = []
        held.append(b)
    if held:
        yield pa.concat_batches(held)


def checked(ids: np.ndarray) -> np.ndarray:
    """The ids, which are stored in 16 bits; a vocabulary that needs more raises."""
    if ids.max(initial=0) > 65_535:
        raise ValueError("ids above 65535 are not supported")
    return ids


def packed(docs: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY, path: str | None = None, slices: int | None = None) -> DataFrame:
    """One row for each piece of a document in a sequence.

    Null and empty texts are the end id alone. Documents with one key are in order of doc_id, and one key's documents
    may be dealt to several tasks. Repeated rows, and rows without a doc_id, are packed each. Other columns are ignored; no documents, no rows.
    Only one sum for each task reaches the driver.
    """
    spark = docs.sparkSession
    tune(spark)
    coded = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in joined(batches):
            ids = [checked(np.append(a, np.uint32(END))) for a in encoder(vocabulary, path).ids(b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(curve_keys(ids), pa.int64()), pa.array([len(a) for a in ids], pa.int64()), pa.array([a.astype("<u2").tobytes() for a in ids], pa.binary())], schema=coded)

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, task = 0, TaskContext.get().partitionId()
        for b in batches:
            sizes = b.column("n").to_numpy()
            before = at + np.cumsum(sizes) - sizes
            at += int(sizes.sum())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n"), b.column("ids"), pa.array(before, pa.int64()), pa.array(np.full(len(sizes), task), pa.int32())], names=["doc_id", "n", "ids", "before", "task"])

    ids = materialise(documents_only(docs).mapInArrow(code, "doc_id long, key long, n long, ids binary"), "pack-ids")
    n = slices or partitions(spark, 2 * byte_count(ids))
    line = materialise(ids.repartitionByRange(n, "key", "doc_id").sortWithinPartitions("key", "doc_id", "n", "ids").mapInArrow(lay, "doc_id long, n long, ids binary, before long, task int"), "pack-line")
    discard(ids)
    base, total = {}, 0
    for r in sorted(line.groupBy("task").agg(F.sum("n").alias("n")).collect()):
        base[r["task"]], total = total, total + r["n"]
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    out = pa.schema([(c, pa.int64()) for c in names])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple[int, ...]] = []
            for d, size, raw, before, task in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n", "ids", "before", "task")), strict=True):
                a, at, start = np.frombuffer(raw, "<u2").astype("<u4"), base[task] + before, 0
                while start < size:
                    k = min(size - start, length - (at + start) % length)
                    rows.append((d, start, k, zlib.crc32(a[start : start + k].tobytes()), size, (at + start) // length, (at + start) % length))
                    start += k
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [()] * len(names))], schema=out)

    return line.mapInArrow(pieces, ", ".join(f"{c} long" for c in names))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
