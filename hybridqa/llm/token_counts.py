"""Operator 1, token counts: huge documents are encoded in overlapping chunks that are spliced together.

A piece that starts at the same character in both chunks of a joint, far enough from the end of the
left one, starts there in the whole text too, and from there on both chunks agree: the parting
pattern looks back at nothing and ahead at one character, and no special string reaches over the place.
A joint without such a place is tried again with longer chunks and a wider overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hybridqa.llm.common import documents_only, materialise, partitions, table, tune
from hybridqa.llm.encoding import encoder

VOCABULARY = "byte_bpe_50k.json"
CHUNK, OVERLAP, LIMIT, WIDEN = 32_768, 256, 1024, 4
#: More characters than any special string has.
LOOK = 16


def cut(text: str, chunk: int, overlap: int) -> list[tuple[int, str]]:
    """(first character, chunk) with overlap characters shared by neighbours."""
    out, at, step = [], 0, chunk - overlap
    while True:
        out.append((at, text[at : at + chunk]))
        if at + chunk >= len(text):
            return out
        at += step


def ends(at: int, chunk: str, overlap: int, vocabulary: str, path: str | None) -> tuple[list[int], list[int], list[int], list[int], int]:
    """Piece starts and ids before them in the first and the last overlap characters, and the ids of the chunk."""
    starts, before = encoder(vocabulary, path).offsets(chunk)
    left = starts[:-1] < overlap
    right = (starts[:-1] >= len(chunk) - overlap) & (starts[:-1] <= len(chunk) - LOOK)
    return (starts[:-1][left] + at).tolist(), before[:-1][left].tolist(), (starts[:-1][right] + at).tolist(), before[:-1][right].tolist(), int(before[-1])


def splice(parts: list[tuple[list[int], list[int], list[int], list[int], int]]) -> int | None:
    """The ids of the whole text from its chunks' ends, None if a joint has no common place."""
    total = parts[0][4]
    for (_, _, rp, rt, n), (lp, lt, _, _, m) in zip(parts, parts[1:], strict=False):
        common = np.intersect1d(rp, lp)
        if not len(common):
            return None
        p = int(common[-1])
        total += rt[rp.index(p)] - n + m - lt[lp.index(p)]
    return total


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, n_chunks of every whole text.

    Null and empty texts have no bytes and no tokens. Repeated rows, and rows without a doc_id, each give a row;
    an empty table gives none. Other columns are ignored. Texts longer than a chunk are dealt out by chunk, so that no task holds more than a few chunks.
    """
    tune(docs.sparkSession)
    docs = documents_only(docs)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("n_chunks", pa.int64())])
    kinds = "doc_id long, n_bytes long, n_tokens long, n_chunks long"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            n = encoder(vocabulary, path).counts(texts)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(n, pa.int64()), pa.array([1] * len(n), pa.int64())], schema=schema)

    sized = docs.withColumn("n_bytes", F.octet_length("text").cast("long"))
    done = sized.where(F.length("text") <= chunk).select("doc_id", "text", "n_bytes").mapInArrow(whole, kinds)
    rest = sized.where(F.length("text") > chunk)
    while True:
        joints = materialise(_joints(rest, vocabulary, path, chunk, overlap), "token-joints")
        done = done.unionByName(joints.where("n_tokens is not null").select("doc_id", "n_bytes", "n_tokens", "n_chunks"))
        failed = joints.where("n_tokens is null").select("doc_id", "text_hash").distinct()
        if not failed.take(1):
            break
        chunk, overlap = chunk * WIDEN, overlap * WIDEN
        failed = failed.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
        rest = rest.join(failed, F.col("doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("hash")), "left_semi")
    return done.withColumn("over_limit", F.col("n_tokens") > limit).select("doc_id", "n_bytes", "n_tokens", "over_limit", "n_chunks")


def _joints(docs: DataFrame, vocabulary: str, path: str | None, chunk: int, overlap: int) -> DataFrame:
    """doc_id, text_hash, n_bytes, n_tokens (null where a joint has no common place), n_chunks of each row."""
    ints = pa.list_(pa.int64())
    chunks = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_bytes", pa.int64()), ("n", pa.int64()), ("k", pa.int64()), ("at", pa.int64()), ("chunk", pa.string())])
    coded = pa.schema([*list(chunks)[:5], ("lp", ints), ("lt", ints), ("rp", ints), ("rt", ints), ("tokens", pa.int64())])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, h, n, t in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text_hash", "n_bytes", "text")), strict=True):
                got = cut(t, chunk, overlap)
                for i in range(0, len(got), 64):
                    yield pa.RecordBatch.from_pylist([{"doc_id": d, "text_hash": h, "n_bytes": n, "n": len(got), "k": i + j, "at": at, "chunk": c} for j, (at, c) in enumerate(got[i : i + 64])], schema=chunks)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [ends(at, c, overlap, vocabulary, path) for at, c in zip(b.column("at").to_pylist(), b.column("chunk").to_pylist(), strict=True)]
            cols = list(zip(*got, strict=True)) if got else [()] * 5
            yield pa.RecordBatch.from_arrays([*b.columns[:5], *(pa.array(list(c), f.type) for c, f in zip(cols, list(coded)[5:], strict=True))], schema=coded)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                by_k = {p["k"]: (p["lp"], p["lt"], p["rp"], p["rt"], p["tokens"]) for p in r["parts"]}
                n = splice([by_k[k] for k in range(r["n"])])
                rows += [{"doc_id": r["doc_id"], "text_hash": r["text_hash"], "n_bytes": r["n_bytes"], "n_tokens": n, "n_chunks": r["n"]}] * (len(r["parts"]) // r["n"])
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([*list(chunks)[:3], ("n_tokens", pa.int64()), ("n_chunks", pa.int64())]))

    to_sql = lambda s, rename="array<long>": ", ".join(f"{f.name} {'string' if f.type == pa.string() else rename if f.type == ints else 'long'}" for f in s)
    n = partitions(docs.sparkSession, docs.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0], 16 << 20)
    dealt = docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(parts, to_sql(chunks)).repartition(n, "doc_id", "k")
    return (
        dealt.mapInArrow(code, to_sql(coded))
        .groupBy("doc_id", "text_hash", "n_bytes", "n").agg(F.collect_list(F.struct("k", "lp", "lt", "rp", "rt", "tokens")).alias("parts"))
        .mapInArrow(join, "doc_id long, text_hash long, n_bytes long, n_tokens long, n_chunks long")
    )


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
