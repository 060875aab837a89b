"""Vectors: hashed embeddings, pooling of variants, exact cosine search in blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hybridqa.cluster import ship
from hybridqa.functions.tokens import tokens

#: Bytes of the vectors that are sent to all workers at once; more are taken in several blocks.
BLOCK_BYTES = 16_000_000


class Embedder(Protocol):
    """What a text encoder has to offer: id and vector of (id, text), of unit length."""

    def embed(self, texts: DataFrame) -> DataFrame: ...


def bucket(term: Column, dims: int = 256) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("long"), F.lit(dims))


def hash_embed(docs: DataFrame, dims: int = 256) -> DataFrame:
    """doc, bucket, n: counts of the tokens' hash buckets; a stand-in for a text encoder that is the same everywhere."""
    return docs.select("doc", F.explode("tokens").alias("term")).groupBy("doc", bucket(F.col("term"), dims).alias("bucket")).agg(F.count("*").alias("n"))


def dense_vectors(docs: DataFrame, dims: int = 256) -> DataFrame:
    """doc, vec (counts as doubles) of every document, those without tokens too."""
    sparse = hash_embed(docs, dims).groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("bucket", F.col("n").cast("double")))).alias("m"))
    vec = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.try_element_at("m", i.cast("long")), F.lit(0.0)))
    return docs.select("doc").join(sparse, "doc", "left").select("doc", F.when(F.col("m").isNull(), F.array_repeat(F.lit(0.0), dims)).otherwise(vec).alias("vec"))


@dataclass(frozen=True)
class HashedEmbedder:
    """The stand-in as an Embedder: hashed counts of tokens, of unit length."""

    dims: int = 256

    def embed(self, texts: DataFrame) -> DataFrame:
        ship(texts.sparkSession)
        dims = self.dims

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                m = np.zeros((b.num_rows, dims))
                lists = b.column("buckets")
                np.add.at(m, (pc.list_parent_indices(lists).to_numpy(), lists.flatten().to_numpy()), 1.0)
                norm = np.sqrt((m * m).sum(1, keepdims=True))
                m /= np.where(norm == 0, 1.0, norm)
                vec = pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, dims, dtype=np.int32)), pa.array(m.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("id"), vec], names=["id", "vec"])

        found = texts.select("id", F.transform(tokens(F.col("text")), lambda t: bucket(t, dims)).alias("buckets"))
        return found.mapInArrow(count, f"id {texts.schema['id'].dataType.simpleString()}, vec array<double>")


def pooled(texts: DataFrame, embedder: Embedder, how: str = "max") -> DataFrame:
    """doc, vec: the vectors of the texts (doc, pos, text) of one document pooled to one of unit length (all zeros stay).

    As pool_vectors, but whole vectors at a time: a row for each document and dimension would be hundreds of times the texts.
    """
    keyed = texts.select(F.concat_ws("#", "pos", "doc").alias("id"), "text")
    vec = embedder.embed(keyed).select(F.regexp_replace("id", "^[0-9]+#", "").alias("doc"), F.struct(F.substring_index("id", "#", 1).cast("long").alias("pos"), F.col("vec").cast("array<double>").alias("vec")).alias("v"))
    own = vec.groupBy("doc").agg(F.transform(F.sort_array(F.collect_list("v")), lambda v: v["vec"]).alias("vs"))
    first, rest = F.col("vs")[0], F.slice("vs", F.lit(2), F.size("vs"))
    if how == "max":
        one = F.aggregate(rest, first, lambda a, v: F.zip_with(a, v, lambda x, y: F.greatest(x, y)))
    elif how == "mean":
        one = F.aggregate(rest, first, lambda a, v: F.zip_with(a, v, lambda x, y: x + y), lambda a: F.transform(a, lambda x: x / F.size("vs")))
    elif how == "first":
        one = first
    else:
        raise ValueError(f"unknown pooling {how}")
    return own.select("doc", _once(one, _to_unit).alias("vec"))


def _once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of c, which is made once though f names it often: it becomes a lambda's variable."""
    return F.transform(F.array(c), f)[0]


def _to_unit(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return _once(F.when(norm == 0, 1.0).otherwise(norm), lambda n: F.transform(v, lambda x: x / n))


def pool_vectors(df: DataFrame, how: str = "max") -> DataFrame:
    """id, dim, v: the vectors (id, pos, vec) of one id pooled for each dimension and brought to unit length (all zeros stay)."""
    long = df.select("id", "pos", F.posexplode("vec").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    if how == "max":
        pooled = F.max("x")
    elif how == "mean":
        pooled = F.avg("x")
    elif how == "first":
        pooled = F.min_by("x", "pos")
    else:
        raise ValueError(f"unknown pooling {how}")
    each = long.groupBy("id", "dim").agg(pooled.alias("v"))
    norm = each.groupBy("id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return each.join(norm, "id").select("id", F.col("dim").cast("long").alias("dim"), (F.col("v") / F.when(F.col("norm") == 0, 1.0).otherwise(F.col("norm"))).alias("v"))


def _blocks(queries: DataFrame) -> Iterator[tuple[list[int], np.ndarray]]:
    """(ids, matrix) of the queries, in blocks of bounded size."""
    queries = queries.select("q", "vec").persist()
    n, width = queries.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(1))).first()
    parts = int(n * width * 8 // BLOCK_BYTES) + 1
    for k in range(parts):
        rows = queries.where(F.pmod(F.xxhash64("q"), F.lit(parts)) == k).select("q", "vec").orderBy("q").collect()
        if rows:
            yield [r["q"] for r in rows], np.array([r["vec"] for r in rows], float)


def cosine_scores(queries: DataFrame, docs: DataFrame, best: int | None = None, digits: int | None = None) -> DataFrame:
    """q, doc, dense: cosine of each query (q, vec) with each document (doc, vec); best: only so many for
    each query and Arrow batch, and all that are equal to the last of them after rounding to so many digits.

    The queries are a stated set: they go to the workers in blocks of bounded size, each block is held against all
    documents by one matrix product a batch. A zero vector has cosine 0.
    """
    spark = docs.sparkSession
    ship(spark)
    q_type, d_type = queries.schema["q"].dataType.simpleString(), docs.schema["doc"].dataType.simpleString()
    out = None
    for ids, matrix in _blocks(queries):
        block = spark.sparkContext.broadcast((np.array(ids), matrix))

        def product(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            ids, m = block.value
            mn = np.sqrt((m * m).sum(1))
            for b in batches:
                if not b.num_rows:
                    continue
                v = np.array(b.column("vec").to_pylist(), float)
                vn = np.sqrt((v * v).sum(1))
                docs = np.array(b.column("doc").to_pylist())
                for i in range(0, len(ids), 64):
                    dot = m[i : i + 64] @ v.T
                    norm = mn[i : i + 64, None] * vn
                    cos = np.divide(dot, norm, out=np.zeros_like(dot), where=norm > 0)
                    if digits is not None:
                        cos = np.round(cos, digits)
                    if best is not None and best < len(docs):
                        kth = np.partition(cos, len(docs) - best, 1)[:, len(docs) - best][:, None]
                        at = np.nonzero(cos >= kth)
                    else:
                        at = np.nonzero(np.ones_like(cos, bool))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + 64][at[0]]), pa.array(docs[at[1]]), pa.array(cos[at])], names=["q", "doc", "dense"])

        part = docs.select("doc", "vec").mapInArrow(product, f"q {q_type}, doc {d_type}, dense double")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], f"q {q_type}, doc {d_type}, dense double")
