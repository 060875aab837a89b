"""Connected components of an undirected edge table by alternating star contraction; few edges are joined by one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hybridqa.llm.common import discard, materialise

#: Edges that one task joins at once (16 bytes each). A larger table goes through rounds over the cluster.
ONE_TASK = 1 << 20


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the edges (a, b) that can reach a lesser one, and the least that each can reach."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, r = at[: len(a)], at[len(a) :], np.arange(len(ids))
    while True:
        x, y = r[x], r[y]
        apart = x != y
        if not apart.any():
            below = r < np.arange(len(ids))
            return ids[below], ids[r[below]]
        x, y = x[apart], y[apart]
        np.minimum.at(r, np.maximum(x, y), np.minimum(x, y))
        while (up := r[r]).tobytes() != r.tobytes():
            r = up


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ends = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
    if ends:
        found = roots(*(np.concatenate(e) for e in zip(*ends, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["id", "root"])


def _least(edges: DataFrame) -> DataFrame:
    """Each edge (u, v) with m, the least of u and all its neighbours: a partial aggregate, then a join that can be split at a hot u."""
    return edges.join(edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "u")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, root) for each id of edges (a, b) but the roots: root is the least id that can be reached.

    Up to ONE_TASK edges are joined by one task, as rounds over the cluster cost more than their work. More
    go through large-star and small-star steps in turn, each round written to the shared folder; no edge or
    label reaches the driver, only one count and one sum a round. Self loops and nulls are ignored.
    """
    now = materialise(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), name)
    if now.count() <= ONE_TASK:
        out = materialise(now.coalesce(1).mapInArrow(_roots, "id long, root long"), name)
        discard(now)
        return out
    last, now = now, materialise(now.distinct(), name)
    discard(last)
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        near = _least(down)
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        last, now = now, materialise(small, name)
        discard(last)
        seen = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(seen) == state:
            return now.select(F.col("u").alias("id"), F.col("v").alias("root"))
        state = tuple(seen)
