"""Repeated windows over all documents: what substring and suffix-array removal share.

Every window of a fixed length is assigned to one anchor inside it, the leftmost of its least hashed
k-grams (winnowing). The windows of one anchor start side by side and make a cell, so equal windows
have anchors with equal hashes, and a window can only be repeated in a cell with the same anchor hash.
Cells with an anchor of their own are done at once; equal cells are counted by a partial aggregate; of
what remains, only one text for each different cell is fetched and goes to the shards of the operator;
what is found in it holds for the equal cells of its document too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hybridqa.llm.common import byte_count, documents_only, materialise, mix64, partitions, tune

_P = np.uint64(0x9E3779B97F4A7C15)
#: Units taken at once; longer texts go in blocks that overlap by a window.
BLOCK = 1 << 22


def byte_units(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)


def word_units(text: str) -> np.ndarray:
    ws = text.encode("utf-8", "surrogatepass").split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))


def gram_hashes(units: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k units from each place; k is a power of two."""
    h = mix64(units.astype(np.uint64) + _P)
    step = 1
    while step < k:
        h = mix64(h[:-step] * _P + h[step:])
        step *= 2
    return h


def sliding_least(v: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours (block prefix and suffix minima)."""
    n = len(v)
    padded = np.full(-(-n // w) * w, np.uint64(2**64 - 1))
    padded[:n] = v
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def cells(units: list[np.ndarray], window: int, k: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(index of the text, anchor hash, content hash, first window, windows) of every cell of the texts.

    Texts are laid end to end so that short ones cost no call each; windows over two texts are left out.
    """
    i = 0
    while i < len(units):
        j, total = i, 0
        while j < len(units) and (j == i or total + len(units[j]) <= BLOCK):
            total += len(units[j])
            j += 1
        yield from _block(units[i:j], i, window, k)
        i = j


def _block(units: list[np.ndarray], base: int, window: int, k: int) -> Iterator[tuple[int, int, int, int, int]]:
    line = np.concatenate(units) if len(units) > 1 else units[0]
    if len(line) < window:
        return
    starts = np.r_[0, np.cumsum([len(u) for u in units])]
    span = (1 << 24) - window
    for begin in range(0, max(1, len(line) - window + 1), span):
        part = line[begin : begin + span + window - 1]
        h = gram_hashes(part, k)
        place = np.arange(len(h), dtype=np.uint64)
        least = sliding_least(h & ~np.uint64(0xFFFFFF) | place, window - k + 1) & np.uint64(0xFFFFFF)
        anchor = least.astype(np.int64)
        at = np.arange(len(anchor)) + begin
        text = np.searchsorted(starts, at, "right") - 1
        inside = at + window <= starts[text + 1]
        new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | (inside[1:] != inside[:-1])])
        ends = np.r_[new[1:], len(anchor)]
        good = inside[new]
        raw, width = part.tobytes(), part.itemsize
        keys = h[anchor[new]].view(np.int64)
        digest = xxhash.xxh3_64_intdigest
        for a, b, key, t in zip(new[good].tolist(), ends[good].tolist(), keys[good].tolist(), text[new][good].tolist(), strict=True):
            content = digest(raw[a * width : (b - 1 + window) * width], int(anchor[a]) - a) - (1 << 63)
            yield base + t, key, content, a + begin - int(starts[t]), b - a


_CELL = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("akey", pa.int64()), ("ckey", pa.int64()), ("lo", pa.int32()), ("n", pa.int32())])
_EDGE = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("akey", pa.int64()), ("ckey", pa.int64()), ("lo", pa.int32()), ("n", pa.int32()), ("units", pa.binary())])
#: begin: where the cell of the span starts.
_SPAN = pa.schema([("uid", pa.int64()), ("akey", pa.int64()), ("ckey", pa.int64()), ("begin", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32())])


def with_uid(docs: DataFrame) -> DataFrame:
    """doc_id, text and a hash of both: rows that repeat both share it, and all that is said of them."""
    return documents_only(docs).select("doc_id", "text", F.xxhash64("doc_id", "text").alias("uid"))


def repeated_spans(
    docs: DataFrame, unit: Callable[[str], np.ndarray], window: int, k: int, later_only: bool,
    shard: Callable[[list[dict]], Iterator[tuple[int, int, int]]], shard_units: int,
) -> DataFrame:
    """uid, spans (first and end unit, may overlap) of every text with repeated windows.

    later_only: a window counts as repeated only if it is also in a document with a smaller doc_id; else
    anywhere else. shard: gets all different cells of one or more anchors, in order of anchor and doc_id,
    and yields (uid, first, end) of the repeated stretches among them; the uid it gets is the cell's place in the list.
    """
    tune(docs.sparkSession)
    width = 1 if unit is byte_units else 8

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            uid, doc = b.column("uid").to_numpy(), b.column("doc_id")
            got = np.array(list(cells([unit(t) for t in b.column("text").to_pylist()], window, k)), np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([pa.array(uid[got[:, 0]]), doc.take(pa.array(got[:, 0])), *(pa.array(got[:, c], f.type) for c, f in zip(range(1, 5), list(_CELL)[2:], strict=True))], schema=_CELL)

    every = materialise(docs.mapInArrow(cut, "uid long, doc_id long, akey long, ckey long, lo int, n int"), "cells")
    common = every.groupBy("akey").agg(F.count("*").alias("cells"), F.min("ckey").alias("c0"), F.max("ckey").alias("c1")).where("cells > 1").select("akey", (F.col("c0") != F.col("c1")).alias("mixed"))
    # written first, so that the join below is of two plain shuffles and a hot anchor's cells can be split
    met = materialise(every.join(materialise(common, "common-anchors"), "akey"), "met-cells")
    first = F.min(F.struct("doc_id", "uid", "lo", "n")).alias("first")
    kinds = met.groupBy("akey", "ckey", "mixed").agg(F.count("*").alias("times"), first)
    # equal cells: all of them are repeated (of those in order of doc_id, all but the first document's)
    again = kinds.where("times > 1").select("akey", "ckey", F.col("first.doc_id").alias("first_doc"), *(F.when(F.col("mixed"), F.col(f"first.{c}")).alias(f"first_{c}") for c in ("uid", "lo") if later_only))
    again = materialise(again, "again-cells")
    whole = met.join(again, ["akey", "ckey"])
    if later_only:
        # the first document's other cells of a kind (their keys stay): what is found in the one that is fetched holds for them too
        twin = F.expr("coalesce(doc_id = first_doc and (uid <> first_uid or lo <> first_lo), false)")
        whole = materialise(whole.where(twin | F.expr("doc_id > first_doc")).select("uid", "lo", "n", *(F.when(twin, F.col(c)).alias(c) for c in ("akey", "ckey"))), "again-spans")
        twins, whole = whole.where("akey is not null").select("akey", "ckey", "uid", F.col("lo").alias("at")), whole.where("akey is null")
    whole = whole.select("uid", "lo", (F.col("lo") + F.col("n") + (window - 1)).cast("int").alias("hi"))
    # different cells with one anchor: one text of each is fetched
    wanted = kinds.where("mixed").select("first.*", "akey", "ckey").groupBy("uid").agg(F.collect_list(F.struct("akey", "ckey", "lo", "n")).alias("wanted"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, seen = [], set()
            for uid, doc, text, want in zip(*(b.column(c).to_pylist() for c in ("uid", "doc_id", "text", "wanted")), strict=True):
                u = unit(text)
                for w in want:
                    if (uid, w["akey"], w["lo"]) not in seen:
                        seen.add((uid, w["akey"], w["lo"]))
                        rows.append({"uid": uid, "doc_id": doc, **w, "units": u[w["lo"] : w["lo"] + w["n"] + window - 1].tobytes()})
            yield pa.RecordBatch.from_pylist(rows, schema=_EDGE)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[dict] = []
        size = 0
        for b in batches:
            for r in b.to_pylist():
                if size >= shard_units and r["akey"] != group[-1]["akey"]:
                    yield _spans(group, shard)
                    group, size = [], 0
                group.append(r)
                size += len(r["units"]) // width
        if group:
            yield _spans(group, shard)

    n = partitions(docs.sparkSession, byte_count(met), 16 << 20)
    edges = docs.join(wanted, "uid").select("uid", "doc_id", "text", "wanted").mapInArrow(fetch, "uid long, doc_id long, akey long, ckey long, lo int, n int, units binary")
    edges = edges.repartition(n, "akey").sortWithinPartitions("akey", "doc_id", "uid", "lo").mapInArrow(shards, "uid long, akey long, ckey long, begin int, lo int, hi int")
    if later_only:
        edges = materialise(edges, "edge-spans")
        spread = edges.drop("uid").join(twins, ["akey", "ckey"])
        whole = whole.unionByName(spread.select("uid", *((F.col(c) - F.col("begin") + F.col("at")).cast("int").alias(c) for c in ("lo", "hi"))))
    edges = edges.select("uid", "lo", "hi")
    return whole.unionByName(edges).groupBy("uid").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def _spans(group: list[dict], shard: Callable[[list[dict]], Iterator[tuple[int, int, int]]]) -> pa.RecordBatch:
    found = shard([r | {"uid": k} for k, r in enumerate(group)])
    got = np.array([(r["uid"], r["akey"], r["ckey"], r["lo"], lo, hi) for k, lo, hi in found for r in (group[k],)], np.int64).reshape(-1, len(_SPAN))
    return pa.RecordBatch.from_arrays([pa.array(got[:, c], f.type) for c, f in enumerate(_SPAN)], schema=_SPAN)


def covered(spans: list[dict] | None) -> list[tuple[int, int]]:
    """The union of the spans as maximal runs."""
    out: list[list[int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or ()):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]
