"""Operator 4, suffix-array dedup: removes bytes of repeated 200-byte strings.

The different cells of an anchor (see repeats) make the shards. Windows that differ from all others of their anchor in
the part that they share with their like leave first (an exact bound). A shard's suffix array is built by induced
sorting, its permuted common prefixes tell which windows have an equal neighbour in that order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from hybridqa.llm.common import table
from hybridqa.llm.repeats import byte_units, covered, gram_hashes, repeated_spans, with_uid
from hybridqa.llm.suffix_array import common_prefixes, suffix_array

WINDOW, GRAM = 200, 16
#: Bytes of a shard, which holds whole anchors.
SHARD = 1 << 20
#: Parts of a window's places around its anchor that are ruled out together.
BANDS = 8


def in_question(rows: list[dict], window: int = WINDOW) -> list[dict]:
    """The stretches of the cells (akey, lo, units) that can have a window in common with another cell of their anchor.

    Equal windows have the anchor at the same place. All windows that have it at a place from a to b - 1 share the units
    from a before it to window - b + 1 after it, so those of one band can only be equal where these units are.
    """
    size = np.array([len(r["units"]) for r in rows])
    starts = np.r_[0, np.cumsum(size)]
    h = gram_hashes(np.frombuffer(b"".join(r["units"] for r in rows), np.uint8), GRAM).view(np.int64)
    hit = np.flatnonzero(h == np.repeat(np.array([r["akey"] for r in rows], np.int64), size)[: len(h)])
    of = np.searchsorted(starts, hit, "right") - 1
    place = hit - starts[of]
    good = (place >= size[of] - window) & (place <= window - GRAM)  # lies in all windows of the cell; the leftmost such is the anchor
    of, first = np.unique(of[good], return_index=True)
    anchor = place[good][first].tolist()
    edges = np.unique(np.linspace(0, window - GRAM + 1, BANDS + 1).astype(int)).tolist()
    bands = list(zip(edges, edges[1:], strict=False))
    keys = np.zeros((len(rows), len(bands)), np.uint64)  # 0: the cell has no such window
    for i, (r, p) in enumerate(zip(rows, anchor, strict=True)):
        t, least, seed = r["units"], p - (size[i] - window), r["akey"] & (1 << 64) - 1
        for k, (a, b) in enumerate(bands):
            if a <= p and b > least:
                keys[i, k] = xxhash.xxh3_64_intdigest(t[p - a : p + window - b + 1], seed ^ k) | 1
    _, same, times = np.unique(keys, return_inverse=True, return_counts=True)
    live = (times[same.reshape(keys.shape)] > 1) & (keys > 0)
    out = []
    for i in np.flatnonzero(live.any(1)).tolist():
        r, p = rows[i], anchor[i]
        at = np.flatnonzero(live[i])
        low, high = max(bands[at[0]][0], p - int(size[i]) + window), min(bands[at[-1]][1] - 1, p)
        out.append(r | {"lo": r["lo"] + p - high, "units": r["units"][p - high : p - low + window]})
    return out


def sort_shard(rows: list[dict], window: int = WINDOW) -> Iterator[tuple[int, int, int]]:
    """(uid, first, end) of the stretches of each cell whose windows occur twice or more in the shard."""
    if len(rows) < 2:
        return
    rows = in_question(rows, window)
    if not rows:
        return
    texts = [np.frombuffer(r["units"], np.uint8) for r in rows]
    line = np.zeros(sum(len(t) + 1 for t in texts), np.uint16)  # 0 stands between cells
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    for t, at in zip(texts, starts, strict=False):
        line[at : at + len(t)] = t
        line[at : at + len(t)] += 1
    phi, common = common_prefixes(line, suffix_array(line, 257), window)
    # windows that lie in a cell, and have an equal one before them in the array
    left = np.repeat(starts[1:] - 1, np.diff(starts)) - np.arange(len(line))
    found = np.flatnonzero((common >= window) & (left >= window))
    twice = np.zeros(len(line), bool)
    twice[found] = True
    twice[phi[found]] = True
    at = np.flatnonzero(twice)
    if not len(at):
        return
    of = np.searchsorted(starts, at, "right") - 1
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (of[1:] != of[:-1])])
    for a, b in zip(new.tolist(), np.r_[new[1:], len(at)].tolist(), strict=True):
        r = rows[of[a]]
        first = r["lo"] + int(at[a] - starts[of[a]])
        yield r["uid"], first, first + (b - a - 1) + window


def without_repeated_bytes(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document.

    A byte goes if a string of that many bytes covers it that also starts anywhere else, overlapping and in the same
    document too. Null and empty texts, and texts shorter than the window, lose nothing. Repeated rows remove each
    other, and rows without a doc_id are texts like any other; an empty table gives no rows. Other columns are ignored.
    """
    docs = with_uid(docs)
    spans = repeated_spans(docs, byte_units, window, GRAM, False, lambda rows: sort_shard(rows, window), SHARD)
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, text, spans in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "spans")), strict=True):
                raw, runs, at = text.encode("utf-8", "surrogatepass"), covered(spans), 0
                kept = hashlib.sha256()
                for lo, hi in runs:
                    kept.update(raw[at:lo])
                    at = hi
                kept.update(raw[at:])
                rows.append((doc, len(raw), sum(hi - lo for lo, hi in runs), len(runs), kept.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * 5, out, strict=True)], schema=out)

    return docs.join(spans, "uid", "left").select("doc_id", "text", "spans").mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeated_bytes(table(spark, sf_dir, "documents"))
