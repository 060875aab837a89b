"""Operator 8, benchmark decontamination by spaced seeds.

A seed is a fixed mask over consecutive words; positions marked 0 are ignored, so that a substituted
word does not hide a leak. Hashes of the benchmark's masked words are joined with those of every
document; each hit is extended along its diagonal and kept if a stretch of it is long and alike enough.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hybridqa.llm.common import documents_only, mix64, table, tune

MASKS = ("110111", "1101011", "1011011", "1110010001")
#: Items with fewer words than the longest contiguous evidence are compared as a whole; below LEAST words an item proves nothing.
LEAST, OVERLAP, SIMILAR = 5, 13, 0.8
#: Words of the benchmark that are held by a worker at a time; a larger benchmark takes more passes.
BLOCK_WORDS = 400_000
#: Places of documents whose hits are expanded at once.
HITS = 10_000
_PUNCTUATION = b".,;:!?\"'()[]{}"


def tokens(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(None, _PUNCTUATION).split()


def least_of(n: int) -> int:
    """Matches that an item of n words needs."""
    return int(np.ceil(SIMILAR * n - 1e-9))


class Seeds:
    """The masked hashes of a block of benchmark items, sorted, with where they are."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.ids, self.items, self.starts, at = [], [], [], 0
        for item_id, text in items:
            ws = tokens(text or "")
            if len(ws) >= LEAST:
                self.items.append(item_id)
                self.starts.append(at)
                self.ids += [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in ws] + [0] * 16
                at = len(self.ids)
        self.ids = np.array(self.ids, np.int64)
        self.starts.append(at)
        self.masks = [np.flatnonzero(np.array(list(m)) == "1") for m in MASKS]
        # a short item that is alike enough has fewer other words than parts: one of its parts is met as it is
        parts: dict[int, list[int]] = {}
        for q, end in zip(self.starts, self.starts[1:], strict=False):
            n = end - 16 - q
            if n < OVERLAP:
                cuts = np.linspace(0, n, n - least_of(n) + 2).astype(int).tolist()
                for a, b in zip(cuts, cuts[1:], strict=False):
                    parts.setdefault(b - a, []).append(q + a)
        self.sorted = []
        for m, only in [*((m, None) for m in self.masks), *((np.arange(k), at) for k, at in sorted(parts.items()))]:
            keys, pos = self.hashes(self.ids, m)
            if only is not None:
                self.masks.append(m)
                keep = np.isin(pos, only)
                keys, pos = keys[keep], pos[keep]
            order = np.argsort(keys, kind="stable")
            self.sorted.append((keys[order], pos[order]))

    @staticmethod
    def hashes(ids: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash and position of each window whose kept positions all have a known word."""
        n = len(ids) - int(mask[-1])
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        known = ids > 0
        ok = known[:n].copy()
        for j in mask[1:]:
            ok &= known[j : n + j]
        pos = np.flatnonzero(ok)
        key = np.zeros(len(pos), np.uint64)
        for j in mask:
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + ids[pos + j].astype(np.uint64))
        return key, pos

    def hits(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int, float]]:
        """(index of the text, item_id, first word, words, matching words, share of the item) of the best leak of each item in each text."""
        get, gap = self.vocabulary.get, [0] * 16
        ids: list[int] = []
        starts = []
        for t in texts:
            starts.append(len(ids))
            ids.extend(map(get, tokens(t), repeat(0)))
            ids += gap
        starts.append(len(ids))
        a, ends = np.array(ids, np.int64), np.array(starts, np.int64)
        starts_of, found = np.array(self.starts, np.int64), [np.zeros((0, 3), np.int64)]
        for m, (keys, where) in zip(self.masks, self.sorted, strict=True):
            key, pos = self.hashes(a, m)
            lo, hi = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            hit = np.flatnonzero(hi > lo)
            for k in range(0, len(hit), HITS):
                some = hit[k : k + HITS]
                times = hi[some] - lo[some]
                p = np.repeat(pos[some], times)
                q = where[np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(lo[some], times)]
                found.append(np.unique(np.column_stack([np.searchsorted(ends, p, "right") - 1, np.searchsorted(starts_of, q, "right") - 1, p - q]), axis=0))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for d, i, diagonal in np.unique(np.concatenate(found), axis=0).tolist():
            q0, q1 = self.starts[i], self.starts[i + 1] - 16
            p0, p1 = max(starts[d], q0 + diagonal), min(starts[d + 1] - 16, q1 + diagonal)
            same = (a[p0:p1] == self.ids[p0 - diagonal : p1 - diagonal]) & (a[p0:p1] > 0)
            if q1 - q0 < OVERLAP:
                matched = int(same.sum())
                got = (0, len(same), matched) if matched >= least_of(q1 - q0) else None
            else:
                got = stretch(same)
                got = got if got and got[1] >= OVERLAP else None
            if got and ((d, i) not in best or got[2] > best[d, i][2]):
                best[d, i] = (p0 - starts[d] + got[0], got[1], got[2])
        for (d, i), (first, length, matched) in sorted(best.items()):
            yield d, self.items[i], first, length, matched, matched / (self.starts[i + 1] - 16 - self.starts[i])


def stretch(same: np.ndarray) -> tuple[int, int, int] | None:
    """Start, length and matches of the longest stretch with a share of matches of SIMILAR or more that begins and ends in a match."""
    at = np.flatnonzero(same)
    if not len(at):
        return None
    # position p is in a good stretch from s if matches - SIMILAR * length >= 0: compare prefix sums
    level = np.r_[0.0, np.cumsum(same - SIMILAR)]
    begin, end = level[at], level[at + 1]
    low, best = np.minimum.accumulate(begin), None
    for k in range(len(at) - 1, -1, -1):
        j = int(np.searchsorted(-low, -end[k] - 1e-9, "left")) if low[k] <= end[k] + 1e-9 else k
        length = int(at[k] - at[j]) + 1
        if best is None or length > best[1]:
            best = (int(at[j]), length, k - j + 1)
        if best[1] >= at[k]:
            break
    return best


def blocks_of(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks of about block_words words at most, so that what is broadcast is bounded."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("item_id is not null and text <> ''")
    total = items.agg(F.coalesce(F.sum(F.length("text") / 6), F.lit(0.0))).first()[0]
    n = int(total // block_words) + 1
    for k in range(n):
        yield [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()]


_LEAKS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start_word", pa.int64()), ("n_words", pa.int64()), ("n_matched", pa.int64()), ("item_share", pa.float64())])


def leaks(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, start_word, n_words, n_matched, item_share of each leak of a benchmark item into a document.

    Words are lower-cased and freed of punctuation. A leak is a stretch of 13 words or more of which 80 % are
    the item's at the same distance; of an item with fewer words, 80 % of the whole item, any of its words. Null and empty texts on
    either side, and items with fewer than five words, give no row; repeated rows each give theirs.
    Each block of the benchmark is held against all documents in one pass. Other columns are ignored.
    """
    spark = docs.sparkSession
    tune(spark)
    whole = None
    for items in blocks_of(benchmark, block_words):
        block = spark.sparkContext.broadcast(items)

        def scan(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            seeds = Seeds(block.value)
            for b in batches:
                ids = b.column("doc_id").to_pylist()
                rows = [(ids[d], *rest) for d, *rest in seeds.hits(b.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * len(_LEAKS), _LEAKS, strict=True)], schema=_LEAKS)

        part = documents_only(docs).mapInArrow(scan, "doc_id long, item_id long, start_word long, n_words long, n_matched long, item_share double")
        whole = whole.unionByName(part) if whole is not None else part
    return whole


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs into which no item leaks, with all their columns; each block is a filter over the rows, without a shuffle."""
    spark = docs.sparkSession
    tune(spark)
    schema = docs.schema
    for items in blocks_of(benchmark, block_words):
        block = spark.sparkContext.broadcast(items)

        def rows(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            seeds = Seeds(block.value)
            for b in batches:
                bad = {d for d, *_ in seeds.hits([t or "" for t in b.column("text").to_pylist()])}
                yield b.filter(pa.array([k not in bad for k in range(b.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(rows, schema)
    return docs
