"""Operator 7, substring dedup: suffix automata of reference shards and matching statistics.

The references are the different cells of an anchor (see repeats): a shard's automaton holds those of
smaller documents, later ones stream through it and read off, word by word, the longest match that
ends there. Shards are dealt out by anchor instead of being broadcast whole: all automata together grow with
the corpus, and a document can only match the shards of its own anchors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from hybridqa.llm.common import table
from hybridqa.llm.repeats import covered, repeated_spans, with_uid, word_units

WINDOW, GRAM = 50, 8
#: Words of an automaton; an anchor with more takes several, one after the other.
SHARD = 60_000


class SuffixAutomaton:
    """Of several sequences: a state for each class of substrings with the same ends."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """The state of the strings of p followed by c, taken out of q."""
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def add(self, sequence: list[int]) -> None:
        last = 0
        for c in sequence:
            q = self.next[last].get(c)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
                continue
            new, p = self._state(self.length[last] + 1, 0, {}), last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
            last = new

    def matches(self, sequence: list[int]) -> Iterator[int]:
        """At each place, the length of the longest substring that ends there and is in the automaton."""
        at = n = 0
        moves, link, length = self.next, self.link, self.length
        for c in sequence:
            while at and c not in moves[at]:
                at = link[at]
                n = length[at]
            if c in moves[at]:
                at = moves[at][c]
                n += 1
            yield n


def match_shard(rows: list[dict], window: int = WINDOW, limit: int = SHARD) -> Iterator[tuple[int, int, int]]:
    """(uid, first, end) of the stretches of each cell that a cell of a smaller document with its anchor has too. rows: in order of anchor and doc_id."""
    i = 0
    while i < len(rows):
        j = i
        while j < len(rows) and rows[j]["akey"] == rows[i]["akey"]:
            j += 1
        if j - i > 1 and rows[i]["doc_id"] != rows[j - 1]["doc_id"]:
            yield from _match_anchor(rows[i:j], window, limit)
        i = j


def _match_anchor(rows: list[dict], window: int, limit: int) -> Iterator[tuple[int, int, int]]:
    words = [np.frombuffer(r["units"], np.uint64).tolist() for r in rows]
    begin = 0
    while begin < len(rows):
        automaton, size, k, waiting = SuffixAutomaton(), 0, begin, begin
        end = None
        while k < len(rows):
            if rows[k]["doc_id"] != rows[waiting]["doc_id"]:  # what is added so far is of smaller documents
                if end is None:
                    for w in words[waiting:k]:
                        automaton.add(w)
                        size += len(w)
                    if size >= limit:
                        end = k
                waiting = k
            if size:
                run = None
                for at, n in enumerate(automaton.matches(words[k])):
                    if n >= window:
                        run = (at - window + 1 if run is None else run[0], at + 1)
                    elif run:
                        yield rows[k]["uid"], rows[k]["lo"] + run[0], rows[k]["lo"] + run[1]
                        run = None
                if run:
                    yield rows[k]["uid"], rows[k]["lo"] + run[0], rows[k]["lo"] + run[1]
            k += 1
        if end is None:
            return
        begin = end


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each document.

    A word goes if a window of that many words covers it whose sequence also starts in a document with a smaller doc_id;
    windows are judged on the input. Null and empty texts, and texts shorter than a window, lose nothing. Rows with the
    same doc_id never remove from each other; rows without one are neither earlier nor later, so they lose nothing and
    take nothing. An empty table gives no rows. Other columns are ignored.
    """
    docs = with_uid(docs)
    spans = repeated_spans(docs.where("doc_id is not null"), word_units, window, GRAM, True, lambda rows: match_shard(rows, window), SHARD)
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, text, spans in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "spans")), strict=True):
                ws = text.encode("utf-8", "surrogatepass").split()
                kept, at = [], 0
                for lo, hi in covered(spans):
                    kept += ws[at:lo]
                    at = hi
                kept += ws[at:]
                rows.append((doc, len(ws), len(ws) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * 4, out, strict=True)], schema=out)

    return docs.join(spans, "uid", "left").select("doc_id", "text", "spans").mapInArrow(remove, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))
