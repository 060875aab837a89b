"""Operator 3, near duplicates by Order MinHash, verified by banded alignment.

A sketch holds the several least occurrence-labelled k-mers (shingles of five words) under one hash
function, in the order in which they stand in the text, so that moved text changes it. A shared sketch proposes
a pair; a pair is a link if the in-order alignment of the two word sequences matches m words with
m / max(n1, n2) >= 0.8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hybridqa.llm.common import discard, documents_only, materialise, mix64, table, tune
from hybridqa.llm.graph import components

SHINGLE = 5
SIMILAR = 0.8
#: Sketches of MINIMA shingles each. Two texts with a share j of common shingles agree in a sketch at about j ** MINIMA.
#: Single words changed at random in a tenth of a text leave j = 0.42, met in 97 of 100 cases (measured recall: README).
SKETCHES, MINIMA = 48, 3
#: Members of a bucket that take the first turn in being compared with those of other components, and the growth of later turns.
TURN, GROWTH = 64, 32
#: In buckets with more members outside the largest component, only texts meet that share one of their rare words.
HOT = 64
#: Words are counted in so many slots to tell rare ones (a power of two). The order that this gives need not be exact, only one for all texts.
SLOTS = 1 << 16
_P = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = mix64(np.arange(1, SKETCHES + 1, dtype=np.uint64) * _P) | np.uint64(1)
#: Elements hashed at once: bounds the memory that a very long text takes.
_BLOCK = 1 << 20


def word_hashes(ws: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))


def shingles(ws: list[bytes]) -> np.ndarray:
    """64-bit hashes of the five-word shingles in text order; a shorter text is one shingle, no words none."""
    if not ws:
        return np.zeros(0, np.uint64)
    h = word_hashes(ws)
    k = min(SHINGLE, len(h))
    out = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        out = out * _P + h[j : len(h) - k + 1 + j]
    return mix64(out)


def occurrence_labelled(s: np.ndarray) -> np.ndarray:
    """The n-th occurrence of a shingle gets a hash of its own; first ones keep theirs."""
    order = np.argsort(s, kind="stable")
    t = s[order]
    first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
    if len(first) == len(s):
        return s
    nth = np.arange(len(s)) - np.repeat(first, np.diff(np.r_[first, len(s)]))
    out = np.empty_like(s)
    out[order] = np.where(nth > 0, mix64(t + nth.astype(np.uint64) * _P), t)
    return out


def sketch(s: np.ndarray) -> np.ndarray:
    """One key for each hash function; no shingles: no keys."""
    n, m = len(s), len(_FACTORS)
    if not n:
        return np.zeros(0, np.int64)
    label = occurrence_labelled(s)
    picked = np.empty((m, min(MINIMA, n)), np.int64)
    step = max(1, _BLOCK // n)
    for i in range(0, m, step):
        v = label[None, :] * _FACTORS[i : i + step, None]
        rows = np.arange(len(v))
        for j in range(picked.shape[1]):
            at = v.argmin(1)
            picked[i : i + step, j] = at
            v[rows, at] = np.uint64(2**64 - 1)
    picked.sort(1)
    key = mix64(np.arange(m, dtype=np.uint64))
    for j in range(picked.shape[1]):
        key = mix64(key * _P + label[picked[:, j]])
    return key.view(np.int64)


def aligned(x: np.ndarray, y: np.ndarray, least: float = SIMILAR) -> bool:
    """Whether the best in-order alignment of x and y reaches that similarity.

    The similarity is the share of the longer text that is matched. An alignment that reaches it leaves at
    most d elements unmatched, so it stays within d of the main diagonal: the longest common
    subsequence is counted bit-parallel in that band alone.
    """
    n, m = len(x), len(y)
    if not n or not m:
        return n == m
    need = int(np.ceil(least * max(n, m) - 1e-9))
    if min(n, m) < need:
        return False
    k = min(n, m)
    same = np.flatnonzero(x[:k] != y[:k])
    head = int(same[0]) if len(same) else k
    same = np.flatnonzero(x[n - (k - head) :][::-1] != y[m - (k - head) :][::-1])
    tail = int(same[0]) if len(same) else k - head
    x, y = x[head : n - tail].tolist(), y[head : m - tail].tolist()
    matched = head + tail
    if not x or not y or matched >= need:
        return matched >= need
    if len(set(x) & set(y)) + matched + (len(x) - len(set(x))) < need:
        return False
    d = n + m - 2 * need
    at: dict[int, list[int]] = {}
    for i, v in enumerate(x):
        at.setdefault(v, []).append(i)
    width = 2 * d + 1
    full = (1 << width) - 1
    s, low = full, -d  # bit b stands for x[low + b]; a zero bit is a matched element
    zeros = 0
    for i, v in enumerate(y):
        if i:
            zeros += not s & 1
            s = (s >> 1) | (1 << (width - 1))
            low += 1
        u = 0
        for p in at.get(v, ()):
            if low <= p < low + width:
                u |= 1 << (p - low)
        u &= s
        if u:
            s = ((s + u) | (s - u)) & full
    return matched + zeros + width - s.bit_count() >= need


def alike_lengths(a: Column, b: Column) -> Column:
    """What any pair of that similarity satisfies, in integers: 5 * shorter >= 4 * longer at 0.8."""
    return F.least(a, b) >= F.ceil(F.greatest(a, b) * F.lit(SIMILAR) - 1e-9)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sig, keys, sizes = [], [], []
        for t in b.column("text").to_pylist():
            ws = t.encode("utf-8", "surrogatepass").split()
            sig.append(hashlib.blake2b(b" ".join(ws), digest_size=16).digest())
            keys.append(sketch(shingles(ws)))
            sizes.append(len(ws))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sig, pa.binary()), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "sig", "n", "keys"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep, held = [], {}
        for ta, tb in zip(b.column("text_a").to_pylist(), b.column("text_b").to_pylist(), strict=True):
            both = []
            for t in (ta, tb):
                if t not in held:
                    held[t] = word_hashes(t.encode("utf-8", "surrogatepass").split())
                both.append(held[t])
            keep.append(aligned(*both))
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        bags = [occurrence_labelled(word_hashes(t.encode("utf-8", "surrogatepass").split())).astype(np.uint32).view(np.int32) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(bags, pa.list_(pa.int32()))], names=["doc_id", "bag"])


def rare_words(bag: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The n - ceil(0.8 n) + 1 words of a bag that come first, rarest slots before others.

    An alignment matches 0.8 or more of both texts' words, so at most n - ceil(0.8 n) words of either one are left
    out: of two such texts, the matched word that is first in this order stands in both selections.
    """
    n = len(bag)
    return bag[np.lexsort((bag, counts[bag & (SLOTS - 1)]))[: n - int(np.ceil(SIMILAR * n - 1e-9)) + 1]]


def _rare(bags: DataFrame) -> DataFrame:
    """doc_id, n (its words) and rare, the rare words that texts of one doc_id and length have; bags: doc_id, bag."""
    counts = np.zeros(SLOTS, np.int64)
    slot = F.col("word").bitwiseAND(F.lit(SLOTS - 1))
    for r in bags.select(F.explode("bag").alias("word")).groupBy(slot.alias("slot")).count().collect():
        counts[r["slot"]] = r["count"]

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = [np.array(x, np.int32) for x in b.column("bag").to_pylist()]
            rare = [rare_words(x, counts) for x in whole]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) for x in whole], pa.int32()), pa.array(rare, pa.list_(pa.int64()))], names=["doc_id", "n", "rare"])

    return bags.mapInArrow(picked, "doc_id long, n int, rare array<long>").groupBy("doc_id", "n").agg(F.array_distinct(F.flatten(F.collect_set("rare"))).alias("rare"))


def _bounded(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """The pairs (a, b) whose bags of words have enough in common for an alignment, an exact bound; those without a bag stay."""
    of = lambda c: bags.select(F.col("doc_id").alias(c), F.col("bag").alias(f"bag_{c}"))
    # words of one text whose hashes are equal count once in an intersection
    most = F.size(F.array_intersect("bag_a", "bag_b")) + F.size("bag_a") - F.size(F.array_distinct("bag_a"))
    enough = most >= F.ceil(F.greatest(F.size("bag_a"), F.size("bag_b")) * F.lit(SIMILAR) - 1e-9)
    return pairs.join(of("b"), "b", "left").join(of("a"), "a", "left").where(F.col("bag_a").isNull() | F.col("bag_b").isNull() | enough).select("a", "b").distinct()


def _joined(keys: DataFrame, docs: DataFrame, tested: DataFrame, links: Callable[[DataFrame], DataFrame], root: DataFrame) -> DataFrame:
    """(id, root) after all pairs of a bucket whose components differ have been compared. keys: key, doc_id, n.

    The members of a bucket's largest component need no comparison with each other. All other texts take turns,
    in slices by a hash that grow from round to round, in being compared with every text of another component
    with which they share a bucket, so that what one round joins spares the next ones. Texts meet at the keys of their
    buckets; in hot buckets they meet at their rare words instead: an exact bound, so that a passage that
    many texts share makes no pairs. Bags of words then rule out more pairs before texts are fetched.
    """
    labelled = lambda rows: rows.join(root, F.col("doc_id") == F.col("id"), "left").withColumn("root", F.coalesce("root", "doc_id")).drop("id")
    rows = labelled(keys)
    mixed = materialise(rows.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("n")).where("r0 < r1 and n > 2").select("key"), "mixed-keys")
    rows = materialise(rows.join(mixed, "key"), "mixed-buckets")
    kinds = rows.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "root")).alias("main"), F.sum("n").alias("all"))
    kinds = materialise(kinds.select("key", F.col("main.root").alias("main"), (F.col("all") - F.col("main.n")).alias("others")), "bucket-kinds")
    cold = F.col("others") <= HOT
    members = rows.join(kinds, "key").groupBy("doc_id", "n").agg(
        F.collect_set("key").alias("mine"), F.collect_set(F.when(cold, F.col("key"))).alias("points"), F.max(~cold).alias("hot"), F.max(F.when(F.col("root") != F.col("main"), F.col("others"))).alias("turn"),
    )
    members = materialise(members, "bucket-members")
    written, (most, hot) = [mixed, rows, kinds, members], members.agg(F.max("turn"), F.max("hot")).first()
    if hot:
        bags = materialise(docs.join(members.where("hot").select("doc_id").distinct(), "doc_id", "left_semi").mapInArrow(_bags, "doc_id long, bag array<int>"), "bags")
        both = members.join(_rare(bags), ["doc_id", "n"], "left")
        members = materialise(both.withColumn("points", F.when(F.col("hot"), F.concat("points", "rare")).otherwise(F.col("points"))).drop("rare"), "bucket-points")
        written += [bags, members]
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30) * F.col("turn")
    members = members.select("doc_id", "n", "mine", "points", F.coalesce(place, F.lit(-1.0)).alias("place"))
    low, high = 0, TURN
    while (most or 0) > low:
        now = labelled(members.where((F.col("place") < 0) | (F.col("place") >= low))).select("doc_id", "n", "mine", "place", "root", F.explode("points").alias("point"))
        centre = now.where((F.col("place") >= low) & (F.col("place") < high)).select(F.col("point").alias("meeting"), F.col("doc_id").alias("centre"), F.col("n").alias("m"), F.col("root").alias("centre_root"), F.col("mine").alias("theirs"))
        met = now.join(
            centre,
            (F.col("point") == F.col("meeting")) & (F.col("root") != F.col("centre_root")) & alike_lengths(F.col("n"), F.col("m")) & F.arrays_overlap("mine", "theirs"),
        )
        new = materialise(met.select(F.least("doc_id", "centre").alias("a"), F.greatest("doc_id", "centre").alias("b")).distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
        found = materialise(links(_bounded(new, bags) if hot else new), "links")
        discard(new)
        if found.take(1):
            # components of the roots that the links join, then each id's root by them
            by = root.withColumnRenamed("root", "r")
            ends = found.join(by.withColumnRenamed("r", "ra"), F.col("a") == F.col("id"), "left").drop("id").join(by.withColumnRenamed("r", "rb"), F.col("b") == F.col("id"), "left").drop("id")
            merged = components(ends.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))).withColumnsRenamed({"id": "old", "root": "new"})
            known = root.join(merged, F.col("root") == F.col("old"), "left").select("id", F.coalesce("new", "root").alias("root"))
            root = materialise(known.unionByName(merged.select(F.col("old").alias("id"), F.col("new").alias("root"))).distinct(), "roots")
        if high >= most:
            break
        low, high = high, high * GROWTH
    discard(*written)
    return root


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class) of every document.

    Documents with the same words in the same order are one text (so all without words, null or empty,
    are one class); only the first of them is sketched and compared. A bucket holds the texts with one sketch:
    every member is first compared with two fixed members; pairs that this leaves in different classes are
    compared too (see _joined), so the classes are those of all pairs of a bucket. Pairs whose lengths alone
    rule out the similarity are never compared. Rows that repeat a doc_id count once; rows without one are
    left out. An empty table gives no rows. Other columns of docs are ignored.
    """
    tune(docs.sparkSession)
    docs = documents_only(docs).where("doc_id is not null")
    base = materialise(docs.mapInArrow(_sketches, "doc_id long, sig binary, n int, keys array<long>"), "sketches")
    # only texts that occur twice are joined, and against a written table: a hot text's rows can then be split
    copied = materialise(base.groupBy("sig").agg(F.min("doc_id").alias("first"), F.count("*").alias("times")).where("times > 1").select("sig", "first"), "copied")
    member = materialise(base.join(copied, "sig", "left").select("doc_id", F.coalesce("first", "doc_id").alias("first"), "n", F.when(F.coalesce("first", "doc_id") == F.col("doc_id"), F.col("keys")).alias("keys")), "members")
    discard(base, copied)
    one = member.where("keys is not null").select("doc_id", "n", F.explode("keys").alias("key"))
    centre = one.groupBy("key").agg(F.min(F.struct("doc_id", "n")).alias("c1"), F.min(F.struct(F.xxhash64("doc_id").alias("h"), "doc_id", "n")).alias("c2"), F.max("doc_id").alias("top")).where(F.col("top") > F.col("c1.doc_id"))
    centre = materialise(centre.select("key", F.array_distinct(F.array("c1", F.struct("c2.doc_id", "c2.n"))).alias("centres")), "centres")
    keys = materialise(one.join(centre, "key").select("key", "doc_id", "n", "centres"), "bucket-keys")
    met = keys.select("doc_id", "n", F.explode("centres").alias("c")).where((F.col("doc_id") != F.col("c.doc_id")) & alike_lengths(F.col("n"), F.col("c.n")))
    pairs = materialise(met.select(F.least("doc_id", "c.doc_id").alias("a"), F.greatest("doc_id", "c.doc_id").alias("b")).distinct(), "pairs")
    text = lambda c: docs.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}"))
    links = lambda pairs: pairs.join(text("b"), "b").join(text("a"), "a").select("a", "b", "text_a", "text_b").mapInArrow(_verified, "a long, b long")
    root = _joined(keys.select("key", "doc_id", "n"), docs, pairs, links, components(links(pairs)))
    discard(keys, centre)
    return member.select("doc_id", "first").distinct().join(root, F.col("first") == F.col("id"), "left").groupBy("doc_id").agg(F.min(F.coalesce("root", "first")).alias("class_id"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs but for those whose doc_id is not the least of its class; rows without a doc_id stay, as do all rows of a doc_id that stays."""
    gone = near_duplicates(docs).where("doc_id <> class_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
