"""Operator 5, toxicity: a learned lexicon in a trie, met by Levenshtein automata, and context windows.

Each different word is read once by its automaton of one edit, which walks a trie of the lexicon: whole terms are met
whole, stems as prefixes. A misspelling counts only where the words of clean documents seldom look like it.
Each hit then looks at the words around it: quotation marks and reporting words speak for a quotation, direct
address for abuse. A logistic regression weighs the counts; misspelled and quoted hits, which labelled documents
seldom have, are added to its rows.
"""

from __future__ import annotations

import random
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hybridqa.llm.common import discard, documents_only, materialise, table, tune

FOLDS = 5
_STRIP = ".,;:!?\"'()[]{}«»“”„‘’…*#%&$|<>"
_OPEN = "\"«“„‘"
_QUOTES = _OPEN + "»”’"
#: Words that report speech, and words of direct address, in the four languages of the documents. Fixed values.
REPORT = frozenset("said says wrote called quote quoted according dit écrit selon appelé sagte schrieb nannte zitat laut dijo escribió según llamó".split())
ADDRESS = frozenset("you your you're yourself tu toi vous votre du dich dir dein sie tú usted te ti".split())
WINDOW = 5
STEM = (4, 8)
#: Letters that a term or stem needs to be met with an edit.
FUZZY_FROM = 4
PRECISION = 0.85
#: Log odds from which a misspelling counts in full.
FULL_EVIDENCE = 5.0
#: Clean documents that make a word known: known words are no misspellings.
KNOWN = 3


class Trie:
    """A trie of terms and stems that an automaton of one edit walks."""

    def __init__(self, terms: tuple[str, ...] | list[str], stems: tuple[str, ...] | frozenset[str] = ()) -> None:
        self.root: dict = {}
        self.heads: dict[int, set[str]] = {}
        self.tails: dict[tuple[int, int], set[str]] = {}
        for mark, entries in ((0, terms), (1, stems)):
            for t in entries:
                half = len(t) // 2
                self.heads.setdefault(half, set()).add(t[:half])
                for shift in (-1, 0, 1):
                    self.tails.setdefault((max(0, half + shift), len(t) + max(0, half + shift) - half), set()).add(t[half:])
                at = self.root
                for c in t:
                    at = at.setdefault(c, {})
                at[mark] = t

    def may_be_near(self, word: str) -> bool:
        """False only if no entry is near: an edit leaves one half of an entry as it is, the first at its place, the second at most one place off."""
        return any(word[:n] in some for n, some in self.heads.items()) or any(word[a:b] in some for (a, b), some in self.tails.items())

    def near(self, word: str, every: bool = True) -> list[tuple[int, str]]:
        """(0, term) of each term at most one edit from the word, (1, stem) of each stem so near to a prefix of it; without every, the first one found.

        Bit i of a state set means that i letters of the word are read, with no or one edit.
        """
        if not self.may_be_near(word):
            return []
        masks: dict[str, int] = {}
        for i, c in enumerate(word):
            masks[c] = masks.get(c, 0) | 1 << i
        end = 1 << len(word)
        todo, out = [(self.root, 1, 3)], []
        while todo:
            at, none, one = todo.pop()
            for c, below in at.items():
                if c == 0 or c == 1:
                    if one & (end if c == 0 else 2 * end - 1):
                        out.append((c, below))
                        if not every:
                            return out
                    continue
                m = masks.get(c, 0)
                n0 = (none & m) << 1
                n1 = (one & m) << 1 | none | none << 1 | n0 << 1
                if (n0 | n1) & (2 * end - 1):
                    todo.append((below, n0, n1))
        return out


@dataclass
class Model:
    stems: frozenset[str]
    terms: tuple[str, ...]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(N_FEATURES + 1))
    #: Words that are no misspellings, and what a misspelling of (0, term) or (1, stem) counts, from 0 to 1 (not given: 1).
    known: frozenset[str] = frozenset()
    evidence: dict[tuple[int, str], float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.exact = frozenset(self.terms)
        fuzzy = lambda k, entries: [t for t in entries if len(t) >= FUZZY_FROM and self.evidence.get((k, t), 1.0) > 0]
        self.trie = Trie(fuzzy(0, self.terms), fuzzy(1, self.stems))
        self.held: dict[str, float] = {}

    def __getstate__(self) -> tuple:
        return self.stems, self.terms, self.weights, self.known, self.evidence

    def __setstate__(self, state: tuple) -> None:
        self.stems, self.terms, self.weights, self.known, self.evidence = state
        self.__post_init__()

    def whole(self, w: str) -> int:
        """3 a term, 2 a stem and more, else 0."""
        if w in self.exact:
            return 3
        return 2 * any(w[:n] in self.stems for n in range(STEM[0], min(STEM[1], len(w)) + 1))

    def kind(self, w: str) -> float:
        """As whole, else the most that it counts as a term or stem with one edit."""
        whole = self.whole(w)
        if whole or len(w) < FUZZY_FROM - 1 or w in self.known:
            return whole
        return max((self.evidence.get(e, 1.0) for e in self.trie.near(w)), default=0)

    def features(self, text: str) -> list[float]:
        raw = text.lower().split()
        if len(self.held) > 400_000:
            self.held = {}
        held = self.held
        kinds = list(map(held.get, raw))
        if None in kinds:
            for i, k in enumerate(kinds):
                if k is None:
                    w = raw[i]
                    kinds[i] = held[w] if w in held else held.setdefault(w, self.kind(w.strip(_STRIP)))
        if not any(kinds):
            return [0.0] * N_FEATURES
        at = [i for i, k in enumerate(kinds) if k]
        quoted = addressed = 0
        for i in at:
            near = raw[max(0, i - WINDOW) : i + WINDOW + 1]
            before = "".join(x for x in raw[max(0, i - WINDOW) : i + 1] if x[:1] in _OPEN)
            after = any(x[-1:] in _QUOTES or x.rstrip(_STRIP) != x and any(q in x for q in _QUOTES) for x in raw[i : i + WINDOW + 1])
            quoted += bool(before) and after or any(x.strip(_STRIP) in REPORT for x in near)
            addressed += any(x.strip(_STRIP) in ADDRESS for x in near)
        n, fuzzy = Counter(kinds), sum(k for k in kinds if 0 < k <= 1)
        return [
            np.log1p(n[3]), np.log1p(n[2]), np.log1p(fuzzy), 1.0, float(n[3] > 0), float(not n[3] and not n[2]),
            np.log1p(quoted), np.log1p(len(at) - quoted), np.log1p(addressed), min(1.0, 20 * (n[3] + n[2]) / len(raw)),
        ]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


N_FEATURES = 10


def bare_words(text: str) -> set[str]:
    return {w.strip(_STRIP) for w in text.lower().split()}


def beginnings(words: set[str]) -> set[str]:
    return {w[:n] for w in words for n in range(STEM[0], min(STEM[1], len(w)) + 1)}


def choose_lexicon(found: list[tuple[str, bool]]) -> tuple[frozenset[str], tuple[str, ...]]:
    """From the forms (form, whether a stem) that are toxic enough; a stem that contains a shorter one is left out."""
    stems: set[str] = set()
    for s in sorted((f for f, stem in found if stem), key=lambda s: (len(s), s)):
        if not any(s[:n] in stems for n in range(STEM[0], len(s))):
            stems.add(s)
    return frozenset(stems), tuple(sorted(f for f, stem in found if not stem))


def misspelled(model: Model, text: str, rng: random.Random) -> str:
    """The text with one random edit in each word that is a hit."""
    out = []
    for w in text.split():
        core = w.strip(_STRIP)
        if len(core) >= FUZZY_FROM and model.whole(core.lower()):
            i, c = rng.randrange(len(core)), rng.choice("abcdefghijklmnopqrstuvwxyz")
            edit = rng.choice([core[:i] + c + core[i + 1 :], core[:i] + c + core[i:], core[:i] + core[i + 1 :]])
            w = w.replace(core, edit, 1)
        out.append(w)
    return " ".join(out)


def quoted(model: Model, text: str, rng: random.Random) -> str:
    """The text with one to three terms of the lexicon as quotations or reported speech."""
    ws = text.split()
    for _ in range(rng.randint(1, 3)):
        term, report, (a, b) = rng.choice(model.terms), rng.choice(sorted(REPORT)), rng.choice(('""', "«»", "“”", ("", "")))
        ws[(i := rng.randint(0, len(ws))) : i] = [report, a + term + b] if a == "" or rng.random() < 0.7 else [a + term + b]
    return " ".join(ws)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40) -> np.ndarray:
    """Newton steps; the last weight is the constant."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(steps if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        d = np.linalg.solve(h, a.T @ (y - p) - ridge * np.r_[w[:-1], 0])
        w += d
        if np.abs(d).max() < 1e-8:
            break
    return w


def fold() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS))


def _tallied(batches: Iterator[tuple], names: tuple[str, ...], most: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Counts of (form, mark), pre-aggregated in the worker; batches: iterables of (form, mark, one count for each name)."""

    def flush() -> pa.RecordBatch:
        rows = list(held.items())
        return pa.RecordBatch.from_arrays([pa.array([f for (f, _), _ in rows], pa.string()), pa.array([m for (_, m), _ in rows], pa.int32()), *(pa.array([c[k] for _, c in rows], pa.int64()) for k in range(len(names)))], names=["form", "mark", *names])

    held: dict[tuple[str, int], list[int]] = {}
    for form, mark, *counts in batches:
        at = held.setdefault((form, mark), [0] * len(names))
        for k, c in enumerate(counts):
            at[k] += c
        if len(held) >= most:
            yield flush()
            held.clear()
    yield flush()


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000) -> Model:
    """Fits lexicon and weights on at most max_rows labelled rows outside the held-out fold, the ones whose doc_id hashes lowest (the bound of the sample is this parameter).

    Texts stay with the workers; the driver gets the forms that make the lexicon, the few known words that look like one of
    them, and one row of features for each sampled document and each made-up variant of it.
    """
    chosen = labels.where("doc_id is not null and toxic is not null").where(fold() != 0).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    sample = materialise(documents_only(docs).join(F.broadcast(chosen), "doc_id"), "toxic-sample")
    n, n1 = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    share, counts = n1 / max(1, n), "form string, mark int"
    half = lambda d: zlib.crc32(str(d).encode()) >> 8 & 1
    rows = lambda b: zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "toxic")), strict=True)

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for b in batches:
                for d, text, y in rows(b):
                    ws = bare_words(text)
                    for mark, some in ((0, ws), (1, beginnings(ws))):
                        for f in some:
                            yield f, mark, y, 1 - y, (1 - y) * half(d)

        yield from _tallied(each(), ("k1", "k0", "half"))

    tally = materialise(sample.mapInArrow(forms, f"{counts}, k1 long, k0 long, half long").groupBy("form", "mark").agg(*(F.sum(c).alias(c) for c in ("k1", "k0", "half"))), "toxic-forms")
    least = F.when(F.col("mark") == 1, max(4, n1 // 200)).otherwise(max(4, n1 // 50))
    good = tally.where((F.col("k1") >= least) & ((F.col("k1") - share) / (F.col("k1") + F.col("k0")) >= PRECISION)).collect()
    model = Model(*choose_lexicon([(r["form"], r["mark"] == 1) for r in good]))
    toxic_docs = {(r["mark"], r["form"]): r["k1"] for r in good}

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([bool(model.trie.near(w, False)) for w in b.column("form").to_pylist()], pa.bool_()))

    known = tally.where((F.col("mark") == 0) & (F.col("half") >= KNOWN)).select("form").mapInArrow(alike, "form string").collect()
    model.known = frozenset(r["form"] for r in known if not model.whole(r["form"]))

    def mistaken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            seen: dict[str, list[tuple[int, str]]] = {}
            for b in batches:
                for d, text, y in rows(b):
                    if not y and not half(d):
                        ws = bare_words(text)
                        if len(seen) > 400_000:
                            seen.clear()
                        for w in ws - seen.keys():
                            seen[w] = model.trie.near(w) if len(w) >= FUZZY_FROM - 1 and w not in model.known and not model.whole(w) else []
                        hit = {e for w in ws for e in seen[w]}
                        for mark, entry in hit:
                            yield entry, mark, 1

        yield from _tallied(each(), ("n",))

    wrong = sample.mapInArrow(mistaken, f"{counts}, n long").groupBy("form", "mark").agg(F.sum("n").alias("n")).collect()
    # only one half of the clean documents was looked at
    false = {(r["mark"], r["form"]): 2 * r["n"] for r in wrong}
    weigh = lambda k, n: float(np.clip(np.log((k + 0.5) / (n + 0.5)) / FULL_EVIDENCE, 0, 1)) if k > 3 * n else 0.0
    evidence = {e: weigh(k, false.get(e, 0)) for e, k in toxic_docs.items() if e[1] in (model.stems if e[0] else model.exact)}
    model = Model(model.stems, model.terms, known=model.known, evidence=evidence)

    def variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, label = [], []
            for d, text, y in rows(b):
                rng, texts = random.Random(d), [(text, y)]
                if y and rng.random() < 0.7:
                    texts.append((misspelled(model, text, rng), 1))
                elif not y and model.terms and rng.random() < 0.2:
                    texts.append((quoted(model, text, rng), 0))
                x += [model.features(t) for t, _ in texts]
                label += [v for _, v in texts]
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(x, pa.list_(pa.float64()))], names=["y", "x"])

    got = sample.mapInArrow(variants, "y int, x array<double>").collect()
    got.sort()
    model.weights = fit_logistic(np.array([r["x"] for r in got], float).reshape(-1, N_FEATURES), np.array([r["y"] for r in got], float))
    discard(sample, tally)
    return model


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Null and empty texts have no hit and the score of a text without hits. Repeated rows are scored each; a label is
    toxic if any row of its doc_id says so. A row without a doc_id is scored and in no fold (held_out false). Without
    training rows every score is a half; an empty table gives no rows. Other columns are no inputs.
    """
    spark = docs.sparkSession
    tune(spark)
    shared = spark.sparkContext.broadcast(train(docs, labels, max_rows))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            x = np.array([model.features(t) for t in b.column("text").to_pylist()], float).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(x), pa.float64())], schema=schema)

    out = documents_only(docs).mapInArrow(judge, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
