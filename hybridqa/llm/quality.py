"""Operator 10, quality rules: gradient-boosted trees over document statistics.

Trees are grown by histograms in numpy with monotonic constraints on chosen features, then
flattened into node arrays and scored in Arrow batches, one vector step for each level of the trees.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hybridqa.llm.common import documents_only, table, tune

SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOL = bytes(set(range(256)) - set(SYMBOLS))
_UPPER = bytes(range(65, 91))
_CONTINUATION = bytes(range(0x80, 0xC0))
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Feature, and the sign that the kept score must have in it (0: free).
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbol_rate": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1,
    "digit_share": 0, "bang_rate": -1, "distinct_share": 0, "ended_lines": 0, "words_a_line": 0, "pipe_rate": -1,
}


def statistics(text: str | None) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """The five base counts and the features of one whole text (null and empty: zeros)."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    ws = raw.split()
    n = len(ws)
    joined = b"".join(ws)
    chars = len(joined.translate(None, _CONTINUATION))
    symbols = len(raw.translate(None, _NOT_SYMBOL))
    lines = [x for x in raw.split(b"\n") if x.split()] if b"\n" in raw else [raw] if n else []
    dup = len(lines) - len(set(lines))
    repeat = 0
    if n >= 6:
        grams = list(zip(ws, ws[1:], ws[2:], ws[3:], ws[4:], strict=False))
        if len(set(grams)) < len(grams):
            times, end = Counter(grams), 0
            for i, g in enumerate(grams):
                if times[g] > 1:
                    repeat += i + 5 - max(end, i)
                    end = i + 5
    base = (n, chars, symbols, dup, repeat)
    if not n:
        return base, (0.0,) * len(FEATURES)
    upper = len(joined) - len(joined.translate(None, _UPPER))
    return base, (
        float(np.log1p(n)), chars / n, symbols / n, dup / len(lines), repeat / n, upper / max(1, chars),
        (len(raw) - len(raw.translate(None, b"0123456789"))) / max(1, chars), raw.count(b"!") / n, len(set(ws)) / n,
        sum(x.rstrip()[-1:] in b".!?\"" for x in lines) / len(lines), n / len(lines), raw.count(b"|") / n,
    )


@dataclass
class Trees:
    """Node arrays: a leaf points at itself, so that every row can take the same number of steps."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        rows = np.arange(len(x))
        total = np.full(len(x), self.start)
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            total += self.value[at]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 40, depth: int = 3, rate: float = 0.25, bins: int = 32, ridge: float = 1.0, least: int = 8) -> Trees:
    """Boosts logistic loss. A split on a feature with a sign is taken only if its leaf values are in that order, and the two sides are then kept apart at their mean."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(1) for j in range(x.shape[1])]
    binned = [np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)]
    rate0 = (y.sum() + 1) / (len(y) + 2)
    start = float(np.log(rate0 / (1 - rate0)))
    total = np.full(len(y), start)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        k = len(feature)
        for a, v in ((feature, 0), (threshold, 0.0), (left, k), (right, k), (value, 0.0)):
            a.append(v)
        return k

    for _ in range(trees if len(y) else 0):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        roots.append(node())
        todo = [(roots[-1], np.arange(len(y)), 0, -np.inf, np.inf)]
        while todo:
            k, rows, level, low, high = todo.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            best = None
            if level < depth and len(rows) >= 2 * least:
                for j, e in enumerate(edges):
                    b, m = binned[j][rows], len(e) + 1
                    gl, hl, nl = (np.cumsum(np.bincount(b, w, m))[:-1] for w in (g[rows], h[rows], None))
                    gr, hr, nr = gs - gl, hs - hl, len(rows) - nl
                    vl, vr = (np.clip(a / (c + ridge), low, high) for a, c in ((gl, hl), (gr, hr)))
                    gain = gl * vl - (hl + ridge) * vl**2 / 2 + gr * vr - (hr + ridge) * vr**2 / 2
                    gain[(nl < least) | (nr < least) | (signs[j] * (vr - vl) < 0)] = -np.inf
                    if len(gain) and (i := int(gain.argmax())) >= 0 and gain[i] > -np.inf and (best is None or gain[i] > best[0]):
                        best = (gain[i], j, i, vl[i], vr[i])
            own = float(np.clip(gs / (hs + ridge), low, high))
            if best is None or best[0] <= gs * own - (hs + ridge) * own**2 / 2 + 1e-6:
                value[k] = rate * own
                total[rows] += value[k]
                continue
            _, j, i, vl, vr = best
            feature[k], threshold[k], left[k], right[k] = j, float(edges[j][i]), node(), node()
            middle, goes = (vl + vr) / 2, binned[j][rows] <= i
            bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[signs[j]]
            todo += [(left[k], rows[goes], level + 1, *bounds[0]), (right[k], rows[~goes], level + 1, *bounds[1])]
    as_int = lambda a: np.array(a, np.int32)
    return Trees(as_int(feature), np.array(threshold), as_int(left), as_int(right), np.array(value), as_int(roots), depth, start)


_STATS = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in BASE), *((c, pa.float64()) for c in FEATURES)])


def _stats_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [statistics(t) for t in b.column("text").to_pylist()]
        columns = list(zip(*((*x, *y) for x, y in got), strict=True)) or [()] * (len(BASE) + len(FEATURES))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(columns, list(_STATS)[1:], strict=True))], schema=_STATS)


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts and the features of every whole text."""
    kinds = ", ".join(["doc_id long", *(f"{c} long" for c in BASE), *(f"{c} double" for c in FEATURES)])
    return documents_only(docs).mapInArrow(_stats_batches, kinds)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> Trees:
    """Fits on at most max_rows labelled rows, the ones whose doc_id hashes lowest: the bound of the sample is this parameter."""
    chosen = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    got = document_statistics(docs.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")).join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", *FEATURES).toPandas().sort_values("doc_id")
    return fit_trees(got[list(FEATURES)].to_numpy(float).reshape(-1, len(FEATURES)), (got["quality"].to_numpy() > 0).astype(float), list(FEATURES.values()))


def quality_rules(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, keep_at: float = 0.5) -> DataFrame:
    """Every document's counts, the base rules' verdict and the trees' score.

    Null and empty texts have zeros and fail the base rule (fewer than ten words). Rows with the same
    doc_id are judged each by its own text. Without labelled rows the trees keep what the base rules keep.
    Other columns of docs are ignored.
    """
    tune(docs.sparkSession)
    model = train(docs, labels, max_rows)
    out_schema = pa.schema([*list(_STATS)[: 1 + len(BASE)], ("base_failed", pa.bool_()), ("score", pa.float64()), ("kept", pa.bool_())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _stats_batches(batches):
            x = np.column_stack([b.column(c).to_numpy() for c in FEATURES])
            score = model.score(x) if len(x) else np.zeros(0)
            n, repeat = b.column("n_words").to_numpy(), b.column("n_repeat_words").to_numpy()
            failed = (n < 10) | (100 * repeat > 20 * n)
            yield pa.RecordBatch.from_arrays([*b.columns[: 1 + len(BASE)], pa.array(failed), pa.array(score), pa.array(~failed & (score >= keep_at))], schema=out_schema)

    kinds = ", ".join(["doc_id long", *(f"{c} long" for c in BASE), "base_failed boolean, score double, kept boolean"])
    return documents_only(docs).mapInArrow(judge, kinds)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns; the verdict is made in the same pass as the row."""
    tune(docs.sparkSession)
    model = train(docs, labels)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [statistics(t) for t in b.column("text").to_pylist()]
            if not got:
                continue
            score = model.score(np.array([f for _, f in got], float))
            yield b.filter(pa.array([bool(s >= 0.5 and c[0] >= 10 and 100 * c[4] <= 20 * c[0]) for (c, _), s in zip(got, score, strict=True)]))

    return docs.mapInArrow(rows, docs.schema)


