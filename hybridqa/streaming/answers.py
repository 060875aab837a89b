"""Streams of utterances: answers by micro-batch, running service counters, an exact LRU cache as keyed state."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hybridqa.config import Config
from hybridqa.cluster import ship
from hybridqa.plans.answer import Index, answer


def serve(utterances: DataFrame, index: Index, sink: Callable[[DataFrame, int], None], checkpoint: str, cfg: Config = Config(), mode: str = "direct") -> StreamingQuery:
    """Answers a stream of (q, raw). Rankings need whole windows, which streams don't have, so each micro-batch is answered as a batch over the static index."""

    def batch(df: DataFrame, epoch: int) -> None:
        sink(answer(df, index, cfg, mode), epoch)

    return utterances.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_stats(results: DataFrame, fallback: str = "is_fallback", latency: str = "latency_s") -> DataFrame:
    """Counters of a stream of results, for complete mode."""
    return results.groupBy().agg(F.count("*").alias("requests"), F.count_if(fallback).alias("fallbacks"), F.avg(F.col(fallback).cast("double")).alias("fallback_rate"), F.avg(latency).alias("avg_latency"))


class LRU:
    """The least recently used key goes when there are more than size; a hit makes a key the most recent."""

    def __init__(self, size: int, keys: list[str] | None = None) -> None:
        self.size, self.keys = size, OrderedDict((k, True) for k in keys or ())

    def seen(self, key: str, keep: bool = True) -> bool:
        hit = key in self.keys
        if hit:
            self.keys.move_to_end(key)
        elif keep:
            self.keys[key] = True
            if len(self.keys) > self.size:
                self.keys.popitem(last=False)
        return hit

    def clear(self) -> None:
        self.keys.clear()


def lru_hits(requests: DataFrame, size: int = Config().cache_size) -> DataFrame:
    """instance, seq, key, cached of a batch of (instance, seq, key, success): each instance has a cache of its own; only successes are kept."""
    ship(requests.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cache = LRU(size)
        pdf = pdf.sort_values("seq")
        return pdf.assign(cached=[cache.seen(k, bool(ok)) for k, ok in zip(pdf["key"], pdf["success"], strict=True)])[["instance", "seq", "key", "cached"]]

    return requests.groupBy("instance").applyInPandas(run, "instance string, seq long, key string, cached boolean")


def lru_stream(requests: DataFrame, size: int = Config().cache_size) -> DataFrame:
    """As lru_hits for a stream: the keys of an instance, in order of use, are its state, bounded by size."""
    ship(requests.sparkSession)

    def run(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cache = LRU(size, list(state.get[0]) if state.exists else None)
        pdf = pd.concat(list(batches)).sort_values("seq")
        out = pdf.assign(cached=[cache.seen(k, bool(ok)) for k, ok in zip(pdf["key"], pdf["success"], strict=True)])
        state.update((list(cache.keys),))
        yield out[["instance", "seq", "key", "cached"]]

    return requests.groupBy("instance").applyInPandasWithState(run, "instance string, seq long, key string, cached boolean", "keys array<string>", "append", GroupStateTimeout.NoTimeout)


class Service:
    """One utterance at a time over an index: a thin facade for a web server or a shell. Answers are kept in an exact LRU cache."""

    def __init__(self, index: Index, cfg: Config = Config(), mode: str = "direct", **plug_ins: Any) -> None:
        self.index, self.cfg, self.mode, self.plug_ins = index, cfg, mode, plug_ins
        self.kept: OrderedDict[str, dict[str, Any]] = OrderedDict()
        self.requests = self.fallbacks = self.hits = 0
        self.seconds = 0.0

    def answer_one(self, text: str | None) -> dict[str, Any]:
        began = time.time()
        key = f"{self.mode}:{(text or '').strip()}"
        found = self.kept.get(key) if self.cfg.cache else None
        if found:
            self.kept.move_to_end(key)
            out = found | {"cached": True}
        else:
            spark = self.index.articles.sparkSession
            out = answer(spark.createDataFrame([(1, text)], "q long, raw string"), self.index, self.cfg, self.mode, **self.plug_ins).first().asDict()
            if self.cfg.cache and not out["is_fallback"]:
                self.kept[key] = out
                if len(self.kept) > self.cfg.cache_size:
                    self.kept.popitem(last=False)
        out = out | {"latency_s": time.time() - began}
        self.requests, self.fallbacks, self.hits, self.seconds = self.requests + 1, self.fallbacks + out["is_fallback"], self.hits + out["cached"], self.seconds + out["latency_s"]
        return out

    def health(self) -> dict[str, Any]:
        return {"status": "ok", "articles": self.index.articles.count(), "mode": self.mode}

    def stats(self) -> dict[str, Any]:
        n = max(1, self.requests)
        return {"requests": self.requests, "fallbacks": self.fallbacks, "fallback_rate": self.fallbacks / n, "cache_hits": self.hits, "cache_size": len(self.kept), "avg_latency_s": self.seconds / n}

    def clear_cache(self) -> int:
        n = len(self.kept)
        self.kept.clear()
        return n
