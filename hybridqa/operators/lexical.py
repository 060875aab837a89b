"""BM25 over an inverted index of four tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hybridqa.config import Config


@dataclass
class LexicalIndex:
    postings: DataFrame  # term, doc, tf
    lengths: DataFrame  # doc, dl
    terms: DataFrame  # term, df, idf
    stats: DataFrame  # n, avg_dl: one row


def term_freq(docs: DataFrame) -> DataFrame:
    """doc, term, tf of (doc, tokens)."""
    return docs.select("doc", F.explode("tokens").alias("term")).groupBy("doc", "term").agg(F.count("*").alias("tf"))


def doc_lengths(docs: DataFrame) -> DataFrame:
    return docs.select("doc", F.size("tokens").cast("long").alias("dl"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """Documents without tokens count."""
    return lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avg_dl"))


def doc_freq(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def with_idf(df: DataFrame, stats: DataFrame) -> DataFrame:
    """The one row of corpus statistics goes to every term."""
    n = F.col("n")
    return df.crossJoin(F.broadcast(stats.select("n"))).select("term", "df", F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))


def build(docs: DataFrame) -> LexicalIndex:
    """docs: doc, tokens. A corpus without documents raises."""
    if docs.isEmpty():
        raise ValueError("no documents to index")
    postings = term_freq(docs)
    lengths = doc_lengths(docs)
    stats = corpus_stats(lengths)
    return LexicalIndex(postings, lengths, with_idf(doc_freq(postings), stats), stats)


def part(cfg: Config = Config()) -> Column:
    """What a term adds to a document's score, of idf, tf, dl and avg_dl."""
    tf, dl = F.col("tf"), F.col("dl")
    return F.col("idf") * tf * (cfg.k1 + 1) / (tf + cfg.k1 * (1 - cfg.b + cfg.b * dl / F.col("avg_dl")))


def weighted_terms(index: LexicalIndex, cfg: Config = Config()) -> DataFrame:
    """doc, terms, weights of every document: its terms and what each adds to a score."""
    each = index.postings.join(index.terms, "term").join(index.lengths, "doc").crossJoin(F.broadcast(index.stats.select("avg_dl"))).select("doc", F.struct("term", part(cfg).alias("weight")).alias("t"))
    own = each.groupBy("doc").agg(F.sort_array(F.collect_list("t")).alias("t"))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    return index.lengths.select("doc").join(own, "doc", "left").select("doc", F.coalesce("t.term", none("string")).alias("terms"), F.coalesce("t.weight", none("double")).alias("weights"))


def scores(queries: DataFrame, index: LexicalIndex, cfg: Config = Config()) -> DataFrame:
    """q, doc, bm25 of every document that shares a term; an index that isn't built raises. queries: q, tokens; repeated terms count once.

    Query terms meet the postings in an equi-join on term, so documents without a common term are never touched.
    """
    if index is None:
        raise ValueError("the index is not built")
    terms = queries.select("q", F.explode(F.array_distinct("tokens")).alias("term"))
    return (
        terms.join(index.terms, "term").join(index.postings, "term").join(index.lengths, "doc").crossJoin(F.broadcast(index.stats.select("avg_dl")))
        .groupBy("q", "doc").agg(F.sum(part(cfg)).alias("bm25"))
    )


def scores_of_set(queries: DataFrame, docs: DataFrame, cfg: Config = Config()) -> DataFrame:
    """As scores over a corpus (doc, tokens) that has no index: only the queries' terms become postings, which carry their document's length."""
    terms = queries.select("q", F.explode(F.array_distinct("tokens")).alias("term"))
    wanted = terms.select("term").distinct()
    stats = corpus_stats(doc_lengths(docs))
    postings = docs.select("doc", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).join(wanted, "term", "left_semi").groupBy("doc", "dl", "term").agg(F.count("*").alias("tf"))
    idf = doc_freq(postings).crossJoin(F.broadcast(stats)).select("term", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"), "avg_dl")
    return terms.join(idf, "term").join(postings, "term").groupBy("q", "doc").agg(F.sum(part(cfg)).alias("bm25"))


def best_form(by_form: DataFrame) -> DataFrame:
    """Of the scores of a query's forms (q, form, doc, bm25) the best for each document."""
    return by_form.groupBy("q", "doc").agg(F.max("bm25").alias("bm25"))


def ranked(df: DataFrame, score: Column, *ties: str, name: str = "rank", by: str = "q") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(score.desc(), *ties)).cast("long"))


def top_k(df: DataFrame, k: int, score: str = "bm25") -> DataFrame:
    """The k best documents of each query, ties by document."""
    return ranked(df, F.col(score), "doc").where(F.col("rank") <= k)
