"""The registered queries of the retrieval engine over the driver's tables, each with its DuckDB SQL where SQL can express it.

Articles are documents, utterances are benchmark passages or turns of conversations, variants of an article
are embeddings with one label, and the request log is events. Scores are rounded before they are ranked, so that the
order of a floating-point sum can't swap equal documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hybridqa.config import Config
from hybridqa.functions import text as T
from hybridqa.functions import tokens as K
from hybridqa.functions.intent import ALONE, KEYWORDS, intent
from hybridqa.cluster import ship
from hybridqa.operators import dense, evaluate, fusion, fuzzy, gates, lexical
from hybridqa.operators.select import overlap_score, select_best
from hybridqa.plans.answer import answer, build_index
from hybridqa.sources.kb import articles_of, category_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
CFG = Config()


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(items: tuple[str, ...]) -> str:
    return "(" + ", ".join(map(quoted, items)) + ")"


# ---- normalisation ----
RE2_SPACE = r"\p{Z}\t-\r\x1c-\x1f\x{85}"
STRIP = f"regexp_replace(%s, '^[{RE2_SPACE}]+|[{RE2_SPACE}]+$', '', 'g')"


@query(f"SELECT conv_id, turn, CASE WHEN text IS NULL THEN 'null_input' WHEN {STRIP % 'text'} = '' THEN 'empty_input' END AS reason FROM conversations")
def normalize_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.guard(F.col("text")).alias("reason"))


_RE2_NOISE = T.BRACKET_NOISE.replace(T.SPACE, RE2_SPACE)


@query(f"SELECT page_id, regexp_replace(regexp_replace(html, {quoted('(?i)' + _RE2_NOISE)}, ' ', 'g'), {quoted(T.BRACKETS)}, ' ', 'g') AS cleaned FROM pages")
def strip_brackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.strip_brackets(F.col("html")).alias("cleaned"))


@query(f"SELECT doc_id, regexp_replace(text, {quoted('(?i)' + T.longest_first(T.PHRASES))}, ' ', 'g') AS cleaned FROM documents")
def strip_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.strip_phrases(F.col("text")).alias("cleaned"))


_BARE = """regexp_replace(lower(w), '^[।?,.!"'']+|[।?,.!"'']+$', '', 'g')"""


@query(f"SELECT doc_id, array_to_string(list_filter(string_split(text, ' '), lambda w: w <> '' AND {_BARE} NOT IN {listed(T.FILLERS + T.FILLERS_MR)}), ' ') AS cleaned FROM documents")
def drop_fillers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.drop_fillers(F.col("text")).alias("cleaned"))


_COLLAPSED = STRIP % f"regexp_replace(text, '[{RE2_SPACE}]+', ' ', 'g')"


@query(f"SELECT doc_id, {_COLLAPSED} AS cleaned FROM documents")
def collapse_ws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.collapse_space(F.col("text")).alias("cleaned"))


@query("SELECT doc_id, " + "".join("regexp_replace(" for _ in range(6)) + "text" + "".join(f", '[{c}]{{2,}}', '{c}', 'g')" for c in ("।", "?", "!", ",", ".", r"\-")).replace(r"'\-', 'g'", "'-', 'g'") + " AS cleaned FROM documents")
def collapse_punctuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.collapse_marks(F.col("text")).alias("cleaned"))


@query(f"""WITH c AS (SELECT conv_id, turn, {_COLLAPSED} AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN t = '' THEN 'empty_after_cleanup' WHEN length(t) < 2 THEN 'too_short_after_cleanup' WHEN NOT regexp_matches(t, '\\p{{L}}') THEN 'no_alpha_chars' ELSE '' END AS reason FROM c""")
def garbage_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.garbage(T.collapse_space(F.col("text"))).alias("reason"))


@query("SELECT doc_id, nfc_normalize(text) AS composed FROM documents")
def nfc(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return table(spark, sf_dir, "documents").select("doc_id", T.composed(F.col("text")).alias("composed"))


@query()
def normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole normaliser; its back references are beyond the oracle's expressions."""
    ship(spark)
    return table(spark, sf_dir, "documents").select("doc_id", "text").transform(T.normalise, "text").select("doc_id", "n.cleaned", "n.is_garbage", "n.reason", F.array_join("n.transformations", ",").alias("transformations"))


# ---- tokens ----
LATIN = "list_filter(list_transform(regexp_extract_all(text, '[A-Za-z]+'), lambda x: lower(x)), lambda x: length(x) > 1)"
WORDS = "regexp_extract_all(text, '[ऀ-ॿA-Za-z]+')"


def _stem_sql(w: str) -> str:
    cases = " ".join(f"WHEN {w} LIKE '%{s}' AND length({w}) >= {K.STEM_LEAST + len(s)} THEN left({w}, length({w}) - {len(s)})" for s in K.SUFFIXES)
    return f"CASE WHEN length({w}) < {K.STEM_LEAST + 2} THEN {w} {cases} ELSE {w} END"


@query(f"SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({LATIN}) AS term FROM documents) GROUP BY ALL")
def latin_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(K.latin_words(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("n"))


@query(f"SELECT word, {_stem_sql('word')} AS stem FROM (SELECT DISTINCT unnest({LATIN}) AS word FROM documents)")
def stem_latin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.explode(K.latin_words(F.col("text"))).alias("word")).distinct().select("word", K.stem(F.col("word")).alias("stem"))


_CUT = f"regexp_replace(text, {quoted('(?i)' + T.longest_first(K.CUT))}, ' ', 'g')"


@query(f"""WITH w AS (SELECT doc_id, unnest({LATIN.replace('(text', '(t')}) AS w FROM (SELECT doc_id, {_CUT} AS t FROM documents))
SELECT doc_id, {_stem_sql('w')} AS token, count(*) AS n FROM w GROUP BY ALL""")
def tokens_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tokens. Equal words of a document are counted before they are stemmed, and each different word is stemmed once."""
    ship(spark)
    counts = table(spark, sf_dir, "documents").select("doc_id", F.explode(K.raw_tokens(F.col("text"))).alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    return counts.select("doc_id", K.stemmed(F.col("word")).alias("token"), "n").groupBy("doc_id", "token").agg(F.sum("n").alias("n"))


@query("SELECT doc_id, regexp_matches(text, '[ऀ-ॿ]') AS has_devanagari, regexp_matches(text, '[A-Za-z]') AS has_latin FROM documents")
def script_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", K.has_devanagari(F.col("text")).alias("has_devanagari"), K.has_latin(F.col("text")).alias("has_latin"))


# ---- vocabulary and correction ----
_VOCAB = f"SELECT DISTINCT lower(w) AS word FROM (SELECT unnest({WORDS}) AS w FROM documents) WHERE length(w) >= 3"


@query(_VOCAB)
def vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy.vocabulary(table(spark, sf_dir, "documents"))


@query("SELECT n_name AS a, r_name AS b, CASE WHEN levenshtein(lower(n_name), lower(r_name)) <= 6 THEN levenshtein(lower(n_name), lower(r_name)) ELSE -1 END::BIGINT AS distance FROM nation JOIN region ON n_regionkey = r_regionkey")
def edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounded edit distance of each nation from its region."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select(F.col("n_name").alias("a"), F.col("r_name").alias("b"), fuzzy.bounded_distance(F.col("n_name"), F.col("r_name"), 6).alias("distance"))


@query(f"""WITH v AS ({_VOCAB}), w AS (SELECT item_id, generate_subscripts({WORDS}, 1) AS pos, unnest({WORDS}) AS w FROM benchmark),
m AS (SELECT DISTINCT lower(w) AS word FROM w WHERE length(w) >= 4 AND lower(w) NOT IN (SELECT word FROM v)),
best AS (SELECT m.word, min(v.word) AS best FROM m JOIN v ON abs(length(m.word) - length(v.word)) <= 1 AND levenshtein(m.word, v.word) = 1 GROUP BY 1)
SELECT item_id, string_agg(CASE WHEN length(w) >= 4 THEN coalesce(best, w) ELSE w END, ' ' ORDER BY pos) AS corrected FROM w LEFT JOIN best ON lower(w.w) = best.word GROUP BY 1""")
def fuzzy_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q"), "text")
    return fuzzy.fuzzy_correct(q, fuzzy.vocabulary(table(spark, sf_dir, "documents"))).select(F.col("q").alias("item_id"), "corrected")


# the vocabulary of one source of text, against the words of another
_BENCH_VOCAB = _VOCAB.replace("documents", "benchmark")
_KNOWN = """EXISTS (SELECT 1 FROM v WHERE starts_with(v.word, w.word) OR starts_with(w.word, v.word) OR (abs(length(v.word) - length(w.word)) <= 1
 AND hamming(left(v.word, least(length(v.word), length(w.word))::BIGINT), left(w.word, least(length(v.word), length(w.word))::BIGINT)) <= 1))"""


@query(f"""WITH v AS ({_BENCH_VOCAB}), w AS (SELECT DISTINCT lower(w) AS word FROM (SELECT unnest({WORDS}) AS w FROM conversations WHERE role = 'user') WHERE length(w) >= 4)
SELECT word, {_KNOWN} AS known FROM w""")
def vocab_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = table(spark, sf_dir, "conversations").where("role = 'user'")
    w = user.select(F.explode(K.words(F.col("text"))).alias("w")).where(F.length("w") >= 4).select(F.lower("w").alias("word")).distinct()
    known = fuzzy.known_words(w, fuzzy.vocabulary(table(spark, sf_dir, "benchmark"))).withColumn("known", F.lit(True))
    return w.join(known, "word", "left").select("word", F.coalesce("known", F.lit(False)).alias("known"))


@query(f"""WITH v AS ({_BENCH_VOCAB}), t AS (SELECT conv_id, turn, list_filter({WORDS}, lambda x: length(x) >= 4) AS ws FROM conversations WHERE role = 'user'),
e AS (SELECT conv_id, turn, lower(unnest(ws)) AS word FROM t), k AS (SELECT w.word, {_KNOWN} AS known FROM (SELECT DISTINCT word FROM e) w)
SELECT t.conv_id, t.turn, count(e.word) AS n_words, count(*) FILTER (WHERE NOT known) AS n_missing, CASE WHEN count(e.word) > 0 AND (count(*) FILTER (WHERE NOT known)) / count(e.word) > 0.5 THEN 'vocab_mismatch' ELSE '' END AS reason
FROM t LEFT JOIN e USING (conv_id, turn) LEFT JOIN k USING (word) GROUP BY 1, 2""")
def vocab_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.struct("conv_id", "turn").alias("q"), "text")
    got = fuzzy.coverage(q, fuzzy.vocabulary(table(spark, sf_dir, "benchmark")))
    return got.select("q.*", "n_words", "n_missing", gates.vocab_gate(F.col("n_missing"), F.col("n_words")).alias("reason"))


# ---- intent ----
def _intent_sql(c: str) -> str:
    t = f"regexp_replace(lower({c}), '[{RE2_SPACE}]+', ' ', 'g')"
    edge = r"[^\p{L}\p{N}_]"
    has = lambda k: f"contains({t}, {quoted(k)})" if len(k) > ALONE else f"regexp_matches({t}, {quoted(f'(^|{edge}){k}({edge}|$)')})"
    (yes_no, phrases), *others = KEYWORDS
    cases = [f"WHEN trim({t}) = '' THEN 'UNKNOWN'", *(f"WHEN {has(k)} THEN '{yes_no}'" for k in phrases)]
    cases.append(f"WHEN regexp_matches({t}, '(^|{edge})(ka|kaa|का)[।॥!?.,;:{RE2_SPACE}]*$') THEN '{yes_no}'")
    cases += [f"WHEN {has(k)} THEN '{label}'" for label, ks in others for k in ks]
    return f"CASE {' '.join(cases)} ELSE 'UNKNOWN' END"


@query(f"SELECT conv_id, turn, {_intent_sql('text')} AS intent FROM conversations")
def intent_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", intent(F.col("text")).alias("intent"))


# ---- lexical retrieval ----
def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), K.latin_words(F.col("text")).alias("tokens"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q"), K.latin_words(F.col("text")).alias("tokens"))


_INDEX = f"""d AS (SELECT doc_id AS doc, {LATIN} AS tokens FROM documents), p AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(tokens) AS term FROM d) GROUP BY ALL),
l AS (SELECT doc, len(tokens) AS dl FROM d), s AS (SELECT count(*) AS n, avg(dl) AS avg_dl FROM l), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
i AS (SELECT term, df, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) AS idf FROM f, s)"""
_PART = f"idf * tf * ({CFG.k1}::DOUBLE + 1) / (tf + {CFG.k1}::DOUBLE * (1 - {CFG.b}::DOUBLE + {CFG.b}::DOUBLE * dl / avg_dl))"
_BM25 = f"""{_INDEX}, q AS (SELECT item_id AS q, unnest(list_distinct({LATIN})) AS term FROM benchmark),
b AS (SELECT q, doc, round(sum({_PART}), 6) AS bm25 FROM q JOIN i USING (term) JOIN p USING (term) JOIN l USING (doc), s GROUP BY 1, 2)"""


@query(f"WITH {_INDEX} SELECT doc AS doc_id, term, tf FROM p")
def term_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.term_freq(_docs(spark, sf_dir)).withColumnRenamed("doc", "doc_id")


@query(f"WITH {_INDEX} SELECT n, round(avg_dl, 6) AS avg_dl FROM s")
def doc_len_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.corpus_stats(lexical.doc_lengths(_docs(spark, sf_dir))).select("n", F.round("avg_dl", 6).alias("avg_dl"))


@query(f"WITH {_INDEX} SELECT term, df FROM f")
def doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.doc_freq(lexical.term_freq(_docs(spark, sf_dir)))


@query(f"WITH {_INDEX} SELECT term, df, round(idf, 6) AS idf FROM i")
def idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.build(_docs(spark, sf_dir)).terms.select("term", "df", F.round("idf", 6).alias("idf"))


def _bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.scores_of_set(_items(spark, sf_dir), T.cut(_docs(spark, sf_dir))).withColumn("bm25", F.round("bm25", 6))


@query(f"WITH {_BM25} SELECT q AS item_id, doc AS doc_id, bm25, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY bm25 DESC, doc) AS rank FROM b) WHERE rank <= 5")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.top_k(_bm25(spark, sf_dir), 5).select(F.col("q").alias("item_id"), F.col("doc").alias("doc_id"), "bm25", "rank")


@query(f"""WITH {_INDEX}, fs AS (SELECT item_id AS q, 0 AS form, {LATIN} AS ts FROM benchmark UNION ALL SELECT item_id, 1, list_transform({LATIN}, lambda w: {_stem_sql('w')}) FROM benchmark),
q AS (SELECT q, form, unnest(list_distinct(ts)) AS term FROM fs), b AS (SELECT q, form, doc, sum({_PART}) AS s1 FROM q JOIN i USING (term) JOIN p USING (term) JOIN l USING (doc), s GROUP BY ALL),
m AS (SELECT q, doc, round(max(s1), 6) AS bm25 FROM b GROUP BY ALL)
SELECT q AS item_id, doc AS doc_id, bm25, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY bm25 DESC, doc) AS rank FROM m) WHERE rank <= 5""")
def bm25_multiform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item in two forms, plain and stemmed; a document keeps the better score."""
    items = _items(spark, sf_dir)
    two = items.select(F.struct("q", F.lit(0).alias("form")).alias("q"), "tokens").unionByName(items.select(F.struct("q", F.lit(1).alias("form")).alias("q"), F.transform("tokens", K.stem).alias("tokens")))
    by_form = lexical.scores(two, lexical.build(_docs(spark, sf_dir))).select("q.q", "doc", "bm25")
    best = lexical.best_form(by_form).withColumn("bm25", F.round("bm25", 6))
    return lexical.top_k(best, 5).select(F.col("q").alias("item_id"), F.col("doc").alias("doc_id"), "bm25", "rank")


# ---- dense retrieval ----
_HASH = "('0x' || substr(md5(term), 1, 8))::BIGINT % 256"


@query(f"SELECT item_id, {_HASH} AS bucket, count(*) AS n FROM (SELECT item_id, unnest({LATIN}) AS term FROM benchmark) GROUP BY ALL")
def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.hash_embed(_items(spark, sf_dir).withColumnRenamed("q", "doc")).select(F.col("doc").alias("item_id"), "bucket", "n")


def _pool_sql(agg: str) -> str:
    return f"""WITH e AS (SELECT label, vec_id, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings),
g AS (SELECT label, dim, {agg} AS v FROM e GROUP BY ALL), n AS (SELECT label, sqrt(sum(v * v)) AS norm FROM g GROUP BY 1)
SELECT label, dim::BIGINT AS dim, round(v / CASE WHEN norm = 0 THEN 1 ELSE norm END, 6) AS v FROM g JOIN n USING (label)"""


def _pooled(spark: SparkSession, sf_dir: str, how: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("id"), F.col("vec_id").alias("pos"), F.col("embedding").alias("vec"))
    return dense.pool_vectors(e, how).select(F.col("id").alias("label"), "dim", F.round("v", 6).alias("v"))


@query(_pool_sql("max(x)"))
def vec_pool_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pooled(spark, sf_dir, "max")


@query(_pool_sql("avg(x)"))
def vec_pool_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pooled(spark, sf_dir, "mean")


@query(_pool_sql("arg_min(x, vec_id)"))
def vec_pool_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pooled(spark, sf_dir, "first")


@query("""WITH c AS (SELECT a.vec_id AS q, b.vec_id AS doc, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a, embeddings b)
SELECT q, doc, cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY cosine DESC, doc) AS rank FROM c) WHERE rank <= 5""")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    got = dense.cosine_scores(e.select(F.col("vec_id").alias("q"), F.col("embedding").alias("vec")), e.select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vec")), best=5, digits=6)
    return lexical.top_k(got.select("q", "doc", F.round("dense", 6).alias("cosine")), 5, "cosine")


# ---- fusion ----
_FRAME = f"""{_BM25}, qv AS (SELECT q, bucket, count(*) AS n FROM (SELECT item_id AS q, {_HASH} AS bucket FROM (SELECT item_id, unnest({LATIN}) AS term FROM benchmark)) GROUP BY ALL),
dv AS (SELECT doc, bucket, count(*) AS n FROM (SELECT doc, {_HASH} AS bucket FROM (SELECT doc, unnest(tokens) AS term FROM d)) GROUP BY ALL),
qn AS (SELECT q, sqrt(sum(n * n)) AS norm FROM qv GROUP BY 1), dn AS (SELECT doc, sqrt(sum(n * n)) AS norm FROM dv GROUP BY 1),
dot AS (SELECT q, doc, sum(qv.n * dv.n) AS dot FROM qv JOIN dv USING (bucket) GROUP BY 1, 2),
fr AS (SELECT item_id AS q, d.doc, coalesce(bm25, 0) AS bm25, round(coalesce(dot / (qn.norm * dn.norm), 0), 9) AS dense FROM benchmark CROSS JOIN d
 LEFT JOIN b ON b.q = item_id AND b.doc = d.doc LEFT JOIN dot ON dot.q = item_id AND dot.doc = d.doc LEFT JOIN qn ON qn.q = item_id LEFT JOIN dn ON dn.doc = d.doc),
rk AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY bm25 DESC, doc) AS bm25_rank, row_number() OVER (PARTITION BY q ORDER BY dense DESC, doc) AS dense_rank FROM fr),
rr AS (SELECT *, 1.0::DOUBLE / (60 + bm25_rank) + 1.0::DOUBLE / (60 + dense_rank) AS rrf FROM rk), fu AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY rrf DESC, bm25_rank, dense_rank, doc) AS rrf_rank FROM rr)"""
_TIER = f"CASE WHEN %s >= {CFG.threshold_high} THEN 'high' WHEN %s >= {CFG.threshold_low} THEN 'medium' ELSE 'low' END"


def _ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """q, doc, bm25, dense, bm25_rank, dense_rank of every item and document."""
    ship(spark)
    docs, items = _docs(spark, sf_dir), _items(spark, sf_dir)
    vectors = dense.dense_vectors(items.withColumnRenamed("q", "doc")).withColumnRenamed("doc", "q")
    frame = dense.cosine_scores(vectors, dense.dense_vectors(docs)).join(_bm25(spark, sf_dir), ["q", "doc"], "left").fillna(0.0, ["bm25"]).withColumn("dense", F.round("dense", 9))
    return lexical.ranked(lexical.ranked(frame, F.col("bm25"), "doc", name="bm25_rank"), F.col("dense"), "doc", name="dense_rank")


def _fused(ranks: DataFrame) -> DataFrame:
    """The pool of each item: its first candidates by fused ranks."""
    return fusion.fused(ranks.select("q", "doc", "bm25_rank", "dense_rank"), CFG, CFG.top_k * CFG.pool_multiplier)


@query(f"WITH {_FRAME} SELECT q AS item_id, doc AS doc_id, bm25_rank, dense_rank, round(rrf, 9) AS rrf, rrf_rank FROM fu WHERE rrf_rank <= 30")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(_ranks(spark, sf_dir)).select(F.col("q").alias("item_id"), F.col("doc").alias("doc_id"), "bm25_rank", "dense_rank", F.round("rrf", 9).alias("rrf"), "rrf_rank")


@query(f"WITH {_FRAME} SELECT q AS item_id, round(rrf, 9) AS top_score, {_TIER % ('rrf', 'rrf')} AS tier FROM fu WHERE rrf_rank = 1")
def confidence_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(_ranks(spark, sf_dir)).where("rrf_rank = 1").select(F.col("q").alias("item_id"), F.round("rrf", 9).alias("top_score"), fusion.tier(F.col("rrf")).alias("tier"))


@query(f"""WITH {_FRAME} SELECT q AS item_id, string_agg(doc, ',' ORDER BY bm25_rank) FILTER (WHERE bm25_rank <= 5) AS bm25_top, string_agg(doc, ',' ORDER BY dense_rank) FILTER (WHERE dense_rank <= 5) AS dense_top FROM rk GROUP BY 1""")
def top_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _ranks(spark, sf_dir)
    one = lambda rank, name: fusion.top_ids(r.select("q", "doc", F.col(rank).alias("rank"))).select("q", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias(name))
    return one("bm25_rank", "bm25_top").join(one("dense_rank", "dense_top"), "q").withColumnRenamed("q", "item_id")


@query(f"""WITH {_FRAME}, u AS (SELECT q, doc, CASE WHEN bm25_rank <= 10 THEN bm25 END AS s, CASE WHEN dense_rank <= 10 THEN dense END AS dn FROM rk WHERE bm25_rank <= 10 OR dense_rank <= 10),
w AS (SELECT q, doc, 0.4::DOUBLE * coalesce((s - min(s) OVER (PARTITION BY q)) / coalesce(nullif(max(s) OVER (PARTITION BY q) - min(s) OVER (PARTITION BY q), 0), 1), 0) + 0.6::DOUBLE * coalesce(dn, 0) AS weighted FROM u),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(weighted, 9) DESC, doc) AS rank FROM w)
SELECT q AS item_id, CASE WHEN weighted >= 0.2 THEN doc END AS doc_id, round(weighted, 6) AS weighted FROM r WHERE rank = 1""")
def weighted_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _ranks(spark, sf_dir)
    got = fusion.weighted_selection(r.select("q", "doc", F.col("bm25_rank").alias("rank"), F.col("bm25").alias("score")), r.select("q", "doc", F.col("dense_rank").alias("rank"), F.col("dense").alias("score")))
    return got.select(F.col("q").alias("item_id"), F.col("doc").alias("doc_id"), F.round("weighted", 6).alias("weighted"))


_POOL = f"""{_FRAME}, di AS (SELECT doc_id AS doc, {_intent_sql('text')} AS doc_intent FROM documents), qi AS (SELECT item_id AS q, {_intent_sql('text')} AS query_intent FROM benchmark),
pl AS (SELECT *, CASE WHEN query_intent = 'UNKNOWN' THEN 'unchanged' WHEN query_intent = doc_intent THEN 'boost' WHEN doc_intent = 'UNKNOWN' THEN 'neutral' ELSE 'penalize' END AS action FROM fu JOIN di USING (doc) JOIN qi USING (q) WHERE rrf_rank <= 30),
aj AS (SELECT *, rrf * CASE action WHEN 'boost' THEN 1.5::DOUBLE WHEN 'penalize' THEN 0.3::DOUBLE ELSE 1 END AS adjusted FROM pl), rn AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY adjusted DESC, rrf_rank) AS rank FROM aj)"""


def _reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), intent(F.col("text")).alias("doc_intent"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q"), intent(F.col("text")).alias("query_intent"))
    pool = _fused(_ranks(spark, sf_dir)).join(docs, "doc").join(items, "q")
    return fusion.rerank_by_intent(pool)


@query(f"WITH {_POOL} SELECT q AS item_id, doc AS doc_id, query_intent, doc_intent, action, round(adjusted, 9) AS adjusted, rank FROM rn")
def intent_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reranked(spark, sf_dir).select(F.col("q").alias("item_id"), F.col("doc").alias("doc_id"), "query_intent", "doc_intent", "action", F.round("adjusted", 9).alias("adjusted"), "rank")


@query(f"WITH {_POOL} SELECT q AS item_id, doc AS doc_id, round(adjusted, 9) AS score, rank, source AS category FROM rn JOIN documents ON doc_id = doc WHERE rank <= 5")
def hybrid_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = _reranked(spark, sf_dir).where(F.col("rank") <= CFG.top_k)
    return best.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.col("source").alias("category")), "doc").select(F.col("q").alias("item_id"), F.col("doc").alias("doc_id"), F.round("adjusted", 9).alias("score"), "rank", "category")


# ---- gates ----
_SPLIT = r"""[\s,।;:!?''"\.\(\)\[\]\{\}<>\/\\|@#$%\^&\*\-=\+~`_…॥]+""".replace(r"\s", RE2_SPACE)


@query(f"""WITH c AS (SELECT conv_id, turn, {STRIP % 'text'} AS t FROM conversations), k AS (SELECT *, list_filter(regexp_split_to_array(lower(t), '{_SPLIT}'), lambda x: x <> '') AS ts FROM c)
SELECT conv_id, turn, CASE WHEN t = '' THEN 'empty' WHEN length(t) < 3 THEN 'too_short' WHEN length(t) > 200 THEN 'too_long' WHEN len(ts) = 0 THEN 'no_tokens'
WHEN len(ts) >= 3 AND list_max(list_transform(list_distinct(ts), lambda x: len(list_filter(ts, lambda y: y = x)))) / len(ts) > 0.6 THEN 'repetitive' ELSE '' END AS reason FROM k""")
def structural_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", gates.structural_gate(F.col("text")).alias("reason"))


@query(f"""WITH {_FRAME}, t AS (SELECT q, max(bm25) AS bm25_top, max(dense) AS dense_top FROM fr GROUP BY 1)
SELECT q AS item_id, bm25_top, dense_top, CASE WHEN dense_top < 0.35 THEN 'low_dense_cosine' WHEN bm25_top < 3.0 THEN 'low_bm25' ELSE '' END AS reason FROM t""")
def score_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _ranks(spark, sf_dir).groupBy("q").agg(F.max("bm25").alias("bm25_top"), F.max("dense").alias("dense_top"))
    return t.select(F.col("q").alias("item_id"), "bm25_top", "dense_top", gates.score_gate(F.col("dense_top"), F.col("bm25_top"), F.lit(None).cast("double"), F.lit(1.0)).alias("reason"))


@query(f"""WITH u AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, lower(string_agg(text, ' ' ORDER BY turn, text)) AS said FROM conversations WHERE role = 'assistant' GROUP BY 1),
w AS (SELECT u.conv_id, turn, list_transform(list_filter({WORDS.replace('(text', '(u.text')}, lambda x: length(x) >= 4), lambda x: lower(x)) AS ws, coalesce(said, '') AS said FROM u LEFT JOIN a USING (conv_id))
SELECT conv_id, turn, round(CASE WHEN len(ws) = 0 THEN 1.0::DOUBLE ELSE len(list_filter(ws, lambda x: contains(said, x))) / len(ws) END, 6) AS coverage FROM w""")
def token_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of a user turn's words that its conversation's answers have."""
    c = table(spark, sf_dir, "conversations")
    said = c.where("role = 'assistant'").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("said"))
    return c.where("role = 'user'").join(said, "conv_id", "left").select("conv_id", "turn", F.round(gates.token_coverage(F.col("text"), F.coalesce("said", F.lit(""))), 6).alias("coverage"))


_EVENT_REASONS = ("low_confidence_crag", "no_candidates", "llm_dont_know", "too_short", "low_bm25")


@query(f"""WITH e AS (SELECT event_id, {listed(_EVENT_REASONS).replace('(', '[').replace(')', ']')}[(user_id % 5 + 1)::BIGINT] AS reason FROM events)
SELECT event_id, reason, CASE WHEN reason IN ('low_confidence_crag', 'no_candidates', 'llm_dont_know', 'llm_error') THEN 'low' ELSE 'rejected' END AS tier FROM e""")
def fallback_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tier of a refusal; the log has no reasons, so each user stands for one."""
    e = table(spark, sf_dir, "events").select("event_id", F.element_at(F.array(*map(F.lit, _EVENT_REASONS)), (F.col("user_id") % 5 + 1).cast("int")).alias("reason"))
    return e.withColumn("tier", gates.fallback_tier(F.col("reason")))


# ---- selection ----
@query(f"""WITH {_POOL}, w AS (SELECT item_id AS q, list_distinct(list_transform({WORDS}, lambda x: lower(x))) AS ws FROM benchmark), dw AS (SELECT doc_id AS doc, list_distinct(list_transform({WORDS}, lambda x: lower(x))) AS ts FROM documents),
sc AS (SELECT q, doc, rank, CASE WHEN len(ws) = 0 THEN 0::DOUBLE ELSE len(list_intersect(ws, ts)) / len(ws) END AS score FROM rn JOIN w USING (q) JOIN dw USING (doc) WHERE rank <= 5)
SELECT q AS item_id, CASE WHEN score >= 0.1 THEN doc END AS doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, rank) AS k FROM sc) WHERE k = 1""")
def pair_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stand-in pair scorer over each item's five candidates."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q"), F.col("text").alias("query"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    scored = _reranked(spark, sf_dir).where("rank <= 5").join(items, "q").join(docs, "doc").select("q", "doc", "rank", overlap_score(F.col("query"), F.col("text")).alias("score"))
    return select_best(scored).select(F.col("q").alias("item_id"), F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))


def _turns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Utterances, and articles: a user turn is the question, the next assistant turn of its conversation the answer."""
    c = table(spark, sf_dir, "conversations")
    follow = c.withColumn("reply", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))).where("role = 'user'")
    # a key for each row: conversation, turn and the place among rows of that turn, padded so that keys sort as numbers do
    place = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("text"))
    key = F.concat_ws("-", *(F.coalesce(F.lpad(c.cast("string"), 20, "0"), F.lit("none")) for c in (F.col("conv_id"), F.col("turn"))), place.cast("string"))
    follow = follow.withColumn("key", key)
    pairs = follow.select(F.col("key").alias("ord"), F.col("text").alias("question"), F.array().cast("array<string>").alias("variants"), F.col("reply").alias("answer_mr"), F.lit("turn").alias("category"))
    raw = follow.select(F.col("key").alias("q"), F.col("text").alias("raw"))
    return raw, articles_of(pairs)


@query()
def kb_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir)[1].select("qa_id", "question", "answer_mr", "category", "doc_text", "intent")


@query()
def answer_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, articles = _turns(spark, sf_dir)
    return answer(raw, build_index(articles), mode="direct")


@query()
def answer_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, articles = _turns(spark, sf_dir)
    return answer(raw, build_index(articles), mode="scored")


# ---- state, statistics, evaluation ----
@query("SELECT event_id, row_number() OVER (PARTITION BY event_type, props ORDER BY ts, event_id) > 1 AS cached FROM events")
def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the same key was asked before, with a cache that never forgets; the bounded one is in streaming."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "props", "ts")
    first = events.groupBy("event_type", "props").agg(F.min(F.struct("ts", "event_id")).alias("first")).select(F.col("event_type").alias("kind"), F.col("props").alias("key"), "first")
    same = F.col("event_type").eqNullSafe(F.col("kind")) & F.col("props").eqNullSafe(F.col("key"))
    return events.join(first, same).select("event_id", (F.col("event_id") != F.col("first.event_id")).alias("cached"))


@query("SELECT count(*) AS requests, count(*) FILTER (WHERE event_type = 'error') AS fallbacks, round(avg((event_type = 'error')::INT), 6) AS fallback_rate, round(avg(value), 6) AS avg_latency FROM events")
def service_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = evaluate.service_stats(table(spark, sf_dir, "events"), F.col("event_type") == "error", F.col("value"))
    return got.select("requests", "fallbacks", F.round("fallback_rate", 6).alias("fallback_rate"), F.round("avg_latency", 6).alias("avg_latency"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS avg_value, list_sort(list(value))[floor(count(value) * 0.95)::BIGINT + 1] AS p95_value FROM events WHERE value IS NOT NULL GROUP BY 1")
def p95_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = evaluate.p95_of(table(spark, sf_dir, "events"), "event_type", "value")
    return got.select("event_type", "n", F.round("avg_value", 6).alias("avg_value"), "p95_value")


@query("SELECT source AS category, count(*) AS n FROM documents GROUP BY 1")
def category_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return category_counts(table(spark, sf_dir, "documents").withColumnRenamed("source", "category"))


QUERIES["category_counts"], ORACLES["category_counts"] = QUERIES.pop("category_counts_query"), ORACLES.pop("category_counts_query")


@query("SELECT label, arg_min(vec_id, md5(concat_ws('|', label::VARCHAR, vec_id::VARCHAR, '42'))) AS vec_id FROM embeddings GROUP BY 1")
def golden_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One variant for each label, chosen by a keyed hash."""
    order = F.md5(F.concat_ws("|", F.col("label").cast("string"), F.col("vec_id").cast("string"), F.lit("42")))
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.min_by("vec_id", order).alias("vec_id"))


_EXPECTED = "x AS (SELECT item_id AS q, doc_id AS doc FROM benchmark JOIN documents ON contains(documents.text, benchmark.text))"
_FOUND = f"{_POOL}, {_EXPECTED}, br AS (SELECT x.q, min(rn.rank) AS rank FROM x LEFT JOIN rn ON rn.q = x.q AND rn.doc = x.doc AND rn.rank <= 5 GROUP BY 1)"


def _expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The golden documents (q, doc) of an item are those that contain it: few passages of bounded length, streamed over all documents."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q"), F.col("text").alias("passage"))
    return table(spark, sf_dir, "documents").join(items, F.contains(F.col("text"), F.col("passage"))).select("q", F.col("doc_id").alias("doc"))


def _best_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rank of each item's best golden document."""
    return evaluate.best_expected_rank(_reranked(spark, sf_dir).where("rank <= 5").select("q", "doc", "rank"), _expected(spark, sf_dir))


@query(f"""WITH {_FOUND} SELECT count(*) AS n, count(*) FILTER (WHERE rank <= 1) AS hits_at_1, count(*) FILTER (WHERE rank <= 3) AS hits_at_3, count(*) FILTER (WHERE rank <= 5) AS hits_at_5,
round(avg(coalesce(rank <= 1, false)::INT), 6) AS hit_at_1, round(avg(coalesce(rank <= 3, false)::INT), 6) AS hit_at_3, round(avg(coalesce(rank <= 5, false)::INT), 6) AS hit_at_5 FROM br""")
def hit_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = evaluate.hit_rates(_best_ranks(spark, sf_dir))
    return got.select("n", "hits_at_1", "hits_at_3", "hits_at_5", *(F.round(f"hit_at_{k}", 6).alias(f"hit_at_{k}") for k in (1, 3, 5)))


@query(f"WITH {_FOUND} SELECT q AS item_id, coalesce(rank, 0) AS rank FROM br WHERE coalesce(rank <> 1, true) ORDER BY q LIMIT 10")
def misses_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.first_misses(_best_ranks(spark, sf_dir)).select(F.col("q").alias("item_id"), F.coalesce("rank", F.lit(0)).cast("long").alias("rank"))


@query(f"WITH {_FRAME} SELECT {_TIER % ('rrf', 'rrf')} AS tier, count(*) AS n FROM fu WHERE rrf_rank = 1 GROUP BY 1")
def tier_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers of the fused score, before intents change it."""
    return evaluate.tier_distribution(_fused(_ranks(spark, sf_dir)).where("rrf_rank = 1").select(fusion.tier(F.col("rrf")).alias("tier")))


@query(f"""WITH {_POOL}, {_EXPECTED}, e AS (SELECT q, min(doc) AS doc FROM x GROUP BY 1), t AS (SELECT e.q, fu.rrf < {CFG.threshold_low} AS low, rn.doc = e.doc AS hit FROM e JOIN fu ON fu.q = e.q AND rrf_rank = 1 JOIN rn ON rn.q = e.q AND rn.rank = 1)
SELECT count(*) AS n, round(avg((hit AND NOT low)::INT), 6) AS accuracy, round(avg(low::INT), 6) AS fallback_rate FROM t""")
def answer_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """End to end: the first candidate, refused in the low tier, against the first document that has the item."""
    best = _reranked(spark, sf_dir)
    low = best.groupBy("q").agg((F.max("rrf") < CFG.threshold_low).alias("is_fallback"))
    chosen = best.where("rank = 1").join(low, "q").select("q", F.when(~F.col("is_fallback"), F.col("doc")).alias("chosen"), "is_fallback")
    got = evaluate.answer_quality(chosen.join(_expected(spark, sf_dir).groupBy("q").agg(F.min("doc").alias("expected")), "q"))
    return got.select("n", F.round("accuracy", 6).alias("accuracy"), F.round("fallback_rate", 6).alias("fallback_rate"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval of every benchmark passage over all documents."""
    return hybrid_retrieve(spark, sf_dir)
