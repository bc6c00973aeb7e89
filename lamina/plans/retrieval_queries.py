"""Queries of retrieval and evaluation over the delivered tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import bm25, candidates, dense, fingerprint, fusion, hashing, judgements, metrics, validate
from ..operators.encoders import HashingEncoder, encode_items
from ..operators.ranking import pad_to_k, ranked
from ..session import cut
from ..sources import dataset as D
from ..sources.tables import read_table
from . import benchmark
from .config import EXPERIMENTS, Config, Retrieval, Run

DOC_K, PASSAGE_K, RRF_K, NDCG_K, RECALL_K, DIM = 20, 100, 60, 10, 100, 512
#: BM25 over a query's own candidates with the tokenizer SQL has too.
PLAIN_CANDIDATES = bm25.Profile(k1=1.2)

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


# Parts of the SQL side

_P = """P AS (SELECT trim(passage_id) AS passage_id, trim(doc_id) AS doc_id, title, text, search_text, paragraph_no,
  CAST(coalesce(paragraph_no, 1000000000) AS BIGINT) AS pos FROM passages WHERE trim(doc_id) <> '' AND trim(passage_id) <> ''
  QUALIFY row_number() OVER (PARTITION BY trim(passage_id) ORDER BY ingested_at NULLS LAST) = 1)"""
_Q = """Q AS (SELECT trim(query_id) AS query_id, text FROM queries WHERE trim(query_id) <> ''
  QUALIFY row_number() OVER (PARTITION BY trim(query_id) ORDER BY created_at NULLS LAST, batch_no NULLS FIRST) = 1)"""
_J = """J AS (SELECT lower(trim(query_id)) AS query_id, lower(trim(passage_id)) AS passage_id, score, metadata, qrel_id AS seq
  FROM qrels WHERE trim(query_id) <> '' AND trim(passage_id) <> '' AND score IS NOT NULL)"""
_REL = f"""{_J}, REL AS (SELECT query_id, passage_id AS item_id, max(score) AS relevance FROM J GROUP BY 1, 2)"""
_WORDS = "regexp_extract_all(lower(coalesce({}, '')), '" + T.WORD.replace("{", "{{").replace("}", "}}") + "')"
_ACCENTED, _BASE = T.latin_accents()
_INDEX_WORDS = f"regexp_extract_all(regexp_replace(translate(lower(coalesce({{}}, '')), '{_ACCENTED}', '{_BASE}'), '[\\x{{{{0300}}}}-\\x{{{{036F}}}}]', '', 'g'), '{T.INDEX_WORD.replace('{', '{{').replace('}', '}}')}')"
_DOCS = "I AS (SELECT CAST(doc_id AS VARCHAR) AS item_id, search_text AS text FROM documents)"


def _bm25_sql(words: str = _WORDS, k1: float = 1.5, floor: bool = False) -> str:
    """CTEs from I (item_id, text) and Q to SC (query_id, item_id, score)."""
    w = words
    idf = "CASE WHEN (n - df + 0.5) / (df + 0.5) > 1 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END" if floor else "ln(1 + (n - df + 0.5) / (df + 0.5))"
    return f"""TOK AS (SELECT item_id, {w.format('text')} AS w FROM I),
    ST AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(w)) AS a FROM TOK),
    TF AS (SELECT item_id, dl, term, CAST(count(*) AS DOUBLE) AS tf FROM (SELECT item_id, CAST(len(w) AS DOUBLE) AS dl, unnest(w) AS term FROM TOK) GROUP BY 1, 2, 3),
    DF AS (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM TF GROUP BY 1),
    QT AS (SELECT query_id, term, CAST(count(*) AS DOUBLE) AS qtf FROM (SELECT query_id, unnest({w.format('text')}) AS term FROM Q) GROUP BY 1, 2),
    W AS (SELECT item_id, term, tf * {k1 + 1} / (tf + {k1} * (0.25 + 0.75 * dl / a)) * ({idf}) AS weight FROM TF JOIN DF USING (term), ST),
    SC AS (SELECT query_id, item_id, sum(qtf * weight) AS score FROM QT JOIN W USING (term) GROUP BY 1, 2)"""


def _top(source: str, k: int, groups: str = "query_id", order: str = "CASE WHEN abs(score) < 0.001 THEN round(score, 15) ELSE round(score, 9) END", digits: int = 6) -> str:
    return f"""SELECT {groups}, item_id, round(score, {digits}) + 0.0 AS score, CAST(rank AS INTEGER) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY {groups} ORDER BY {order} DESC, item_id) AS rank FROM {source}) WHERE rank <= {k}"""


def _out(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumn("score", F.round("score", digits))


# Text


@query(f"SELECT CAST(doc_id AS VARCHAR) AS item_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(list_distinct(w)) AS BIGINT) AS n_terms FROM (SELECT doc_id, {_WORDS.format('search_text')} AS w FROM documents)")
def tokenize_words(spark, sf):
    w = T.words(F.col("search_text"))
    return read_table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("item_id"), F.size(w).cast("bigint").alias("n_words"), F.size(F.array_distinct(w)).cast("bigint").alias("n_terms"))


@query(f"SELECT CAST(doc_id AS VARCHAR) AS item_id, array_to_string({_INDEX_WORDS.format('search_text')}, ' ') AS words FROM documents")
def tokenize_index(spark, sf):
    return read_table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("item_id"), F.array_join(T.index_words(F.col("search_text")), " ").alias("words"))


@query(f"""WITH {_P} SELECT doc_id, first(coalesce(title, '') ORDER BY pos, passage_id) AS title,
  string_agg(coalesce(text, ''), chr(10) ORDER BY pos, passage_id) AS text, min(pos) AS pos FROM P GROUP BY 1""")
def documents_from_passages(spark, sf):
    return D.documents_from_passages(D.passages_of(spark, sf))


_STRIP = r"regexp_replace(regexp_replace({}, '^[\s\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+', ''), '[\s\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+$', '')"


@query(f"""WITH {_P}, G AS (SELECT doc_id, string_agg(coalesce(text, ''), chr(10) ORDER BY pos, passage_id) AS body FROM P GROUP BY 1)
  SELECT 'title' AS strategy, CAST(doc_id AS VARCHAR) AS item_id, {_STRIP.format("coalesce(title, '')")} AS text FROM documents
  UNION ALL SELECT 'body', CAST(doc_id AS VARCHAR), {_STRIP.format("coalesce(text, '')")} FROM documents
  UNION ALL SELECT 'title_body', CAST(doc_id AS VARCHAR), {_STRIP.format("coalesce(title, '') || chr(10) || coalesce(text, '')")} FROM documents
  UNION ALL SELECT 'title_passages', G.doc_id, {_STRIP.format("coalesce(title, '') || chr(10) || body")} FROM documents d JOIN G ON G.doc_id = CAST(d.doc_id AS VARCHAR)""")
def document_text_strategies(spark, sf):
    docs, passages = D.documents_of(spark, sf), D.passages_of(spark, sf)
    with_passages = docs.join(passages.select("doc_id").distinct(), "doc_id", "left_semi")
    out = None
    for s in ("title", "body", "title_body", "title_passages"):
        part = D.document_texts(with_passages if s == "title_passages" else docs, passages, s).select(F.lit(s).alias("strategy"), "item_id", "text")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""WITH {_P} SELECT passage_id AS item_id, {_STRIP.format("coalesce(title, '') || chr(10) || coalesce(text, '')")} AS text FROM P""")
def passage_text(spark, sf):
    return D.passage_texts(D.passages_of(spark, sf))


# Sparse retrieval


def _doc_items(spark, sf):
    return read_table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("item_id"), F.col("search_text").alias("text"))


def _passage_items(spark, sf):
    return D.passages_of(spark, sf).select(F.col("passage_id").alias("item_id"), F.col("search_text").alias("text"))


def _asked(spark, sf):
    return D.queries_of(spark, sf).select("query_id", "text")


@query(f"SELECT count(*) AS n_items, round(avg(len(w)), 6) AS avg_words, CAST(sum(len(w)) AS BIGINT) AS n_words FROM (SELECT {_WORDS.format('search_text')} AS w FROM documents)")
def bm25_corpus_stats(spark, sf):
    n = F.size(T.words(F.col("text")))
    return _doc_items(spark, sf).agg(F.count(F.lit(1)).alias("n_items"), F.round(F.avg(n), 6).alias("avg_words"), F.sum(n).cast("bigint").alias("n_words"))


@query(f"WITH {_DOCS}, {_Q}, {_bm25_sql()} SELECT item_id, term, round(weight, 6) AS weight FROM W")
def bm25_index_weights(spark, sf):
    return bm25.index_weights(_doc_items(spark, sf)).select("item_id", "term", F.round("weight", 6).alias("weight"))


def _sparse_documents(spark, sf):
    items, asked = _doc_items(spark, sf), _asked(spark, sf)
    hits = bm25.search(asked, items, DOC_K)
    return ranked(pad_to_k(hits, asked, "query_id", items, DOC_K), ["query_id"], DOC_K)


_PADDED = f"""PAD AS (SELECT * FROM SC UNION ALL SELECT query_id, item_id, 0.0 FROM Q, (SELECT item_id FROM I ORDER BY item_id LIMIT {DOC_K}) x
  WHERE NOT EXISTS (SELECT 1 FROM SC s WHERE s.query_id = Q.query_id AND s.item_id = x.item_id))"""


@query(f"WITH {_DOCS}, {_Q}, {_bm25_sql()}, {_PADDED} {_top('PAD', DOC_K)}")
def bm25_doc_topk(spark, sf):
    return _out(_sparse_documents(spark, sf)).select("query_id", "item_id", "score", "rank")




def _passage_candidates(spark, sf):
    """Computed once: candidates are read for scores, statistics and filling up."""
    return cut(candidates.expand_to_passages(_sparse_documents(spark, sf), D.passages_of(spark, sf)))


def _two_stage_sql(second: str) -> str:
    """Document stage, its candidates, and ``second`` over PI (passages) and CAND."""
    return f"""WITH {_P}, {_Q}, CAND AS (
      WITH {_DOCS}, {_bm25_sql()}, {_PADDED}, DOCS AS ({_top('PAD', DOC_K)})
      SELECT query_id, passage_id AS item_id FROM DOCS JOIN P ON P.doc_id = DOCS.item_id),
    I AS (SELECT passage_id AS item_id, search_text AS text FROM P), {second}"""


@query(_two_stage_sql(f"{_bm25_sql()}, HIT AS (SELECT CAND.query_id, CAND.item_id, coalesce(score, 0) AS score FROM CAND LEFT JOIN SC USING (query_id, item_id)) {_top('HIT', PASSAGE_K)}"))
def bm25_passage_global(spark, sf):
    pairs = _passage_candidates(spark, sf).select("query_id", "item_id").distinct()
    scored = bm25.scores(_asked(spark, sf), _passage_items(spark, sf), candidates=pairs)
    hits = pairs.join(scored, ["query_id", "item_id"], "left").fillna(0.0, ["score"])
    return _out(ranked(hits, ["query_id"], PASSAGE_K)).select("query_id", "item_id", "score", "rank")


_LOCAL = f"""TOK AS (SELECT item_id, {_WORDS.format('text')} AS w FROM I),
  ST AS (SELECT query_id, CAST(count(*) AS DOUBLE) AS n, avg(len(w)) AS a FROM CAND JOIN TOK USING (item_id) GROUP BY 1),
  TF AS (SELECT item_id, dl, term, CAST(count(*) AS DOUBLE) AS tf FROM (SELECT item_id, CAST(len(w) AS DOUBLE) AS dl, unnest(w) AS term FROM TOK) GROUP BY 1, 2, 3),
  QT AS (SELECT DISTINCT query_id, unnest({_WORDS.format('text')}) AS term FROM Q),
  H AS (SELECT query_id, item_id, dl, term, tf FROM CAND JOIN TF USING (item_id) JOIN QT USING (query_id, term)),
  DF AS (SELECT query_id, term, CAST(count(*) AS DOUBLE) AS df FROM H GROUP BY 1, 2),
  SC AS (SELECT query_id, item_id, sum(tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a)) * ln(1 + (n - df + 0.5) / (df + 0.5))) AS score
         FROM H JOIN DF USING (query_id, term) JOIN ST USING (query_id) GROUP BY 1, 2) """


def _candidate_bm25(spark, sf, profile):
    pairs = _passage_candidates(spark, sf)
    return _out(ranked(bm25.candidate_scores(_asked(spark, sf), _passage_items(spark, sf), pairs, profile=profile), ["query_id"], PASSAGE_K)).select("query_id", "item_id", "score", "rank")


@query(_two_stage_sql(_LOCAL + _top("SC", PASSAGE_K)))
def bm25_passage_candidate_plain(spark, sf):
    """Candidate statistics with the plain tokenizer."""
    return _candidate_bm25(spark, sf, PLAIN_CANDIDATES)


@query(f"WITH {_DOCS}, {_Q}, {_bm25_sql(_INDEX_WORDS, 1.2, True)} {_top('SC', DOC_K, digits=9)}")
def fts_bm25_doc_topk(spark, sf):
    hits = bm25.search(_asked(spark, sf), _doc_items(spark, sf), DOC_K, bm25.FTS)
    return _out(hits, 9).select("query_id", "item_id", "score", "rank")


# Candidates


def _ranking(spark, sf, level, k, *retrievers):
    """Cleaned search results: each item once with its highest score, ranked anew."""
    rows = read_table(spark, sf, "ranking").where((F.col("item_level") == level) & F.col("query_id").isNotNull() & F.col("item_id").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))
    if retrievers:
        rows = rows.where(F.col("retriever").isin(*retrievers))
    best = rows.groupBy("retriever", "query_id", "item_id").agg(F.max("score").alias("score"))
    return ranked(best, ["retriever", "query_id"], k, order=[F.col("score").desc(), F.col("item_id").asc()])


def _ranking_sql(level: str, k: int, name: str) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY retriever, query_id ORDER BY score DESC, item_id) AS rank FROM (
      SELECT retriever, query_id, item_id, max(score) AS score FROM ranking WHERE item_level = '{level}' AND query_id IS NOT NULL
        AND item_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY 1, 2, 3)) WHERE rank <= {k})"""


_PAIRS = f"""{_P}, {_ranking_sql('document', DOC_K, 'DR')},
  PAIRS AS (SELECT retriever, query_id, passage_id AS item_id, P.doc_id, rank AS doc_rank, pos FROM DR JOIN P ON P.doc_id = DR.item_id)"""


def _pairs(spark, sf):
    return candidates.expand_to_passages(_ranking(spark, sf, "document", DOC_K), D.passages_of(spark, sf), ["retriever", "query_id"])


@query(f"WITH {_PAIRS} SELECT retriever, query_id, item_id, doc_id, CAST(doc_rank AS INTEGER) AS doc_rank, pos FROM PAIRS")
def doc_to_passage_candidates(spark, sf):
    return _pairs(spark, sf)


@query(f"WITH {_PAIRS} SELECT DISTINCT item_id FROM PAIRS")
def candidate_union(spark, sf):
    return candidates.candidate_union(_pairs(spark, sf))


@query(f"""WITH {_PAIRS}, B AS (SELECT retriever, doc_id, item_id FROM PAIRS UNION ALL SELECT 'all', doc_id, item_id FROM PAIRS)
  SELECT retriever, count(DISTINCT doc_id) AS candidate_documents, count(DISTINCT item_id) AS candidate_passages,
  round(100.0 * (1 - count(DISTINCT item_id) / CAST((SELECT count(*) FROM P) AS DOUBLE)), 6) AS reduction_percent FROM B GROUP BY 1""")
def candidate_audit(spark, sf):
    audit = candidates.candidate_audit(_pairs(spark, sf), D.passages_of(spark, sf).agg(F.count(F.lit(1))), "retriever")
    return audit.withColumn("reduction_percent", F.round("reduction_percent", 6))


@query(f"WITH {_P}, {_J} SELECT passage_id AS item_id, pos FROM P WHERE passage_id IN (SELECT passage_id FROM J)")
def items_for_ids(spark, sf):
    ids = D.judgements_of(spark, sf).select("passage_id").distinct()
    return D.passages_of(spark, sf).join(ids, "passage_id", "left_semi").select(F.col("passage_id").alias("item_id"), "pos")


# Dense retrieval


def _vectors(spark, sf):
    return read_table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("item_id"), "embedding", "label", "vec_id")


_E = "E AS (SELECT CAST(vec_id AS VARCHAR) AS item_id, vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


@query(f"WITH {_E}, S AS (SELECT q.item_id AS query_id, e.item_id, list_dot_product(q.v, e.v) AS score FROM E q, E e WHERE q.vec_id % 100 = 0) {_top('S', DOC_K)}")
def dense_topk(spark, sf):
    """Queries: every vector whose id is divisible by 100, against all."""
    items = _vectors(spark, sf)
    asked = items.where("vec_id % 100 = 0").select(F.col("item_id").alias("query_id"), "embedding")
    return _out(dense.search(asked, items, DOC_K, 64))


@query(f"WITH {_E}, S AS (SELECT q.item_id AS query_id, e.item_id, list_dot_product(q.v, e.v) AS score FROM E q JOIN E e USING (label) WHERE q.vec_id % 100 = 0) {_top('S', DOC_K)}")
def dense_candidate_topk(spark, sf):
    """The same queries, each against the vectors of its label."""
    items = _vectors(spark, sf)
    asked = items.where("vec_id % 100 = 0").select(F.col("item_id").alias("query_id"), "embedding", "label")
    pairs = items.select("item_id", "label").join(asked.select("query_id", "label"), "label").select("query_id", "item_id")
    return _out(dense.candidate_search(pairs, asked, items, DOC_K)).select("query_id", "item_id", "score", "rank")


@query(f"""WITH {_DOCS}, V AS (SELECT item_id, CAST('0x' || substr(md5(word), 1, 15) AS BIGINT) AS v FROM (SELECT item_id, unnest({_WORDS.format('text')}) AS word FROM I)),
  X AS (SELECT item_id, v % {DIM} AS bucket, sum(CASE WHEN (v >> 8) & 1 = 1 THEN -1.0 ELSE 1.0 END)::DOUBLE AS value FROM V GROUP BY 1, 2)
  SELECT item_id, bucket, round(value / sqrt(sum(value * value) OVER (PARTITION BY item_id)), 6) AS value FROM X WHERE value <> 0""")
def hash_md5_vectors(spark, sf):
    return hashing.hash_vectors(_doc_items(spark, sf), DIM).withColumn("value", F.round("value", 6))


@query()
def hash_blake2b_topk(spark, sf):
    """The digest is not a SQL function."""
    encoder = HashingEncoder(DIM)
    asked = encode_items(_asked(spark, sf).withColumnRenamed("query_id", "item_id"), encoder).withColumnRenamed("item_id", "query_id")
    return _out(dense.search(asked, _doc_items(spark, sf), DOC_K, DIM, encoder))


# Fusion


def _two(spark, sf):
    return [_ranking(spark, sf, "passage", PASSAGE_K, r).drop("retriever") for r in ("bm25", "dense")]


_TWO = f"""{_ranking_sql('passage', PASSAGE_K, 'PR')}, L AS (SELECT CASE retriever WHEN 'bm25' THEN 0 ELSE 1 END AS source, * FROM PR WHERE retriever IN ('bm25', 'dense'))"""


@query(f"WITH {_TWO}, S AS (SELECT query_id, item_id, sum(1.0::DOUBLE / ({RRF_K} + rank)) AS score FROM L GROUP BY 1, 2) {_top('S', PASSAGE_K)}")
def rrf_fusion(spark, sf):
    return _out(fusion.reciprocal_rank_fusion(_two(spark, sf), PASSAGE_K, RRF_K)).select("query_id", "item_id", "score", "rank")


@query(f"""WITH {_TWO}, S AS (SELECT query_id, item_id, min((rank - 1) * 2 + source) AS f, max(score) AS score FROM L GROUP BY 1, 2)
  SELECT query_id, item_id, round(score, 6) + 0.0 AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY f, item_id) AS rank FROM S) WHERE rank <= {PASSAGE_K}""")
def interleave_fusion(spark, sf):
    return _out(fusion.interleave(_two(spark, sf), PASSAGE_K)).select("query_id", "item_id", "score", "rank")


_RAW = "SELECT retriever, query_id, item_id, score, rank FROM ranking WHERE item_level = 'passage' AND query_id IS NOT NULL AND item_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) AND rank IS NOT NULL"


@query(f"""WITH S AS (SELECT retriever, query_id, item_id, min(rank) AS f, max(score) AS score FROM ({_RAW}) GROUP BY 1, 2, 3)
  SELECT retriever, query_id, item_id, round(score, 6) + 0.0 AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY retriever, query_id ORDER BY f, item_id) AS rank FROM S) WHERE rank <= {PASSAGE_K}""")
def dedupe_rankings(spark, sf):
    rows = read_table(spark, sf, "ranking").where("item_level = 'passage' AND query_id IS NOT NULL AND item_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) AND rank IS NOT NULL")
    return _out(fusion.deduplicate(rows.withColumnRenamed("rank", "seq"), PASSAGE_K, ["retriever", "query_id"])).select("retriever", "query_id", "item_id", "score", "rank")


# Evaluation: each retriever of the search results is a run


def _relevance(spark, sf):
    return D.judgements_of(spark, sf).groupBy("query_id", F.col("passage_id").alias("item_id")).agg(F.max("score").alias("relevance"))


def _runs(spark, sf):
    kinds = F.array(*[F.lit(r) for r in ("bm25", "dense", "fts", "hashing")])
    return D.queries_of(spark, sf).select(F.explode(kinds).alias("experiment"), "query_id")


def _as_run(df):
    return df.withColumnRenamed("retriever", "experiment")


_EVAL = f"""{_P}, {_Q}, {_REL}, {_ranking_sql('passage', PASSAGE_K, 'PR')}, {_ranking_sql('document', DOC_K, 'DR')},
  RUNS AS (SELECT unnest(['bm25', 'dense', 'fts', 'hashing']) AS experiment, query_id FROM Q),
  DREL AS (SELECT query_id, doc_id AS item_id, greatest(max(relevance), 0) AS relevance FROM REL JOIN P ON P.passage_id = REL.item_id GROUP BY 1, 2)"""


def _ndcg_sql(ranking: str, rel: str, name: str) -> str:
    return f"""{name} AS (SELECT experiment, query_id, coalesce(CASE WHEN ideal <> 0 THEN coalesce(dcg, 0) / ideal END, 0) AS v FROM RUNS
      LEFT JOIN (SELECT retriever AS experiment, query_id, sum((pow(2, coalesce(relevance, 0)) - 1) / log2(rank + 1)) AS dcg
                 FROM {ranking} LEFT JOIN {rel} USING (query_id, item_id) WHERE rank <= {NDCG_K} GROUP BY 1, 2) USING (experiment, query_id)
      LEFT JOIN (SELECT query_id, sum((pow(2, relevance) - 1) / log2(place + 1)) AS ideal
                 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, item_id) AS place FROM {rel}) WHERE place <= {NDCG_K} GROUP BY 1) USING (query_id))"""


def _recall_sql(ranking: str, rel: str, k: int, name: str) -> str:
    return f"""{name} AS (SELECT experiment, query_id, coalesce(coalesce(hits, 0) / CAST(good AS DOUBLE), 0) AS v FROM RUNS
      LEFT JOIN (SELECT retriever AS experiment, query_id, count(DISTINCT item_id) AS hits FROM {ranking} JOIN {rel} USING (query_id, item_id) WHERE relevance > 0 AND rank <= {k} GROUP BY 1, 2) USING (experiment, query_id)
      LEFT JOIN (SELECT query_id, count(*) AS good FROM {rel} WHERE relevance > 0 GROUP BY 1) USING (query_id))"""


_PER_QUERY = f"""WITH {_EVAL}, {_ndcg_sql('PR', 'REL', 'A')}, {_recall_sql('PR', 'REL', RECALL_K, 'B')}, {_ndcg_sql('DR', 'DREL', 'C')}, {_recall_sql('DR', 'DREL', DOC_K, 'E')},
  PQ AS (SELECT experiment, query_id, A.v AS a, B.v AS b, C.v AS c, E.v AS e FROM A JOIN B USING (experiment, query_id) JOIN C USING (experiment, query_id) JOIN E USING (experiment, query_id))"""
_NAMES = {"a": f"passage_ndcg@{NDCG_K}", "b": f"passage_recall@{RECALL_K}", "c": f"document_ndcg@{NDCG_K}", "e": f"document_recall@{DOC_K}"}
_MEANS = ", ".join(f'round(avg({k}), 6) AS "{n}"' for k, n in _NAMES.items())


def _rounded(df):
    return df.select(*[F.round(F.col(f"`{c}`"), 6).alias(c) if "@" in c else F.col(c) for c in df.columns])


@query(f"WITH {_EVAL}, {_ndcg_sql('PR', 'REL', 'A')} SELECT experiment, query_id, round(v, 6) AS ndcg FROM A")
def ndcg_at_k(spark, sf):
    out = metrics.ndcg_at_k(_as_run(_ranking(spark, sf, "passage", PASSAGE_K)), _relevance(spark, sf), NDCG_K, _runs(spark, sf), ["experiment", "query_id"])
    return out.withColumn("ndcg", F.round("ndcg", 6))


@query(f"WITH {_EVAL}, {_recall_sql('PR', 'REL', RECALL_K, 'B')} SELECT experiment, query_id, round(v, 6) AS recall FROM B")
def recall_at_k(spark, sf):
    out = metrics.recall_at_k(_as_run(_ranking(spark, sf, "passage", PASSAGE_K)), _relevance(spark, sf), RECALL_K, _runs(spark, sf), ["experiment", "query_id"])
    return out.withColumn("recall", F.round("recall", 6))


def _passage_documents(spark, sf):
    return D.passages_of(spark, sf).select(F.col("passage_id").alias("item_id"), "doc_id")


@query(f"WITH {_EVAL} SELECT query_id, item_id, CAST(relevance AS DOUBLE) AS relevance FROM DREL")
def doc_relevance(spark, sf):
    return metrics.document_relevance(_relevance(spark, sf), _passage_documents(spark, sf))


def _per_query(spark, sf):
    return metrics.per_query_metrics(
        _runs(spark, sf), _as_run(_ranking(spark, sf, "passage", PASSAGE_K)), _as_run(_ranking(spark, sf, "document", DOC_K)),
        _relevance(spark, sf), _passage_documents(spark, sf), NDCG_K, RECALL_K, DOC_K, ["experiment", "query_id"],
    )


@query(_PER_QUERY + " SELECT experiment, query_id, " + ", ".join(f'round({k}, 6) AS "{n}"' for k, n in _NAMES.items()) + " FROM PQ")
def per_query_metrics(spark, sf):
    return _rounded(_per_query(spark, sf))


@query(f"{_PER_QUERY} SELECT experiment, {_MEANS}, CAST(count(*) AS DOUBLE) AS evaluated_queries FROM PQ GROUP BY 1")
def mean_metrics(spark, sf):
    return _rounded(metrics.mean_metrics(_per_query(spark, sf), ["experiment"]))


@query(f"""{_PER_QUERY} SELECT experiment, category, {_MEANS}, count(*) AS queries FROM PQ
  JOIN (SELECT query_id, unnest(categories) AS category FROM query_metadata) USING (query_id) WHERE category IS NOT NULL GROUP BY 1, 2""")
def grouped_metrics(spark, sf):
    return _rounded(metrics.grouped_metrics(_per_query(spark, sf), read_table(spark, sf, "query_metadata"), ["experiment"]))


@query(f"{_PER_QUERY} SELECT experiment, {_MEANS}, CAST(count(*) AS DOUBLE) AS evaluated_queries FROM PQ GROUP BY 1 ORDER BY avg(a) DESC, experiment")
def leaderboard(spark, sf):
    return _rounded(metrics.leaderboard(metrics.mean_metrics(_per_query(spark, sf), ["experiment"]), f"passage_ndcg@{NDCG_K}"))


@query("""SELECT experiment, count(*) AS runs, round(avg(latency_ms), 6) AS mean_ms, min(latency_ms) AS min_ms, max(latency_ms) AS max_ms
  FROM (SELECT DISTINCT run_id, experiment, latency_ms FROM query_runs) WHERE latency_ms >= 0 GROUP BY 1""")
def latency_summary(spark, sf):
    """Runs delivered twice count once; unknown and negative latencies do not count."""
    rows = read_table(spark, sf, "query_runs").select("run_id", "experiment", "latency_ms").distinct().where("latency_ms >= 0")
    return rows.groupBy("experiment").agg(F.count(F.lit(1)).alias("runs"), F.round(F.avg("latency_ms"), 6).alias("mean_ms"), F.min("latency_ms").alias("min_ms"), F.max("latency_ms").alias("max_ms"))


# Dataset


@query(f"""WITH {_P}, {_Q}, {_J}, U AS (SELECT query_id, passage_id, max(score) AS score FROM J GROUP BY 1, 2)
  SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM P) AS passages, (SELECT count(*) FROM Q) AS queries, count(*) AS qrels,
  count(*) FILTER (score > 1) AS graded_qrels, count(DISTINCT query_id) FILTER (score > 0) AS queries_with_relevant_passages FROM U""")
def dataset_summary(spark, sf):
    return validate.summary(D.documents_of(spark, sf), D.passages_of(spark, sf), D.queries_of(spark, sf), judgements.upsert(D.judgements_of(spark, sf)))


@query(f"""WITH {_P}, {_Q}, {_J} SELECT 'passages.doc_id' AS relation, count(*) AS n_orphans FROM P WHERE doc_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM documents)
  UNION ALL SELECT 'qrels.query_id', count(*) FROM J WHERE query_id NOT IN (SELECT query_id FROM Q)
  UNION ALL SELECT 'qrels.passage_id', count(*) FROM J WHERE passage_id NOT IN (SELECT passage_id FROM P)""")
def validate_orphans(spark, sf):
    return validate.orphan_counts(D.documents_of(spark, sf), D.passages_of(spark, sf), D.queries_of(spark, sf), D.judgements_of(spark, sf))


@query(f"""WITH {_J}, M AS (SELECT query_id, passage_id, metadata FROM J QUALIFY row_number() OVER (PARTITION BY query_id, passage_id ORDER BY seq DESC) = 1)
  SELECT query_id, passage_id, max(score) AS score, any_value(M.metadata) AS metadata FROM J JOIN M USING (query_id, passage_id) GROUP BY 1, 2""")
def qrels_upsert(spark, sf):
    return judgements.upsert(D.judgements_of(spark, sf))


@query(f"WITH {_J} SELECT query_id, passage_id, score FROM J QUALIFY row_number() OVER (PARTITION BY query_id, passage_id ORDER BY seq DESC) = 1")
def qrels_last_wins(spark, sf):
    return judgements.last_wins(D.judgements_of(spark, sf))


_ROW_HASH = "sha256(coalesce(len(item_id) || ':' || item_id, '-') || coalesce(len(text) || ':' || text, '-'))"
_SUMS = ", ".join(f"coalesce(sum(CAST(CAST('0x' || substr(h, {16 * i + 1}, 16) AS UBIGINT) AS HUGEINT)), 0) AS s{i}" for i in range(4))


@query(f"""WITH {_DOCS} SELECT n_items, sha256(n_items || ',' || s0 || ',' || s1 || ',' || s2 || ',' || s3) AS digest
  FROM (SELECT count(*) AS n_items, {_SUMS} FROM (SELECT {_ROW_HASH} AS h FROM I))""")
def corpus_fingerprint(spark, sf):
    return fingerprint.corpus_fingerprint(_doc_items(spark, sf))


# Whole runs


def _board(spark, sf, profile):
    ds = D.from_tables(spark, sf, keep=True)
    config = Config(retrieval=Retrieval(DOC_K, PASSAGE_K), run=Run("full"))
    return _rounded(benchmark.run(ds, config, profile, EXPERIMENTS, check=False).leaderboard)


@query()
def leaderboard_memory(spark, sf):
    """All nine experiments, statistics of all items; an iterative plan, no single SQL."""
    return _board(spark, sf, "memory")


@query()
def leaderboard_scalable(spark, sf):
    """All nine experiments, full-text documents and candidate statistics."""
    return _board(spark, sf, "scalable")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
