"""Queries of the dataset store, the vector index, validation and whole experiments over the delivered
tables, and the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import bm25, validate
from ..operators.retrievers import CandidateSparseRetriever, CombinedRetriever, EncoderRetriever, FullTextRetriever, SparseRetriever
from ..session import checkpoint_dir
from ..sources import dataset as D
from ..sources.store import DatasetStore
from ..sources.vector_index import VectorIndex
from . import benchmark
from . import retrieval_queries as R
from .config import Config, Retrieval

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
_stores: dict[tuple[str, str], str] = {}
K = 10


def query(sql: str):
    def add(f):
        _QUERIES[f.__name__], _SQL[f.__name__] = f, sql
        return f

    return add


class LetterEncoder:
    """How often each of the letters a to z occurs, at unit length."""

    name, dimension = "letters", 26

    def encode(self, texts):
        counts = np.array([[t.lower().count(c) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts], np.float64).reshape(len(texts), 26)
        size = np.sqrt((counts * counts).sum(1, keepdims=True))
        return (counts / np.where(size > 0, size, 1.0)).astype(np.float32)


def _store(spark: SparkSession, sf: str) -> DatasetStore:
    """A finalized store of the delivered tables: documents by id, passages by id, the rest as it comes;
    passages and judgements without target left out, judgements in two appends. One a session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _stores:
        docs, passages, queries, qrels = D.documents_of(spark, sf), D.passages_of(spark, sf), D.queries_of(spark, sf), D.judgements_of(spark, sf)
        store = DatasetStore.create(spark, f"{checkpoint_dir(spark)}/store-{uuid.uuid4().hex}", "tables", {"from": "tables"})
        passages = passages.join(docs.select("doc_id"), "doc_id", "left_semi")
        qrels = qrels.join(queries.select("query_id"), "query_id", "left_semi").join(passages.select("passage_id"), "passage_id", "left_semi")
        store.add_documents(docs.orderBy("doc_id"))
        store.add_passages(passages.orderBy("passage_id"))
        store.add_queries(queries.orderBy("query_id"))
        for half in ("pmod(seq, 2) = 0", "pmod(seq, 2) = 1"):
            store.add_qrels(qrels.where(half).orderBy("seq"))
        store.finalize(build_passage_index=True)
        _stores[key] = store.path
    return DatasetStore(spark, _stores[key])


_STRIP = R._STRIP
_TITLED = _STRIP.format("coalesce(title, '') || chr(10) || coalesce(text, '')")
_TABLES = f"""WITH {R._P}, {R._Q}, {R._J},
  SD AS (SELECT row_number() OVER (ORDER BY CAST(doc_id AS VARCHAR)) - 1 AS pos, CAST(doc_id AS VARCHAR) AS doc_id, {_TITLED} AS search_text FROM documents),
  SP AS (SELECT row_number() OVER (ORDER BY passage_id) - 1 AS pos, passage_id, P.doc_id, P.metadata, P.paragraph_no, {_TITLED} AS search_text FROM
    (SELECT P.*, m.metadata FROM P JOIN (SELECT trim(passage_id) AS k, metadata FROM passages WHERE trim(doc_id) <> '' QUALIFY row_number() OVER (PARTITION BY trim(passage_id) ORDER BY ingested_at NULLS LAST) = 1) m ON m.k = P.passage_id) P
    WHERE P.doc_id IN (SELECT CAST(doc_id AS VARCHAR) FROM documents)),
  SJ AS (SELECT * FROM J WHERE query_id IN (SELECT query_id FROM Q) AND passage_id IN (SELECT passage_id FROM SP)),
  SU AS (SELECT query_id, passage_id, max(score) AS score FROM SJ GROUP BY 1, 2)"""


@query(f"{_TABLES} SELECT pos, doc_id AS item_id, search_text FROM SD")
def store_documents(spark, sf):
    """Written, numbered without gaps, read again."""
    return _store(spark, sf).items("document")


@query(f"{_TABLES} SELECT pos, passage_id, doc_id, paragraph_no, metadata, search_text FROM SP")
def store_passages(spark, sf):
    return _store(spark, sf).passages.select("pos", "passage_id", "doc_id", "paragraph_no", "metadata", "search_text")


@query(f"{_TABLES} SELECT row_number() OVER (ORDER BY query_id) - 1 AS pos, query_id, text FROM Q")
def store_queries(spark, sf):
    return _store(spark, sf).in_order("queries").select("pos", "query_id", "text")


@query(f"""{_TABLES}, N AS (SELECT *, row_number() OVER (ORDER BY seq % 2, seq) AS n FROM SJ),
  F AS (SELECT query_id, passage_id, min(n) AS n, max(score) AS score FROM N GROUP BY 1, 2) SELECT row_number() OVER (ORDER BY n) AS place, query_id, passage_id, score FROM F""")
def store_qrels(spark, sf):
    """Appended twice, merged, in order of first arrival."""
    rows = _store(spark, sf).in_order("qrels").select("query_id", "passage_id", "score").coalesce(1)
    return rows.select((F.monotonically_increasing_id() + 1).alias("place"), "*")


@query(f"""{_TABLES} SELECT 'tables' AS name, (SELECT count(*) FROM SD) AS documents, (SELECT count(*) FROM SP) AS passages, (SELECT count(*) FROM Q) AS queries, count(*) AS qrels,
  count(*) FILTER (score > 1) AS graded_qrels, count(DISTINCT query_id) FILTER (score > 0) AS queries_with_relevant_passages, true AS finalized FROM SU""")
def store_summary(spark, sf):
    store = _store(spark, sf)
    store.validate()
    row = store.summary()
    names = ["documents", "passages", "queries", "qrels", "graded_qrels", "queries_with_relevant_passages"]
    return spark.createDataFrame([(row["name"], *(row[n] for n in names), store.finalized)], "name string, " + ", ".join(f"{n} bigint" for n in names) + ", finalized boolean")


@query(f"{_TABLES} SELECT passage_id AS item_id, pos FROM SP WHERE passage_id IN (SELECT passage_id FROM SU)")
def store_rows_for_ids(spark, sf):
    store = _store(spark, sf)
    return store.rows_for_ids("passage", store.qrels.select(F.col("passage_id").alias("item_id")))


@query(f"{_TABLES} SELECT pos, doc_id AS item_id FROM SD WHERE pos IN (0, 1, 2, 5, 100, 101)")
def store_ids_for_rows(spark, sf):
    """Rows asked for twice count once, unknown rows not at all."""
    return _store(spark, sf).ids_for_rows("document", [0, 1, 1, 2, 5, 100, 101, 10**12])


@query(f"{_TABLES} SELECT passage_id, doc_id, pos FROM SP WHERE doc_id IN (SELECT item_id FROM ranking WHERE item_level = 'document')")
def store_passages_of_documents(spark, sf):
    ranked_docs = R.read_table(spark, sf, "ranking").where("item_level = 'document'").select(F.col("item_id").alias("doc_id"))
    return _store(spark, sf).passages_of_documents(ranked_docs)


@query(f"{_TABLES} SELECT DISTINCT passage_id, doc_id FROM SP WHERE passage_id IN (SELECT passage_id FROM SU WHERE score > 2)")
def store_documents_of_passages(spark, sf):
    store = _store(spark, sf)
    return store.documents_of_passages(r.passage_id for r in store.qrels.where("score > 2").select("passage_id").distinct().toLocalIterator())


def _fts_sql(items: str, extra: str = "", source: str = "SC") -> str:
    return f"{_TABLES}, I AS (SELECT {items}), {R._bm25_sql(R._INDEX_WORDS, 1.2, True)}{extra} {R._top(source, K, digits=9)}"


@query(_fts_sql("doc_id AS item_id, search_text AS text FROM SD"))
def store_search_documents(spark, sf):
    """Full-text search by the written term index."""
    store = _store(spark, sf)
    return R._out(store.sparse_search("document", store.queries.select("query_id", "text"), K), 9)


@query(_fts_sql("passage_id AS item_id, search_text AS text FROM SP", ", H AS (SELECT SC.* FROM SC JOIN SU ON SU.query_id = SC.query_id AND SU.passage_id = SC.item_id)", "H"))
def store_search_candidates(spark, sf):
    """The same restricted to candidates: the judged passages of each query."""
    store = _store(spark, sf)
    judged = store.qrels.select("query_id", F.col("passage_id").alias("item_id"))
    return R._out(store.sparse_search("passage", store.queries.select("query_id", "text"), K, judged), 9)


# Vector index, of letter counts

_LETTERS = "list_transform(string_split('abcdefghijklmnopqrstuvwxyz', ''), lambda c: CAST(len({0}) - len(replace({0}, c, '')) AS DOUBLE))"
_UNIT = "list_transform(v, lambda x: CAST(CASE WHEN list_dot_product(v, v) > 0 THEN x / sqrt(list_dot_product(v, v)) ELSE 0 END AS FLOAT)::DOUBLE)"


def _vectors_sql(source: str, key: str, text: str, name: str) -> str:
    return f"{name} AS (SELECT id, {_UNIT} AS v FROM (SELECT {key} AS id, {_LETTERS.format(f'lower({text})')} AS v FROM {source}))"


_VECTORS = f"{_TABLES}, {_vectors_sql('SP', 'passage_id', 'search_text', 'VP')}, {_vectors_sql('Q', 'query_id', 'coalesce(text, chr(32))', 'VQ')}"


def _index(spark, sf) -> tuple[DatasetStore, VectorIndex]:
    store = _store(spark, sf)
    items = store.items("passage").selectExpr("item_id", "search_text AS text")
    return store, VectorIndex(spark, f"{store.path}/letters", items, LetterEncoder(), checkpoint_rows=max(1, store.item_count("passage") // 2)).build()


@query(f"{_VECTORS} SELECT id AS item_id, CAST(round(list_sum(v), 4) AS DOUBLE) AS total, round(list_dot_product(v, v), 4) AS size FROM VP")
def vector_index_rows(spark, sf):
    """Built in portions, written, read again: sum and squared length of each vector."""
    v = F.col("embedding")
    total = lambda f: F.aggregate(v, F.lit(0.0), lambda a, x: a + f(x.cast("double")))
    return _index(spark, sf)[1].vectors().select("item_id", F.round(total(lambda x: x), 4).alias("total"), F.round(total(lambda x: x * x), 4).alias("size"))


@query(f"{_VECTORS}, S AS (SELECT VQ.id AS query_id, VP.id AS item_id, list_dot_product(VQ.v, VP.v) AS score FROM VQ, VP) {R._top('S', K, digits=5)}")
def vector_index_search(spark, sf):
    """Every query against every written vector."""
    store, index = _index(spark, sf)
    return R._out(index.search(store.queries.select("query_id", "text"), K), 5)


@query(f"{_VECTORS}, S AS (SELECT SU.query_id, passage_id AS item_id, list_dot_product(VQ.v, VP.v) AS score FROM SU JOIN VQ ON VQ.id = SU.query_id JOIN VP ON VP.id = SU.passage_id) {R._top('S', K, digits=5)}")
def vector_index_candidates(spark, sf):
    store, index = _index(spark, sf)
    judged = store.qrels.select("query_id", F.col("passage_id").alias("item_id"))
    return R._out(index.search_candidates(store.queries.select("query_id", "text"), judged, K), 5)


# Retrievers by their common interface, over judged candidates

_JUDGED = "CAND AS (SELECT query_id, passage_id AS item_id FROM SU), I AS (SELECT passage_id AS item_id, search_text AS text FROM SP)"


def _retrieved(spark, sf, retriever, digits=6):
    store = _store(spark, sf)
    items = store.items("passage").selectExpr("item_id", "search_text AS text")
    judged = store.qrels.select("query_id", F.col("passage_id").alias("item_id"))
    return R._out(retriever.fit(items).search(store.queries.select("query_id", "text"), K, judged), digits)


@query(f"{_TABLES}, {_JUDGED}, {R._bm25_sql()}, H AS (SELECT CAND.query_id, CAND.item_id, coalesce(score, 0) AS score FROM CAND LEFT JOIN SC USING (query_id, item_id)) {R._top('H', K)}")
def retriever_sparse(spark, sf):
    return _retrieved(spark, sf, SparseRetriever())


@query(f"{_TABLES}, {_JUDGED}, {R._bm25_sql(R._INDEX_WORDS, 1.2, True)}, H AS (SELECT SC.* FROM SC JOIN CAND USING (query_id, item_id)) {R._top('H', K, digits=9)}")
def retriever_full_text(spark, sf):
    return _retrieved(spark, sf, FullTextRetriever(), 9)


@query(f"{_VECTORS}, {_JUDGED}, S AS (SELECT CAND.query_id, CAND.item_id, list_dot_product(VQ.v, VP.v) AS score FROM CAND JOIN VQ ON VQ.id = CAND.query_id JOIN VP ON VP.id = CAND.item_id) {R._top('S', K, digits=5)}")
def retriever_encoder(spark, sf):
    return _retrieved(spark, sf, EncoderRetriever(LetterEncoder(), "", ""), 5)


@query(f"""{_VECTORS}, {_JUDGED}, {R._bm25_sql()},
  A AS ({R._top('(SELECT CAND.query_id, CAND.item_id, coalesce(score, 0) AS score FROM CAND LEFT JOIN SC USING (query_id, item_id))', K)}),
  B AS ({R._top('(SELECT CAND.query_id, CAND.item_id, list_dot_product(VQ.v, VP.v) AS score FROM CAND JOIN VQ ON VQ.id = CAND.query_id JOIN VP ON VP.id = CAND.item_id)', K)}),
  S AS (SELECT query_id, item_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT * FROM A UNION ALL SELECT * FROM B) GROUP BY 1, 2) {R._top('S', K)}""")
def retriever_combined(spark, sf):
    return _retrieved(spark, sf, CombinedRetriever(SparseRetriever(), EncoderRetriever(LetterEncoder(), "", "")))


# The folded tokenizer: case folding, compatibility forms and accents, in SQL by lists of their own

_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_NARROW = "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")
_HALF = "ｦｧｨｩｪｫｬｭｮｯｰｱｲｳｴｵｶｷｸｹｺｻｼｽｾｿﾀﾁﾂﾃﾄﾅﾆﾇﾈﾉﾊﾋﾌﾍﾎﾏﾐﾑﾒﾓﾔﾕﾖﾗﾘﾙﾚﾛﾜﾝ"
_FULL = "ヲァィゥェォャュョッーアイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワン"
_FORMS = {
    "ß": "ss", "ς": "σ", "ﬃ": "ffi", "ﬄ": "ffl", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬅ": "st", "ﬆ": "st",
    "½": "1⁄2", "¼": "1⁄4", "¾": "3⁄4", "²": "2", "³": "3", "¹": "1", "™": "TM", "ª": "a", "º": "o",
}


def _folded_sql(text: str) -> str:
    plain = f"lower(translate(coalesce({text}, ''), '{_WIDE}{_HALF}ﾞﾟ', '{_NARROW}{_FULL}\u3099\u309a'))"
    for odd, form in _FORMS.items():
        plain = f"replace({plain}, '{odd}', '{form}')"
    marks = r"[\x{300}-\x{36F}\x{3099}\x{309A}]"
    return f"regexp_extract_all(regexp_replace(strip_accents(nfc_normalize({plain})), '{marks}', '', 'g'), " + r"'[\p{L}\p{N}]+')"


@query(f"SELECT CAST(doc_id AS VARCHAR) AS item_id, array_to_string({_folded_sql('search_text')}, ' ') AS words FROM documents")
def tokenize_folded(spark, sf):
    """Case folded, decomposed, without accents."""
    return R.read_table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("item_id"), F.array_join(T.folded_words("search_text"), " ").alias("words"))


_LOCAL_FOLDED = R._LOCAL.replace(R._WORDS.format("text"), _folded_sql("text"))


@query(R._two_stage_sql(_LOCAL_FOLDED + R._top("SC", R.PASSAGE_K)))
def bm25_passage_candidate(spark, sf):
    """Candidate statistics with folded words."""
    return R._candidate_bm25(spark, sf, bm25.CANDIDATES)


@query(f"{_TABLES}, {_JUDGED}, {_LOCAL_FOLDED} {R._top('SC', K)}")
def retriever_candidate_sparse(spark, sf):
    return _retrieved(spark, sf, CandidateSparseRetriever())


# Validation and scalars


@query(f"""WITH {R._P}, {R._Q}, {R._J}, M AS (SELECT DISTINCT 'passages.doc_id' AS relation, doc_id AS missing FROM P WHERE doc_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM documents)
  UNION SELECT 'qrels.query_id', query_id FROM J WHERE query_id NOT IN (SELECT query_id FROM Q) UNION SELECT 'qrels.passage_id', passage_id FROM J WHERE passage_id NOT IN (SELECT passage_id FROM P))
  SELECT relation, missing, row_number() OVER (PARTITION BY relation ORDER BY missing) AS place FROM M QUALIFY place <= 3""")
def missing_ids(spark, sf):
    """The first three missing keys of each relation, as validation messages name them."""
    docs, passages, queries, qrels = D.documents_of(spark, sf), D.passages_of(spark, sf), D.queries_of(spark, sf), D.judgements_of(spark, sf)
    found = {"passages.doc_id": (passages, "doc_id", docs, "doc_id"), "qrels.query_id": (qrels, "query_id", queries, "query_id"), "qrels.passage_id": (qrels, "passage_id", passages, "passage_id")}
    rows = [(name, key, i) for name, args in found.items() for i, key in enumerate(validate.missing_ids(*args), 1)]
    return spark.createDataFrame(rows, "relation string, missing string, place bigint")


@query("""WITH N AS (SELECT (SELECT count(*) FROM passages WHERE paragraph_no < 0) AS p, (SELECT count(*) FROM qrels WHERE score < 0) AS s,
    (SELECT count(*) - count(DISTINCT passage_id) FROM passages) AS d, (SELECT count(*) FROM passages WHERE trim(coalesce(doc_id, '')) NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM documents)) AS m,
    (SELECT count(*) - count(DISTINCT query_id) FROM queries) AS q)
  SELECT unnest(['duplicate query ids', 'duplicate passage ids', 'passages refer to missing documents', 'negative paragraph numbers', 'negative judgement scores']) AS problem, unnest([q > 0, d > 0, m > 0, p > 0, s > 0]) AS found FROM N""")
def validation_problems(spark, sf):
    """Which problems the check of the tables as delivered names."""
    read = lambda t: R.read_table(spark, sf, t)
    found = validate.errors(read("documents"), read("passages").withColumn("doc_id", F.coalesce(F.trim("doc_id"), F.lit(""))), read("queries"), read("qrels"))
    names = ["duplicate query ids", "duplicate passage ids", "passages refer to missing documents", "negative paragraph numbers", "negative judgement scores"]
    return spark.createDataFrame([(n, any(m.startswith(n) for m in found)) for n in names], "problem string, found boolean")


@query(f"SELECT CAST(doc_id AS VARCHAR) AS item_id, {_STRIP.format('text')} AS stripped FROM documents")
def strip_texts(spark, sf):
    return R.read_table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("item_id"), T.strip(F.col("text")).alias("stripped"))


# Whole experiments

_SPARSE_RUN = f"""{R._two_stage_sql(f'''{R._bm25_sql()}, HIT AS (SELECT CAND.query_id, CAND.item_id, coalesce(score, 0) AS score FROM CAND LEFT JOIN SC USING (query_id, item_id)),
  PR AS (SELECT 'sparse__sparse' AS retriever, * FROM ({R._top('HIT', R.PASSAGE_K)})),
  DR AS (SELECT 'sparse__sparse' AS retriever, * FROM (WITH {R._DOCS}, {R._bm25_sql()}, {R._PADDED} {R._top('PAD', R.DOC_K)})),
  RUNS AS (SELECT 'sparse__sparse' AS experiment, query_id FROM Q),
  {R._J}, REL AS (SELECT query_id, passage_id AS item_id, arg_max(score, seq) AS relevance FROM J GROUP BY 1, 2),
  DREL AS (SELECT query_id, doc_id AS item_id, greatest(max(relevance), 0) AS relevance FROM REL JOIN P ON P.passage_id = REL.item_id GROUP BY 1, 2),
  {R._ndcg_sql('PR', 'REL', 'A')}, {R._recall_sql('PR', 'REL', R.RECALL_K, 'B')}, {R._ndcg_sql('DR', 'DREL', 'C')}, {R._recall_sql('DR', 'DREL', R.DOC_K, 'E')},
  PQ AS (SELECT experiment, query_id, A.v AS a, B.v AS b, C.v AS c, E.v AS e FROM A JOIN B USING (experiment, query_id) JOIN C USING (experiment, query_id) JOIN E USING (experiment, query_id))''')}"""


@query(f"{_SPARSE_RUN} SELECT experiment, query_id, " + ", ".join(f'round({k}, 6) AS "{n}"' for k, n in R._NAMES.items()) + " FROM PQ")
def experiment_sparse_sparse(spark, sf):
    """A whole run of one experiment, memory profile: the metrics of each query."""
    config = Config(retrieval=Retrieval(R.DOC_K, R.PASSAGE_K))
    report = benchmark.run(D.from_tables(spark, sf, keep=True), config, "memory", ["sparse__sparse"], check=False)
    return R._rounded(report.per_query.drop("latency_ms"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
