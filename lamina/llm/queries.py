"""Registered queries of this subpackage, over whole tables, and the SQL of those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from . import encode, ideal, language, leaks, lookalike, sample, terms, topn

SAMPLE_FRACTION = 0.1
TOP_ITEMS = 5
DISTINCT_MIN_COUNT, DISTINCT_MAX_RECORDS = 3, 3


def _text_records(spark: SparkSession, sf: str) -> DataFrame:
    parts = [
        lookalike.records(read_table(spark, sf, table), table, key, text)
        for table, key, text in (("documents", "doc_id", "title"), ("passages", "passage_id", "text"), ("queries", "query_id", "text"))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of records whose texts look the same and differ."""
    return lookalike.look_alike_pairs(_text_records(spark, sf))


def p2_canonical(spark: SparkSession, sf: str) -> DataFrame:
    """Every record with its text in the one form of its class."""
    return lookalike.canonical_texts(_text_records(spark, sf))


def p2_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Every record that has look-alikes, with its class and the number of its links."""
    return lookalike.look_alike_membership(_text_records(spark, sf))


def p3_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Sampled query_ids with bucket, bucket_place and the batch they first came in."""
    s = sample.stable_sample(read_table(spark, sf, "queries"), "query_id", SAMPLE_FRACTION, "batch_no")
    return s.select("query_id", "bucket", "bucket_place", F.col("first_seen").cast("bigint").alias("first_batch"))


def _scored_terms(spark: SparkSession, sf: str, min_count: int) -> DataFrame:
    parts = [
        terms.residual_scores(read_table(spark, sf, table), key, "search_text", min_count).withColumn("table_name", F.lit(table))
        for table, key in (("documents", "doc_id"), ("passages", "passage_id"))
    ]
    return parts[0].unionByName(parts[1])


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Terms frequent in a record and in almost no other."""
    rows = _scored_terms(spark, sf, DISTINCT_MIN_COUNT).where((F.col("n_records") <= DISTINCT_MAX_RECORDS) & F.col("score").isNotNull())
    return rows.select("table_name", "record_key", "term")


def p4_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The score of every term of every record."""
    return _scored_terms(spark, sf, 1).select("table_name", "record_key", "term", "n", F.round("score", 6).alias("score"))


def _passage_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "ranking").where("item_level = 'passage'").select("query_id", "retriever", "item_id", "score")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """The first five passages of each query and retriever."""
    top = topn.top_n(_passage_ranking(spark, sf), ["query_id", "retriever"], "item_id", "score", TOP_ITEMS)
    return top.select("query_id", "retriever", "item_id", "place")


def p6_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """Rank of every passage by closeness to its query's ideal point."""
    return ideal.ideal_point_ranking(_passage_ranking(spark, sf), "query_id", "retriever", "item_id", "score")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """First passage of the combined ranking, for queries on whose winner three retrievers agree."""
    rows = _passage_ranking(spark, sf)
    winners = topn.top_n(rows, ["query_id", "retriever"], "item_id", "score", 1)
    agreed = winners.groupBy("query_id", "item_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").select("query_id").distinct()
    ranking = ideal.closeness(rows.join(agreed, "query_id", "left_semi"), "query_id", "retriever", "item_id", "score")
    return ideal.first_of_ranking(ranking, "query_id")


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id and ids of every document."""
    return encode.encode_corpus(read_table(spark, sf, "documents"), "doc_id", "text")


def p8_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Longest verbatim match of each document and benchmark item, with its place in both."""
    return leaks.verbatim_matches(read_table(spark, sf, "documents"), "doc_id", "text", read_table(spark, sf, "benchmark"), "item_id", "text")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and the benchmark items of which they hold twelve words in a row."""
    return p8_matches(spark, sf).select("doc_id", "item_id")


def p8_clean(spark: SparkSession, sf: str) -> DataFrame:
    """The documents that hold no benchmark item."""
    docs = read_table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    return leaks.remove_affected(docs, "doc_id", p8_matches(spark, sf))


def _languages(spark: SparkSession, sf: str) -> DataFrame:
    model = language.fit(read_table(spark, sf, "lang_samples"), "lang", "text")
    return language.line_languages(read_table(spark, sf, "documents"), "doc_id", "text", "lang", model)


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Languages of wrongly labelled documents and of the lines of mixed ones."""
    return language.label_repairs(_languages(spark, sf)).select("doc_id", "line_no", "lang")


def p9_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Language and confidence of every document (line 0) and of every line with letters."""
    return _languages(spark, sf).select("doc_id", "line_no", "lang", F.round("confidence", 4).alias("confidence"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (p2_found, p2_canonical, p2_classes, p3_sample, p4_found, p4_scores, p5_found, p6_found, p6_ranking, p7_ids, p8_found, p8_matches, p8_clean, p9_found, p9_segments)
    return {f.__name__: f for f in own}


def _terms_sql(table: str, key: str) -> str:
    return f"""
    SELECT '{table}' AS table_name, k AS record_key, sum(n) OVER (PARTITION BY k) AS r, term, n,
           sum(n) OVER (PARTITION BY term) AS c, sum(n) OVER () AS total, count(*) OVER (PARTITION BY term) AS n_records
    FROM (SELECT k, term, count(*) AS n
          FROM (SELECT k, unnest(regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}]+')) AS term
                FROM (SELECT CAST({key} AS VARCHAR) AS k, min(search_text) AS t FROM {table} WHERE {key} IS NOT NULL GROUP BY 1))
          GROUP BY 1, 2)"""


# Look-alike folding in SQL, with lists of its own: full-width forms by their offset, composed
# accents, blanks, invisible characters, ligatures, half-width kana and letters of one shape.
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_NARROW = "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")
_KANA_HALF = "｡｢｣､･ｦｧｨｩｪｫｬｭｮｯｰｱｲｳｴｵｶｷｸｹｺｻｼｽｾｿﾀﾁﾂﾃﾄﾅﾆﾇﾈﾉﾊﾋﾌﾍﾎﾏﾐﾑﾒﾓﾔﾕﾖﾗﾘﾙﾚﾛﾜﾝﾞﾟ"
_KANA_FULL = "。「」、・ヲァィゥェォャュョッーアイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワン\u3099\u309a"
_SHAPES = ("асԁеһіјӏорԛѕухԝѵАВСЕНІЈКМОРԚЅТУХԜԌѴΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρϲϳ", "acdehijlopqsyxwvABCEHIJKMOPQSTYXWGVABEZHIKMNOPTYXovpcj")
_BLANK = "chr(9) || " + " || ".join(f"chr({c})" for c in (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000))
_UNSEEN = r"[\x{00}-\x{08}\x{0E}-\x{1F}\x{7F}-\x{84}\x{86}-\x{9F}\x{AD}\x{34F}\x{61C}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFF9}-\x{FFFB}]"


def _shape_sql(text: str) -> str:
    plain = f"regexp_replace(translate({text}, {_BLANK}, repeat(' ', 18)), '{_UNSEEN}', '', 'g')"
    plain = f"translate({plain}, '{_WIDE}{_KANA_HALF}', '{_NARROW}{_KANA_FULL}')"
    for joined in ("ffi ﬃ", "ffl ﬄ", "ff ﬀ", "fi ﬁ", "fl ﬂ", "st ﬆ", "st ﬅ"):
        plain = f"replace({plain}, '{joined.split()[1]}', '{joined.split()[0]}')"
    letters = f"translate(nfc_normalize({plain}), '{_SHAPES[0]}ЁёЀѐЇїЙй', '{_SHAPES[1]}ËëÈèÏïЙй')"
    return f"nfc_normalize({letters})"


_LOOK_ALIKE = f"""
WITH R AS (SELECT DISTINCT 'documents' AS table_name, CAST(doc_id AS VARCHAR) AS record_key, title AS text FROM documents WHERE doc_id IS NOT NULL
  UNION SELECT 'passages', passage_id, text FROM passages WHERE passage_id IS NOT NULL
  UNION SELECT 'queries', query_id, text FROM queries WHERE query_id IS NOT NULL),
S AS (SELECT *, {_shape_sql('text')} AS shape FROM R WHERE text <> ''),
M AS (SELECT * FROM S WHERE regexp_matches(shape, '\\S') QUALIFY min(text) OVER (PARTITION BY table_name, shape) <> max(text) OVER (PARTITION BY table_name, shape))
"""

def _word_runs_sql(table: str, key: str) -> str:
    """Key and every twelve words in a row of a table's text, in lower case and folded."""
    words = f"regexp_extract_all({_shape_sql('lower(text)')}, " + r"'[\p{L}\p{N}]+')"
    return f"""SELECT DISTINCT {key}, array_to_string(w[i : i + {leaks.MIN_WORDS - 1}], ' ') AS run
      FROM (SELECT {key}, w, unnest(range(1, len(w) - {leaks.MIN_WORDS - 2})) AS i FROM (SELECT {key}, {words} AS w FROM {table} WHERE {key} IS NOT NULL))"""


_LEAKS = f"SELECT DISTINCT doc_id, item_id FROM ({_word_runs_sql('documents', 'doc_id')}) JOIN ({_word_runs_sql('benchmark', 'item_id')}) USING (run)"

_IDEAL = """
WITH S AS (SELECT query_id, retriever AS r, item_id, max(score) AS s FROM ranking WHERE item_level = 'passage' AND query_id IS NOT NULL AND retriever IS NOT NULL
  AND item_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY ALL),
O AS (SELECT *, row_number() OVER (PARTITION BY query_id, r ORDER BY s, item_id) AS place, count(*) OVER (PARTITION BY query_id, r) AS n FROM S),
X AS (SELECT query_id, r, max(s) AS top,
  CASE WHEN n >= 3 THEN least(max(s) FILTER (place = (95 * n + 99) // 100), max(s) FILTER (place = n - 1)) ELSE max(s) END AS hi,
  CASE WHEN n >= 5 THEN greatest(max(s) FILTER (place = greatest(1, (5 * n + 99) // 100)), max(s) FILTER (place = 2)) ELSE min(s) END AS lo
  FROM O GROUP BY query_id, r, n),
C AS (SELECT query_id, r, item_id, s >= top AS first, hi - least(lo, hi) AS width, greatest(least(lo, hi), least(hi, s)) - least(lo, hi) AS x FROM S JOIN X USING (query_id, r)),
K AS (SELECT query_id, r, any_value(width) AS width, CASE WHEN sqrt(sum(x * x)) > 0 THEN 1.0 / sqrt(sum(x * x)) ELSE 0 END AS scale FROM C GROUP BY 1, 2),
V AS (SELECT query_id, item_id, first, CAST(round(x * scale * 1e8) AS HUGEINT) AS v, CAST(round(K.width * scale * 1e8) AS HUGEINT) AS span FROM C JOIN K USING (query_id, r)),
F AS (SELECT query_id, sum(CAST(round(width * scale * 1e8) AS HUGEINT) * CAST(round(width * scale * 1e8) AS HUGEINT)) AS whole FROM K GROUP BY 1),
I AS (SELECT query_id, item_id, sqrt(CAST(sum(v * v) AS DOUBLE)) AS far, sum((span - v) * (span - v) - span * span) AS missing, count(*) FILTER (first) AS firsts FROM V GROUP BY 1, 2),
D AS (SELECT query_id, item_id, firsts, far, sqrt(CAST(whole + missing AS DOUBLE)) AS ideal FROM I JOIN F USING (query_id)),
Z AS (SELECT query_id, item_id, firsts, round(CASE WHEN far + ideal > 0 THEN far / (far + ideal) ELSE 0.5 END, 9) AS closeness FROM D),
P AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY closeness DESC, firsts DESC, item_id) AS rank FROM Z)
"""


def oracle_sql() -> dict[str, str]:
    every_term = f"{_terms_sql('documents', 'doc_id')} UNION ALL {_terms_sql('passages', 'passage_id')}"
    return {
        "p2_found": f"""{_LOOK_ALIKE} SELECT DISTINCT table_name, least(a.record_key, b.record_key) AS key_a, greatest(a.record_key, b.record_key) AS key_b
            FROM M a JOIN M b USING (table_name, shape) WHERE a.record_key < b.record_key AND a.text <> b.text""",
        "p2_canonical": f"""{_LOOK_ALIKE}, L AS (SELECT table_name, record_key, text, first_value(text) OVER (PARTITION BY table_name, shape ORDER BY text <> shape, text) AS canonical FROM M)
            SELECT table_name, record_key, coalesce(canonical, text) AS canonical_text FROM R LEFT JOIN L USING (table_name, record_key, text)""",
        "p6_ranking": _IDEAL + " SELECT query_id, item_id, closeness, firsts, rank FROM P",
        "p6_found": _IDEAL + """, B AS (SELECT query_id, r, item_id FROM S QUALIFY row_number() OVER (PARTITION BY query_id, r ORDER BY s DESC, item_id) = 1),
            A AS (SELECT DISTINCT query_id FROM (SELECT query_id, item_id FROM B GROUP BY 1, 2 HAVING count(*) >= 3))
            SELECT query_id, item_id FROM P JOIN A USING (query_id) WHERE rank = 1""",
        "p8_found": _LEAKS,
        "p8_clean": f"SELECT doc_id, source, n_chars FROM documents WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM ({_LEAKS}))",
        "p3_sample": f"""
            WITH b AS (SELECT CAST(range AS BIGINT) AS bucket,
                       row_number() OVER (ORDER BY md5('{sample.SEED}:' || range), range) AS bucket_place
                       FROM range({sample.BUCKETS})),
            q AS (SELECT trim(query_id) AS query_id, min(batch_no) AS first_batch FROM queries
                  WHERE trim(query_id) <> '' GROUP BY 1)
            SELECT query_id, b.bucket, bucket_place, CAST(first_batch AS BIGINT) AS first_batch
            FROM q JOIN b ON b.bucket = CAST('0x' || substr(md5(query_id), 1, 15) AS BIGINT) % {sample.BUCKETS}
            WHERE bucket_place <= ceil({SAMPLE_FRACTION} * {sample.BUCKETS})""",
        "p4_found": f"""
            SELECT table_name, record_key, term FROM ({every_term})
            WHERE n >= {DISTINCT_MIN_COUNT} AND n_records <= {DISTINCT_MAX_RECORDS}""",
        "p4_scores": f"""
            SELECT table_name, record_key, term, n, round((n - r * 1.0::DOUBLE * c / total) / sqrt(r * 1.0::DOUBLE * c / total)
                   / sqrt((1 - r * 1.0::DOUBLE / total) * (1 - c * 1.0::DOUBLE / total)), 6) + 0.0 AS score
            FROM ({every_term})""",
        "p5_found": f"""
            SELECT query_id, retriever, item_id, place FROM (
              SELECT *, row_number() OVER (PARTITION BY query_id, retriever ORDER BY score DESC, item_id) AS place
              FROM (SELECT query_id, retriever, item_id, max(score) AS score FROM ranking
                    WHERE item_level = 'passage' AND query_id IS NOT NULL AND retriever IS NOT NULL AND item_id IS NOT NULL
                      AND score IS NOT NULL AND NOT isnan(score) GROUP BY 1, 2, 3))
            WHERE place <= {TOP_ITEMS}""",
    }
