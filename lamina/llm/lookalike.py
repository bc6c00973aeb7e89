"""Texts that look the same although their characters differ.

Every text is look-alike mapped once, in Arrow batches (texts of plain ASCII never leave the JVM),
and kept as a table. Equivalence classes come from grouping under Spark's accent- and
case-sensitive ``UNICODE`` collation in SQL; the canonical member of a class is the least member
that needs no mapping, else the least member. It is joined back to all records.

The main product is the membership: one row for each record of a class of several texts, with the
class, the text's number in it and the number of links (records of the class with another text).
Pairs are its expansion. Classes and texts are known by their MD5 (128 bits). Nothing of a class is
gathered in one task: statistics are partial aggregates, and a class (or a text) takes as many salts
as its texts (or records) need, so classes of a third of all rows, or of 100,000 spellings, are split.

Records are (table_name, record_key, text). Null, empty and blank texts belong to no class and
are their own canonical text. Repeated rows of one key count once; a key with several texts is a
member with each. Equal strings make no pair, nor does a record with itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..operators.skew import salted_join
from ..session import kept
from .fold import folding

#: Texts of a class, or records of a text, that one task joins with the others.
SALT_ROWS = 1_000
#: A class's rows are spread over so many tasks where the class is joined to them.
CLASS_SALTS = 8
_CLASS = ["table_name", "class_id"]
_TEXT = [*_CLASS, "text_id"]


def records(df: DataFrame, table_name: str, key: str, text: str) -> DataFrame:
    """(table_name, record_key, text) of one table; rows without a key are left out."""
    return df.select(
        F.lit(table_name).alias("table_name"),
        F.col(key).cast("string").alias("record_key"),
        F.col(text).cast("string").alias("text"),
    ).where("record_key IS NOT NULL")


def mapped(recs: DataFrame) -> DataFrame:
    """table_name, record_key, shape (the look-alike mapped text) and written (the text, where it
    is not its shape); blank texts are left out."""
    shared = recs.sparkSession.sparkContext.broadcast(folding())  # tables of fixed size

    def fold(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        visual = shared.value.visual
        for text in batches:
            yield pd.Series([visual(t) for t in text], dtype=object)

    folded = F.pandas_udf(fold, StringType())
    plain = F.col("text").rlike(r"^[\x20-\x7e\n\r]*$")
    rows = recs.where("text IS NOT NULL AND text <> ''")
    rows = rows.withColumn("shape", F.coalesce(folded(F.when(~plain, F.col("text"))), "text"))
    return rows.where(r"shape RLIKE '[^\\s]'").select("table_name", "record_key", "shape", F.when(F.col("text") != F.col("shape"), F.col("text")).alias("written"))


def look_alike_classes(folded: DataFrame) -> DataFrame:
    """table_name, class_shape of the classes with at least two different texts, of ``mapped`` rows."""
    return folded.sparkSession.sql(
        """
        SELECT table_name, collate(shape, 'UNICODE') AS class_shape
        FROM (SELECT table_name, shape, xxhash64(coalesce(written, shape)) AS a, xxhash64(1, coalesce(written, shape)) AS b FROM {folded})
        GROUP BY table_name, collate(shape, 'UNICODE')
        HAVING min(a) <> max(a) OR min(b) <> max(b)
        """,
        folded=folded,
    )


def class_members(recs: DataFrame) -> DataFrame:
    """table_name, class_id, text_id, record_key, text, odd (whether it needs mapping) of classes with at least two different texts,
    each record and text once. Maps all texts once and keeps the result."""
    folded = kept(mapped(recs))
    members = folded.sparkSession.sql(
        """
        SELECT DISTINCT r.table_name, md5(CAST(CAST(c.class_shape AS STRING) AS BINARY)) AS class_id, r.record_key, coalesce(r.written, r.shape) AS text, r.written IS NOT NULL AS odd
        FROM {folded} r JOIN (SELECT *, explode(sequence(0, {salts} - 1)) AS salt FROM {classes}) c
          ON r.table_name = c.table_name AND collate(r.shape, 'UNICODE') = c.class_shape
             AND pmod(xxhash64(r.record_key), {salts}) = c.salt
        """,
        folded=folded,
        classes=look_alike_classes(folded),
        salts=CLASS_SALTS,
    )
    return members.withColumn("text_id", F.md5(F.col("text").cast("binary")))


def membership(members: DataFrame) -> DataFrame:
    """table_name, class_id, text_id, record_key, n_same (records with this text), n_texts (texts of
    the class) and n_links (records of the class with another text); ``members`` are read twice."""
    texts = members.groupBy(*_TEXT).agg(F.count(F.lit(1)).alias("n_same"))
    classes = texts.groupBy(*_CLASS).agg(F.count(F.lit(1)).alias("n_texts"), F.sum("n_same").alias("n_all"))
    sizes = salted_join(texts, classes, _CLASS, ["text_id"], salts=CLASS_SALTS)
    rows = salted_join(members.select(*_TEXT, "record_key"), sizes, _TEXT, ["record_key"], salts=CLASS_SALTS)
    return rows.select(*_TEXT, "record_key", "n_same", "n_texts", (F.col("n_all") - F.col("n_same")).alias("n_links"))


def canonical_texts(recs: DataFrame) -> DataFrame:
    """Every record with its canonical text: table_name, record_key, canonical_text.

    A text alone in its class, null or blank is its own canonical text."""
    members = kept(class_members(recs))
    texts = members.select(*_CLASS, "odd", "text").distinct()
    best = texts.groupBy(*_CLASS).agg(F.min(F.struct("odd", "text")).getField("text").alias("canonical"))
    canonical = salted_join(members, best, _CLASS, ["record_key"], salts=CLASS_SALTS).select("table_name", "record_key", "text_id", "canonical")
    one = recs.select("table_name", "record_key", "text").distinct().withColumn("text_id", F.md5(F.col("text").cast("binary")))
    return one.join(canonical, ["table_name", "record_key", "text_id"], "left").select("table_name", "record_key", F.coalesce("canonical", "text").alias("canonical_text"))


def _split(df: DataFrame, rows: str, by: str) -> DataFrame:
    """Adds ``salt``: one of as many as ``rows`` need, by the hash of ``by``."""
    return df.withColumn("salt", F.pmod(F.xxhash64(by), _salts(rows)))


def _repeated(df: DataFrame, rows: str) -> DataFrame:
    """Adds ``salt``: every one of as many as ``rows`` need."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), _salts(rows) - 1)))


def _salts(rows: str) -> Column:
    return F.ceil(F.col(rows) / SALT_ROWS).cast("bigint")


def text_pairs(members: DataFrame) -> DataFrame:
    """table_name, class_id, text_a, text_b, n_a, n_b (records of each): different texts of a class,
    once for each two; ``members`` as ``membership`` gives them."""
    texts = members.select(*_TEXT, "n_same", "n_texts").distinct()
    a = _split(texts, "n_texts", "text_id").select(*_CLASS, "salt", F.col("text_id").alias("text_a"), F.col("n_same").alias("n_a"))
    b = _repeated(texts, "n_texts").select(*_CLASS, "salt", F.col("text_id").alias("text_b"), F.col("n_same").alias("n_b"))
    return a.join(b, [*_CLASS, "salt"]).where("text_a < text_b").drop("salt")


def look_alike_pairs(recs: DataFrame) -> DataFrame:
    """table_name, key_a, key_b: pairs of different records with texts that look the same and
    differ. Work is proportional to the result: pairs are made between the texts of a class and
    only then spread to their records."""
    members = kept(membership(kept(class_members(recs))))
    rows = text_pairs(members)
    for side in ("a", "b"):
        of_text = _split(members, "n_same", "record_key").select(*_CLASS, "salt", F.col("text_id").alias(f"text_{side}"), F.col("record_key").alias(f"key_{side}"))
        rows = _repeated(rows, f"n_{side}").join(of_text, [*_CLASS, "salt", f"text_{side}"]).drop("salt")
    return rows.where("key_a <> key_b").select("table_name", F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b")).distinct()


def look_alike_membership(recs: DataFrame) -> DataFrame:
    """table_name, record_key, class_id, n_links: one row for each record and text that has look-alikes."""
    return membership(kept(class_members(recs))).select("table_name", "record_key", "class_id", "n_links")
