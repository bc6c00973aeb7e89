"""References to records that do not exist.

Parent keys are split into a family (the text before the trailing digits and, with leading
zeros, their width) and an integer, so that key and (family, integer) determine each other.
Sorted integers are compressed into contiguous runs of one state (present or deleted); runs end
at multiples of ``BLOCK``, so a window never holds more than ``BLOCK`` keys however large a
family. Distinct referenced keys are as-of matched to the preceding run start in their block: no
run, or a key beyond its end, is a missing target. A reference to a present key may be late only
if the run's latest time lies after the key's earliest reference; those keys alone are looked up.

Only distinct keys take part in the match; references are aggregated and counted per key before any
shuffle. The keys in question are kept as a table and joined back to their references by frequency:
hot keys meet a bounded broadcast, so a key that holds a third of all references is no single task's
burden, and nothing is repeated for it.

Keys compare after removing outer spaces and lower-casing; a null or then empty key is no
reference and no target. A deletion wins over a row that remains. A null time of the reference
or the target is never late. Repeated rows of a target count once, with the earliest time.
Empty tables: without targets every reference is missing, without references there is no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept
from .skew import frequency_join

BLOCK = 1 << 16
_PLACE = ["target_table", "family", "width", "block"]


def plain_key(key: Column) -> Column:
    """Key as compared: null if it is none."""
    k = F.lower(F.trim(key.cast("string")))
    return F.when(k != "", k)


def split_key(df: DataFrame) -> DataFrame:
    """Adds family, width, no and block of the column ``key``."""
    digits = F.regexp_extract("key", "([0-9]{1,18})$", 1)
    return (
        df.withColumn("digits", digits)
        .withColumn("family", F.expr("substring(key, 1, length(key) - length(digits))"))
        .withColumn("width", F.expr("CASE WHEN digits = '' THEN -1 WHEN digits LIKE '0_%' THEN length(digits) ELSE 0 END"))
        .withColumn("no", F.expr("CASE WHEN digits = '' THEN 0L ELSE cast(digits AS bigint) END"))
        .withColumn("block", F.floor(F.col("no") / BLOCK))
        .drop("digits")
    )


def target_keys(targets: DataFrame, deleted: DataFrame) -> DataFrame:
    """target_table, key, deleted, time (earliest) of every key that exists or is deleted.

    ``targets``: target_table, key, time; ``deleted``: target_table, key."""
    rows = targets.select("target_table", plain_key(F.col("key")).alias("key"), "time", F.lit(False).alias("deleted"))
    gone = deleted.select("target_table", plain_key(F.col("key")).alias("key"), F.lit(None).cast("timestamp_ntz").alias("time"), F.lit(True).alias("deleted"))
    rows = rows.withColumn("time", F.col("time").cast("timestamp_ntz")).unionByName(gone).where("key IS NOT NULL")
    return rows.groupBy("target_table", "key").agg(F.max("deleted").alias("deleted"), F.min("time").alias("time"))


def key_runs(keys: DataFrame) -> DataFrame:
    """Contiguous runs of keys of one state: place columns, first, last, deleted, latest."""
    w = Window.partitionBy(*_PLACE).orderBy("no")
    starts = (F.col("no") - F.lag("no").over(w) != 1) | (F.lag("deleted").over(w) != F.col("deleted"))
    rows = split_key(keys).withColumn("starts", F.coalesce(starts, F.lit(True)).cast("bigint"))
    rows = rows.withColumn("run", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*_PLACE, "run").agg(
        F.min("no").alias("first"), F.max("no").alias("last"), F.first("deleted").alias("deleted"), F.max("time").alias("latest")
    )


def as_of_runs(asked: DataFrame, runs: DataFrame) -> DataFrame:
    """Asked keys (target_table, key, ...) with ``run``: first, last, deleted and latest of the run
    they lie in, or null."""
    at = F.struct("first", "last", "deleted", "latest").alias("run")
    events = runs.select(*_PLACE, F.col("first").alias("no"), F.lit(0).alias("kind"), at).unionByName(
        split_key(asked).withColumn("kind", F.lit(1)), allowMissingColumns=True
    )
    w = Window.partitionBy(*_PLACE).orderBy("no", "kind").rowsBetween(Window.unboundedPreceding, 0)
    matched = events.withColumn("run", F.last("run", ignorenulls=True).over(w)).where("kind = 1")
    return matched.withColumn("run", F.when(F.col("run.last") >= F.col("no"), F.col("run"))).drop("kind", "no", *_PLACE[1:])


def dangling_references(references: DataFrame, targets: DataFrame, deleted: DataFrame) -> DataFrame:
    """ref_table, ref_field, ref_key, state (deleted, missing or late), ref_month.

    ``references``: ref_table, ref_field, ref_key, target_table, key, time, one row for each."""
    keys = target_keys(targets, deleted)
    refs = references.select(
        "ref_table", "ref_field", "ref_key", "target_table", plain_key(F.col("key")).alias("key"), F.col("time").cast("timestamp_ntz").alias("ref_time")
    ).where("key IS NOT NULL")
    asked = refs.groupBy("target_table", "key").agg(F.min("ref_time").alias("earliest"), F.count(F.lit(1)).alias("n"))
    matched = as_of_runs(asked, key_runs(keys))
    sure = matched.where("run IS NULL OR run.deleted").select(
        "target_table", "key", "n", F.when(F.col("run").isNull(), "missing").otherwise("deleted").alias("state"), F.lit(None).cast("timestamp_ntz").alias("target_time")
    )
    maybe = matched.where("NOT run.deleted AND run.latest > earliest").select("target_table", "key", "n", "earliest")
    late = maybe.join(keys.select("target_table", "key", F.col("time").alias("target_time")), ["target_table", "key"]).where("target_time > earliest")
    problems = sure.unionByName(late.select("target_table", "key", "n", F.lit("late").alias("state"), "target_time"))
    found = frequency_join(refs, kept(problems), ["target_table", "key"], "n").where("state <> 'late' OR target_time > ref_time")
    return found.select("ref_table", "ref_field", "ref_key", "state", F.coalesce(F.date_format("ref_time", "yyyy-MM"), F.lit("unknown")).alias("ref_month"))


def report_by_period(found: DataFrame) -> DataFrame:
    """Dangling references by table, field, month and state."""
    return found.groupBy("ref_table", "ref_field", "ref_month", "state").agg(F.count(F.lit(1)).alias("n_references"))


def retrieval_references(documents: DataFrame, passages: DataFrame, queries: DataFrame, qrels: DataFrame, tombstones: DataFrame) -> DataFrame:
    """``dangling_references`` of passages to documents and of judgements to queries and passages."""
    one = lambda c: F.col(c).cast("string")
    targets = (
        documents.select(F.lit("documents").alias("target_table"), one("doc_id").alias("key"), F.col("ingested_at").alias("time"))
        .unionByName(passages.select(F.lit("passages").alias("target_table"), one("passage_id").alias("key"), F.col("ingested_at").alias("time")))
        .unionByName(queries.select(F.lit("queries").alias("target_table"), one("query_id").alias("key"), F.col("created_at").alias("time")))
    )
    first = passages.where("passage_id IS NOT NULL").groupBy("passage_id").agg(
        F.min(F.struct(F.col("ingested_at").isNull().alias("late"), F.col("ingested_at").alias("time"), F.col("doc_id"))).alias("r")
    )
    references = (
        first.select(F.lit("passages").alias("ref_table"), F.lit("doc_id").alias("ref_field"), F.col("passage_id").alias("ref_key"), F.lit("documents").alias("target_table"), one("r.doc_id").alias("key"), F.col("r.time").alias("time"))
        .unionByName(qrels.select(F.lit("qrels").alias("ref_table"), F.lit("query_id").alias("ref_field"), one("qrel_id").alias("ref_key"), F.lit("queries").alias("target_table"), one("query_id").alias("key"), F.col("judged_at").alias("time")))
        .unionByName(qrels.select(F.lit("qrels").alias("ref_table"), F.lit("passage_id").alias("ref_field"), one("qrel_id").alias("ref_key"), F.lit("passages").alias("target_table"), one("passage_id").alias("key"), F.col("judged_at").alias("time")))
    )
    deleted = tombstones.select("target_table", F.col("target_key").alias("key"))
    return dangling_references(references, targets, deleted)
