"""How characteristic each term of a record is: adjusted residuals of the record-term table.

With n the count of a term in a record, r the record's terms, c the term's count in the table
and N all terms: e = r c / N, residual = (n - e) / sqrt(e), score = residual /
sqrt((1 - r/N)(1 - c/N)). Where a margin is the whole table the score is 0.

Terms are the longest runs of letters and digits (Unicode categories L and N) of the
lower-cased text. Null, empty and term-less texts give no rows. Rows with one key are one record
(the least text counts, as redelivered rows are equal); a null key is no record.

Texts are shuffled once, by record, and sorted there, which removes redelivery. Counting a record's
terms keeps that partitioning, and the counts are kept as a table, of which margins, total and
scores are read: every text is tokenised once. Margins are partial aggregates. Terms that make up more than 1/HOT_SHARE of all occurrences number at most HOT_SHARE,
so their margins are broadcast; all others are joined by term, where none is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept

HOT_SHARE = 10_000


def term_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """record_key, record_terms, term, n; one shuffle, by record."""
    rows = df.select(F.col(f"`{key}`").cast("string").alias("record_key"), F.col(f"`{text}`").cast("string").alias("t")).where("record_key IS NOT NULL AND t <> ''")
    rows = rows.repartition("record_key")  # before the window, or each side of the shuffle would sort whole texts
    place = F.row_number().over(Window.partitionBy("record_key").orderBy("t"))
    one = rows.withColumn("place", place).where("place = 1")
    words = one.select("record_key", F.expr(r"regexp_extract_all(lower(t), '[\\p{L}\\p{N}]+', 0)").alias("w"))
    each = words.select("record_key", F.size("w").cast("bigint").alias("record_terms"), F.explode("w").alias("term"))
    return each.groupBy("record_key", "record_terms", "term").agg(F.count(F.lit(1)).alias("n"))


def term_margins(counts: DataFrame) -> DataFrame:
    """term, term_total, n_records."""
    return counts.groupBy("term").agg(F.sum("n").alias("term_total"), F.count(F.lit(1)).alias("n_records"))


def residual_scores(df: DataFrame, key: str, text: str, min_count: int = 1) -> DataFrame:
    """record_key, term, n, n_records, score of each record and term that occurs there at
    least ``min_count`` times; margins are those of the whole table."""
    counts = kept(term_counts(df, key, text))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    margins = term_margins(counts).select("*", total.scalar().alias("total"))
    is_hot = F.col("term_total") * HOT_SHARE >= F.col("total")
    hot = F.broadcast(margins.where(is_hot))
    asked = counts.where(F.col("n") >= min_count)
    joined = asked.join(hot, "term").unionByName(asked.join(hot.select("term"), "term", "left_anti").join(margins.where(~is_hot), "term"))
    r, c, total_n = F.col("record_terms").cast("double"), F.col("term_total").cast("double"), F.col("total").cast("double")
    e = r * c / total_n
    spread = (1 - r / total_n) * (1 - c / total_n)
    score = F.when(spread > 0, (F.col("n") - e) / F.sqrt(e) / F.sqrt(F.when(spread > 0, spread).otherwise(1.0))).otherwise(0.0)
    return joined.select("record_key", "term", "n", "n_records", score.alias("score"))
