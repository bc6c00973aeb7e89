"""One ranking from several differently scaled scores, by closeness to an ideal point.

For each group (query) every source (retriever) is one criterion. Its scores are winsorised,
measured from their least value, and divided by their vector norm; distances to the ideal point
(best value of each criterion) and the anti-ideal point (least value) give the closeness
anti / (ideal + anti), which is sorted on.

Winsorising: values above the 95th percentile, but at least the highest one (from three values
on), are lowered to the value below; those under the 5th percentile, but at least the lowest
one (from five values on), are raised likewise. One wild score thus never sets a scale. The
percentiles are exact at every size: the values in place ceil(0.95 n) and ceil(0.05 n).

An item that a source does not list has that source's least value. A source whose winsorised
values are all equal says nothing and adds no distance; if all say nothing, closeness is 0.5.
Ties: more first places in unclipped scores, then identifier. Nulls, NaN and repeated items as in
``topn.best_by_item``.

Places come from ``ranking.numbered``, which spreads a group over tasks by ranges; the other
statistics are partial aggregates, and joins back to the rows are salted. Normalised scores are
taken as whole multiples of 1e-8, so sums of squares are exact and no ranking depends on partitioning.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import numbered
from ..operators.skew import salted_join
from ..session import kept
from .topn import best_by_item

#: Normalised scores are whole multiples of 1 / UNIT; sums of squares of 900 sources fit 64 bits (more raise an error).
UNIT = 10**8


def source_bounds(best: DataFrame, group: str, source: str) -> DataFrame:
    """For each group and source: lo, hi (winsorising bounds), top (highest raw score)."""
    keys = [group, source]
    sizes = best.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"), F.max("score").alias("top"))
    places = numbered(best, keys, [F.col("score").asc(), F.col("item_id").asc()], "place")
    at = lambda place: F.max(F.when(F.col("place") == F.expr(place), F.col("score")))
    rows = salted_join(places, sizes, keys, ["item_id"]).groupBy(*keys, "n", "least", "top").agg(
        at("(95 * n + 99) div 100").alias("p95"), at("n - 1").alias("second_highest"),
        at("greatest(1, (5 * n + 99) div 100)").alias("p5"), at("2").alias("second_lowest"),
    )
    hi = F.when(F.col("n") >= 3, F.least("p95", "second_highest")).otherwise(F.col("top"))
    lo = F.when(F.col("n") >= 5, F.greatest("p5", "second_lowest")).otherwise(F.col("least"))
    return rows.select(*keys, F.least(lo, hi).alias("lo"), hi.alias("hi"), "top")


def closeness(df: DataFrame, group: str, source: str, item: str, score: str, weights: Mapping[str, float] | None = None) -> DataFrame:
    """group, item_id, closeness (double), firsts (bigint): one row for each group and item."""
    best = kept(best_by_item(df, [group, source], item, score))
    bounds = source_bounds(best, group, source)
    x = F.greatest("lo", F.least("hi", "score")) - F.col("lo")
    clipped = kept(salted_join(best, bounds, [group, source], ["item_id"]).select(group, source, "item_id", x.alias("x"), (F.col("hi") - F.col("lo")).alias("width"), (F.col("score") >= F.col("top")).cast("bigint").alias("first")))
    norms = clipped.groupBy(group, source).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), F.max("width").alias("width"))
    most = max([1.0, *(weights or {}).values()])
    weight = F.lit(1.0 / most)
    for name, w in (weights or {}).items():
        weight = F.when(F.col(source) == name, F.lit(float(w) / most)).otherwise(weight)
    whole = lambda v: F.round(v * UNIT).cast("bigint")
    square = lambda c: c * c
    scaled = norms.select(group, source, "width", F.when(F.col("norm") > 0, weight / F.col("norm")).otherwise(0.0).alias("scale"))
    full = scaled.groupBy(group).agg(F.sum(square(whole(F.col("width") * F.col("scale")))).alias("full"))
    rows = salted_join(clipped.drop("width"), scaled, [group, source], ["item_id"]).select(group, "item_id", "first", whole(F.col("x") * F.col("scale")).alias("v"), whole(F.col("width") * F.col("scale")).alias("span"))
    items = rows.groupBy(group, "item_id").agg(
        F.sum(square(F.col("v"))).alias("anti"),
        F.sum(square(F.col("span") - F.col("v")) - square(F.col("span"))).alias("less"),
        F.sum("first").alias("firsts"),
    )
    anti, ideal = F.sqrt(F.col("anti").cast("double")), F.sqrt((F.col("full") + F.col("less")).cast("double"))
    near = F.when(anti + ideal > 0, anti / (anti + ideal)).otherwise(0.5)
    return salted_join(items, full, [group], ["item_id"]).select(group, "item_id", F.round(near, 9).alias("closeness"), "firsts")


def ideal_point_ranking(df: DataFrame, group: str, source: str, item: str, score: str, weights: Mapping[str, float] | None = None) -> DataFrame:
    """group, item_id, closeness, firsts, rank (bigint, from 1): one row for each group and item."""
    rows = kept(closeness(df, group, source, item, score, weights))
    return numbered(rows, [group], [F.col("closeness").desc(), F.col("firsts").desc(), F.col("item_id").asc()])


def first_of_ranking(ranking: DataFrame, group: str) -> DataFrame:
    """group, item_id of the first item: closeness, then firsts, then identifier."""
    entry = F.struct((-F.col("closeness")).alias("c"), (-F.col("firsts")).alias("f"), F.col("item_id"))
    return ranking.groupBy(group).agg(F.min(entry).alias("e")).select(group, F.col("e.item_id").alias("item_id"))
