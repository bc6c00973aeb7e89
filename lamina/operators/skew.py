"""Joins whose keys may be hot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16
SALT = "salt of the join"
#: A key that holds more than 1 / HOT_SHARE of all rows is hot; there are at most HOT_SHARE of them.
HOT_SHARE = 10_000


def salted_join(many: DataFrame, few: DataFrame, keys: Sequence[str], by: Sequence[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """``many`` joined with ``few`` on ``keys``; a key's rows of ``many`` are spread over ``salts``
    tasks by the hash of the columns ``by``, for which ``few`` is repeated ``salts`` times.

    For a ``few`` that is small beside ``many``, such as statistics of its groups. ``how`` keeps
    its meaning for inner and left joins and for semi and anti joins from the left."""
    a = many.withColumn(SALT, F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
    b = few.withColumn(SALT, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.join(b, [*keys, SALT], how).drop(SALT)


def frequency_join(many: DataFrame, few: DataFrame, key: str | Sequence[str], count: str, share: int = HOT_SHARE) -> DataFrame:
    """``many`` joined with ``few``, which has one row a ``key`` and in ``count`` how many rows of
    ``many`` have it. Rows of hot keys meet a broadcast of at most ``share`` rows and are not
    shuffled; all others are joined by key, where none is hot. ``few`` is read several times."""
    keys = [key] if isinstance(key, str) else list(key)
    total = few.agg(F.coalesce(F.sum(count), F.lit(0))).scalar()
    hot_count = F.col(count) * share >= total
    hot = F.broadcast(few.where(hot_count))
    return many.join(hot, keys).unionByName(many.join(hot.select(*keys), keys, "left_anti").join(few.where(~hot_count), keys))
