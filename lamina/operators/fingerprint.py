"""Fingerprints of id lists and corpora."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ordered_fingerprint(values: Iterable[str]) -> str:
    """sha256 of the values in order, each followed by a zero byte; for lists on the driver or
    a ``toLocalIterator`` (one value at a time)."""
    digest = hashlib.sha256()
    for v in values:
        digest.update(v.encode() + b"\0")
    return digest.hexdigest()


def corpus_fingerprint(items: DataFrame, item: str = "item_id", text: str = "text", pos: str | None = None) -> DataFrame:
    """One row: n_items and a digest (64 hexadecimal digits). Four sums of the quarters of each row's
    sha256, so repeated rows add up and do not cancel; with ``pos`` the place of a row counts too, and
    the digest depends on order. One partial aggregate, no shuffle of texts. Lengths keep the parts of a
    row apart; a null text differs from an empty one."""
    part = lambda c: F.when(c.isNull(), "-").otherwise(F.concat(F.length(c), F.lit(":"), c))
    columns = [F.col(item).cast("string"), F.col(text), *([F.col(pos).cast("string")] if pos else [])]
    row = F.sha2(F.concat(*map(part, columns)), 256)
    quarter = lambda i: F.sum(F.conv(F.substring(row, 16 * i + 1, 16), 16, 10).cast("decimal(38,0)"))
    sums = items.agg(F.count(F.lit(1)).alias("n_items"), *[F.coalesce(quarter(i), F.lit(0)).alias(f"s{i}") for i in range(4)])
    joined = F.concat_ws(",", F.col("n_items").cast("string"), *[F.col(f"s{i}").cast("string") for i in range(4)])
    return sums.select("n_items", F.sha2(joined, 256).alias("digest"))
