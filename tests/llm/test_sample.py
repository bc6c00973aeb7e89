import pytest
from pyspark.sql import functions as F

from lamina.llm import sample as S


def keys(df):
    return {r[0] for r in df.collect()}


def frame(spark, ids):
    return spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "query_id string, bucket int")


def test_same_in_every_partitioning_and_with_growth(spark):
    ids = [f"q{n}" for n in range(3000)]
    few, all_ = frame(spark, ids[:1000]), frame(spark, ids + ids[:50])
    a = keys(S.stable_sample(few, "query_id", 0.1))
    b = keys(S.stable_sample(all_.repartition(7), "query_id", 0.1))
    assert a <= b and b & set(ids[:1000]) == a
    assert keys(S.stable_sample(all_.orderBy(F.rand(3)), "query_id", 0.1)) == b
    assert 200 < len(b) < 400
    assert b <= keys(S.stable_sample(all_, "query_id", 0.3))


def test_bounds_and_dirt(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), (" a", 3), (None, 0), ("", 0), ("  ", 0), ("é" * 5000, 4)], "query_id string, first_seen int")
    rows = {r.query_id: r.first_seen for r in S.stable_sample(df, "query_id", 1.0, "first_seen").collect()}
    assert rows == {"a": 1, "é" * 5000: 4}
    assert S.stable_sample(df, "query_id", 0.0).count() == 0
    assert S.stable_sample(df.limit(0), "query_id", 0.5).count() == 0
    assert S.stable_sample(df, "query_id", 1.0).where("query_id = 'a'").first().n_rows == 3
    with pytest.raises(ValueError):
        S.stable_sample(df, "query_id", 1.5)


def test_order_of_buckets_is_a_permutation():
    assert sorted(S.bucket_order(64, "s")) == list(range(64)) and S.bucket_order(64, "s") != S.bucket_order(64, "t")
