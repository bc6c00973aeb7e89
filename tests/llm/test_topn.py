import math
import random

import pytest

from lamina.llm import topn as N

SCHEMA = "query_id string, retriever string, item_id string, score double, place string, neg int"


def brute(rows, n):
    best = {}
    for q, r, i, s, *_ in rows:
        if None not in (q, r, i, s) and not math.isnan(s):
            best[q, r, i] = max(s, best.get((q, r, i), -math.inf))
    out = set()
    for g in {k[:2] for k in best}:
        own = sorted(((-s, i.encode(), i) for (q, r, i), s in best.items() if (q, r) == g))
        out |= {(*g, i, p, -s) for p, (s, _, i) in enumerate(own[:n], 1)}
    return out


@pytest.mark.parametrize("n", [1, 3, 50])
def test_against_brute_force(spark, n):
    rnd = random.Random(n)
    scores = [None, math.nan, math.inf, -math.inf, 0.0, -0.0, 1.0, 1.0, -2.5, 1e300]
    rows = [(rnd.choice(["q1", "q1", "q2", None]), rnd.choice(["a", "b", None]), rnd.choice(["i1", "i2", "I3", "é", "i10", "𝒳", "ﬁ", None]), rnd.choice(scores), "x", 1) for _ in range(300)]
    rows += [("hot", "a", f"i{k:05}", float(k % 7), "x", 1) for k in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = [tuple(r) for r in N.top_n(df, ["query_id", "retriever"], "item_id", "score", n).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, n)


def test_empty_and_bad_n(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert N.top_n(df, ["query_id"], "item_id", "score", 3).count() == 0
    with pytest.raises(ValueError):
        N.top_n(df, ["query_id"], "item_id", "score", 0)


def test_small_heaps_and_hand_ons(spark, monkeypatch):
    rnd = random.Random(5)
    rows = [(f"q{rnd.randrange(40)}", "a", f"i{rnd.randrange(30):02}", float(rnd.randrange(9)), "x", 1) for _ in range(4000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    monkeypatch.setattr(N, "WAITING_ROWS", 50)
    monkeypatch.setattr(N, "HEAP_ENTRIES", 60)
    got = [tuple(r) for r in N.top_n(df, ["query_id", "retriever"], "item_id", "score", 3).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 3)


def test_a_hot_group_is_cut_down_before_the_only_shuffle(spark):
    hot = spark.range(200_000, numPartitions=4).selectExpr("'q' AS query_id", "'a' AS retriever", "concat('i', id % 50000) AS item_id", "cast(id % 977 AS double) AS score")
    assert N.partial_heaps(N.best_rows(hot, ["query_id", "retriever"], "item_id", "score"), 5).count() == 20
    plan = N.top_n(hot, ["query_id", "retriever"], "item_id", "score", 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Exchange") < plan.index("MapInArrow")
    places = [r.item_id for r in N.top_n(hot, ["query_id", "retriever"], "item_id", "score", 5).orderBy("place").collect()]
    assert places == sorted({f"i{i % 50000}" for i in range(200_000) if i % 977 == 976})[:5]
