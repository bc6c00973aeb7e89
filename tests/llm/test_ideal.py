import math
import random

import pytest

from lamina.llm import ideal as I

SCHEMA = "q string, r string, item_id string, score double, closeness int"


def brute(rows):
    best = {}
    for q, r, i, s, *_ in rows:
        if None not in (q, r, i, s) and not math.isnan(s):
            best.setdefault(q, {}).setdefault(r, {})
            best[q][r][i] = max(s, best[q][r].get(i, -math.inf))
    out = {}
    for q, lists in best.items():
        near, full, items = {}, 0.0, {i for x in lists.values() for i in x}
        anti, gap, firsts = dict.fromkeys(items, 0.0), dict.fromkeys(items, 0.0), dict.fromkeys(items, 0)
        for x in lists.values():
            v = sorted(x.values())
            n = len(v)
            hi = min(v[math.ceil(0.95 * n) - 1], v[-2]) if n >= 3 else v[-1]
            lo = max(v[max(1, math.ceil(0.05 * n)) - 1], v[1]) if n >= 5 else v[0]
            lo = min(lo, hi)
            y = {i: max(lo, min(hi, s)) - lo for i, s in x.items()}
            size = math.sqrt(sum(a * a for a in y.values()))
            top = (hi - lo) / size if size else 0.0
            for i in items:
                w = y.get(i, 0.0) / size if size else 0.0
                anti[i] += w * w
                gap[i] += (top - w) ** 2
                firsts[i] += i in x and x[i] >= v[-1]
        for i in items:
            a, b = math.sqrt(anti[i]), math.sqrt(gap[i])
            out[q, i] = (a / (a + b) if a + b > 1e-12 else 0.5, firsts[i])
    return out


def test_against_brute_force(spark):
    rnd = random.Random(4)
    rows = []
    for q in range(25):
        for r, scale in (("bm25", 50.0), ("dense", 0.1), ("fts", 1.0)):
            for i in rnd.sample(range(12), rnd.randrange(0, 11)):
                rows.append((f"q{q}", r, f"i{i}", rnd.choice([None, math.nan, scale * rnd.random(), scale * rnd.random(), 0.0, scale * 40 * rnd.random()]), 1))
    rows += [(None, "bm25", "i1", 1.0, 1), ("q1", None, "i1", 1.0, 1), ("q1", "bm25", None, 1.0, 1)]
    got = {(r.q, r.item_id): (r.closeness, r.firsts) for r in I.ideal_point_ranking(spark.createDataFrame(rows, SCHEMA).repartition(5), "q", "r", "item_id", "score").collect()}
    want = brute(rows)
    assert set(got) == set(want)
    for k in want:
        assert got[k][0] == pytest.approx(want[k][0], abs=1e-6) and got[k][1] == want[k][1], k


def test_one_wild_score_does_not_decide(spark):
    rows = []
    for n in range(8):
        rows += [("q", r, f"i{n}", s * (8 - n), 1) for r, s in (("dense", 0.01), ("fts", 1.0), ("hash", 0.1))]
        rows.append(("q", "bm25", f"i{n}", 20.0 - n if n != 7 else 5000.0, 1))
    ranking = I.ideal_point_ranking(spark.createDataFrame(rows, SCHEMA), "q", "r", "item_id", "score")
    assert I.first_of_ranking(ranking, "q").collect() == [("q", "i0")]


def test_nothing_to_tell_and_empty(spark):
    same = spark.createDataFrame([("q", "a", i, 1.0, 1) for i in "xyz"], SCHEMA)
    assert {r.closeness for r in I.ideal_point_ranking(same, "q", "r", "item_id", "score").collect()} == {0.5}
    assert I.first_of_ranking(I.ideal_point_ranking(same, "q", "r", "item_id", "score"), "q").collect() == [("q", "x")]
    assert I.ideal_point_ranking(same.limit(0), "q", "r", "item_id", "score").count() == 0


def test_weights(spark):
    rows = [("q", "a", "x", 2.0, 1), ("q", "a", "y", 1.0, 1), ("q", "b", "y", 2.0, 1), ("q", "b", "x", 1.0, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    for weights, first in (({"a": 5.0}, "x"), ({"b": 5.0}, "y")):
        assert I.first_of_ranking(I.ideal_point_ranking(df, "q", "r", "item_id", "score", weights), "q").first().item_id == first


def test_a_hot_group_ranks_alike_in_any_partitioning(spark):
    from pyspark.sql import functions as F

    items = spark.range(50_000)
    rows = None
    for r, score in (("a", "abs(hash(id)) / 1e6"), ("b", "pmod(hash(id, 1), 1000) / 7"), ("c", "exp(pmod(hash(id, 2), 100) / 30)")):
        part = items.where(f"pmod(hash(id, '{r}'), 5) > 0").selectExpr("'hot' AS q", f"'{r}' AS r", "concat('i', id) AS item_id", f"{score} AS score", "1 AS closeness")
        rows = part if rows is None else rows.unionByName(part)
    one, two = (I.ideal_point_ranking(x, "q", "r", "item_id", "score") for x in (rows.repartition(3), rows.orderBy(F.col("score").desc()).repartition(7)))
    first, second = (sorted((r["rank"], r.item_id, r.closeness, r.firsts) for r in x.collect()) for x in (one, two))
    assert first == second and [r[0] for r in first] == list(range(1, len(first) + 1))
    assert [(-c, -f, i) for _, i, c, f in first] == sorted((-c, -f, i) for _, i, c, f in first)
    # the bounds are exact order statistics
    best = I.best_by_item(rows.where("r = 'a'"), ["q", "r"], "item_id", "score")
    values = sorted(r.score for r in best.collect())
    n = len(values)
    [b] = I.source_bounds(best, "q", "r").collect()
    assert (b.lo, b.hi, b.top) == (values[(5 * n + 99) // 100 - 1], values[(95 * n + 99) // 100 - 1], values[-1])
