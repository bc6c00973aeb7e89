import math
import re
from collections import Counter

import pytest

from lamina.llm import terms as T


def brute(rows, min_count=1):
    words = {}
    for k, t, *_ in rows:
        if k is not None and t is not None:
            words[k] = min(t, words.get(k, t))
    counts = {k: Counter(re.findall(r"[^\W_]+", t.lower())) for k, t in words.items()}
    total, col, df = sum(sum(c.values()) for c in counts.values()), Counter(), Counter()
    for c in counts.values():
        col.update(c)
        df.update(c.keys())
    out = {}
    for k, c in counts.items():
        r = sum(c.values())
        for w, n in c.items():
            if n >= min_count:
                e, spread = r * col[w] / total, (1 - r / total) * (1 - col[w] / total)
                out[k, w] = (n, df[w], (n - e) / math.sqrt(e) / math.sqrt(spread) if spread > 0 else 0.0)
    return out


ROWS = [
    ("a", "The the THE cat", 1), ("b", "the dog, the Dog 42 ½ ünï_x", 2), ("b", "the dog, the Dog 42 ½ ünï_x", 2), ("c", None, 3), ("d", "", 3), ("e", " -- ", 3),
    (None, "ghost", 1), ("f", "rare " * 5000 + "the", 1), ("g", "日本語 テスト the", 1),
]


@pytest.mark.parametrize("hot", [1, 10_000])
@pytest.mark.parametrize("least", [1, 3])
def test_against_brute_force(spark, monkeypatch, hot, least):
    monkeypatch.setattr(T, "HOT_SHARE", hot)
    df = spark.createDataFrame(ROWS, "k string, text string, term int").repartition(4)
    rows = T.residual_scores(df, "k", "text", least).collect()
    got = {(r.record_key, r.term): (r.n, r.n_records, r.score) for r in rows}
    want = brute(ROWS, least)
    assert len(rows) == len(want) and set(got) == set(want)
    for k in want:
        assert got[k] == pytest.approx(want[k])


def test_common_terms_count_little(spark):
    rows = [(f"r{i}", "the of and " * 3 + f"word{i} word{i}", 1) for i in range(50)]
    got = {(r.record_key, r.term): r.score for r in T.residual_scores(spark.createDataFrame(rows, "k string, text string, n int"), "k", "text").collect()}
    assert got["r1", "word1"] > 5 > 1 > abs(got["r1", "the"])


def test_one_record_and_none(spark):
    one = spark.createDataFrame([("a", "x x y", 1)], "k string, text string, n int")
    assert {r.score for r in T.residual_scores(one, "k", "text").collect()} == {0.0}
    assert T.residual_scores(one.limit(0), "k", "text").count() == 0


def test_every_text_is_tokenised_once(spark, monkeypatch):
    calls, kept = [], T.kept
    monkeypatch.setattr(T, "kept", lambda df: calls.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df))
    df = spark.createDataFrame(ROWS, "k string, text string, term int")
    plan = T.residual_scores(df, "k", "text", 3)._jdf.queryExecution().toString()
    assert len(calls) == 1 and calls[0].count("Exchange") == 1 and "SortAggregate" not in calls[0] and "regexp_extract_all" not in plan
