"""Dangling references against brute force, with every kind of dirt."""

import random
from datetime import datetime

from lamina.operators import references as R

T = "target_table string, key string, time timestamp"
REF = "ref_table string, ref_field string, ref_key string, target_table string, key string, time timestamp"
D = "target_table string, key string"


def day(n):
    return datetime(2024, 1 + n // 28, 1 + n % 28)


def brute(refs, targets, deleted):
    plain = lambda k: (k or "").strip(" ").lower() or None
    gone = {(t, plain(k)) for t, k in deleted if plain(k)}
    have = {}
    for t, k, time in targets:
        if plain(k):
            have.setdefault((t, plain(k)), []).append(time)
    out = []
    for table, field, key, target, k, time in refs:
        k = plain(k)
        if k is None:
            continue
        times = [x for x in have.get((target, k), []) if x]
        if (target, k) in gone:
            state = "deleted"
        elif (target, k) not in have:
            state = "missing"
        elif times and time and min(times) > time:
            state = "late"
        else:
            continue
        out.append((table, field, key, state, time.strftime("%Y-%m") if time else "unknown"))
    return sorted(out)


def run(spark, refs, targets, deleted):
    df = R.dangling_references(spark.createDataFrame(refs, REF), spark.createDataFrame(targets, T), spark.createDataFrame(deleted, D))
    return sorted(tuple(r) for r in df.collect())


def test_random_tables(spark):
    rnd = random.Random(7)
    keys = [None, "", "  ", *[f"{p}{n}" for p in ("q", "d7-p", "", "x0", "q00") for n in (0, 1, 2, 3, 9, 10, 65535, 65536, 65537, 10**17)], "name", "Ümlaut", "9" * 25, "0" * 20]
    dress = lambda k: k if k is None else rnd.choice([k, f" {k}", f"{k} ", k.upper()])
    for _ in range(3):
        targets = [(rnd.choice("ab"), dress(rnd.choice(keys)), rnd.choice([None, day(rnd.randrange(60))])) for _ in range(60)]
        deleted = [(rnd.choice("ab"), dress(rnd.choice(keys))) for _ in range(8)]
        refs = [("r", "f", str(i), rnd.choice("ab"), dress(rnd.choice(keys)), rnd.choice([None, day(rnd.randrange(60))])) for i in range(200)]
        refs += [("r", "f", f"hot{i}", "a", "nowhere", day(3)) for i in range(150)]
        assert run(spark, refs, targets, deleted) == brute(refs, targets, deleted)


def test_empty_tables(spark):
    ref = [("r", "f", "1", "a", "q1", day(1))]
    assert run(spark, ref, [], []) == [("r", "f", "1", "missing", "2024-01")]
    assert run(spark, [], [("a", "q1", day(1))], []) == []
    assert run(spark, ref, [], [("a", "Q1 ")]) == [("r", "f", "1", "deleted", "2024-01")]


def test_runs_compress_neighbours(spark):
    keys = spark.createDataFrame([("a", f"k{i}", False, day(1)) for i in [*range(5, 105), 200]] + [("a", "k50x", False, None)], "target_table string, key string, deleted boolean, time timestamp")
    runs = sorted((r.family, r.first, r.last) for r in R.key_runs(keys).collect())
    assert runs == [("k", 5, 104), ("k", 200, 200), ("k50x", 0, 0)]


def test_key_split_is_injective(spark):
    keys = ["q1", "q01", "q001", "q10", "1", "01", "", "q", "q-1", "7" * 30]
    df = R.split_key(spark.createDataFrame([(k,) for k in keys], "key string"))
    assert len({(r.family, r.width, r.no) for r in df.collect()}) == len(keys)


def test_report_and_delivered_tables_with_extra_columns(spark):
    docs = spark.createDataFrame([("1", day(5), "x")], "doc_id string, ingested_at timestamp, state string")
    passages = spark.createDataFrame([("p1", " 1 ", day(1), "s"), ("p1", " 1 ", day(9), "s"), ("p2", "2", day(1), "s"), ("p3", None, day(1), "s")], "passage_id string, doc_id string, ingested_at timestamp, key string")
    queries = spark.createDataFrame([("q1", day(1))], "query_id string, created_at timestamp")
    qrels = spark.createDataFrame([(1, "Q1", "p1", day(2)), (2, "q2", "p9", None)], "qrel_id long, query_id string, passage_id string, judged_at timestamp")
    gone = spark.createDataFrame([("passages", "p1")], "target_table string, target_key string")
    found = R.retrieval_references(docs, passages, queries, qrels, gone)
    assert sorted(tuple(r) for r in found.collect()) == [
        ("passages", "doc_id", "p1", "late", "2024-01"), ("passages", "doc_id", "p2", "missing", "2024-01"),
        ("qrels", "passage_id", "1", "deleted", "2024-01"), ("qrels", "passage_id", "2", "missing", "unknown"), ("qrels", "query_id", "2", "missing", "unknown"),
    ]
    assert {tuple(r) for r in R.report_by_period(found).collect()} >= {("qrels", "query_id", "unknown", "missing", 1)}
