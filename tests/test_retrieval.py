"""Operators on small datasets with known results."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.functions import text as T
from lamina.functions import vectors as V
from lamina.operators import bm25, candidates, dense, fusion, hashing, judgements, metrics
from lamina.operators.encoders import HashingEncoder, encode_items
from lamina.operators.ranking import pad_to_k, ranked
from lamina.sources import dataset as D

RANKING = "query_id string, item_id string, score double, rank int"


def ids(df, q="q1"):
    return [r.item_id for r in sorted(df.where(F.col("query_id") == q).collect(), key=lambda r: r["rank"])]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def ds(spark):
    return D.synthetic(spark)


def test_global_bm25_with_padding(spark, ds):
    items = D.document_texts(ds.documents)
    hits = pad_to_k(ranked(bm25.scores(ds.queries, items), ["query_id"], 2), ds.queries, "query_id", items, 2)
    rows = {(r.query_id, r["rank"]): (r.item_id, round(r.score, 6)) for r in ranked(hits, ["query_id"], 2).collect()}
    assert rows == {("q1", 1): ("d1", 3.13364), ("q1", 2): ("d2", 0.0), ("q2", 1): ("d3", 3.5884), ("q2", 2): ("d1", 0.0)}


def test_global_bm25_of_passages(spark, ds):
    hits = ranked(bm25.scores(ds.queries, D.passage_texts(ds.passages)), ["query_id"], 3)
    assert [(r.item_id, round(r.score, 6)) for r in hits.where("query_id = 'q1'").orderBy("rank").collect()] == [("p1", 3.365164), ("p2", 2.256893), ("p3", 0.366373)]


def test_candidate_bm25(spark):
    items = frame(spark, [("p1", "red apple"), ("p2", "green apple"), ("p3", "yellow banana")], "item_id string, text string")
    q = frame(spark, [("q1", "apple apple")], "query_id string, text string")
    pairs = frame(spark, [("q1", p) for p in ("p1", "p2", "p3", "p3", "none")], "query_id string, item_id string")
    got = {r.item_id: r.score for r in bm25.candidate_scores(q, items, pairs).collect()}
    assert got == pytest.approx({"p1": 0.47000362924573563, "p2": 0.47000362924573563})
    only = frame(spark, [("q1", "p3")], "query_id string, item_id string")
    assert bm25.candidate_scores(q, items, only).count() == 0


def test_full_text_bm25_floor_and_phrases(spark):
    items = frame(spark, [("d1", "Alpha\napple orchard"), ("d2", "Beta\nbanana grove"), ("d3", "x_y plain"), ("d4", "y x"), ("d5", None), ("d6", "")], "item_id string, text string")
    two = items.where("item_id IN ('d1', 'd2')")
    q = frame(spark, [("q1", "apple")], "query_id string, text string")
    assert [(r.item_id, r.score) for r in bm25.scores(q, two, bm25.FTS).collect()] == [("d1", pytest.approx(1e-6))]
    phrase = frame(spark, [("q1", "x_y")], "query_id string, text string")
    assert [r.item_id for r in bm25.scores(phrase, items, bm25.FTS).collect()] == ["d3"]


def brute_bm25(items, query, k1=1.5):
    import re

    tok = {i: re.findall(r"[^\W]{2,}", (t or "").lower()) for i, t in items}
    n, avg = len(tok), sum(map(len, tok.values())) / len(tok) or 1.0
    out = {}
    for w in re.findall(r"[^\W]{2,}", query.lower()):
        df = sum(w in t for t in tok.values())
        for i, t in tok.items():
            if tf := t.count(w):
                out[i] = out.get(i, 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (0.25 + 0.75 * len(t) / avg))
    return out


def test_bm25_against_brute_force(spark):
    rnd = random.Random(3)
    items = [(f"i{n}", " ".join(rnd.choices(["aa", "bb", "cc", "dd", "éé", "x", "10"], k=rnd.randrange(0, 12))) or None) for n in range(40)]
    q = [(f"q{n}", " ".join(rnd.choices(["aa", "bb", "éé", "zz"], k=3))) for n in range(5)] + [("q9", None), ("q8", "")]
    got = {}
    for r in bm25.scores(frame(spark, q, "query_id string, text string"), frame(spark, items, "item_id string, text string")).collect():
        got.setdefault(r.query_id, {})[r.item_id] = r.score
    for qid, text in q:
        assert got.get(qid, {}) == pytest.approx(brute_bm25(items, text or ""))


def test_empty_collection(spark):
    none = frame(spark, [], "item_id string, text string")
    q = frame(spark, [("q1", "apple")], "query_id string, text string")
    assert bm25.scores(q, none).count() == 0
    assert pad_to_k(frame(spark, [], "query_id string, item_id string, score double"), q, "query_id", none, 5).count() == 0


def test_fusion(spark):
    a = frame(spark, [("q1", "a", 1.0, 1), ("q1", "b", 0.5, 2)], RANKING)
    b = frame(spark, [("q1", "b", 1.0, 1), ("q1", "c", 0.5, 2)], RANKING)
    assert ids(fusion.interleave([a, b], 3)) == ["a", "b", "c"]
    got = {r.item_id: r.score for r in fusion.reciprocal_rank_fusion([a, b], 3, 1).collect()}
    assert got == pytest.approx({"b": 0.8333333333333333, "a": 0.5, "c": 0.3333333333333333})
    with pytest.raises(ValueError):
        fusion.fuse([a], "sum", 3)


def test_fusion_against_brute_force(spark):
    rnd = random.Random(5)
    lists = [[(f"q{q}", i, rnd.random(), n) for q in range(3) for n, i in enumerate(rnd.sample("abcdefgh", 5), 1)] for _ in range(3)]
    frames = [frame(spark, x, RANKING) for x in lists]
    for q in ("q0", "q1", "q2"):
        score, first, n = {}, {}, 0
        for place in range(1, 6):
            for x in lists:
                i = next(r[1] for r in x if r[0] == q and r[3] == place)
                score[i] = score.get(i, 0) + 1 / (60 + place)
                first.setdefault(i, n := n + 1)
        assert ids(fusion.reciprocal_rank_fusion(frames, 6), q) == sorted(score, key=lambda i: (-round(score[i], 9), i))[:6]
        assert ids(fusion.interleave(frames, 6), q) == sorted(first, key=first.get)[:6]


def test_metrics(spark):
    rel = frame(spark, [("q1", "p1", 2.0), ("q1", "p2", 1.0), ("q3", "p1", 1.0)], "query_id string, item_id string, relevance double")
    runs = frame(spark, [("q1",), ("q2",), ("q3",)], "query_id string")
    rank = frame(spark, [("q1", "p2", 2.0, 1), ("q1", "p1", 1.0, 2), ("q2", "p1", 1.0, 1), ("q3", "x", 1.0, 1), ("q3", "p1", 1.0, 2)], RANKING)
    got = {r.query_id: r.ndcg for r in metrics.ndcg_at_k(rank, rel, 2, runs).collect()}
    assert got == pytest.approx({"q1": 0.7967075809905066, "q2": 0.0, "q3": 0.6309297535714575})
    recall = {r.query_id: r.recall for r in metrics.recall_at_k(rank, rel, 1, runs).collect()}
    assert recall == {"q1": 0.5, "q2": 0.0, "q3": 0.0}


def test_grouped_and_mean(spark):
    per = frame(spark, [("e", "q1", 1.0), ("e", "q2", 0.0)], "experiment string, query_id string, `m@1` double")
    cats = frame(spark, [("q1", ["x", "x", None]), ("q2", ["x"]), ("q3", ["y"]), ("q4", None)], "query_id string, categories array<string>")
    assert [tuple(r) for r in metrics.grouped_metrics(per, cats).collect()] == [("x", pytest.approx(2 / 3), 3)]
    assert [tuple(r) for r in metrics.mean_metrics(per, ["experiment"]).collect()] == [("e", 0.5, 2.0)]


def test_hashing_encoder_golden():
    e = HashingEncoder(512)
    assert [e.bucket(w) for w in ("capital", "france", "paris", "ocean")] == [(312, -1.0), (379, -1.0), (401, -1.0), (213, 1.0)]
    small = HashingEncoder(64)
    v = small.encode(["capital paris france", "mars phobos", "ocean", "capital france", ""])
    assert v[:3] @ v[3] == pytest.approx([0.816497, 0, 0], abs=1e-6)
    assert not v[4].any()


def test_dense_search_ties_blocks_and_candidates(spark, monkeypatch):
    rng = np.random.default_rng(1)
    items = [(f"i{n:02}", [float(x) for x in rng.integers(-2, 3, 4)]) for n in range(60)] + [("none", None)]
    asked = [(f"q{n}", [float(x) for x in rng.integers(-2, 3, 4)]) for n in range(7)]
    di, dq = frame(spark, items, "item_id string, embedding array<float>"), frame(spark, asked, "query_id string, embedding array<float>")
    monkeypatch.setattr(dense, "BLOCK_BYTES", 48)
    got = dense.search(dq, di.repartition(5), 9, 4)
    for q, v in asked:
        want = sorted((-float(np.dot(v, x)), i) for i, x in items if x)[:9]
        assert ids(got, q) == [i for _, i in want]
    pairs = frame(spark, [(q, i) for q, _ in asked for i in ("i01", "i02", "i03", "zzz")], "query_id string, item_id string")
    few = dense.candidate_search(pairs, dq, di, 2)
    for q, v in asked:
        want = sorted((-float(np.dot(v, x)), i) for i, x in items if i in ("i01", "i02", "i03"))[:2]
        assert ids(few, q) == [i for _, i in want]
    assert dense.search(dq, di, 0, 4).count() == 0
    assert dense.search(dq.limit(0), di, 3, 4).count() == 0


def test_candidate_texts_keep_zero_scores(spark):
    items = frame(spark, [("a", "capital paris france"), ("b", "mars phobos"), ("c", "ocean")], "item_id string, text string")
    q = frame(spark, [("q1", "capital france")], "query_id string, text string")
    pairs = frame(spark, [("q1", "a"), ("q1", "c"), ("q1", "a")], "query_id string, item_id string")
    e = HashingEncoder(64)
    assert ids(dense.candidate_text_search(pairs, q, items, e, e, 5)) == ["a", "c"]


def test_sparse_hash_vectors_are_unit(spark):
    items = frame(spark, [("a", "one two two"), ("b", None), ("c", "")], "item_id string, text string")
    v = hashing.hash_vectors(items, 64)
    assert v.groupBy("item_id").agg(F.round(F.sum(F.col("value") ** 2), 9).alias("s")).collect() == [("a", 1.0)]
    assert [len(r.embedding) for r in hashing.dense_vectors(v, 64).collect()] == [64]
    got = hashing.search(frame(spark, [("q", "two one two"), ("none", "")], "query_id string, text string"), items, 3, 64).collect()
    assert [(r.query_id, r.item_id, r["rank"]) for r in got] == [("q", "a", 1)] and got[0].score == pytest.approx(1.0, abs=1e-6)


def test_folded_words_of_ascii_and_other_texts_agree(spark):
    texts = ["The cat_SAT on 42 mats", "İstanbul cafe\u0301 ﬁn", "", None, "tab\tline\nend\n", "ﬁ", "K2", "½ a"]
    got = frame(spark, [(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.folded_words("t").alias("w")).collect()
    assert {r.i: r.w for r in got} == {i: T._FOLDED.findall(T.fold(t)) if t else [] for i, t in enumerate(texts)}


def test_judgements(spark):
    rows = frame(spark, [("q", "p", 2.0, "a", 1), ("q", "p", 1.0, None, 2)], "query_id string, passage_id string, score double, metadata string, seq long")
    assert judgements.upsert(rows).collect() == [("q", "p", 2.0, None)]
    assert judgements.last_wins(rows).collect() == [("q", "p", 1.0)]


def test_texts(spark):
    rows = frame(spark, [("  a Ünï-foo_bar x 42 　", "straße Ǆé"), (None, None), ("", "")], "a string, b string")
    got = rows.select(T.strip(F.col("a")), T.words(F.col("a")), T.folded_words("a"), T.folded_words("b"), T.index_words(F.col("b")), T.query_phrases(F.col("a"))).collect()
    assert tuple(got[0]) == ("a Ünï-foo_bar x 42", ["ünï", "foo_bar", "42"], ["a", "uni", "foo", "bar", "x", "42"], ["strasse", "dze"], ["straße", "ǆe"], ["a", "uni", "foo bar", "x", "42"])
    assert tuple(got[1]) == (None, [], [], [], [], [])


def test_documents_from_passages_and_strategies(spark):
    ds = D.from_rows(spark, [("d1", "T", "B"), ("d2", None, None)], [("p1", "d1", "x", "two", None), ("p2", "d1", "y", "one", 0), ("p3", "d1", "z", None, 5)], [], [])
    assert [tuple(r) for r in D.documents_from_passages(ds.passages).collect()] == [("d1", "y", "one\n\ntwo", 0)]
    text = lambda s, **k: {r.item_id: r.text for r in D.document_texts(ds.documents, ds.passages, s, **k).collect()}
    assert text("title_body") == {"d1": "T\nB", "d2": ""} and text("title") == {"d1": "T", "d2": ""} and text("body") == {"d1": "B", "d2": ""}
    with pytest.raises(Exception, match="no passages"):
        text("title_passages")
    only = D.document_texts(ds.documents.where("doc_id = 'd1'"), ds.passages, "title_passages", 1).collect()
    assert only[0].text == "T\none"
    with pytest.raises(ValueError):
        text("other")


def test_candidates_and_audit(spark, ds):
    docs = frame(spark, [("q1", "d1", 1.0, 2), ("q1", "d1", 1.0, 1), ("q1", "d9", 1.0, 3), ("q2", "d2", 1.0, 1)], RANKING)
    pairs = candidates.expand_to_passages(docs, ds.passages)
    assert sorted((r.query_id, r.item_id, r.doc_rank) for r in pairs.collect()) == [("q1", "p1", 1), ("q1", "p2", 1), ("q2", "p3", 1)]
    audit = candidates.candidate_audit(pairs.withColumn("document_method", F.lit("sparse")), ds.passages.agg(F.count("*")))
    assert sorted(map(tuple, audit.collect())) == [("all", 2, 3, 25.0), ("sparse", 2, 3, 25.0)]
    assert [r.item_id for r in candidates.candidate_order(pairs.where("query_id = 'q1'")).orderBy("place").collect()] == ["p1", "p2"]


def test_vector_functions(spark):
    df = frame(spark, [([3.0, 4.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [tuple(r) for r in df.select(V.dot(F.col("a"), F.col("b")), V.norm(F.col("a"))).collect()] == [(11.0, 5.0), (0.0, 0.0)]
    assert df.select(V.unit(F.col("a"))).collect()[0][0] == pytest.approx([0.6, 0.8])


def test_encode_items_nulls(spark):
    got = encode_items(frame(spark, [("a", None), ("b", "word word")], "item_id string, text string"), HashingEncoder(8)).collect()
    assert {r.item_id: round(sum(x * x for x in r.embedding), 6) for r in got} == {"a": 0.0, "b": 1.0}


def test_numbered_across_partitions(spark):
    from lamina.operators.ranking import numbered

    rows = [("hot", n % 7, n) for n in range(3000)] + [(f"g{n % 9}", n % 3, n) for n in range(100)] + [(None, n % 4, n) for n in range(50)]
    got = numbered(frame(spark, rows, "g string, v int, n int").repartition(5), ["g"], [F.col("v").desc(), F.col("n").asc()]).collect()
    for g in {r[0] for r in rows}:
        own = sorted((-v, n) for h, v, n in rows if h == g)
        assert [(-r.v, r.n) for r in sorted((r for r in got if r.g == g), key=lambda r: r["rank"])] == own
        assert sorted(r["rank"] for r in got if r.g == g) == list(range(1, len(own) + 1))
    assert numbered(frame(spark, [], "g string, v int, n int"), ["g"], [F.col("v").asc()]).count() == 0


def test_best_k_against_sorting():
    from lamina.operators.topk import BestK

    rng = np.random.default_rng(2)
    for positive in (False, True):
        best, all_ = BestK(5, 4, positive), [[] for _ in range(5)]
        names = rng.permutation([f"i{n}" for n in range(60)]).astype(object)
        for part in range(0, 60, 13):
            ids = names[part : part + 13]
            scores = rng.integers(-3, 4, (5, len(ids))) / 2
            best.add(ids, scores)
            for q in range(5):
                all_[q] += list(zip(-scores[q], ids))
        row, score, ids = best.result()
        for q in range(5):
            want = sorted(x for x in all_[q] if not positive or -x[0] > 0)[:4]
            assert list(zip(-score[row == q], ids[row == q])) == want


def test_bm25_search_equals_scores_in_blocks(spark, monkeypatch):
    rnd = random.Random(9)
    items = frame(spark, [(f"i{n:03}", " ".join(rnd.choices(["aa", "bb", "cc", "dd", "ee_ff", "ee", "ff"], k=rnd.randrange(0, 9))) or None) for n in range(90)] + [(None, "aa")], "item_id string, text string").repartition(3)
    q = frame(spark, [(f"q{n}", " ".join(rnd.choices(["aa", "bb", "ee_ff", "zz"], k=3))) for n in range(7)], "query_id string, text string")
    monkeypatch.setattr(bm25, "BLOCK_TERMS", 4)
    monkeypatch.setattr(bm25, "QUERY_ROWS", 2)
    monkeypatch.setattr(bm25, "ITEM_ROWS", 16)
    key = lambda r: (r.query_id, r.item_id, r["rank"], round(r.score, 9))
    for profile in (bm25.GLOBAL, bm25.FTS):
        want = ranked(bm25.scores(q, items.where("item_id IS NOT NULL"), profile), ["query_id"], 5)
        assert sorted(map(key, bm25.search(q, items, 5, profile).collect())) == sorted(map(key, want.collect()))
    assert bm25.search(q, items, 0).count() == 0 and bm25.search(q.limit(0), items, 3).count() == 0 and bm25.search(q, items.limit(0), 3).count() == 0


def test_salted_join(spark):
    from lamina.operators.skew import salted_join

    many = frame(spark, [("hot", n) for n in range(200)] + [("cold", 1), ("none", 2)], "k string, n int")
    few = frame(spark, [("hot", "x"), ("cold", "y"), ("cold", "z")], "k string, v string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert sorted(map(str, salted_join(many, few, ["k"], ["n"], how).collect())) == sorted(map(str, many.join(few, "k", how).collect()))


def test_written_index(spark, tmp_path):
    items = frame(spark, [("a", "red apple"), ("b", "green apple pie"), ("c", None)], "item_id string, text string")
    q = frame(spark, [("q1", "apple pie"), ("q2", "x_y")], "query_id string, text string")
    bm25.write_index(items, f"{tmp_path}/i", bm25.FTS)
    assert bm25.search_index(q, f"{tmp_path}/i", bm25.FTS) is None  # a phrase
    one = q.where("query_id = 'q1'")
    got = {r.item_id: r.score for r in bm25.search_index(one, f"{tmp_path}/i", bm25.FTS).collect()}
    assert got == pytest.approx({r.item_id: r.score for r in bm25.scores(one, items, bm25.FTS).collect()})


def test_best_keeps_only_what_reaches_the_limit():
    from lamina.operators.topk import BestK

    best, ids = BestK(3, 4), np.array([f"i{n:03d}" for n in range(200)], dtype=object)
    best.add(ids, np.tile(np.arange(200.0), (3, 1)))
    before = best.waiting
    best.add(np.array([f"j{n:03d}" for n in range(200)], dtype=object), np.tile(np.arange(200.0) - 500, (3, 1)))
    assert best.waiting == before and best.result()[2].tolist() == ["i199", "i198", "i197", "i196"] * 3


def test_few_entries_need_few_blocks(spark, monkeypatch):
    """Vectors of hashed words go out by their entries, so items are read and encoded once for many queries."""
    vectors = np.eye(512, dtype=np.float32)[:40]
    asked = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(vectors)], "query_id string, embedding array<float>")
    monkeypatch.setattr(dense, "BLOCK_BYTES", 8 * 512)
    assert len(list(dense._blocks(asked, 512, 20))) == 1
    items = spark.createDataFrame([(f"i{i:02d}", v.tolist()) for i, v in enumerate(vectors)], "item_id string, embedding array<float>")
    assert {r.query_id: r.item_id for r in dense.search(asked, items, 1, 512).collect()} == {f"q{i}": f"i{i:02d}" for i in range(40)}


def test_candidate_scores_over_batches_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(12)]
    text = lambda n: " ".join(rng.choice(words, n))
    q = spark.createDataFrame([(f"q{i}", text(4)) for i in range(9)] + [("none", "")], "query_id string, text string")
    items = spark.createDataFrame([(f"i{i:02d}", text(int(rng.integers(0, 9)))) for i in range(30)], "item_id string, text string")
    rows = [(m, f"q{i}", f"i{int(j):02d}") for m in ("a", "b") for i in range(9) for j in rng.choice(33, 12)] + [("a", "none", "i01")]
    pairs, groups = spark.createDataFrame(rows, "method string, query_id string, item_id string"), ["method", "query_id"]
    want = {}
    asked, texts = {r.query_id: set(r.text.split()) for r in q.collect()}, {r.item_id: r.text.split() for r in items.collect()}
    for g in {r[:2] for r in rows}:
        own = sorted({r[2] for r in rows if r[:2] == g and r[2] in texts})
        mean = sum(len(texts[i]) for i in own) / len(own) or 1.0
        for i in own:
            score = 0.0
            for t in asked[g[1]]:
                df, tf = sum(t in texts[o] for o in own), texts[i].count(t)
                score += math.log1p((len(own) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(texts[i]) / mean))
            if score > 0:
                want[*g, i] = round(score, 9)
    monkeypatch.setattr(bm25, "BLOCK_TERMS", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = bm25.candidate_scores(q, items, pairs, groups).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(want) and {(r.method, r.query_id, r.item_id): round(r.score, 9) for r in got} == want


def test_best_of_index_makes_no_rows_of_other_scores(spark, tmp_path, monkeypatch):
    rnd = random.Random(4)
    items = frame(spark, [(f"i{n:03}", " ".join(rnd.choices(["aa", "bb", "cc", "dd", "ee"], k=rnd.randrange(0, 9))) or None) for n in range(90)], "item_id string, text string").repartition(3)
    q = frame(spark, [(f"q{n}", " ".join(rnd.choices(["aa", "bb", "zz"], k=3))) for n in range(7)], "query_id string, text string")
    bm25.write_index(items, f"{tmp_path}/i", bm25.FTS)
    monkeypatch.setattr(bm25, "BLOCK_TERMS", 4)
    monkeypatch.setattr(bm25, "ITEM_ROWS", 16)
    key = lambda r: (r.query_id, r.item_id, r["rank"], round(r.score, 9))
    want = sorted(map(key, ranked(bm25.scores(q, items, bm25.FTS), ["query_id"], 5).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(map(key, bm25.best_of_index(q, f"{tmp_path}/i", 5, bm25.FTS).collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert bm25.best_of_index(frame(spark, [("p", "x_y")], "query_id string, text string"), f"{tmp_path}/i", 5, bm25.FTS) is None
    assert bm25.best_of_index(q, f"{tmp_path}/i", 0, bm25.FTS).count() == 0
