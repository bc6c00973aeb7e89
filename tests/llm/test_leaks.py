import random

import pytest

from lamina.llm import leaks as L


def brute(docs, items, n):
    out = {}
    for d, t in docs:
        w = L.words(t)
        for k, x in items:
            v = L.words(x)
            best = 0
            for i in range(len(w)):
                for j in range(len(v)):
                    k2 = 0
                    while i + k2 < len(w) and j + k2 < len(v) and w[i + k2] == v[j + k2]:
                        k2 += 1
                    best = max(best, k2)
            if best >= n and d is not None:
                out[d, k] = max(best, out.get((d, k), 0))
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 5, 12])
def test_against_brute_force(spark, n):
    rnd = random.Random(n)
    docs = [(d, " ".join(rnd.choices(["A", "b,", "с", "d\n", "oov"], k=rnd.randrange(0, 40)))) for d in range(30)] + [(100, None), (101, ""), (102, " ")]
    items = [(k, " ".join(rnd.choices(["a", "B", "c", "Ｄ"], k=rnd.randrange(0, 30)))) for k in range(8)] + [(50, None), (51, "")]
    dd = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, item_id int").repartition(4)
    di = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    for shard, block in ((10**6, 10**6), (60, 20)):
        rows = L.verbatim_matches(dd, "doc_id", "text", di, "item_id", "text", n, shard, block).collect()
        got = {(r.doc_id, r.item_id): r.n_words for r in rows}
        assert len(rows) == len(got) and got == brute(docs, items, n)
        for r in rows:
            w, v = L.words(dict(docs)[r.doc_id]), L.words(dict(items)[r.item_id])
            assert w[r.doc_word : r.doc_word + r.n_words] == v[r.item_word : r.item_word + r.n_words]


def test_twelve_words_in_odd_characters(spark):
    text = " ".join(f"word{i} Vater" for i in range(6))
    odd = text.upper().replace("A", "А").replace(" ", " ,\n").replace("O", "O​")
    docs = spark.createDataFrame([(1, f"before {odd} after"), (2, " ".join(text.split()[:11]))], "doc_id long, text string")
    items = spark.createDataFrame([(5, "x " + text)], "item_id long, text string")
    found = L.verbatim_matches(docs, "doc_id", "text", items, "item_id", "text")
    assert [tuple(r) for r in found.collect()] == [(1, 5, 12, 1, 1)]
    assert [r.doc_id for r in L.remove_affected(docs, "doc_id", found).collect()] == [2]


def test_letters_alike_in_the_other_case_only(spark):
    text = "the old {} near the river was dark and {} miles around there were trees".format
    docs = spark.createDataFrame([(1, text("cave", "nine")), (2, text("cane", "nine")), (3, text("cave", "vine").upper()), (4, text("ϲаνe", "ΝІΝЕ"))], "doc_id long, text string")
    items = spark.createDataFrame([(5, text("cave", "nine"))], "item_id long, text string")
    for least, want in ((13, [(1, 15), (4, 15)]), (4, [(1, 15), (2, 12), (3, 9), (4, 15)])):
        rows = L.verbatim_matches(docs, "doc_id", "text", items, "item_id", "text", least).collect()
        assert sorted((r.doc_id, r.n_words) for r in rows) == want


def brute_words(doc, item):
    best, run = 0, [0] * (len(doc) + 1)
    for w in item:
        run = [0, *(run[i] + 1 if x == w else 0 for i, x in enumerate(doc))]
        best = max(best, *run)
    return best


def test_streams_against_brute_force():
    rnd = random.Random(8)
    for n in (1, 2, 3, 6):
        for size in (2, 3, 9):
            docs = [[rnd.randrange(size + 1) for _ in range(rnd.randrange(60))] for _ in range(12)]
            items = [[rnd.randrange(1, size + 1) for _ in range(rnd.randrange(40))] for _ in range(6)]
            found = L.longest_matches(L.Stream.of(docs, n), L.Stream.of(items, n), n)
            want = {(d, i): m for d, x in enumerate(docs) for i, y in enumerate(items) if (m := brute_words([w or -1 for w in x], y)) >= n}
            assert {(d, i): m for d, i, m, *_ in found.tolist()} == want
            assert all(docs[d][p : p + m] == items[i][q : q + m] for d, i, m, p, q in found.tolist())


@pytest.mark.parametrize("words", [["a"], ["a", "b"], ["a", "a", "b", "a", "c"]])
def test_repetition_stays_cheap(words):
    import time
    import tracemalloc

    doc, item = words * (40_000 // len(words)), words * (1000 // len(words))
    number = {w: i + 1 for i, w in enumerate(words)}
    tracemalloc.start()
    began = time.perf_counter()
    found = L.longest_matches(L.Stream.of([[number[w] for w in doc]], 12), L.Stream.of([[number[w] for w in item]], 12), 12)
    seconds, peak = time.perf_counter() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    [[d, i, n, p, q]] = found.tolist()
    assert (d, i, n, q) == (0, 0, len(item), 0) and doc[p : p + n] == item and seconds < 2 and peak < 300 << 20


def test_many_copies_of_one_text(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(d, f"x{d} {text} y{d}") for d in range(3000)], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(i, text) for i in range(4)], "item_id long, text string")
    rows = L.verbatim_matches(docs, "doc_id", "text", items, "item_id", "text").collect()
    assert len(rows) == 12_000 and {(r.n_words, r.doc_word, r.item_word) for r in rows} == {(30, 1, 0)}


def test_both_keys_of_one_name(spark):
    df = spark.createDataFrame([(1, "a b c", "x")], "id long, text string, t string")
    assert L.verbatim_matches(df, "id", "text", df, "id", "text", 2).columns[:2] == ["id", "item_id"]
    assert L.verbatim_matches(df, "id", "text", df, "id", "text", 2).count() == 1


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    for d, i in ((docs.limit(0), items), (docs, items.limit(0))):
        assert L.verbatim_matches(d, "doc_id", "text", i, "item_id", "text", 2).count() == 0
