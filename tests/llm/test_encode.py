import random

import pytest

from lamina.llm import encode as E

PATH = f"{E.TOKENIZERS}/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def codec():
    return E.Codec.at(PATH)


def tree(codec, text, n):
    parts = [text[i * len(text) // n : (i + 1) * len(text) // n] for i in range(n)]
    return E.join_tree(codec, [E.leaf(codec, p) for p in parts]).ids


def test_joins_are_exact(codec):
    rnd = random.Random(1)
    pieces = ["a", "b", " ", "  ", "'", "ll", "'ll", "\n", "é", "東", "1", "the", "'s", "re", "\t", "!", "??", "ing", "ABC", "́", "🙂", "　", "\x1c"]
    for _ in range(1500):
        text = "".join(rnd.choices(pieces, k=rnd.randrange(1, 300)))
        assert tree(codec, text, rnd.choice([2, 4, 8])) == codec.encode(text)


def test_unsplit_runs(codec):
    rnd = random.Random(2)
    for alphabet in ("abcdefghijklmnoprstu", "ab", "é日本", "0123456789", " ", "\n", "!?", "a'"):
        for _ in range(8):
            text = "".join(rnd.choices(alphabet, k=rnd.randrange(2000, 6000)))
            assert tree(codec, text, rnd.choice([2, 4, 8])) == codec.encode(text), alphabet


def test_against_the_other_library(codec):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{E.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    for text in ("", " ", "Hello  world's\n\n<|endoftext|> café", "日本語のテキスト。", " x y", "👩‍🔬"):
        assert codec.encode(text) == t.encode(text, add_special_tokens=False).ids


def test_corpus(spark, codec):
    rnd = random.Random(3)
    long = ["".join(rnd.choices("ab c\né1'", k=k)) for k in (100, 101, 399, 401, 3000)] + ["x" * 2500]
    rows = [(1, None, 1), (2, "", 1), (3, " ", 1), (4, "some text", 1), (4, "some text", 1), (None, "no key", 1), *[(10 + i, t, 1) for i, t in enumerate(long)], (10, long[4], 1), (10, long[4], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int").repartition(3)
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.ids) for r in E.encode_corpus(df, "doc_id", "text", leaf_chars=100).collect()))
    assert got == sorted((k is None, k or 0, codec.encode(t) if t else []) for k, t, _ in rows)
    assert E.encode_corpus(df.limit(0), "doc_id", "text").count() == 0


def test_depth_of_the_tree():
    assert [E.tree_depth(n, 100) for n in (0, 100, 101, 200, 201, 800)] == [0, 0, 1, 1, 2, 3]
