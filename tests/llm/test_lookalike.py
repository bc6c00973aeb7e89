import itertools
import unicodedata

from pyspark.sql import functions as F

from lamina.llm import lookalike as L
from lamina.llm.fold import caseless_fold, folding, is_blank, visual_fold

SAME = [
    ("Notes", "Nоtes"), ("Notes", "Ｎｏｔｅｓ"), ("Notes", "No​tes"), ("Notes", "No­tes﻿"), ("a b", "a b"), ("a b", "a　b"),
    ("é", "é"), ("ẹ́", "ẹ́"), ("ﬁn", "fin"), ("ﬆ", "st"), ("ガ", "ｶﾞ"), ("over", "oνer"), ("Ëla", "Ёla"), ("ab", "a\x07b"), ("A", "Α"),
]
DIFFERENT = [("Notes", "notes"), ("é", "e"), ("a b", "ab"), ("a  b", "a b"), ("2", "²"), ("rn", "m"), ("l", "1"), ("a-b", "a–b"), ("½", "1/2"), ("a\nb", "a b")]


def test_visual_fold():
    for a, b in SAME:
        assert visual_fold(a) == visual_fold(b), (a, b)
    for a, b in DIFFERENT:
        assert visual_fold(a) != visual_fold(b), (a, b)
    assert visual_fold(None) is None and visual_fold("") == ""
    for a, b in SAME:
        assert visual_fold(visual_fold(b)) == visual_fold(b)


def test_caseless_fold():
    for w in ("Straße", "ΝΕΡΌ", "Новый", "Victoria", "Ёлка", "ﬁn", "Őr", "σύνορος", "ΐ"):
        assert caseless_fold(w) == caseless_fold(w.upper()) == caseless_fold(w.lower()), w
    assert caseless_fold("Нat") == caseless_fold("hat") and caseless_fold(None) is None
    assert caseless_fold("cafe") != caseless_fold("café")
    assert is_blank(" ​ ") and is_blank(None) and not is_blank("a")


def test_letters_of_many_scripts():
    for odd, plain in zip("օոᎪꓮɑɡᴏ𝐚ιυӏԝԚϲЅ", "onAAagoaiulwQcS"):
        assert visual_fold(f"x{odd}x") == f"x{plain}x", odd
    # one letter of a script only, letters of one script, digits, signs and bent letters stay apart
    for a, b in (("σ", "ο"), ("ѡ", "ԝ"), ("ı", "i"), ("þ", "p"), ("ſ", "f"), ("l", "I"), ("0", "O"), ("m", "rn"), ("\u2010", "-"), ("ه", "o"), ("०", "o")):
        assert visual_fold(a) != visual_fold(b), (a, b)
    letters = [chr(c) for c in range(0x250, 0x530) if chr(c).isalpha() and unicodedata.normalize("NFKD", chr(c)) == chr(c)]
    for block in (range(0x370, 0x400), range(0x400, 0x530)):
        own = [c for c in letters if ord(c) in block and c != "Ү"]
        assert len({visual_fold(c) for c in own}) == len(own)


def test_same_word():
    f = folding()
    for a, b in (("Nοtes", "notes"), ("ΝΕΡΌ", "νερό"), ("ΝΕΡΟ", "nepo"), ("Straße", "STRASSE"), ("οver", "OVER"), ("ΣΎΝΟΡΟΣ", "σύνορος"), ("Ёлка", "ЁЛКА"), ("ոս", "ՈՍ")):
        assert f.same_word(a, b) and f.coarse(a) == f.coarse(b), (a, b)
    for a, b in (("cave", "cane"), ("nine", "vine"), ("νine", "nine"), ("cafe", "café"), ("да", "то")):
        assert not f.same_word(a, b), (a, b)


def test_fast_and_slow_fold_agree():
    f = folding()
    text = [chr(c) for c in range(0x3000) if unicodedata.category(chr(c)) not in ("Cn", "Cs")]
    for c in text:
        for w in (c, f"a{c}ο", f"e{c}{c}́"):
            assert f.visual(w) == f._visual_slowly(w) and f.coarse(w) == f._coarse_slowly(w.replace("ß", "ss")), ascii(w)


def frame(spark, rows):
    return spark.createDataFrame(rows, "table_name string, record_key string, text string")


def brute(rows):
    out = set()
    for (t, k, x), (u, j, y) in itertools.product(rows, rows):
        if t == u and k is not None and j is not None and k < j and x != y and x and y and not is_blank(x) and not is_blank(y) and visual_fold(x) == visual_fold(y):
            out.add((t, k, j))
    return out


def test_pairs_against_brute_force(spark):
    texts = [x for pair in SAME + DIFFERENT for x in pair] + [None, "", " ", "​", " ", "Notes", "Notes"]
    rows = [("t", f"k{i:03}", x) for i, x in enumerate(texts)] + [("u", "k000", "Nоtes"), ("u", "k001", "Notes"), ("u", "k001", "Notes"), ("t", None, "Nоtes")]
    rows += [("v", f"m{i:03}", "hot") for i in range(200)] + [("v", "m900", "hоt"), ("v", "m901", "ｈot")]
    long = "é " * 20_000
    rows += [("w", "a", long), ("w", "b", unicodedata.normalize("NFD", long))]
    got = [tuple(r) for r in L.look_alike_pairs(frame(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_canonical_member(spark):
    rows = [("t", "1", "Nоtes"), ("t", "2", "Notes"), ("t", "3", None), ("t", "4", "​"), ("t", "5", "ａ"), ("t", "6", "а"), ("t", "6", "а"), ("t", "7", "Ю")]
    got = {r.record_key: r.canonical_text for r in L.canonical_texts(frame(spark, rows)).collect()}
    assert got == {"1": "Notes", "2": "Notes", "3": None, "4": "​", "5": "а", "6": "а", "7": "Ю"}


def test_empty_and_extra_columns(spark):
    assert L.look_alike_pairs(frame(spark, [])).count() == 0 and L.canonical_texts(frame(spark, [])).count() == 0
    odd = spark.createDataFrame([(1, "Nоtes", "x"), (2, "Notes", "y")], "id long, text string, shape string").withColumnRenamed("shape", "canonical")
    assert [tuple(r) for r in L.look_alike_pairs(L.records(odd, "t", "id", "text")).collect()] == [("t", "1", "2")]


def test_hot_class_and_hot_text_in_bounded_tasks(spark, monkeypatch):
    monkeypatch.setattr(L, "SALT_ROWS", 7)
    rows = [("t", f"k{i:03}", "hot") for i in range(90)] + [("t", f"m{i:03}", "hоt" + "\u200b" * i) for i in range(40)] + [("t", "k001", "hоt")]
    got = [tuple(r) for r in L.look_alike_pairs(frame(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == {(t, *sorted((k, j))) for t, k, j in brute(rows) | {(t, j, k) for t, k, j in brute(rows)}}


def test_membership_of_many_spellings(spark):
    n = 50_000
    odd = F.expr("concat('w', repeat('\u200b', cast(id % 250 as int)), 'о', repeat('\u00ad', cast(id div 250 as int)), 'd')")
    recs = spark.range(n).select(F.lit("t").alias("table_name"), F.format_string("k%06d", "id").alias("record_key"), odd.alias("text"))
    recs = recs.unionByName(frame(spark, [("t", "z1", "wod"), ("t", "z2", "wod"), ("t", "z3", "wood"), ("u", "z1", "wod")]))
    got = L.look_alike_membership(recs)
    rows = {r.record_key: r.n_links for r in got.where("record_key IN ('k000000', 'z1', 'z2', 'z3')").collect()}
    assert rows == {"k000000": n + 1, "z1": n, "z2": n} and got.count() == n + 2
    assert got.select("table_name", "class_id").distinct().count() == 1


def test_every_text_is_mapped_once(spark, monkeypatch):
    calls, mapped = [], L.mapped
    monkeypatch.setattr(L, "mapped", lambda r: calls.append(1) or mapped(r))
    for product in (L.look_alike_pairs, L.canonical_texts, L.look_alike_membership):
        calls.clear()
        plan = product(frame(spark, [("t", "1", "Nоtes"), ("t", "2", "Notes")]))._jdf.queryExecution().toString()
        assert len(calls) == 1 and "ArrowEvalPython" not in plan
