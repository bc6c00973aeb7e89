import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.llm import language as G

WORDS = {
    "en": "the of and river with house that report station garden village market evening between weather",
    "de": "der die und das mit haus nicht bericht garten dorf markt abend zwischen wetter fluss",
    "fr": "le la et les avec maison que rapport jardin village marché soir entre temps rivière",
    "ru": "и не на что дом река отчёт сад деревня рынок вечер между погода было для",
    "ja": "これは 川と 家の 報告 です庭の 村で 市場 夕方に 天気が しました",
}


def sentence(rnd, lang, n=12):
    return " ".join(rnd.choices(WORDS[lang].split(), k=n)).capitalize() + "."


@pytest.fixture(scope="module")
def model():
    rnd = random.Random(1)
    return G.Model([(lang, sentence(rnd, lang)) for lang in WORDS for _ in range(40)])


def test_held_out_sentences(model):
    rnd = random.Random(2)
    truth = [lang for lang in WORDS for _ in range(30)]
    found = G.infer(model, [sentence(rnd, lang, 8) for lang in truth])
    assert sum(model.languages[x[0][2]] == t for x, t in zip(found, truth)) == len(truth)


def test_mixed_documents_names_and_odd_letters(model):
    rnd = random.Random(3)
    name = "Kovakegeix"
    lines = [sentence(rnd, "en"), f"{name} QX-V49JSCD {name}", "", "12 | 34", sentence(rnd, "ru"), sentence(rnd, "en").replace("e", "е").replace("o", "ο"), f"<b>{sentence(rnd, 'en')}</b>"]
    [found] = G.infer(model, ["\n".join(lines)])
    assert [(x[0], model.languages[x[2]]) for x in found] == [(1, "en"), (2, "en"), (5, "ru"), (6, "en"), (7, "en")]
    assert all(0.5 < x[3] <= 1 for x in found) and all(abs(x[4].sum() - 1) < 1e-9 for x in found)
    [alone] = G.infer(model, [f"{sentence(rnd, 'de')}\n{name} {name}"])
    assert {model.languages[x[2]] for x in alone} == {"de"}


def test_no_letters_and_no_model(model):
    assert G.infer(model, [None, "", " \n ", "12 34 |", "​"]) == [[]] * 5
    assert G.infer(G.Model([]), ["text"]) == [[]]


def test_labels(spark):
    labels = {"de": "de", "DEU": "de", "ger": "de", "de-AT": "de", "de_at": "de", "German": "de", " GERMAN ": "de", "pt-BR": "pt", "sv": "sv", "swe": "sv", "Swedish": "sv", "zh-Hans-CN": "zh", "chi": "zh", "Norwegian": "no", "haw": "haw", "Hawaiian": "haw", "Flemish": "nl", "rum": "ro", "Klingon": "tlh", "gibberish": "gibberish", "": None, "und": None, "Unknown": None, None: None}
    df = spark.createDataFrame([(x,) for x in labels], "l string").select("l", G.label_language(F.col("l")).alias("n"))
    assert {r.l: r.n for r in df.collect()} == labels


def test_documents(spark, model):
    rnd = random.Random(4)
    long = "\n".join(sentence(rnd, "fr") for _ in range(300))
    docs = [
        (1, sentence(rnd, "en"), "en", 0), (2, sentence(rnd, "en"), "de-AT", 0), (3, sentence(rnd, "de"), None, 0), (4, None, None, 0), (5, "123", "und", 0),
        (6, sentence(rnd, "fr", 30) + "\n\n" + sentence(rnd, "ru"), "French", 0), (7, long, "fr", 0), (None, sentence(rnd, "en"), "ru", 0), (2, sentence(rnd, "en"), "de", 0),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, line_no int")
    rows = G.label_repairs(G.line_languages(df, "doc_id", "text", "lang", model))
    assert sorted((r.doc_id, r.line_no, r.lang) for r in rows.collect()) == [(2, 0, "en"), (2, 0, "en"), (3, 0, "de"), (6, 1, "fr"), (6, 3, "ru")]
    assert G.line_languages(df.limit(0), "doc_id", "text", "lang", model).count() == 0
    fitted = G.fit(spark.createDataFrame([("en", "a word"), (None, "x"), ("de", None)], "lang string, text string"), "lang", "text")
    assert fitted.languages == ["en"]


def test_batches_do_not_matter(model):
    rnd = random.Random(5)
    texts = [sentence(rnd, rnd.choice(list(WORDS))) + "\n" + sentence(rnd, rnd.choice(list(WORDS))) for _ in range(40)]
    whole = G.infer(model, texts)
    for one, text in zip(whole, texts):
        [alone] = G.infer(model, [text])
        assert [(x[0], x[2]) for x in alone] == [(x[0], x[2]) for x in one]
        assert np.allclose([x[3] for x in alone], [x[3] for x in one])


def test_a_twelfth_and_a_rare_language(spark):
    rnd = random.Random(6)
    swedish = "och att det som en på är av för med inte var jag till ett kväll trädgård mellan väder flod"
    rows = [(lang, sentence(rnd, lang)) for lang in ("en", "de") for _ in range(400)] + [("sv", " ".join(rnd.choices(swedish.split(), k=12))) for _ in range(5)]
    fitted = G.fit(spark.createDataFrame(rows, "lang string, text string"), "lang", "text", max_rows=50)
    assert fitted.languages == ["de", "en", "sv"]
    docs = [(1, " ".join(rnd.choices(swedish.split(), k=15)), "swe"), (2, " ".join(rnd.choices(swedish.split(), k=15)), "Swedish"), (3, " ".join(rnd.choices(swedish.split(), k=15)), "de"), (4, sentence(rnd, "en"), "en_GB")]
    got = G.label_repairs(G.line_languages(spark.createDataFrame(docs, "doc_id long, text string, lang string"), "doc_id", "text", "lang", fitted))
    assert [(r.doc_id, r.lang) for r in got.collect()] == [(3, "sv")]
    assert G.fit(spark.createDataFrame(rows, "lang string, text string"), "lang", "text", max_languages=2).languages == ["de", "en"]


def test_tags_of_any_length_in_linear_time(model):
    import time

    rnd = random.Random(7)
    english = sentence(rnd, "en")
    [found] = G.infer(model, [f"<p data-x='{'der die und ' * 200}'>{english}</p>\n1 < 2 {english} 3 > 2"])
    assert [(model.languages[x[2]]) for x in found] == ["en", "en"]
    assert G.plain_line("Ab ab-12-c QX-V49JSCD me@x.org at http://a.b/c word").split() == ["ab", "ab-", "qx-", "at", "word"]
    began = time.perf_counter()
    assert G.plain_line("b" * 200_000 + " " + "x" * 200_000 + "@")
    assert G.plain_line("<a" * 100_000) and G.plain_line("<a " + "b" * 200_000)
    assert time.perf_counter() - began < 2
