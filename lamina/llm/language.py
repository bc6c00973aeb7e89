"""Languages of documents and of the lines of mixed documents.

A multilingual mixture model. Each language has a distribution of character n-grams (1 to 5,
within words, and one of scripts), fitted to labelled sentences. The likelihood of a line is
the product over its distinct words of the word's n-gram likelihood, each mixed with a background, so
that no single word (a coined name, a code) can outweigh a line. A document is a mixture of a
set of languages: the set starts with the best single one and takes in the language with the
largest gain in likelihood as long as the gain exceeds a penalty; expectation-maximisation then
estimates the proportions of the chosen languages, and each line gets its most probable language
with its posterior probability as confidence.

Everything happens in one Arrow map over the documents, no shuffle. Likelihoods of all lines of
a batch and the EM of all its documents are computed together in numpy.

Null texts and texts without letters have no language and give no row. Lines are split at line
feeds and counted from 1; lines without letters get no row but keep their number. Ties between
languages go to the first in the model's order (alphabetical). A label is read by
``label_language``; an unreadable one names no known language and counts as wrong.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fold import first_table

ORDERS = 5
#: At most so many labelled rows of each language are used to fit the model (the least by hash of
#: their text), and of at most so many languages (the most frequent).
MAX_ROWS_PER_LANGUAGE, MAX_LANGUAGES = 2_000, 500
#: A word changes the likelihood ratio of two languages by at most 1 / BACKGROUND.
BACKGROUND = 0.02
#: Gain in log-likelihood that a further language must bring: this much, and so much for each
#: doubling of the document's words.
PENALTY, PENALTY_BY_SIZE = 5.0, 0.5
EM_ROUNDS = 12

# The bibliographic codes of ISO 639-2 that differ from the terminological ones, and
# second English names; all other codes and names come from the ICU library (``notations``).
BIBLIOGRAPHIC = "alb sq, arm hy, baq eu, bur my, chi zh, cze cs, dut nl, fre fr, geo ka, ger de, gre el, ice is, mac mk, mao mi, may ms, per fa, rum ro, slo sk, tib bo, wel cy"
SECOND_NAMES = "castilian es, flemish nl, farsi fa, moldavian ro, valencian ca, gaelic gd, pashto ps, punjabi pa, sinhalese si, uighur ug"
# Letters of Greek and Cyrillic that pass for Latin ones in running text, as parallel
# strings. Letters that merely resemble (those of r, y, i or a in Greek) are left out, or Greek and
# Russian words would turn into Latin ones.
LOOKALIKE_FROM = (
    "асԁеһіјӏорԛѕухԝѵ" "АВСЕНІЈКМОРԚЅТУХԜԌҮѴ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϺ" "ονρϲϳ"
)
LOOKALIKE_TO = (
    "acdehijlopqsyxwv" "ABCEHIJKMOPQSTYXWGYV" "ABEZHIKMNOPTYXCM" "ovpcj"
)
NO_LABEL = ("", "und", "unknown")

_TEXT = "text that is read"
_WORD = re.compile(r"[^\W\d_]+")
#: What counts as a word in the model: letters; where writing has no blanks, three of them.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff"
_UNIT = re.compile(rf"[{_UNSPACED}]{{1,3}}|[^\W\d_{_UNSPACED}]+")
#: Numbers that are no digits (fractions, superscripts, ...): word characters, but no letters.
_NUMBER = re.compile("[" + "".join(re.escape(chr(c)) for c in range(0x80, 0x10000) if unicodedata.category(chr(c)) in ("No", "Nl")) + "]+")
#: A tag of any length: each "<" is looked at up to the next one, so the scan is linear.
_TAG = re.compile(r"<[A-Za-z/!?][^<>\n]*>|&#?\w{1,10};")
_TOKEN, _RUN, _DIGIT = re.compile(r"\S+"), re.compile(r"\w[\w-]*"), re.compile(r"\d")


@lru_cache(1)
def notations() -> dict[str, str]:
    """Label in lower case to language: codes of two and three letters and English names of all
    languages the ICU library on Spark's class path knows; on the driver."""
    from pyspark import SparkContext

    locale = SparkContext._active_spark_context._jvm.com.ibm.icu.util.ULocale
    codes = sorted(locale.getISOLanguages(), key=lambda c: (len(c), c))
    out = dict(pair.split() for pair in f"{BIBLIOGRAPHIC}, {SECOND_NAMES}".split(", "))
    for code in codes:
        one = locale(code)
        for name in (code, one.getISO3Language(), one.getDisplayLanguage(locale.ENGLISH)):
            if name:
                out.setdefault(name.lower(), code)
    return out


def label_language(label: Column) -> Column:
    """Language of a label: its code; null if there is no label; else the label itself."""
    plain = F.lower(F.trim(label))
    head = F.regexp_extract(plain, r"^([a-z]{2,3})([-_].*)?$", 1)
    known = F.from_json(F.lit(json.dumps(notations())), "map<string, string>")  # a constant
    return F.when(label.isNull() | plain.isin(*NO_LABEL), None).otherwise(
        F.coalesce(F.try_element_at(known, F.when(head != "", head).otherwise(plain)), plain)
    )


@lru_cache(1)
def _script_tables() -> tuple[dict[int, str], dict[str, dict[int, str]]]:
    """Look-alikes into Latin, and back into Cyrillic (c) or Greek (g)."""
    to = {ord(a): b for a, b in zip(LOOKALIKE_FROM, LOOKALIKE_TO, strict=True)}
    cyr = {ord(b): a for a, b in zip(LOOKALIKE_FROM, LOOKALIKE_TO, strict=True) if "Ѐ" <= a <= "ӿ"}
    gre = {ord(b): a for a, b in zip(LOOKALIKE_FROM, LOOKALIKE_TO, strict=True) if "Ͱ" <= a <= "Ͽ"}
    return to, {"c": cyr, "g": gre}


_LATIN = re.compile("[A-Za-zÀ-ɏ]")
_CYRILLIC = re.compile("[Ѐ-ԯ]")
_GREEK = re.compile("[Ͱ-Ͽ]")


def _one_script(m: re.Match) -> str:
    """A word of mixed scripts in the script of those letters that look like no other."""
    w = m.group()
    if w.isascii() or not (_LATIN.search(w) and (_CYRILLIC.search(w) or _GREEK.search(w))):
        return w
    to, back = _script_tables()
    rest = w.translate(to)
    if not (_CYRILLIC.search(rest) or _GREEK.search(rest)):
        return rest
    return w.translate(back["c" if _CYRILLIC.search(rest) else "g"])


def _token_without_address(m: re.Match) -> str:
    token = m.group()
    if "@" in token[1:-1]:
        return " "
    at = min((i for i in (token.find("http://"), token.find("https://")) if i >= 0), default=len(token))
    return token[:at]


def _run_without_code(m: re.Match) -> str:
    """What stands before the word with the first digit."""
    digit = _DIGIT.search(m.group())
    return m.group() if digit is None else m.group()[: m.group().rfind("-", 0, digit.start()) + 1] + " "


def plain_line(line: str) -> str:
    """Lower case, without markup, codes and characters that are not seen; words in one script."""
    if not line.isascii():
        line = unicodedata.normalize("NFC", line.translate(first_table()))
        line = _WORD.sub(_one_script, line)
    if "<" in line or "&" in line:
        line = _TAG.sub(" ", line)
    if "@" in line or "://" in line:
        line = _TOKEN.sub(_token_without_address, line)
    if _DIGIT.search(line):
        line = _RUN.sub(_run_without_code, line)
    return line.lower()


def _script_of(code: np.ndarray) -> np.ndarray:
    """A small number for the script of each code point."""
    edges = np.array([0x250, 0x370, 0x400, 0x530, 0x600, 0x900, 0x3040, 0x30A0, 0x3100, 0x3400, 0xA000, 0xAC00, 0xD7B0])
    return np.searchsorted(edges, code, "right")


def word_grams(vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All n-grams of the words, as 64-bit hashes, with order and word number of each."""
    text = "".join(f"\x02{w}\x03" for w in vocabulary)
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.array([len(w) + 2 for w in vocabulary])
    word = np.repeat(np.arange(len(vocabulary)), size)
    hashes, orders, words = [], [], []
    inner = code > 3
    mix = np.uint64(0x9E3779B97F4A7C15)
    h = np.zeros(len(code), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, ORDERS + 1):
            end = len(code) - n + 1
            if end <= 0:
                break
            h = (h[:end] ^ code[n - 1 :]) * mix
            h ^= h >> np.uint64(29)
            ok = word[:end] == word[n - 1 :]
            if n == 1:
                ok &= inner
            at = np.flatnonzero(ok)
            hashes.append(h[at] ^ np.uint64(n))
            orders.append(np.full(len(at), n - 1))
            words.append(word[at])
        at = np.flatnonzero(inner)
        hashes.append((_script_of(code[at]).astype(np.uint64) + np.uint64(1)) * mix)
        orders.append(np.full(len(at), ORDERS))
        words.append(word[at])
    return np.concatenate(hashes), np.concatenate(orders), np.concatenate(words)


class Model:
    """log-likelihoods of n-grams in each language: sorted hashes and a table (one row a gram)."""

    def __init__(self, samples: list[tuple[str, str]]):
        self.languages = sorted({lang for lang, _ in samples})
        k = len(self.languages)
        grams: list[np.ndarray] = []
        owner: list[np.ndarray] = []
        order: list[np.ndarray] = []
        for i, lang in enumerate(self.languages):
            own = [w for label, t in samples if label == lang for w in _UNIT.findall(plain_line(t or ""))]
            if own:
                h, o, _ = word_grams(own)
                grams.append(h)
                order.append(o)
                owner.append(np.full(len(h), i))
        h, o, lang_no = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((grams, np.uint64), (order, np.int64), (owner, np.int64)))
        self.keys, at = np.unique(h, return_inverse=True)
        count = np.zeros((len(self.keys), k))
        np.add.at(count, (at, lang_no), 1)
        of = np.zeros(len(self.keys), np.int64)
        of[at] = o
        table = np.zeros((len(self.keys) + 1, k), np.float32)
        for n in range(ORDERS + 1):
            own = of == n
            if not own.any():
                continue
            # each language counts as much, however much of it was labelled
            share = count[own] / np.maximum(1, count[own].sum(0))
            mean = share.mean(1, keepdims=True)
            smooth = 0.02 if n < ORDERS else 0.001
            table[:-1][own] = np.log((1 - smooth) * share + smooth * mean + 1e-9)
        # orders overlap: a letter takes part in several n-grams, so each weighs less
        self.table = table / 3.0
        self.k = k

    def word_likelihoods(self, vocabulary: list[str]) -> np.ndarray:
        """Words x languages, in log; differences bounded by the background."""
        if not vocabulary or not self.k:
            return np.zeros((len(vocabulary), self.k), np.float32)
        h, _, word = word_grams(vocabulary)
        at = np.minimum(np.searchsorted(self.keys, h), max(0, len(self.keys) - 1))
        at = np.where(self.keys[at] == h, at, len(self.keys)) if len(self.keys) else np.zeros(len(h), np.int64)
        seen = at < len(self.keys)
        word, at = word[seen], at[seen]
        order = np.argsort(word, kind="stable")
        word, at = word[order], at[order]
        out = np.zeros((len(vocabulary), self.k), np.float32)
        if len(word):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            for i in range(0, len(starts), 20_000):
                s = starts[i : i + 20_000]
                stop = starts[i + 20_000] if i + 20_000 < len(starts) else len(word)
                out[word[s]] = np.add.reduceat(self.table[at[s[0] : stop]], s - s[0], axis=0)
        best = out.max(1, keepdims=True)
        return np.log((1 - BACKGROUND) * np.exp(out - best) + BACKGROUND)


def infer(model: Model, texts: list[str | None]) -> list[list[tuple[int, int, int, float, np.ndarray]]]:
    """For each text its lines with letters: (line number, letters, language, confidence,
    share of each language)."""
    vocabulary: dict[str, int] = {}
    line_words: list[int] = []
    lines: list[tuple[int, int, int, int]] = []  # text, number, letters, words
    for d, text in enumerate(texts):
        for no, line in enumerate((text or "").split("\n"), 1):
            if not line.isascii():
                line = _NUMBER.sub(" ", line)
            found = _WORD.findall(line)
            if not found:
                continue
            own = list(dict.fromkeys(_UNIT.findall(plain_line(line))))  # a name said twice is no more evidence
            line_words += [vocabulary.setdefault(w, len(vocabulary)) for w in own]
            lines.append((d, no, sum(map(len, found)), len(own)))
    out: list[list] = [[] for _ in texts]
    if not lines or not model.k:
        return out
    doc, number, letters, n_words = (np.array(x) for x in zip(*lines))
    by_word = model.word_likelihoods(list(vocabulary))
    total = np.zeros((len(lines), model.k))
    some = np.flatnonzero(n_words)
    if len(some):
        starts = (np.cumsum(n_words) - n_words)[some]
        total[some] = np.add.reduceat(by_word[line_words], starts, axis=0)
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    of = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(doc)]))
    words_of = np.add.reduceat(n_words, first)
    # the set of languages by penalised likelihood
    chosen = np.zeros((len(first), model.k), bool)
    sums = np.add.reduceat(total, first, axis=0)
    chosen[np.arange(len(first)), sums.argmax(1)] = True
    best = total[np.arange(len(doc)), sums.argmax(1)[of]]
    price = PENALTY + PENALTY_BY_SIZE * np.log2(np.maximum(2, words_of))
    for _ in range(model.k - 1):
        gain = np.add.reduceat(np.maximum(0, total - best[:, None]), first, axis=0)
        gain[chosen] = 0
        lang = gain.argmax(1)
        takes = gain[np.arange(len(first)), lang] > price
        if not takes.any():
            break
        chosen[takes, lang[takes]] = True
        best = np.where(takes[of], np.maximum(best, total[np.arange(len(doc)), lang[of]]), best)
    # proportions by expectation-maximisation, lines weighing as their words
    like = np.exp(total - total.max(1, keepdims=True)) + 1e-30
    pi = chosen / chosen.sum(1, keepdims=True)
    weight = np.maximum(1, n_words)[:, None]
    for _ in range(EM_ROUNDS):
        post = pi[of] * like
        post /= post.sum(1, keepdims=True)
        pi = np.add.reduceat(post * weight, first, axis=0)
        pi = (pi + 0.5 * chosen) / (pi + 0.5 * chosen).sum(1, keepdims=True)
    post = pi[of] * like
    post /= post.sum(1, keepdims=True)
    lang = post.argmax(1)
    for i in range(len(doc)):
        out[doc[i]].append((int(number[i]), int(letters[i]), int(lang[i]), float(post[i, lang[i]]), post[i]))
    return out


def fit(samples: DataFrame, lang: str, text: str, max_rows: int = MAX_ROWS_PER_LANGUAGE, max_languages: int = MAX_LANGUAGES) -> Model:
    """A model from labelled rows, at most ``max_rows`` of each language and ``max_languages``
    languages; rows without label or text are left out."""
    rows = samples.select(F.col(f"`{lang}`").alias("l"), F.col(f"`{text}`").alias("t")).where("l IS NOT NULL AND t IS NOT NULL")
    frequent = rows.groupBy("l").count().orderBy(F.col("count").desc(), "l").limit(max_languages)
    place = F.row_number().over(Window.partitionBy("l").orderBy(F.xxhash64("t"), "t"))
    rows = rows.join(frequent, "l", "left_semi").withColumn("place", place).where(F.col("place") <= max_rows)
    return Model([(r.l, r.t) for r in rows.collect()])


def line_languages(docs: DataFrame, key: str, text: str, label: str, model: Model) -> DataFrame:
    """For each document with letters: ``line_no`` 0 for the whole and one row for each line
    with letters. Columns: key, line_no, lang, confidence, n_langs (languages of the
    document's lines), named (language of the label or null)."""
    rows = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias(_TEXT), label_language(F.col(f"`{label}`")).alias("named")).where(f"`{key}` IS NOT NULL AND `{_TEXT}` <> ''")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # grows with the training rows only, which are bounded

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            for start in range(0, b.num_rows, 1000):
                part = b.slice(start, 1000)
                rows_at, no, lang, sure, n_langs = [], [], [], [], []
                for d, found in enumerate(infer(model, part.column(1).to_pylist())):
                    if not found:
                        continue
                    kinds = len({x[2] for x in found})
                    letters = np.array([x[1] for x in found], float)
                    share = np.zeros(model.k)
                    np.add.at(share, [x[2] for x in found], letters)
                    main = int(share.argmax())
                    mass = float((np.stack([x[4] for x in found]) * letters[:, None]).sum(0)[main] / letters.sum())
                    for n, code, p in ((0, main, mass), *((x[0], x[2], x[3]) for x in found)):
                        rows_at.append(d)
                        no.append(n)
                        lang.append(model.languages[code])
                        sure.append(p)
                        n_langs.append(kinds)
                at = pa.array(rows_at, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(at), pa.array(no, pa.int64()), pa.array(lang, pa.string()), pa.array(sure, pa.float64()), pa.array(n_langs, pa.int64()), part.column(2).take(at)],
                    names=[key, "line_no", "lang", "confidence", "n_langs", "named"],
                )

    return rows.mapInArrow(work, f"`{key}` {dict(rows.dtypes)[key]}, line_no bigint, lang string, confidence double, n_langs bigint, named string")


def label_repairs(lines: DataFrame) -> DataFrame:
    """Of ``line_languages``: the whole where the label is missing or wrong, and all lines of
    documents in more than one language."""
    return lines.where("(line_no = 0 AND (named IS NULL OR named <> lang)) OR (line_no > 0 AND n_langs > 1)")
