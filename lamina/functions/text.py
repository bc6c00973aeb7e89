"""Text construction and tokenizers.

Five tokenizers, because the two retrieval profiles treat words differently on purpose:

* ``words``: runs of at least two word characters of the lower-cased text (accents kept).
* ``folded_words``: case folded, compatibility-decomposed, accents dropped; runs of letters and
  digits of any length, the underscore separates.
* ``index_words`` and ``query_phrases``: the full-text profile. Letters, digits and private-use
  characters; accents of Latin letters dropped, sharp s kept. A query token with underscores is a
  phrase of its parts.

Null texts have no words.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

WORD = r"[\p{L}\p{N}_]{2,}"
INDEX_WORD = r"[\p{L}\p{N}\p{Co}]+"
# Fixed value: white space that is stripped at both ends of a text (all Unicode blanks).
BLANKS = r"[\s\x1c-\x1f\x85\xa0  -     　]+"


def strip(text: Column) -> Column:
    """Without white space at either end; a null stays null."""
    return F.regexp_replace(text, f"^{BLANKS}|{BLANKS}$", "")


def titled(title: Column, text: Column) -> Column:
    """Title, line feed, text, stripped; a null part counts as empty."""
    return strip(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit(""))))


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


_FOLDED = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))


@F.pandas_udf(ArrayType(StringType()))
def _folded_words(text: pd.Series) -> pd.Series:
    return pd.Series([_FOLDED.findall(fold(t)) if t else [] for t in text], dtype=object)


def folded_words(text: Column | str) -> Column:
    """Texts of ASCII alone never leave the JVM."""
    text = F.col(text) if isinstance(text, str) else text
    ascii_only = text.rlike(r"\A[\x00-\x7f]*\z")
    return F.when(ascii_only, F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))).otherwise(_folded_words(F.when(~ascii_only, text)))


@lru_cache(1)
def latin_accents() -> tuple[str, str]:
    """Lower case Latin letters with one accent and their base letters, by rule."""
    pairs = []
    for cp in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        plain = unicodedata.normalize("NFD", chr(cp))
        if chr(cp).islower() and len(plain) == 2 and plain[0].isascii() and plain[0].isalpha() and unicodedata.combining(plain[1]):
            pairs.append((chr(cp), plain[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def plain_accents(text: Column) -> Column:
    accented, base = latin_accents()
    return F.regexp_replace(F.translate(F.lower(text), accented, base), "[\\u0300-\\u036f]", "")


def index_words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(plain_accents(text), F.lit(INDEX_WORD), F.lit(0)), F.array().cast("array<string>"))


def query_phrases(text: Column) -> Column:
    """Index words of each query token, joined by blanks; repeated tokens are kept."""
    tokens = F.regexp_extract_all(plain_accents(text), F.lit(r"[\p{L}\p{N}\p{Co}_]+"), F.lit(0))
    phrases = F.transform(tokens, lambda t: F.array_join(F.filter(F.split(t, "_"), lambda p: p != ""), " "))
    return F.coalesce(F.filter(phrases, lambda p: p != ""), F.array().cast("array<string>"))


def phrase_words(tokens: Column, length: int) -> Column:
    """All runs of ``length`` neighbouring tokens, joined by blanks."""
    if length == 1:
        return tokens
    starts = F.when(F.size(tokens) >= length, F.sequence(F.lit(1), F.size(tokens) - (length - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, length), " "))
