"""Folding of characters that look alike, shared by the text operators.

``Folding`` holds tables made by rule from two public sources: the Unicode character data of
Python, and the Unicode confusables as the ICU library on Spark's own class path carries them.
It is made once on the driver (``folding()``) and shipped to workers; its size does not depend on
any data.

* ``visual``: equal for two texts that look the same. Case, accents and words stay.
* ``coarse``: coarser, for finding words that may be the same whatever their case. Greek nu looks
  like v in lower and like N in upper case, so v and n are one here; ``same_word`` decides.
* ``same_word``: whether two words are equal but for case and look-alike letters. Both are written
  in one script first, then case is dropped, so cave and cane differ, and so do nine and vine.

Look-alike letters: letters of different scripts with one confusables prototype and one case. Of
one script only one letter takes part (the one whose other case is alike too, else the first), so
no two words of one script become one: sigma is not omicron, dotless i is not i, thorn is not p.
Letters of phonetic notation count as a script of their own. Scripts whose letters join or bend
with their neighbours (Arabic, Indic, ...) only resemble and stay as they are; so do digits and
punctuation (a Unicode hyphen is not the ASCII one), which are no letters.

A null stays null in every fold; an empty text stays empty.
"""

from __future__ import annotations

import glob
import os
import re
import struct
import unicodedata
import zipfile
from collections import defaultdict
from functools import lru_cache

import numpy as np

#: Scripts with separate letters that can pass for one another.
ALPHABETS = ("LATIN", "GREEK", "CYRILLIC", "ARMENIAN", "CHEROKEE", "COPTIC", "LISU", "PHONETIC")
EAST_ASIAN = ("CJK", "KATAKANA", "HIRAGANA", "BOPOMOFO")
# Look-alikes that the rule leaves open (no prototype in the public data, or a second
# letter of one script), and their Latin letters.
FURTHER = {"Ԛ": "Q", "ӏ": "l", "Ү": "Y"}

#: Format characters that are drawn (they enclose or sign numbers), kept by the folds.
_DRAWN_FORMATS = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
_JOINED_TAGS = ("<initial>", "<medial>", "<final>", "<isolated>")
_ASCII_ODD = re.compile("[\x00-\x09\x0e-\x1f\x7f]")
_DIACRITIC = re.compile("[̀-ͯ]")
_WORD = re.compile(r"[^\W_]+")
_WORD_WITH_MARKS = re.compile("[^\\W_](?:[^\\W_]|[̀-ͯ])*")

_SIZE, _SLOW, _DROP = 0x30000, 0xFFFFFFFE, 0xFFFFFFFF


@lru_cache(1)
def first_table() -> dict[int, str | None]:
    """What happens before decomposition, by rule from the Unicode character data.

    Format and control characters vanish (tab, line feed, vertical tab, form feed and carriage
    return are blanks, not invisible), variation selectors too; every kind of blank that stays
    on a line becomes a space; width forms, joined letters and letters in mathematical fonts become
    their plain letters.
    """
    table: dict[int, str | None] = {0x34F: None, 0x115F: None, 0x1160: None, 0x17B4: None, 0x17B5: None, 0x3164: None, 0xFFA0: None, 9: " "}
    for cp in (*range(_SIZE), *range(0xE0000, 0xE01F0)):
        ch = chr(cp)
        cat = unicodedata.category(ch)
        if cp in table:
            continue
        if cat == "Cf" and cp not in _DRAWN_FORMATS or cat == "Cc" and cp not in (9, 10, 11, 12, 13, 0x85):
            table[cp] = None
        elif 0xFE00 <= cp <= 0xFE0F or 0x180B <= cp <= 0x180F or cp >= 0xE0000:
            table[cp] = None
        elif cat == "Zs":
            table[cp] = " "
        else:
            form = unicodedata.decomposition(ch)
            if form.startswith(("<wide>", "<narrow>")) or cat[0] == "L" and (
                form.startswith((*_JOINED_TAGS, "<font>")) or form.startswith("<compat>") and form.count(" ") > 1
            ):
                plain = unicodedata.normalize("NFKC", ch)
                if plain != ch:
                    table[cp] = plain
    return table


def public_prototypes() -> dict[str, str]:
    """Character to prototype of the Unicode confusables, out of the ICU library that Spark carries.

    The file is a header, sorted keys (code point, and length of the prototype in the high byte),
    values (the prototype itself, or its place in the string table) and the string table, all
    big-endian; see ICU's public description of ``confusables.cfu``."""
    import pyspark

    homes = [os.environ.get("SPARK_HOME", ""), os.path.dirname(pyspark.__file__)]
    jars = [j for h in homes if h for j in sorted(glob.glob(os.path.join(h, "jars", "icu4j-*.jar")))]
    if not jars:
        raise FileNotFoundError("Spark's icu4j library, which holds the public confusables, was not found")
    with zipfile.ZipFile(jars[0]) as z:
        raw = z.read("com/ibm/icu/impl/data/icudata/confusables.cfu")
    data = raw[struct.unpack(">H", raw[:2])[0] :]
    keys_at, n_keys, values_at, n_values, strings_at, n_strings = struct.unpack(">6I", data[12:36])
    keys = struct.unpack(f">{n_keys}I", data[keys_at : keys_at + 4 * n_keys])
    values = struct.unpack(f">{n_values}H", data[values_at : values_at + 2 * n_values])
    strings = data[strings_at : strings_at + 2 * n_strings]
    out = {}
    for key, value in zip(keys, values):
        size = (key >> 24) + 1
        out[chr(key & 0xFFFFFF)] = chr(value) if size == 1 else strings[2 * value : 2 * (value + size)].decode("utf-16-be")
    return out


def script_of(letter: str) -> str:
    """First word of the character's name; letters of phonetic notation are a script of their own."""
    if 0x250 <= ord(letter) <= 0x2AF or 0x1D00 <= ord(letter) <= 0x1D7F:
        return "PHONETIC"
    return unicodedata.name(letter, "").split(" ")[0]


def look_alike_letters(prototypes: dict[str, str]) -> tuple[dict[str, str], dict[str, dict[str, str]]]:
    """Letter to the canonical letter of its class (canonical ones left out), and letter to the
    members of its class by script."""
    classes: dict[tuple[str, str], dict[str, list[str]]] = defaultdict(lambda: defaultdict(list))
    case_of = {}
    for cp in range(0x20000):
        ch = chr(cp)
        cat = unicodedata.category(ch)
        if cat not in ("Lu", "Ll", "Lo") or unicodedata.normalize("NFD", ch) != ch or ch in FURTHER or cp in first_table():
            continue
        script = script_of(ch)
        if script not in (EAST_ASIAN if cat == "Lo" and script != "LISU" else ALPHABETS):
            continue
        case_of[ch] = "upper" if cat == "Lu" or script == "LISU" else "lower" if cat == "Ll" else ""
        classes[prototypes.get(ch, ch), case_of[ch]][script].append(ch)
    shapes, members = dict(FURTHER), {a: {script_of(a): a, "LATIN": b} for a, b in FURTHER.items()}
    key = lambda ch: (prototypes.get(ch, ch), case_of.get(ch))
    for by_script in classes.values():
        if len(by_script) < 2:
            continue
        latin = [c for c in by_script.get("LATIN", ()) if c.isascii()]
        other = lambda c: key(c.swapcase()) if len(c.swapcase()) == 1 else None
        partner = other(latin[0]) if latin else None
        pick = {s: min(letters, key=lambda c: (other(c) != partner, c)) for s, letters in by_script.items()}
        if latin:
            pick["LATIN"] = latin[0]
        canonical = pick.get("LATIN") or min(pick.values())
        for c in pick.values():
            members[c] = pick
            if c != canonical:
                shapes[c] = canonical
    return shapes, members


def _letter_classes(shapes: dict[str, str], members: dict[str, dict[str, str]]) -> dict[int, str]:
    """Letter to the least letter that can be reached by look-alikes and case."""
    up: dict[str, str] = {}

    def end(c: str) -> str:
        while up.get(c, c) != c:
            c = up[c]
        return c

    def tie(a: str, b: str) -> None:
        a, b = sorted((end(a), end(b)))
        up[b] = a

    letters = {chr(cp) for cp in range(0x20000) if unicodedata.category(chr(cp))[0] == "L"}
    for c in letters:
        small = c.casefold()
        if len(small) == 1 and small != c and small in letters:
            tie(c, small)
    for a, b in shapes.items():
        tie(a, b)
    return {ord(c): end(c) for c in up if end(c) != c}


def _marks(ch: str) -> bool:
    """Whether normalisation may join the character to its neighbours."""
    return unicodedata.category(ch)[0] == "M" or "ᄀ" <= ch <= "ᇿ" or "ꥠ" <= ch <= "꥿" or "ힰ" <= ch <= "ퟻ"


class Folding:
    def __init__(self, prototypes: dict[str, str]):
        self.shapes, self.members = look_alike_letters(prototypes)
        self._shape_table = {ord(a): b for a, b in self.shapes.items()}
        self._class_table = _letter_classes(self.shapes, self.members)
        self._visual = self._fast_table(self._visual_slowly)
        self._coarse = self._fast_table(self._coarse_slowly)
        self._ascii = {cp: self._coarse_slowly(chr(cp)) for cp in range(128)}

    def _fast_table(self, fold) -> np.ndarray:
        """Code point to folded code point; others vanish, or make the text take the slow way."""
        table = np.arange(_SIZE, dtype=np.uint32)
        table[0xD800:0xE000] = _SLOW
        for cp in range(_SIZE):
            ch = chr(cp)
            if (0x3400 <= cp <= 0x9FFF or 0x20000 <= cp < 0x2F800) and ch not in self.shapes or 0xAC00 <= cp <= 0xDFFF:
                continue
            if _marks(ch):
                table[cp] = _SLOW
                continue
            out = fold(ch)
            if out != ch:
                table[cp] = _DROP if not out else ord(out) if len(out) == 1 and not _marks(out) else _SLOW
        return table

    @staticmethod
    def _fold(text: str, table: np.ndarray, slowly) -> str:
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if int(code.max()) >= _SIZE:
            return slowly(text)
        out = table[code]
        if int(out.max()) >= _SLOW:
            if (out == _SLOW).any():
                return slowly(text)
            out = out[out != _DROP]
        return out.tobytes().decode("utf-32-le")

    def _visual_slowly(self, text: str) -> str:
        plain = unicodedata.normalize("NFD", text.translate(first_table()))
        return unicodedata.normalize("NFC", plain.translate(self._shape_table))

    def _coarse_slowly(self, text: str) -> str:
        plain = unicodedata.normalize("NFD", unicodedata.normalize("NFD", text.translate(first_table())).casefold())
        return unicodedata.normalize("NFC", plain.translate(self._class_table))

    def visual(self, text: str | None) -> str | None:
        if not text:
            return text
        if text.isascii():
            return text.translate(first_table()) if _ASCII_ODD.search(text) else text
        return self._fold(text, self._visual, self._visual_slowly)

    def coarse(self, text: str | None) -> str | None:
        if not text:
            return text
        if text.isascii():
            return text.translate(self._ascii)
        return self._fold(text.replace("ß", "ss"), self._coarse, self._coarse_slowly)

    def coarse_words(self, text: str | None) -> list[str]:
        """Runs of letters and digits of the coarse text; a combining accent belongs to its word."""
        folded = self.coarse(text) or ""
        return (_WORD if folded.isascii() or not _DIACRITIC.search(folded) else _WORD_WITH_MARKS).findall(folded)

    def words(self, text: str | None) -> list[str]:
        """The same words as written, without invisible characters and width forms."""
        plain = text or ""
        if not plain.isascii() or _ASCII_ODD.search(plain):
            plain = unicodedata.normalize("NFC", plain.translate(first_table()))
        return (_WORD if plain.isascii() or not _DIACRITIC.search(plain) else _WORD_WITH_MARKS).findall(plain)

    def in_script(self, word: str, script: str) -> str | None:
        """The word written in ``script``, without case; None if some letter has no such form."""
        out = []
        for c in unicodedata.normalize("NFD", word):
            if unicodedata.category(c)[0] == "L" and script_of(c) != script:
                c = self.members.get(c, {}).get(script)
                if c is None:
                    return None
            out.append(c)
        return unicodedata.normalize("NFC", "".join(out).casefold())

    def same_word(self, a: str, b: str) -> bool:
        """Equal but for case, how accents are composed, and letters of one shape."""
        if a == b:
            return True
        if a.isascii() and b.isascii():
            return a.lower() == b.lower()
        plain = lambda w: unicodedata.normalize("NFC", unicodedata.normalize("NFD", w).casefold())
        if plain(a) == plain(b):
            return True
        for script in ALPHABETS[:-1]:
            form = self.in_script(a, script)
            if form is not None and form == self.in_script(b, script):
                return True
        return False


@lru_cache(1)
def folding() -> Folding:
    """On the driver; workers get it shipped."""
    return Folding(public_prototypes())


def visual_fold(text: str | None) -> str | None:
    return folding().visual(text)


def caseless_fold(text: str | None) -> str | None:
    return folding().coarse(text)


def is_blank(text: str | None) -> bool:
    """Null, empty, or nothing but blanks and invisible characters."""
    return text is None or not (visual_fold(text) or "").strip()
