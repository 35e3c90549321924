"""One consistent form for texts that look the same (problem 1).

``visual_form`` is the key by which texts are compared; it removes what a reader cannot see: width and code-block variants (compatibility decomposition, composed
again), the kind of a space, default-ignorable characters, joined letters and look-alike letters of other scripts. Raised,
lowered, circled, squared and vertical characters keep their own form, because they look different. Letter case is kept by
default; ``fold_case=True`` adds full case folding for comparisons that should ignore it. ``readable_form`` is the same text for
readers: letters of another script stay, unless they stand in a Latin word.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge.runtime import cut, spread

# Letters of other scripts drawn like a letter of the Latin script, and kana drawn like a Han character.
LOOK_ALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y",
    "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ү": "Y", "Ԁ": "d", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V", "Ӏ": "I", "Ԍ": "G",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l", "ԍ": "g", "ү": "y",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J", "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j",
    # Armenian and Cherokee
    "Օ": "O", "օ": "o", "ո": "n", "ս": "u", "հ": "h", "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭼ": "E", "Ꮋ": "H",
    "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    # Latin letters outside the basic alphabet
    "ɑ": "a", "ɡ": "g",
    # hyphens
    "‐": "-", "‑": "-",
    # kana and Han
    "ニ": "二", "ハ": "八", "ロ": "口", "カ": "力", "ト": "卜", "タ": "夕", "エ": "工",
    "ヘ": "へ", "ベ": "べ", "ペ": "ぺ",
}

# Ranges of Default_Ignorable_Code_Point.
IGNORABLE = [
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F),
    (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF),
    (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
]

#: Compatibility classes whose characters look different from what they decompose to.
_KEEPS_LOOK = ("<super>", "<sub>", "<circle>", "<square>", "<fraction>", "<vertical>")
#: Line ends and what a reader sees as a line end.
_LINE_END = re.compile("\r\n|[\r\x85\u2028\u2029]")
#: A text without any of these is already in its form: ASCII, plain Han, plain hiragana, common CJK marks.
_UNUSUAL = re.compile("[^\n\x20-\x7e\u3001-\u301b\u3041-\u3056\u4e00-\u9fff\u2014\u201c\u201d\xb7]")


class _Forms(dict):
    """Character -> its visual form, filled on demand for str.translate."""

    def __missing__(self, code: int) -> str:
        self[code] = form = _form(chr(code))
        return form


@lru_cache(maxsize=None)
def _form(char: str) -> str:
    code = ord(char)
    if any(low <= code <= high for low, high in IGNORABLE):
        return ""
    if char == "\n":
        return char
    if char.isspace() or unicodedata.category(char) == "Zs":
        return " "
    shape = unicodedata.decomposition(char)
    if shape.startswith(_KEEPS_LOOK):
        return char
    if shape:
        return "".join(_form(c) if c != char else c for c in unicodedata.normalize("NFKD", char))
    if 0xAC00 <= code <= 0xD7A3:
        return unicodedata.normalize("NFD", char)
    return LOOK_ALIKES.get(char, char)


_FORMS = _Forms()


def visual_form(text: str | None, fold_case: bool = False) -> str | None:
    """The consistent form of one text; null stays null, a text of invisible characters becomes empty.

    Trailing white space of a line cannot be seen and is dropped; other white space keeps its count.
    """
    if text is None:
        return None
    if _UNUSUAL.search(text):
        if _LINE_END.search(text):
            text = _LINE_END.sub("\n", text)
        if _UNUSUAL.search(text):
            text = unicodedata.normalize("NFC", text.translate(_FORMS))
    if " \n" in text or text.endswith(" "):
        text = re.sub(" +(?=\n|$)", "", text)
    return text.casefold() if fold_case else text


class _Plain(dict):
    """Character -> its form with look-alikes of other scripts left as they are."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        self[code] = form = char if char in LOOK_ALIKES else _plain(char)
        return form


def _plain(char: str) -> str:
    parts = unicodedata.normalize("NFKD", char) if unicodedata.decomposition(char) and not unicodedata.decomposition(char).startswith(_KEEPS_LOOK) else char
    return "".join(c if c in LOOK_ALIKES else _form(c) for c in parts)


_PLAIN = _Plain()
_WORD = re.compile(r"[^\W\d_]+")


def readable_form(text: str | None) -> str | None:
    """The consistent form for readers: composed, mapped spaces, without invisible characters; null stays null.

    Look-alikes are letters of their own script (カタログ, Москва) unless their word has a Latin letter and no other one.
    """
    if text is None:
        return None
    text = unicodedata.normalize("NFC", _LINE_END.sub("\n", text).translate(_PLAIN))

    def latin(word: re.Match) -> str:
        parts = unicodedata.normalize("NFD", word[0])
        letters = [c for c in parts if not unicodedata.combining(c)]
        mixed = any(c in LOOK_ALIKES for c in letters) and any(c.isascii() for c in letters) and all(c.isascii() or c in LOOK_ALIKES or "LATIN" in unicodedata.name(c, "") for c in letters)
        return unicodedata.normalize("NFC", "".join(LOOK_ALIKES.get(c, c) for c in parts)) if mixed else word[0]

    if _UNUSUAL.search(text):
        text = _WORD.sub(latin, text)
    return re.sub(" +(?=\n|$)", "", text)


def _per_value(function):
    """A column function over the distinct values of a batch; each is mapped once, however often it occurs."""

    @F.pandas_udf(T.StringType())
    def mapped(texts: pd.Series) -> pd.Series:
        codes, values = pd.factorize(texts)
        forms = np.array([*map(function, values), None], dtype=object)
        return pd.Series(forms[codes])

    return mapped


_visual = _per_value(visual_form)
_visual_folded = _per_value(lambda text: visual_form(text, True))
_readable = _per_value(readable_form)


def readable(column: Column | str) -> Column:
    """``readable_form`` as a column."""
    return _readable(column)


def visual(column: Column | str, fold_case: bool = False) -> Column:
    """``visual_form`` as a column, computed once per distinct value of a batch."""
    return (_visual_folded if fold_case else _visual)(column)


def with_visual_form(frame: DataFrame, column: str, output: str, fold_case: bool = False) -> DataFrame:
    """Add the consistent form of a text column; every row stays, nulls stay null."""
    return frame.withColumn(output, visual(F.col(column), fold_case))


def _hashes(frame: DataFrame, key: str, text: str) -> DataFrame:
    """(k, v1, v2, t1, t2) once a record: two hashes of its visual form and two of its text; null texts are left out."""
    source = spread(frame.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"))).where("k is not null and t is not null")
    shaped = source.withColumn("v", visual("t"))
    seeds = [F.xxhash64(F.lit(seed), c).alias(f"{c}{seed}") for c in ("v", "t") for seed in (1, 2)]
    return cut(shaped.select("k", *seeds).distinct())


def look_classes(frame: DataFrame, key: str, text: str) -> DataFrame:
    """(member, class, links) of every record with a text: the least key of those that look the same, and how many of them differ
    from it in a character.

    No pair is formed; a look that a third of all records have is counted by partition first.
    """
    hashes = _hashes(frame, key, text)
    looks = hashes.groupBy("v1", "v2").agg(F.min("k").alias("class"), F.count("*").alias("_all"))
    texts = hashes.groupBy("v1", "v2", "t1", "t2").agg(F.count("*").alias("_same"))
    found = hashes.join(texts.join(looks, ["v1", "v2"]), ["v1", "v2", "t1", "t2"])
    return found.select(F.col("k").alias("member"), "class", (F.col("_all") - F.col("_same")).alias("links"))


def same_look_pairs(frame: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs of different keys whose texts look the same and differ in a character: (key_a, key_b), key_a < key_b.

    Rows are reduced to hashes before anything is shuffled. Equal texts form one class; classes of one form are paired with
    each other and only then spread to their members, so groups of exact copies alone cost no pairs; ``look_classes`` has the
    same links without pairs. Repeated rows count once. Null texts have no look and take part in no pair.
    """
    hashes = _hashes(frame, key, text)
    classes = hashes.select("v1", "v2", "t1", "t2").distinct()
    mixed = classes.groupBy("v1", "v2").agg(F.count("*").alias("n")).where("n > 1").select("v1", "v2")
    classes = classes.join(mixed, ["v1", "v2"], "left_semi")
    other = classes.select("v1", "v2", F.col("t1").alias("o1"), F.col("t2").alias("o2"))
    paired = classes.join(other, ["v1", "v2"]).where("(t1, t2) < (o1, o2)")
    hashes = hashes.join(mixed, ["v1", "v2"], "left_semi")
    one = hashes.select("v1", "v2", "t1", "t2", F.col("k").alias("a"))
    two = hashes.select("v1", "v2", F.col("t1").alias("o1"), F.col("t2").alias("o2"), F.col("k").alias("b"))
    pairs = paired.join(one, ["v1", "v2", "t1", "t2"]).join(two, ["v1", "v2", "o1", "o2"]).where("a <> b")
    return pairs.select(F.least("a", "b").alias("key_a"), F.greatest("a", "b").alias("key_b")).distinct()
