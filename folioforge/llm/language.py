"""Languages of documents and of the stretches of mixed ones (problem 9).

Rank-order profiles: the n-grams of a sentence, most frequent first, are compared with the most frequent n-grams of each
language by out-of-place distance: the sum of the differences in rank, with a fixed penalty for n-grams a profile lacks.
Latin-script letters count as triples with word ends, Han characters and kana one by one. All sentences of an Arrow batch
are ranked at once. A sentence far from every profile, or in another script, is in none of the languages. Profiles are trained on a bounded sample of the labelled documents, and once more without the sentences
that contradict their label.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.visual import visual_form
from folioforge.runtime import ship, spread

LANGUAGES = ("zh", "en", "ja", "de", "fr", "es", "pt")
#: Labelled documents a language that profiles are trained on, and characters of each (from its start, for training only).
SAMPLE_DOCUMENTS, SAMPLE_CHARS = 400, 20_000
#: Every so many of these only say how sure a sentence is.
HELD_OUT = 5
#: Texts that training holds n-grams of at once.
TRAIN_TEXTS = 200
#: n-grams in a profile; also the penalty of one that it lacks.
PROFILE = 1500
#: Letters that make up a sentence worth counting: Latin letters, or Han characters and kana.
LEAST_LATIN, LEAST_WIDE = 16, 6
#: Sentences closer to the second language than this share of its distance follow their document.
LEAST_MARGIN = 0.02
#: Full sentences that make a language one of a document's languages.
LEAST_SENTENCES = 2
#: A Latin sentence at least so far from the nearest profile, and hardly nearer to it than to the next, has none of the languages.
REJECT_DISTANCE, REJECT_LEAD = 0.4, 0.1
#: Bounds of the bins of a sentence's lead, for which the share that agrees with its document is counted.
LEADS = (0.02, 0.05, 0.1, 0.2, 0.4)
_GRAM_BITS = 20

# How labels name the languages; region, script and case are taken off before.
LABEL_NAMES = {
    "zh": "zh zho chi cmn chinese mandarin 中文 汉语 chinois chino chinesisch",
    "en": "en eng english englisch anglais inglés 英语 英文",
    "ja": "ja jpn jp japanese 日本語 日语 japanisch japonais japonés",
    "de": "de deu ger german deutsch allemand alemán 德语",
    "fr": "fr fra fre french français francais französisch francés 法语",
    "es": "es spa spanish español espanol espagnol spanisch castilian 西班牙语",
    "pt": "pt por portuguese português portugues portugiesisch portugais 葡萄牙语",
}
_LABELS = {name: lang for lang, names in LABEL_NAMES.items() for name in names.split()}


def label_language():
    """Column function: the language a label names, or null."""
    names = F.create_map(*(F.lit(x) for pair in _LABELS.items() for x in pair))

    def of(label):
        whole = F.lower(F.trim(label))
        return F.coalesce(F.try_element_at(names, whole), F.try_element_at(names, F.regexp_extract(whole, r"^(\w+?)(?:[-_]\w+)+$", 1)))

    return of


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, ...]:
    """(letter, wide, hidden, space, other): each code point's lower-case letter in its visual form, 0 for other characters; whether it
    is Han or kana; whether it is a combining mark or invisible; whether it is white space of any kind or ends a text; and whether it is a letter of another script that isn't drawn like a Latin one."""
    letter = np.zeros(0x110000, dtype=np.uint32)
    hidden = np.zeros(0x110000, dtype=bool)
    for code in range(0x10000):
        if 0xD800 <= code < 0xE000:
            continue
        form = visual_form(chr(code)) if code != 32 else " "
        latin = len(form) == 1 and form.isalpha() and (0x41 <= ord(form) < 0x250 or 0x1E00 <= ord(form) < 0x1F00)
        letter[code] = ord(form.lower()[0]) if latin else 0
        hidden[code] = unicodedata.category(chr(code)) in ("Mn", "Cf")
    hidden[0x3099:0x309B] = False
    wide = np.zeros(0x110000, dtype=bool)
    for low, high in ((0x3041, 0x3097), (0x30A1, 0x30FF), (0x31F0, 0x3200), (0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00), (0x20000, 0x32000)):
        wide[low:high] = True
    wide[0x30FB] = False
    letter[wide] = np.flatnonzero(wide)
    for code in (*range(0x2E80, 0x2FE0), *range(0xF900, 0xFB00), *range(0xFF66, 0xFF9E)):
        form = visual_form(chr(code))
        if len(form) == 1 and wide[ord(form)]:
            letter[code], wide[code] = ord(form), True
    other = np.array([unicodedata.category(chr(code))[0] == "L" and not 0x41 <= code < 0x250 and not 0x1E00 <= code < 0x1F00 and not 0xFF00 <= code < 0xFFF0 for code in range(0x10000)] + [False] * 0x100000)
    other[0x2100:0x2150] = False
    other &= ~wide & (letter == 0)
    space = np.zeros(0x110000, dtype=bool)
    space[[code for code in range(0x10000) if chr(code).isspace() or unicodedata.category(chr(code)) == "Zs"]] = True
    space[0] = True
    return letter, wide, hidden, space, other


class Units:
    """The sentences and lines of many texts, and their n-grams as (unit, n-gram, rank within the unit)."""

    def __init__(self, texts: list[str]) -> None:
        letter, wide, hidden, space, other = _tables()
        codes = np.frombuffer("\x00".join(texts).encode("utf-32-le", "surrogatepass") + b"\x00\x00\x00\x00", dtype=np.uint32)
        self.text_start = np.append(0, np.flatnonzero(codes == 0)[:-1] + 1)
        seen = np.flatnonzero(~hidden[codes])
        length, codes = len(codes), codes[seen]
        after = np.append(codes[1:], 0)
        stop = (codes == 0x3002) | (codes == 0xFF01) | (codes == 0xFF1F)
        stop |= ((codes == 46) | (codes == 33) | (codes == 63)) & space[after]
        text_end = codes == 0
        ends = stop | (codes == 10) | text_end
        last = np.flatnonzero(ends)
        first = np.append(0, last[:-1] + 1)
        self.start = seen[first]
        self.end = np.append(self.start[1:], length)
        self.text = np.concatenate([[0], np.cumsum(text_end)[last[:-1]]]) if len(last) else np.zeros(0, int)
        self.stopped = stop[last]
        unit = np.repeat(np.arange(len(last)), last + 1 - first)
        c = letter[codes]
        is_wide = wide[codes]
        self.latin = np.add.reduceat((c > 0) & ~is_wide, first) if len(last) else np.zeros(0, int)
        self.wide = np.add.reduceat(is_wide, first) if len(last) else np.zeros(0, int)
        self.other = np.add.reduceat(other[codes], first) if len(last) else np.zeros(0, int)
        self.marked = np.add.reduceat((codes == 0x7C) | (codes == 0x23), first) > 0 if len(last) else np.zeros(0, bool)
        narrow = np.where(is_wide, 0, c).astype(np.uint64)
        one, two = np.append(0, narrow[:-1]).astype(np.uint64), np.append([0, 0], narrow[:-2]).astype(np.uint64)[: len(narrow)]
        gram = (two * np.uint64(0x9E3779B1) + one * np.uint64(0x85EBCA77) + narrow * np.uint64(0xC2B2AE3D)) * np.uint64(0x9E3779B97F4A7C15)
        gram = np.where(is_wide, c.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), gram) >> np.uint64(64 - _GRAM_BITS)
        # Names in the script that a sentence isn't mainly written in say nothing about its language.
        mainly_wide = (3 * self.wide > self.latin)[unit]
        used = (is_wide & mainly_wide) | (~is_wide & ~mainly_wide & (one > 0) & ((narrow > 0) | (two > 0)))
        key = np.sort((unit[used].astype(np.int64) << _GRAM_BITS) | gram[used].astype(np.int64))
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, int)
        count = np.diff(np.append(new, len(key)))
        self.unit, self.gram, self.count = key[new] >> _GRAM_BITS, key[new] & ((1 << _GRAM_BITS) - 1), count

    def ranked(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(unit, n-gram, rank), ranks by falling count, at most PROFILE a unit."""
        many = np.minimum(self.count, 1023)
        order = np.sort((self.unit << (_GRAM_BITS + 10)) | ((1023 - many) << _GRAM_BITS) | self.gram)
        unit = order >> (_GRAM_BITS + 10)
        begin = np.flatnonzero(np.append(True, unit[1:] != unit[:-1])) if len(unit) else np.zeros(0, int)
        rank = np.arange(len(unit)) - np.repeat(begin, np.diff(np.append(begin, len(unit))))
        return unit, order & ((1 << _GRAM_BITS) - 1), rank

    def distances(self, ranks: np.ndarray) -> np.ndarray:
        """Out-of-place distance of each unit to each language, as a share of the greatest possible; 1 without letters."""
        unit, gram, rank = self.ranked()
        keep = rank < PROFILE
        unit, gram, rank = unit[keep], gram[keep], rank[keep].astype(np.int32)
        out = np.ones((len(self.start), ranks.shape[1]))
        if not len(unit):
            return out
        begin = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
        width = np.diff(np.append(begin, len(unit)))
        for k in range(ranks.shape[1]):
            place = ranks[gram, k].astype(np.int32)
            off = np.where(place < PROFILE, np.minimum(np.abs(place - rank), PROFILE), PROFILE)
            out[unit[begin], k] = np.add.reduceat(off, begin) / (width * PROFILE)
        return out


def _lead(distance: np.ndarray) -> np.ndarray:
    """How much nearer the nearest profile is than the next, as a share of the next one's distance."""
    two = np.sort(distance, axis=1)[:, :2]
    return (two[:, 1] - two[:, 0]) / np.maximum(two[:, 1], 1e-9)


def train(texts: list[str], labels: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ranks, sure): ranks of every n-gram in every language's profile, PROFILE where it has none; and how often a sentence agrees
    with its document, by bin of its lead.

    Trained twice: the second time without sentences whose nearest profile isn't that of their label, and without the
    held-out documents, which are then counted.
    """
    language = np.array([LANGUAGES.index(x) for x in labels], dtype=np.int64)
    held = np.arange(len(texts)) % HELD_OUT == HELD_OUT - 1
    ranks = None
    agree, seen = np.ones(len(LEADS) + 1), np.full(len(LEADS) + 1, 2.0)
    for turn in range(3):
        counts = np.zeros((len(LANGUAGES), 1 << _GRAM_BITS), dtype=np.int32)
        for k in range(0, len(texts), TRAIN_TEXTS):
            units = Units(texts[k : k + TRAIN_TEXTS])
            of_unit = language[k : k + TRAIN_TEXTS][units.text]
            distance = None if ranks is None else units.distances(ranks)
            worth = units.latin + 3 * units.wide >= LEAST_LATIN
            if turn == 2:
                near, rows = distance.argmin(axis=1), worth & held[k : k + TRAIN_TEXTS][units.text]
                votes = np.zeros((units.text.max() + 1, len(LANGUAGES)), dtype=np.int64)
                np.add.at(votes, (units.text[worth], near[worth]), 1)
                bins = np.searchsorted(LEADS, _lead(distance)[rows], side="right")
                np.add.at(seen, bins, 1)
                np.add.at(agree, bins, near[rows] == votes.argmax(axis=1)[units.text[rows]])
                continue
            if ranks is not None:
                of_unit = np.where((distance.argmin(axis=1) == of_unit) & worth & ~held[k : k + TRAIN_TEXTS][units.text], of_unit, -1)
            owner = of_unit[units.unit]
            for lang in range(len(LANGUAGES)):
                own = owner == lang
                np.add.at(counts[lang], units.gram[own], units.count[own])
        ranks = _profiles(counts) if turn < 2 else ranks
    return ranks, np.maximum.accumulate(agree / seen)


def _profiles(counts: np.ndarray) -> np.ndarray:
    ranks = np.full((1 << _GRAM_BITS, len(LANGUAGES)), PROFILE, dtype=np.int16)
    for k, own in enumerate(counts):
        seen = np.flatnonzero(own)
        top = seen[np.argsort(-own[seen], kind="stable")[:PROFILE]]
        ranks[top, k] = np.arange(len(top))
    return ranks


def trained_on(documents: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Profiles, and how sure they are, from the first SAMPLE_CHARS characters of at most SAMPLE_DOCUMENTS labelled documents a language, chosen by a hash of their id."""
    labelled = documents.select("doc_id", label_language()(F.col("lang")).alias("named")).where("named is not null")
    order = Window.partitionBy("named").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = labelled.withColumn("k", F.row_number().over(order)).where(F.col("k") <= SAMPLE_DOCUMENTS).select("doc_id", "named")
    sample = documents.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id").select(F.substring("text", 1, SAMPLE_CHARS).alias("text"), "named").toArrow()
    return train(sample["text"].to_pylist(), sample["named"].to_pylist())


def judge(texts: list[str], model: tuple[np.ndarray, np.ndarray]) -> tuple[Units, np.ndarray, np.ndarray, list[dict[str, float]]]:
    """(units, language of each unit or -1, its confidence, for each text its languages with confidence).

    Units too short or too close to call follow the language with most letters in their text; those in none of the languages
    (mostly letters of another script, or a Latin sentence far from all profiles) have none, and a text that consists mostly
    of such has none either. A text has each language in which it has LEAST_SENTENCES full sentences (closed by a mark, not a
    heading or table row); or else only the one with most letters. A sentence's confidence is how often held-out sentences
    with such a lead agree with their document; that of a text's language is its share of the letters, so weighted.
    """
    ranks, sure = model
    units = Units(texts)
    distance = units.distances(ranks)
    language, nearest, lead = distance.argmin(axis=1), distance.min(axis=1), _lead(distance)
    weight = units.latin + 3 * units.wide
    n, m = len(texts), len(LANGUAGES)
    various = np.bincount(units.unit, minlength=len(units.start)) >= LEAST_WIDE - 1
    worth = ((units.latin >= LEAST_LATIN) | (units.wide >= LEAST_WIDE)) & various
    strange = (2 * units.other > weight) | (worth & (units.latin > 3 * units.wide) & (nearest > REJECT_DISTANCE) & (lead < REJECT_LEAD))
    confidence = np.where(strange, 0, sure[np.searchsorted(LEADS, lead, side="right")])
    clear = (weight > 0) & (lead >= LEAST_MARGIN) & ~strange
    mass = np.bincount(units.text * m + language, weights=np.where(clear, weight * confidence, 0) + 1e-6 * ((weight > 0) & ~strange), minlength=n * m).reshape(n, m)
    letters = np.bincount(units.text, weights=np.maximum(weight, units.other), minlength=n)
    foreign = 2 * np.bincount(units.text, weights=np.where(strange, np.maximum(weight, units.other), 0), minlength=n) > letters
    main = np.where((mass.sum(axis=1) > 0) & ~foreign, mass.argmax(axis=1), -1)
    follows = ~(worth & clear)
    language = np.where((weight == 0) | strange, -1, np.where(follows, main[units.text], language))
    full = worth & clear & units.stopped & ~units.marked
    sentences = np.bincount((units.text * m + np.maximum(language, 0))[full], minlength=n * m).reshape(n, m)
    found = []
    for k in range(n):
        total = max(mass[k].sum(), 1e-9)
        several = np.flatnonzero(sentences[k] >= LEAST_SENTENCES)
        chosen = several if len(several) > 1 else [main[k]] if main[k] >= 0 else []
        found.append({LANGUAGES[j]: float(mass[k, j] / total * sure[-1]) for j in chosen})
    return units, language, confidence, found


def _run(documents: DataFrame, rows, schema: str) -> DataFrame:
    """Map over (doc_id, text) with the profiles broadcast; their size is fixed."""
    spark = ship(documents.sparkSession)
    model = spark.sparkContext.broadcast(trained_on(documents))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.value
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                yield rows(part, [t or "" for t in part["text"].to_pylist()], table)

    return spread(documents.select("doc_id", "lang", "text")).mapInArrow(run, schema)


def document_languages(documents: DataFrame) -> DataFrame:
    """(doc_id, label, langs, confidences) of every document; the lists are empty for texts without letters and null texts."""

    def rows(batch: pa.RecordBatch, texts: list[str], model: tuple) -> pa.RecordBatch:
        found = judge([t.replace("\x00", " ") for t in texts], model)[3]
        columns = [batch["doc_id"], batch["lang"], pa.array([list(x) for x in found], pa.list_(pa.string())), pa.array([list(x.values()) for x in found], pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "label", "langs", "confidences"])

    return _run(documents, rows, "doc_id long, label string, langs array<string>, confidences array<double>")


def language_segments(documents: DataFrame) -> DataFrame:
    """(doc_id, segment, start, length, lang, confidence): maximal stretches of sentences in one language, in order.

    Positions are in characters from 0. Texts without letters have no segment.
    """

    def rows(batch: pa.RecordBatch, texts: list[str], model: tuple) -> pa.RecordBatch:
        units, language, confidence, _ = judge([t.replace("\x00", " ") for t in texts], model)
        some = np.flatnonzero(language >= 0)
        text, lang = units.text[some], language[some]
        new = np.append(True, (text[1:] != text[:-1]) | (lang[1:] != lang[:-1])) if len(some) else np.zeros(0, bool)
        begin = np.flatnonzero(new)
        until = np.append(begin[1:], len(some)) - 1
        weight = (units.latin + 3 * units.wide)[some]
        sure = np.add.reduceat(weight * confidence[some], begin) / np.add.reduceat(weight, begin) if len(begin) else np.zeros(0)
        own = text[begin]
        start = units.start[some[begin]] - units.text_start[own]
        length = units.end[some[until]] - units.text_start[own] - start
        length = np.minimum(length, np.array([len(texts[k]) for k in own], dtype=np.int64) - start)
        number = np.arange(len(begin)) - np.repeat(np.flatnonzero(np.append(True, own[1:] != own[:-1])), np.diff(np.append(np.flatnonzero(np.append(True, own[1:] != own[:-1])), len(own)))) if len(own) else own
        columns = [batch["doc_id"].take(pa.array(own)), pa.array(number.astype(np.int32)), pa.array(start.astype(np.int32)), pa.array(length.astype(np.int32)), pa.array([LANGUAGES[x] for x in lang[begin]], pa.string()), pa.array(np.round(sure, 6))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "segment", "start", "length", "lang", "confidence"])

    return _run(documents, rows, "doc_id long, segment int, start int, length int, lang string, confidence double")


def mislabelled(documents: DataFrame) -> DataFrame:
    """(doc_id, lang): the languages of each document whose label names none, or another one than its text has, or whose
    text is in several languages. Texts that are null, blank or without words are no cases."""
    judged = document_languages(documents)
    named = label_language()(F.col("label"))
    wrong = named.isNull() | (F.size("langs") > 1) | (named != F.col("langs")[0])
    return judged.where((F.size("langs") > 0) & wrong).select("doc_id", F.explode("langs").alias("lang"))
