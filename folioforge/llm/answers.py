"""How an answer ends, what it says and in which language: the evidence both answer checks share."""

from __future__ import annotations

import json
import math
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard

from folioforge.llm import wordlists as W
from folioforge.llm.visual import visual_form

#: Lengths of the contexts before an end, in characters with each run of digits as one.
ORDERS = (4, 8, 12, 16)
TERMINAL = "。．.！!？?…"
OPENERS = dict(zip("([{（［｛「『《〈【“‘«", ")]}）］｝」』》〉】”’»"))
_OPENS = re.compile("[" + re.escape("".join(OPENERS)) + "]")
CLOSERS = {v: k for k, v in OPENERS.items()}
_DIGITS = re.compile(r"\d+(?:[.,]\d+)*")
_TAIL_MARK = re.compile(r"(?:\s*[\[［(（](?:\d{1,3}|p\. ?\d+|[^\[\]()（）]{0,24}\d+)[\]］)）])+$|[\s*_~`#>]+$|\s*-{3,}$|\s*—{2,}$")
_SPLIT = re.compile(r"(?<=[。！？!?；])|(?<=[a-zà-ÿ)]\.)\s|\n")
_WORD = re.compile(r"(?<!\w)[a-zà-öø-ÿœß]+(?!\w)")
_FIRST_WORD = re.compile(r"(?:^|[\n.!?¿¡:\"“-])\s*([A-ZÀ-Ý][a-zà-öø-ÿœß]*)(?!\w)")
_WIDE_RUN = re.compile("[一-鿿㐀-䶿豈-﫿ぁ-ゖァ-ヺー]{2,}")
_NAME = re.compile(r"\b[A-ZÀ-Ý]\w+")
_WORD_RUN = re.compile(r"[^\W_]+")
_WIDE = re.compile("[一-鿿㐀-䶿豈-﫿ぁ-ゖァ-ヺー]")
_FIGURES = re.compile(r"\d+")
_HIRAGANA = re.compile("[ぁ-ゖ]")


def _written_by(codec: str) -> frozenset[str]:
    return frozenset(c for c in map(chr, range(0x4E00, 0xA000)) if c.encode(codec, "ignore"))


#: Characters of simplified Chinese that Japanese doesn't write: in the one national character set, not in the other.
_CHINESE = _written_by("gb2312") - _written_by("cp932")
_HAN, _KANA, _LATIN = re.compile("[一-鿿㐀-䶿豈-﫿]"), re.compile("[ぁ-ゖァ-ヺー]"), re.compile("[A-Za-zÀ-ÖØ-öø-ÿœŒ]")
_FUNCTION: dict[str, list[str]] = {}
for _lang, _words in W.FUNCTION_WORDS.items():
    for _word in _words.split():
        _FUNCTION.setdefault(_word, []).append(_lang)
_OWN = {c: lang for lang, letters in W.OWN_LETTERS.items() for c in letters}
_OWN_LETTER = re.compile("[" + "".join(_OWN) + "]")
_INABLE = {k: re.compile(v, re.I) for k, v in W.INABILITY.items()}
_ABOUT = {k: re.compile(v, re.I) for k, v in W.ANSWERING.items()}
_POLITE = {k: re.compile(v, re.I) for k, v in W.COURTESY.items()}
def _any_of(languages: tuple[str, ...]) -> re.Pattern:
    """Whether a pattern of one of the languages can match somewhere in a text: all of them without their anchors."""
    return re.compile("|".join(f"(?:{part[k]})" for part in (W.INABILITY, W.COURTESY) for k in languages).replace("^", "").replace("$", ""), re.I)


_LATIN_LANGUAGES = ("en", "de", "fr", "es", "pt")
_ANY_WIDE, _ANY_LATIN = _any_of(("zh", "ja")), _any_of(_LATIN_LANGUAGES)


def _first_words(patterns: list[str]) -> tuple[frozenset[str], tuple[str, ...]]:
    """(words, beginnings) one of which a word of a text must be, or begin with, for one of the patterns to match in it."""
    words, beginnings = set(), set()
    for pattern in patterns:
        depth = 0
        parts = [""]
        for c in pattern:
            depth += (c == "(") - (c == ")")
            parts = [*parts, ""] if c == "|" and not depth else [*parts[:-1], parts[-1] + c]
        for part in parts:
            bare = re.sub(r"^(?:\^|\\b|\([^()]*\)\?)+", "", part)
            letters = re.match(r"[^\W\d_]*", bare)[0]
            rest = bare[len(letters) :]
            if rest[:1] == "?":
                letters = letters[:-1]
            (beginnings if rest[:1] in ("?", "(", "[", "\\") and rest[:1] else words).add(letters)
    return frozenset(words), tuple(beginnings)


_LATIN_WORDS, _LATIN_BEGINNINGS = _first_words([part[k] for part in (W.INABILITY, W.COURTESY) for k in _LATIN_LANGUAGES])


def may_decline(sentence: str) -> bool:
    """Whether anything in a sentence can decline or be a courtesy by the dictionaries."""
    return bool((not sentence.isascii() and _ANY_WIDE.search(sentence)) or (_LATIN.search(sentence) and _has_first_word(sentence) and _ANY_LATIN.search(sentence)))


def _has_first_word(sentence: str) -> bool:
    words = _WORD_RUN.findall(sentence.lower())
    return not _LATIN_WORDS.isdisjoint(words) or any(w.startswith(_LATIN_BEGINNINGS) for w in words)


_LABEL = re.compile(rf"^\W*{W.LABELS}\s*[:：]\s*", re.I)
_ONLY_LABELS = re.compile(rf"^(?:\W*{W.LABELS}\s*[:：])*\W*$", re.I)
#: A plain character that no label or placeholder has; where a text has one outside a tag, it carries something.
_TELLS = re.compile("[" + "".join(c for c in map(chr, [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x3041, 0x3097), *range(0x4E00, 0xA000)]) if c not in W.LABELS and c not in "".join(W.NOTHING)) + "]")
_NAMED = {k: re.compile(v, re.I) for k, v in W.LANGUAGE_NAMES.items()}
_ASKS = re.compile(W.ASKS_FOR_LANGUAGE, re.I)


def carries_nothing(answer: str | None) -> bool:
    """Null, blank, invisible, a placeholder, an empty container or labels without anything after them."""
    if answer is None:
        return True
    if "<" not in answer and "`" not in answer and _TELLS.search(answer):
        return False
    text = visual_form(answer)
    text = re.sub(r"<[^<>]*>|```\w*", " ", text).strip().strip("\"'“”`*").strip()
    if text.lower().strip(".") in W.NOTHING or not any(c.isalnum() for c in text):
        return True
    return bool(_ONLY_LABELS.match(text))


def collapsed(text: str) -> str:
    """The text with each number as one 0."""
    return _DIGITS.sub("0", text)


def unmatched(text: str) -> bool:
    """True if a bracket or quotation is opened and not closed again."""
    if not _OPENS.search(text):
        return False
    stack: list[str] = []
    for c in text:
        if c in OPENERS:
            stack.append(c)
        elif c in CLOSERS and stack and stack[-1] == CLOSERS[c]:
            stack.pop()
    return bool(stack)


def ending(answer: str) -> tuple[str, str]:
    """(state, stem): ``closed``, ``open``, or ``ask`` when only the text before the end can tell; stem is that text.

    ``ask-dots`` is that with dots at the end, ``ask-clause`` with a clause before it.

    Forms are read before marks: JSON must parse, code fences, emphasis, brackets and quotations must close, a table row must
    have the cells of the row before it. Marks that follow a complete answer (citations, page references, symbols, rules) are
    taken off first.
    """
    text = answer.rstrip()
    if text[:1] in "{[" and re.match(r'[{\[]\s*["{\[]', text):
        try:
            json.loads(text)
            return "closed", text
        except ValueError:
            return "open", text
    if text.endswith("�") or text.count("```") % 2 or text.count("**") % 2:
        return "open", text
    last = text.rsplit("\n", 1)[-1].strip()
    if last.startswith("|"):
        lines = [x.strip() for x in text.split("\n")[-2:]]
        whole = last.endswith("|") and len(last) > 1 and (len(lines) < 2 or not lines[0].startswith("|") or lines[0].count("|") == last.count("|"))
        return ("closed" if whole else "open"), text
    if unmatched(text):
        return "open", text
    stem, dots = text, False
    while True:
        before = stem
        stem = _TAIL_MARK.sub("", stem)
        while stem and (unicodedata.category(stem[-1]) in ("So", "Sk", "Cf", "Mn") or stem[-1].isspace()):
            stem = stem[:-1]
        if stem == before:
            break
    if not stem:
        return "closed", text
    if re.search(r"(?:\.{3,}|…+)$", stem):
        stem, dots = re.sub(r"\s*(?:\.{3,}|…+)$", "", stem), True
        if not stem:
            return "closed", text
    end = stem[-1]
    if end in "。！？!?":
        return "closed", stem
    # A point after a plain number may be a decimal point; after a word with figures (a reference) it is a full stop.
    if end == "." and len(stem) > 1 and (not stem[-2].isdigit() or re.search(r"[A-Za-z]\d+\.$", stem)) and not re.search(r"\b[A-ZÀ-Ý]\.$", stem):
        return "closed", stem
    if end in CLOSERS and len(stem) > 1 and not dots:
        return ("closed" if stem[-2] in TERMINAL else "ask"), stem[:-1] if stem[-2] not in TERMINAL else stem
    return ("ask-dots" if dots else "ask-clause" if re.search("[，,;；、]", stem) else "ask"), stem


_FACTORS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, ORDERS[-1] + 1)], dtype=np.uint64)
_PAD, _END = 2, 3


def context_hashes(stem: str) -> list[int]:
    """One 63-bit hash for each order of the characters before the end of ``stem``; the text's start counts as characters."""
    tail = collapsed(stem)[-ORDERS[-1] :]
    codes = [_PAD] * (ORDERS[-1] - len(tail)) + [ord(c) for c in tail]
    value, out = 0, []
    for k in range(1, ORDERS[-1] + 1):
        value = (value + codes[-k] * int(_FACTORS[k - 1])) & 0xFFFFFFFFFFFFFFFF
        if k in ORDERS:
            out.append(((value ^ (value >> 29)) * (2 * k + 1) & 0xFFFFFFFFFFFFFFFF) >> 1)
    return out


_STOPS = np.zeros(0x110000, dtype=bool)
_STOPS[[ord(c) for c in TERMINAL + ";；\n|" + "".join(OPENERS) + "".join(CLOSERS)]] = True
_STOPS[_END] = True


def all_contexts(texts: list[str], orders: tuple[int, ...] = ORDERS) -> tuple[list[np.ndarray], np.ndarray]:
    """For every place in the texts: the hashes of its contexts (one array for each of these orders), and whether a unit ends there.

    After a full stop a unit ends only before white space and a character that isn't lower case, so that decimal points
    and abbreviations don't count as ends.
    """
    pad = np.full(ORDERS[-1], _PAD, dtype=np.uint32)
    parts = []
    for t in texts:
        parts += [pad, np.frombuffer(collapsed(t).rstrip().encode("utf-32-le", "surrogatepass"), dtype=np.uint32), np.array([_END], dtype=np.uint32)]
    if not parts:
        return [np.zeros(0, np.uint64)] * len(orders), np.zeros(0, bool)
    codes = np.concatenate(parts)
    wide = codes.astype(np.uint64)
    n, top = len(codes), orders[-1]
    value, hashes = np.zeros(n, dtype=np.uint64), []
    for k in range(1, top + 1):
        value[k:] += wide[:-k] * _FACTORS[k - 1]
        if k in orders:
            hashes.append(((value ^ (value >> np.uint64(29))) * np.uint64(2 * k + 1)) >> np.uint64(1))
    after = np.append(codes[1:], _END)
    space = (codes == 32) | (codes == 0x3000)
    ends = _STOPS[codes] | (space & _STOPS[after])
    dotted = np.append(False, codes[:-1] == ord("."))
    lower = np.isin(after, [ord(c) for c in "abcdefghijklmnopqrstuvwxyzàâäçéèêëîïôöùûüßáíóúñãõ"])
    ends = np.where(dotted, (codes == _END) | (codes == 10) | (space & ~lower), ends)
    real = (codes != _PAD) & np.append(False, codes[:-1] != _PAD)
    return [h[real] for h in hashes], ends[real]


def language(text: str) -> tuple[frozenset[str], int]:
    """(candidate languages, letters) of a text: script shares first, function words and own letters within the Latin script.

    More than one candidate means that nothing tells them apart; a text without letters has none.
    """
    plain = text.isascii()
    kana, han, latin = 0 if plain else len(_KANA.findall(text)), 0 if plain else len(_HAN.findall(text)), len(_LATIN.findall(text))
    wide = 3 * (kana + han)
    if wide + latin == 0:
        return frozenset(), 0
    if wide > latin:
        particles = len(_HIRAGANA.findall(text))
        if particles * 20 >= han and particles:
            return frozenset(["ja"]), wide
        return frozenset(["zh"] if any(c in _CHINESE for c in text) else ["zh", "ja"]), wide
    words = _WORD.findall(text) + [w.lower() for w in _FIRST_WORD.findall(text)]
    votes = dict.fromkeys(W.FUNCTION_WORDS, 0)
    for word in words:
        for lang in _FUNCTION.get(word, ()):
            votes[lang] += 1
    for c in [] if plain else _OWN_LETTER.findall(text):
        votes[_OWN[c]] += 1
    best = max(votes.values())
    return frozenset(lang for lang, n in votes.items() if n == best), latin


def other_language(question: str, answer: str) -> bool:
    """True if the answer is mainly in another language than its question, and the question doesn't ask for that.

    Names that the answer takes over from the question say nothing about its language. Fewer than 20 letters (a Han
    character or kana counts as three) are a figure or a name and have no language.
    """
    own = _WIDE_RUN.sub(lambda m: " " if m[0] in question else m[0], answer)
    names = set(_NAME.findall(question))
    own = _NAME.sub(lambda m: " " if m[0] in names and len(m[0]) > 3 else m[0], own)
    theirs, letters = language(own)
    if letters < 20 or not theirs:
        return False
    allowed = _asked(question)
    return bool(allowed) and not theirs & allowed


@lru_cache(maxsize=1 << 16)
def _asked(question: str) -> frozenset[str]:
    """Languages in which a question may be answered: its own and those it asks for; questions return with every variant."""
    return language(question)[0] | requested_language(question)


def requested_language(question: str) -> set[str]:
    """Languages in which the question asks to be answered."""
    return {lang for lang, named in _NAMED.items() if named.search(question)} if _ASKS.search(question) else set()


def bare_forms(forms: list[str]) -> list[str]:
    """Letters and figures only, case folded, of texts in their visual form; a column at once."""
    return pc.replace_substring_regex(pa.array([f.casefold() for f in forms], pa.string()), r"[^\p{L}\p{N}]+", "").to_pylist()


_NO_LETTER = re.compile(r"[\W_]+")


@lru_cache(maxsize=1 << 16)
def _bare_question(question: str) -> str:
    return _NO_LETTER.sub("", visual_form(question).casefold())


_PLAIN = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False)


def _compressed(text: str, given: str | None = None) -> int:
    if given is None:
        return len(_PLAIN.compress(text.encode()))
    content = zstandard.ZstdCompressionDict(given.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return len(zstandard.ZstdCompressor(level=3, dict_data=content, write_content_size=False, write_checksum=False).compress(text.encode()))


#: What zstandard writes around the content of a short text.
_FRAME = 9
#: Where the share that is left parts copies from answers before any is seen; the search for a better place, in percent.
COPY_SHARE, COPY_RANGE = 0.4, (15, 60)
#: Shares above this are beyond the range and its smoothing; compressing alone can only raise them.
_NO_COPY = 0.7


def beyond_question(question: str, a: str) -> tuple[float, bool]:
    """(share, adds): the share of an answer, in its bare form, that is left once its question is known, by compressing it with
    the question as zstandard dictionary; and whether it goes on after the question, has a figure that the question lacks, or
    is much shorter.

    Case, marks, white space and visual form don't count. An equal text leaves nothing, however short it is; one without
    letters has no share below 1. Where not even the answer's length leaves a share that can matter, that is returned.
    """
    q = _bare_question(question)
    if not q or not a:
        return 1.0, True
    if q == a:
        return 0.0, False
    given = max(_compressed(a, q) - _FRAME, 0)
    if given > _NO_COPY * len(a.encode()):
        return given / len(a.encode()), True
    given /= max(_compressed(a) - _FRAME, 1)
    if given > COPY_RANGE[1] / 100:
        return given, True
    after = a.rpartition(q)[2] if q in a else ""
    return given, len(a) < 0.6 * len(q) or len(after) > 1 or not set(_FIGURES.findall(a)) <= set(_FIGURES.findall(q))


def copy_threshold(bins: np.ndarray, counts: np.ndarray) -> float:
    """The share left that parts copies from other answers: the emptiest place between both, from counts by percent.

    Few answers leave it near COPY_SHARE.
    """
    density = np.zeros(121)
    np.add.at(density, np.clip(bins, 0, 120), counts)
    width = np.arange(-8, 9)
    smooth = np.convolve(density, np.exp(-(width**2) / 18.0) / np.exp(-(width**2) / 18.0).sum(), "same")
    places = np.arange(*COPY_RANGE)
    pull = 2.0 * ((places / 100 - COPY_SHARE) / 0.1) ** 2
    return float(places[np.argmin(smooth[places] + pull)]) / 100 + 0.01


class Phrases:
    """Which words and pairs of wide characters declining answers have: a naive Bayes model counted over all answers."""

    def __init__(self, counts, declining: int, other: int) -> None:
        self.counts, self.declining, self.other = counts, declining, other

    def score(self, text: str) -> float:
        """Log odds that a sentence declines; what was never seen speaks a little against it."""
        if not self.declining or not self.other:
            return -1.0
        total = PHRASE_PRIOR
        for first, second in self.counts.of(phrase_hashes(text)):
            if first + second == 0:
                total += UNSEEN_PHRASE
            else:
                total += min(max(math.log((first + 0.2) / (self.declining + 1)) - math.log((second + 0.2) / (self.other + 1)), -4.0), 4.0)
        return total


#: Log odds that a sentence declines before its words are seen, and of a word or pair that no two answers have.
PHRASE_PRIOR, UNSEEN_PHRASE = -4.0, -0.7


def phrase_hashes(text: str) -> list[int]:
    """Hashes of the distinct words and pairs of wide characters of a text; figures are one kind of word."""
    lowered = collapsed(text).lower()
    found = {w if w.isascii() or not _WIDE.search(w) else "" for w in _WORD_RUN.findall(lowered)}
    for run in _WIDE_RUN.findall(lowered):
        found.update(run[k : k + 2] for k in range(len(run) - 1))
    found.discard("")
    return [xxhash.xxh3_64_intdigest(x) >> 1 for x in sorted(found)]


def refuses(form: str, phrases: Phrases | None = None) -> bool:
    """Of an answer in its visual form: true if every sentence declines, says that nothing can be answered, or is a courtesy; and one declines.

    A sentence declines by the dictionaries, or where they don't know it and it has no figure, by the phrases of other
    declining answers.
    """
    declined = False
    text = _LABEL.sub("", form, count=1)
    while text:
        # Sentence by sentence: most answers give something in their first.
        sentence, *rest = _SPLIT.split(text, maxsplit=1)
        text = rest[0] if rest else ""
        bare = sentence.strip().strip("。.!！?？;；*\"“”").strip()
        if not bare or not any(c.isalnum() for c in bare):
            continue
        if (phrases is None or _FIGURES.search(bare)) and not may_decline(bare):
            return False
        found, _ = language(bare)
        langs = sorted(found) or list(_INABLE)
        clauses = [c.strip() for c in re.split(r"[，,、；;]|(?<=ありません)が", bare) if c.strip()]
        if any(_INABLE[k].search(bare) and _ABOUT[k].search(bare) for k in langs) and not _gives(bare):
            declined = True
        elif all(any(_POLITE[k].search(c) for k in langs) for c in clauses):
            continue
        elif phrases is not None and not _FIGURES.search(bare) and not _gives(bare) and phrases.score(bare) > 0:
            declined = True
        else:
            return False
    return declined


def _gives(sentence: str) -> bool:
    """A sentence that declines one thing and goes on to give another."""
    return bool(re.search(r"但可以|但是?可|不过|yet |but (?:here (?:is|are)|we can|i can\b(?!'t|not))|however|jedoch|toutefois|sin embargo|no entanto|ただし|以下|following|folgend|suivant|siguiente|seguinte", sentence, re.I))
