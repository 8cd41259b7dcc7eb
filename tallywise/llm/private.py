"""Personal data: identifiers in plain and in disguised form, as spans of the source text."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tallywise.llm.batches import with_computed

KINDS = ("email", "ip", "card", "phone")

# Cyrillic and Greek letters that look like ASCII ones, spaces, dashes and dots, signs without a width.
LOOKALIKES = {
    **dict(zip("АВЕЅІЈКМНОРСТУХаеорсухѕіјһԁԛԝ", "ABESIJKMHOPCTYXaeopcyxsijhdqw")),
    **dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανρι", "ABEZHIKMNOPTYXoavpi")),
    **dict.fromkeys("              　", " "),
    **dict.fromkeys("‐‑‒–—―−﹣", "-"),
    **dict.fromkeys("․。｡٫", "."),
    **dict.fromkeys("­​‌‍‎‏⁠﻿", ""),
}
# Digits in words, in the languages of the corpus, and the words for the signs at and dot.
DIGIT_WORDS = {
    word: str(digit)
    for words in (
        "zero one two three four five six seven eight nine",
        "oh",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
        "zéro un deux trois quatre cinq six sept huit neuf",
    )
    for digit, word in enumerate(words.split())
}
AT_WORDS = ("at", "arroba", "arobase")
DOT_WORDS = ("dot", "punto", "punkt", "point")


def _lookalikes() -> dict[str, str]:
    """All characters that stand for one of letters, digits and ``@ . + - ( )``: the list, digits of other scripts, and
    what Unicode calls a wide, narrow, small, circled or font variant."""
    wanted = re.compile(r"[A-Za-z0-9@.+()_%-]")
    found = {}
    for code in range(0x80, 0x20000):
        sign = chr(code)
        variant = unicodedata.decomposition(sign).split(" ")[0]
        if variant in ("<wide>", "<narrow>", "<small>", "<circle>", "<font>"):
            plain = unicodedata.normalize("NFKC", sign)
            if wanted.fullmatch(plain):
                found[sign] = plain
        elif (digit := unicodedata.decimal(sign, None)) is not None:
            found[sign] = str(digit)
    return found | LOOKALIKES


# Detectors of plain identifiers. Each finds its kind's matches from left to right, none overlapping, in linear time.

_LOCAL_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_DOUBLED = str.maketrans("0123456789", "0246813579")

Span = tuple[int, int]


def emails(text: str) -> list[Span]:
    """A match has one ``@``: from each, the name is what stands before it, back to the last match at most."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        if domain:
            start = at
            while start > free and text[start - 1] in _LOCAL_SIGNS:
                start -= 1
            if start < at:
                found.append((start, domain.end()))
                free = domain.end()
        at = text.find("@", max(at + 1, free))
    return found


def addresses(text: str) -> list[Span]:
    """Numbers joined by dots are taken four by four from the left of each such chain."""
    found = []
    for chain in _DOTTED.finditer(text):
        at, numbers = chain.start(), chain.group().split(".")
        for i in range(0, len(numbers) - 3, 4):
            four = numbers[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(n.lstrip("0")) <= 3 and int(n.lstrip("0") or 0) <= 255 for n in four):
                found.append((at, end))
            at = end + 1
    return found


def _luhn(digits: str) -> bool:
    double = digits[-2::-2].translate(_DOUBLED)
    return (sum(map(int, digits[-1::-2])) + sum(map(int, double))) % 10 == 0


def cards(text: str) -> list[Span]:
    spans = ((m, _NOT_DIGIT.sub("", m.group())) for m in _CARD.finditer(text) if m.end() - m.start() >= 13)
    return [m.span() for m, digits in spans if 13 <= len(digits) <= 19 and _luhn(digits)]


def phones(text: str) -> list[Span]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]


DETECTORS: dict[str, Callable[[str], list[Span]]] = dict(zip(KINDS, (emails, addresses, cards, phones)))


# Transducers


class Rewritten:
    """A text that was rewritten in places, and for each of its stretches the stretch of the source it came from."""

    def __init__(self, source: str, changes: list[tuple[int, int, str]]):
        """``changes``: start, end and new text, in order and apart. What has no text any more has no stretch."""
        pieces, self.starts, self.sources, self.changed, here, done = [], [], [], [], 0, 0
        for start, end, new in [*changes, (len(source), len(source), "")]:
            for piece, place, changed in ((source[done:start], (done, start), False), (new, (start, end), True)):
                if piece:
                    pieces.append(piece)
                    self.starts.append(here)
                    self.sources.append(place)
                    self.changed.append(changed)
                    here += len(piece)
            done = end
        self.text = "".join(pieces)

    def source(self, start: int, end: int) -> tuple[int, int, bool]:
        """Where the characters of a span came from, and whether any of them, or what stood between, was rewritten."""
        first, last = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1) - 1
        (a, _), (x, b) = self.sources[first], self.sources[last]
        a += 0 if self.changed[first] else start - self.starts[first]
        b = b if self.changed[last] else x + end - self.starts[last]
        gaps = any(self.sources[i][1] != self.sources[i + 1][0] for i in range(first, last))
        return a, b, gaps or any(self.changed[first : last + 1])


def _either(words) -> str:
    return "|".join(sorted(map(re.escape, words), key=len, reverse=True))


_SIGNS = _lookalikes()
_FOREIGN = re.compile("[\xa0\xadͰ-。＀-￯ꀀ-꯿︀-﻿\U00010000-\U0001ffff]")  # where they stand

_WORD, _DOT_WORD = f"(?:{_either(DIGIT_WORDS)})", f"(?:{_either(DOT_WORDS)})"
_NUMERAL, _GAP = f"(?:{_WORD}|[0-9]++)", "[ ,-]{1,2}"
_DIGIT_RUN = re.compile(rf"(?<![^\W_]){_NUMERAL}(?:{_GAP}(?:{_DOT_WORD} )?{_NUMERAL})+(?![^\W\d_])", re.IGNORECASE)
_TOKEN = re.compile(rf"{_WORD}|[0-9]+|{_DOT_WORD}|[ ,-]+", re.IGNORECASE)
_LETTER_IN_DIGITS = re.compile(r"(?<=[0-9])[OoIl|]{1,3}(?=[ .-]?[0-9])|(?<=[0-9][ .-])[OoIl|]{1,3}(?=[0-9])")

_BLANK, _OPEN, _CLOSE = r"(?:[ \t\n]{1,2}|_)", r"\s?[(\[{<]\s?", r"\s?[)\]}>]\s?"
_BRACKET_AT = rf"{_OPEN}(?:{_either(AT_WORDS)}|@){_CLOSE}"
_BRACKET_DOT = rf"{_OPEN}(?:{_DOT_WORD}|\.){_CLOSE}"
_BARE_AT = rf"{_BLANK}(?:{_either(AT_WORDS)}|@){_BLANK}"
_ANY_DOT = rf"(?:{_BRACKET_DOT}|{_BLANK}{_DOT_WORD}{_BLANK})"
_LABELS = r"[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}"
_DOT = re.compile(rf"(?<=[A-Za-z0-9]){_ANY_DOT}(?=[A-Za-z0-9])", re.IGNORECASE)
# a bare "at" or a spaced sign counts only where a disguised dot follows in the domain
_AT = re.compile(
    rf"(?<=[A-Za-z0-9_%+-])(?:{_BRACKET_AT}(?=[A-Za-z0-9])|{_BARE_AT}(?={_LABELS}{_ANY_DOT}[A-Za-z]))", re.IGNORECASE
)

# What the rules could start from, quick to look for in lower-cased text; most texts hold none of it.
_MAYBE_BRACKETS = re.compile(rf"[(\[{{<]\s?(?:@|\.|{_either(AT_WORDS + DOT_WORDS)})\s?[)\]}}>]")
_MAYBE_SPELLED = re.compile(rf"{_WORD}{_GAP}(?:{_NUMERAL}|{_DOT_WORD})")
_MAYBE_SPELLED_LAST = re.compile(rf"[0-9]{_GAP}(?:{_DOT_WORD} )?{_WORD}")
_MAYBE_LETTER = re.compile(r"[0-9][ .-]?[OoIl|]{1,3}[ .-]?[0-9]")


def plain_signs(text: str) -> list[tuple[int, int, str]]:
    """Homoglyphs to the character they look like; signs without a width go."""
    if text.isascii():
        return []
    return [(m.start(), m.end(), _SIGNS[m.group()]) for m in _FOREIGN.finditer(text) if m.group() in _SIGNS]


def plain_digits(text: str) -> list[tuple[int, int, str]]:
    """Runs of digit words to digits without gaps; letters within digits to the digits they look like."""
    changes, low = [], text.lower()
    if _MAYBE_SPELLED.search(low) or _MAYBE_SPELLED_LAST.search(low):
        for run in _DIGIT_RUN.finditer(text):
            tokens = [(*m.span(), m.group().casefold()) for m in _TOKEN.finditer(run.group())]
            numerals = [t in DIGIT_WORDS or t[0].isdigit() for _, _, t in tokens]
            for i, (a, b, t) in enumerate(tokens):
                a, b = a + run.start(), b + run.start()
                if t in DIGIT_WORDS:
                    changes.append((a, b, DIGIT_WORDS[t]))
                elif 0 < i < len(tokens) - 1 and numerals[i - 1] and numerals[i + 1]:
                    if tokens[i - 1][2] in DIGIT_WORDS or tokens[i + 1][2] in DIGIT_WORDS:
                        changes.append((a, b, ""))
    if _MAYBE_LETTER.search(text):
        for m in _LETTER_IN_DIGITS.finditer(text):
            changes.append((*m.span(), "".join("0" if c in "Oo" else "1" for c in m.group())))
        changes.sort()
    return [c for i, c in enumerate(changes) if not i or changes[i - 1][1] <= c[0]]


def _disguised(text: str) -> bool:
    low = text.lower()
    return any(word in low for word in DOT_WORDS) or bool(_MAYBE_BRACKETS.search(low))


def plain_ats(text: str) -> list[tuple[int, int, str]]:
    return [(*m.span(), "@") for m in _AT.finditer(text)] if _disguised(text) else []


def plain_dots(text: str) -> list[tuple[int, int, str]]:
    return [(*m.span(), ".") for m in _DOT.finditer(text)] if _disguised(text) else []


#: Each rewrites what the one before wrote. Signs for at come before dots, because they look for disguised dots.
TRANSDUCERS = (plain_signs, plain_digits, plain_ats, plain_dots)
_TOP_LEVEL = re.compile(r"\.[A-Za-z][A-Za-z-]*[A-Za-z]\Z")


def normalised(text: str) -> list[Rewritten]:
    """The texts after each transducer that changed something."""
    layers = []
    for rewrite in TRANSDUCERS:
        changes = rewrite(layers[-1].text if layers else text)
        if changes:
            layers.append(Rewritten(layers[-1].text if layers else text, changes))
    return layers


def disguised_spans(text: str, plain: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Spans of identifiers that only the normalised text shows, without those that lie within a plain one of their kind.

    Of an identifier something must have been rewritten, and an e-mail address must end in a name of two letters or more.
    A plain identifier is not prolonged over a blank: the word after it may be prose.
    """
    layers = normalised(text)
    if not layers:
        return {}
    found: dict[str, list[Span]] = {}
    for kind, detect in DETECTORS.items():
        for start, end in detect(layers[-1].text):
            if kind == "email" and not _TOP_LEVEL.search(layers[-1].text, start, end):
                continue
            rewritten = False
            for layer in reversed(layers):
                start, end, here = layer.source(start, end)
                rewritten |= here
            within = any(a <= start and end <= b for a, b in plain[kind])
            prose = any(a == start and text[b : b + 1].isspace() for a, b in plain[kind])  # "me@here.org dot ..."
            if rewritten and not within and not prose:
                found.setdefault(kind, []).append((start, end))
    return found


def identifiers(text: str) -> list[tuple[str, int, int, bool]]:
    """``kind, start, end, plain`` in code points, by kind as in ``KINDS``, then place."""
    plain = {kind: detect(text) for kind, detect in DETECTORS.items()}
    hidden = disguised_spans(text, plain)
    out = []
    for kind in KINDS:
        spans = [(a, b, True) for a, b in plain[kind]] + [(a, b, False) for a, b in hidden.get(kind, [])]
        out += [(kind, *s) for s in sorted(spans)]
    return out


def find_identifiers(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``identifiers``: every e-mail address, IP address, card and phone number of the whole text.

    Each is ``(kind, start, end, plain)``, in code points, end exclusive, by kind (email, ip, card, phone), then start.
    ``plain`` ones stand in the text as they are. The others are found in the text after transducers have put homoglyphs,
    spelled digits and disguises of at and dot right, and are traced back to the characters they came from; one that
    reaches beyond a plain one of its kind is given beside it.

    One row at a time, no shuffle. Null and empty texts have an empty array. Time is linear in the text's length.
    Repeated rows each have their result; a column ``identifiers`` of ``docs`` is replaced, all others pass.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("plain", pa.bool_())]))
    names = ("kind", "start", "end", "plain")

    def start() -> Callable[[pa.RecordBatch], list]:
        def compute(b: pa.RecordBatch) -> list:
            texts = (t.as_py() or "" for t in b.column(text_col))
            return [pa.array([[dict(zip(names, f)) for f in identifiers(t)] for t in texts], kind)]

        return compute

    return with_computed(docs, "identifiers array<struct<kind:string,start:int,end:int,plain:boolean>>", start)
