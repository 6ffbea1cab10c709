"""The noise filter, scores and choice of article texts (T13, T18 to T20, E5 to E8) over whole texts, as Arrow functions.

They give what the column expressions of ``article`` and ``html`` give, in one pass over a text: a pattern is tried only in sentences that hold its
literal beginning. A text with characters that Java and Python may read differently, or that isn't UTF-8, is left (null) to those expressions.
"""

from __future__ import annotations

import math
import re
from collections import deque
from itertools import count, islice
from typing import NamedTuple

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions import text as tx

MAX_ARTICLE_CHARS = 12_000
# Fixed values of article candidates: shortest line that stands in for a paragraph; mostly links: their share of a paragraph, and the length from which on
# that doesn't count; shortest segment, JSON-LD body and page text.
IN_LINE, LINK_SHARE, LINK_CHARS, SEGMENT, BODY, PAGE = 55, 0.72, 420, 35, 100, 180


def _python(pattern: str) -> str:
    """A pattern of ``text`` with Java's classes spelled out."""
    return pattern.replace(tx.LEFT, r"(?<!\w)").replace(tx.RIGHT, r"(?!\w)").replace(r"\d", "[0-9]").replace(r"\s", r"[ \t\n\x0b\f\r]")


def _fold(text: str) -> str:
    """Lower case, with the letters that match ASCII ones when case is ignored replaced by these."""
    if not text.isascii():
        for a, b in zip(*tx.FOLDED, strict=True):
            text = text.replace(a, b)
    return text.lower()


def _any(patterns) -> re.Pattern:
    return re.compile("(?i)(?:" + "|".join(_python(p) for p in patterns) + ")")


def _stems(patterns) -> tuple[str, ...]:
    found = tuple(dict.fromkeys(_fold(tx.stem(p)) for p in patterns))
    if "" in found:
        raise ValueError("a pattern begins with no literal")
    return found


#: All but characters that Unicode has had, with the same case and kind, since long before any Java or Python in use. Capital sigma is left out, as its lower case hangs on its place.
ODD = re.compile(
    r"[^\x00-\u0233\u0300-\u033f\u0386\u0388-\u038a\u038c\u038e-\u03a1\u03a4-\u03ce\u0400-\u0481\u05d0-\u05ea\u060c\u061b\u061f\u0621-\u063a\u0640-\u0652\u0660-\u0669\u06a9\u06af\u06cc"
    r"\u0901-\u0903\u0905-\u0939\u093c-\u094d\u0958-\u096f\u0e01-\u0e3a\u0e3f-\u0e5b\u1e00-\u1e9b\u1ea0-\u1ef9\u2000-\u200f\u2010-\u2046\u20a0-\u20b1\u2100-\u2138\u2190-\u21ea\u2200-\u22f1"
    r"\u2500-\u2595\u25a0-\u25ef\u3000-\u301f\u3041-\u3094\u30a1-\u30fe\u4e00-\u9fa5\uac00-\ud7a3\uff01-\uff5e\uffe0-\uffe6\ufe0f\ufeff\ufffd\U0001f300-\U0001f320\U0001f600-\U0001f610]"
)
CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\u200b]")
TOKEN = re.compile(r"\w(?:[\w'-]*\w)?")
MARKS = ".!?…。！？؟"
SENTENCE = re.compile(f"[^{MARKS} ][^{MARKS}]*[{MARKS}]?|[{MARKS}]")
NO_LETTERS = re.compile("[^A-Za-zÀ-ÖØ-öø-ÿÇĞİÖŞÜçğıöşüА-Яа-я一-龯ぁ-んァ-ン]+")
SIGN = re.compile(tx.CJK)
NAV_WORDS = frozenset(tx.NAV_WORDS)
NAV_SHORT = tuple(_any([tx.LEFT + p + tx.RIGHT]) for p in tx.NAV_SHORT)
PHRASES = tuple(f"{tx.LEFT}(?:{p}){tx.RIGHT}" for p in tx.BOILERPLATE) + tuple(f"{tx.LEFT}{p}" for p in tx.BOILERPLATE_OPEN)
SCRIPT = ("function", "const", "let", "var")
PHRASE, CODE, SCRIPTED = _any(PHRASES), _any(tx.CODE_NOISE), _any([f"{tx.LEFT}(?:{'|'.join(SCRIPT)}){tx.RIGHT}"])
PHRASE_STEMS, CODE_STEMS = _stems(PHRASES), _stems(tx.CODE_NOISE)
COUNTED = [[(_fold(tx.stem(p)), _any([p])) for p in group] for group in (PHRASES, tx.CODE_NOISE)]
MARKED = _any([m.replace(".", "[.]") for m in (*tx.MARKERS, *tx.MARKERS_TR)])
NAMED = _any([f"{tx.LEFT}(?:{'|'.join(tx.DATE_WORDS)}){tx.RIGHT}"])
MONTHS = (*tx.MONTHS_TR, *tx.MONTHS_EN)
DATED = _any([f"{tx.LEFT}(?:{'|'.join((*tx.DATE_SHAPES, *MONTHS))}){tx.RIGHT}"])
BARE = re.compile("[0-9 :./|-]+")
DIGIT = re.compile("[0-9]")
NOTE_STEMS = tuple(dict.fromkeys(_fold(x) for x in (*tx.MARKERS, *tx.MARKERS_TR, *MONTHS)))
MOJIBAKE = re.compile("[" + "".join(sorted({m[0] for m in (*tx.MOJIBAKE_SINGLE, *tx.MOJIBAKE_SEQUENCES)})) + "ä-é]")
MOJIBAKE_PATTERNS = tuple(re.compile(p) for p in tx.MOJIBAKE_PATTERNS)


def readable(text: str) -> bool:
    return text.isascii() or not ODD.search(text)


def clean(text: str | None) -> str:
    """T5, as ``text.clean``."""
    return " ".join(CONTROL.sub(" ", text or "").split())


def sentences(text: str) -> list[str]:
    """T6 on clean text."""
    return [s.rstrip(" ") for s in SENTENCE.findall(text)]


def _held(stems, fold: str) -> tuple[str, ...]:
    return tuple([s for s in stems if s in fold])


def _holds(stems, fold: str) -> bool:
    for s in stems:
        if s in fold:
            return True
    return False


class Stems(NamedTuple):
    """Beginnings of matches that a text may hold."""

    phrases: tuple[str, ...] = PHRASE_STEMS
    code: tuple[str, ...] = CODE_STEMS
    script: tuple[str, ...] = SCRIPT
    notes: tuple[str, ...] = NOTE_STEMS

    def within(self, fold: str) -> Stems:
        return Stems(*[_held(x, fold) for x in self])


ALL = Stems()


def code_noise(text: str, fold: str, stems: Stems = ALL) -> bool:
    """T9; ``fold`` is the folded text."""
    if stems.script and len(text) <= 240 and _holds(stems.script, fold) and SCRIPTED.search(text):
        return True
    if ":" in text:
        n = text.count
        colons = n(":")
        if (colons >= 3 and n(";") >= 2 and n("{") + n("}") >= 2) or (colons >= 5 and n('":') >= 5 and n('{"') >= 2) or (colons >= 8 and n('","') >= 5):
            return True
    return bool(stems.code) and _holds(stems.code, fold) and CODE.search(text) is not None


def boilerplate(low: str, fold: str, stems: Stems = ALL) -> bool:
    """T10 on clean text in lower case."""
    if not low or (stems.phrases and _holds(stems.phrases, fold) and PHRASE.search(low)):
        return True
    size = len(low)
    if size <= 420 and len(NAV_WORDS.intersection(low.split(" "))) >= 6:
        return True
    if size <= 64 and sum([p.search(low) is not None for p in NAV_SHORT]) >= 2:
        return True
    return code_noise(low, fold, stems)


def note(text: str, low: str, fold: str, stems: Stems = ALL) -> bool:
    """T15 in English or Turkish, of up to 140 characters: the markers of the latter hold those of the former."""
    size = len(low)
    if len(text) > 140 or size > 240:
        return False
    if BARE.fullmatch(low):
        return True
    if not (DIGIT.search(low) or _holds(stems.notes, fold)):
        return False
    marked = MARKED.search(low) is not None
    if marked and size <= 110:
        return True
    return DATED.search(low) is not None and (marked or (size <= 64 and len(TOKEN.findall(low)) <= 7) or NAMED.search(low) is not None)


class Memo:
    """What is known of the sentences of a text and of the candidates beside it: a number, lower case and words; the share of words of two; whether they are noise.

    Each part is emptied when it is full, so a text's length doesn't matter.
    """

    FULL = 50_000

    def __init__(self):
        self.words: dict[str, tuple[int, str, set[str]]] = {}
        self.shares: dict[tuple[int, int], float] = {}
        self.noise: dict[str, bool] = {}
        self.numbers = count()

    def read(self, s: str) -> tuple[int, str, set[str]]:
        if (found := self.words.get(s)) is None:
            if len(self.words) >= self.FULL:
                self.words.clear()
            low = s.lower()
            found = self.words[s] = next(self.numbers), low, {w for w in TOKEN.findall(low) if len(w) > 2}
        return found

    def share(self, a: tuple[int, str, set[str]], b: tuple[int, str, set[str]]) -> float:
        """The shared part of the smaller of two sets of words; 1 for equal texts."""
        if len(self.shares) >= self.FULL:
            self.shares.clear()
        least = min(len(a[2]), len(b[2]))
        found = self.shares[a[0], b[0]] = 1.0 if a[1] == b[1] else len(a[2] & b[2]) / least if least else 0.0
        return found


def unlike_recent(segments: list[str], last: int, threshold: float, memo: Memo) -> list[str]:
    """T13, J8, as ``article.unlike_recent``."""
    kept, seen, shares = [], deque(maxlen=last), memo.shares
    for s in segments:
        one = memo.read(s)
        i = one[0]
        for other in seen:
            if (share := shares.get((i, other[0]))) is None:
                share = memo.share(one, other)
            if share >= threshold:
                break
        else:
            kept.append(s)
            seen.append(one)
    return kept


def dedupe_segments(segments: list[str], memo: Memo) -> list[str]:
    """T13 on clean segments that aren't empty."""
    return unlike_recent(segments, 8, 0.9, memo)


def filter_noise(text: str, memo: Memo) -> str:
    """T18 on clean text."""
    whole = _fold(text)
    stems = ALL.within(whole)
    said, known = [], memo.noise
    for part in text.split(" | "):
        for s in sentences(part.strip(" ")):
            if len(s) >= 18:
                if (noise := known.get(s)) is None:
                    low = s.lower()
                    fold = low if s.isascii() else _fold(s)
                    if len(known) >= memo.FULL:
                        known.clear()
                    noise = known[s] = bool(code_noise(s, fold, stems) or boilerplate(low, fold, stems) or note(s, low, fold, stems))
                if not noise:
                    said.append(s)
    kept = " ".join(unlike_recent(said, 6, 0.92, memo))
    if not text or len(kept) >= max(80, math.floor(len(text) * 0.35)) or boilerplate(text.lower(), whole, stems):
        return kept
    return text


def mojibake_count(text: str) -> int:
    """T3."""
    if text.isascii() or not MOJIBAKE.search(text):
        return 0
    return sum(text.count(m) for m in (*tx.MOJIBAKE_SINGLE, *tx.MOJIBAKE_SEQUENCES)) + sum(len(p.findall(text)) for p in MOJIBAKE_PATTERNS)


def score(text: str, memo: Memo) -> float:
    """T19 on clean text, as ``article.score``."""
    if not text:
        return -10000.0
    size, fold, sents = len(text), _fold(text), sentences(text)
    phrases, code = (sum(len(p.findall(text)) for s, p in group if s in fold) for group in COUNTED)
    repeated = max(0, len(sents) - len(dedupe_segments(sents, memo)))
    plus = min(size, MAX_ARTICLE_CHARS) * 0.12 + len(sents) * 32 + len(NO_LETTERS.sub("", text)) / max(1, size) * 170
    minus = phrases * 180 + code * 260 + mojibake_count(text) * 85 + repeated * 130
    few = sum(1 for _ in islice(TOKEN.finditer(text), 40)) < 40 and len(SIGN.findall(text)) // 2 < 40
    return plus - minus - ((320 if size < 160 else 0) + (120 if few else 0) + (140 if len(sents) < 2 else 0))


def pick_best(candidates: list[str | None], memo: Memo) -> str:
    """T20, O14."""
    texts = dict.fromkeys(t for t in (filter_noise(c, memo) for c in dict.fromkeys(map(clean, candidates))) if t)
    # of equal texts the first counts, and only a choice needs scores
    best = max(texts, key=lambda t: (score(t, memo), len(t))) if len(texts) > 1 else next(iter(texts), "")
    return best[:MAX_ARTICLE_CHARS]


def mostly_links(text: str, links: str) -> bool:
    """E5 on clean texts."""
    return links != "" and len(text) < LINK_CHARS and len(links) / max(1, len(text)) > LINK_SHARE


def segments(block: dict, memo: Memo) -> list[str]:
    """E6, as ``html.segments``."""
    least = block["least"]
    said = []
    for p in block["paragraphs"]:
        text = clean(p["text"])
        if len(text) >= least and not mostly_links(text, clean(p["links"])) and not boilerplate(text.lower(), _fold(text)):
            said.append(text)
    if not said:
        said = [t for t in map(clean, block["lines"]) if len(t) >= max(IN_LINE, least) and not boilerplate(t.lower(), _fold(t))]
    return dedupe_segments(said, memo)


def candidate(found: list[str]) -> str:
    """Of segments, which are clean and no boilerplate."""
    return clean(" ".join([s for s in found if len(s) >= SEGMENT and not note(s, s.lower(), _fold(s))]))


def candidates(read: dict, memo: Memo) -> list[str]:
    """E8's candidates, as ``html.candidates``."""
    bodies = dedupe_segments([t for t in map(clean, read["bodies"]) if len(t) >= BODY], memo)
    text = clean(read["body"])
    return [c for c in (*bodies, *[candidate(segments(b, memo)) for b in (*read["blocks"], read["page"])], text if len(text) >= PAGE else "") if c]


def text_of(data: bytes | None) -> str | None:
    """The text if it is for Python to read."""
    try:
        text = bytes(data or b"").decode()
    except UnicodeDecodeError:
        return None
    return text if readable(text) else None


@F.pandas_udf(T.StringType())
def filtered(col: pd.Series) -> pd.Series:
    """T18 of texts, given as bytes."""
    return pd.Series([None if t is None else filter_noise(clean(t), Memo()) for t in map(text_of, col)], dtype=object)


@F.pandas_udf(T.StringType())
def picked(col: pd.Series) -> pd.Series:
    """T20 of arrays of candidates, given as bytes."""

    def one(row) -> str | None:
        texts = [text_of(c) for c in (row if row is not None else ())]
        return None if None in texts else pick_best(texts, Memo())

    return pd.Series([one(r) for r in col], dtype=object)
