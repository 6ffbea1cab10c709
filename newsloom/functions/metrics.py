"""Summary metrics as column expressions (M1 to M15), and the three that need dynamic programming as Arrow UDFs."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions.text import CJK, collapse, let

SEP = "\x01"


def tokens(text: Column) -> Column:
    """M1: lower case; each CJK character is a token, in order; other tokens may hold inner ' and -."""
    sign = r"[\p{L}\p{N}_'\-]"
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"[{sign}&&{CJK}]|[{sign}&&[^{CJK[1:]}]+"), F.lit(0))


def sentences(text: Column) -> Column:
    """M2: without the ellipsis among the closing marks."""
    t = collapse(text)
    parts = F.filter(F.transform(F.split(t, r"(?<=[.!?。！？؟])\s*"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(t == "", F.array().cast("array<string>")).otherwise(parts)


def ngrams(toks: Column, n: int) -> Column:
    """M3: each as one string."""
    if n == 1:
        return toks
    return F.when(F.size(toks) >= n, F.transform(F.sequence(F.lit(1), F.size(toks) - (n - 1)), lambda i: F.array_join(F.slice(toks, i, n), SEP))).otherwise(F.array().cast("array<string>"))


def _tally(a: Column, b: Column, gain) -> Column:
    """Sum of ``gain(times in a, times in b)`` over the distinct items of both: one sort and one pass, whatever repeats."""
    sided = lambda xs, side: F.transform(xs, lambda x: F.struct(x.alias("x"), F.lit(side).alias("side")))
    state = lambda x, n, m, total: F.struct(x.alias("x"), n.alias("n"), m.alias("m"), total.alias("total"))

    def step(s: Column, e: Column) -> Column:
        n, m = F.when(e["side"] == 0, 1).otherwise(0), F.when(e["side"] == 1, 1).otherwise(0)
        again = s["x"] == e["x"]
        return state(e["x"], F.when(again, s["n"] + n).otherwise(n), F.when(again, s["m"] + m).otherwise(m), F.when(again, s["total"]).otherwise(s["total"] + gain(s["n"], s["m"])))

    both = F.array_sort(F.concat(sided(a, 0), sided(b, 1)))
    return F.aggregate(both, state(F.lit(""), F.lit(0), F.lit(0), F.lit(0)), step, lambda s: s["total"] + gain(s["n"], s["m"]))


def clipped(a: Column, b: Column) -> Column:
    """Size of the multiset intersection."""
    return _tally(a, b, F.least)


def prf(hits: Column, of_prediction: Column, of_reference: Column) -> tuple[Column, Column, Column]:
    """M4: precision, recall and F1; zero where there is nothing to divide by."""
    p = F.coalesce(F.try_divide(hits, of_prediction), F.lit(0.0))
    r = F.coalesce(F.try_divide(hits, of_reference), F.lit(0.0))
    return p, r, F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


@F.pandas_udf(T.StructType([T.StructField("one", T.IntegerType()), T.StructField("two", T.IntegerType())]))
def overlaps(ref: pd.Series, pred: pd.Series) -> pd.DataFrame:
    """Sizes of the multiset intersections of tokens and of 2-grams."""
    out = []
    for a, b in zip(ref, pred, strict=True):
        a, b = a.tolist(), b.tolist()
        out.append(((Counter(a) & Counter(b)).total(), (Counter(zip(a, a[1:], strict=False)) & Counter(zip(b, b[1:], strict=False))).total()))
    return pd.DataFrame(out, columns=["one", "two"], dtype="int32")


def rouge_n(ref: Column, pred: Column, n: int) -> tuple[Column, Column, Column]:
    """M5 on token arrays."""
    a, b = ngrams(ref, n), ngrams(pred, n)
    return prf(clipped(a, b), F.size(b), F.size(a))


def repetition(toks: Column, n: int) -> Column:
    """M9: share of n-grams that repeat an earlier one."""
    g = ngrams(toks, n)
    return F.coalesce(1 - F.try_divide(F.size(F.array_distinct(g)), F.size(g)), F.lit(0.0))


def novelty(summary: Column, source: Column, n: int) -> Column:
    """Share of the summary's n-gram occurrences that the source doesn't have. The shared ones are found once, by hashing."""

    return let(F.struct(ngrams(summary, n).alias("g"), ngrams(source, n).alias("s")), lambda x: novelty_of(x["g"], x["s"]))


def novelty_of(grams: Column, of_source: Column) -> Column:
    """M10 on n-grams of both sides."""
    held = _tally(grams, F.array_intersect(grams, of_source), lambda n, m: F.when(m > 0, n).otherwise(0))
    return F.coalesce(1 - F.try_divide(held, F.size(grams)), F.lit(0.0))


def new_share(held: Column, total: Column) -> Column:
    """M10 from the number of a summary's n-grams that the source has, and of all."""
    return F.coalesce(1 - F.try_divide(held, total), F.lit(0.0))


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def sentence_lengths(text: Column) -> Column:
    """Mean and population deviation of the sentences' token counts, as a struct."""
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)

    def both(n: Column) -> Column:
        mean = F.coalesce(F.try_divide(total(n), F.size(n)), F.lit(0.0))
        spread = lambda m: F.struct(m.alias("mean"), F.sqrt(F.coalesce(F.try_divide(total(F.transform(n, lambda x: (x - m) * (x - m))), F.size(n)), F.lit(0.0))).alias("std"))
        return let(mean, spread)

    return let(F.transform(sentences(text), lambda s: F.size(tokens(s)).cast("double")), both)


def ideal_length(mean: Column, language: Column) -> Column:
    """1 inside the band of the language, falling linearly outside."""
    dense = language.isin("zh", "ja", "ko")
    low, high = F.when(dense, 12.0).otherwise(8.0), F.when(dense, 45.0).otherwise(25.0)
    return F.when(mean <= 0, 0.0).when(mean < low, clamp01(mean / low)).when(mean > high, clamp01(1 - (mean - high) / high)).otherwise(1.0)


def syllables(word: Column) -> Column:
    """Groups of vowels, a silent final e not counted, one at least."""
    w = F.regexp_replace(F.lower(word), "[^a-z]", "")
    groups = F.regexp_count(w, F.lit("[aeiouy]+"))
    return F.when(w == "", 0).otherwise(F.greatest(F.lit(1), groups - F.when(w.endswith("e") & (groups > 1), 1).otherwise(0)))


def flesch(text: Column, language: Column) -> Column:
    """Reading ease, English only (null otherwise)."""
    words = F.filter(tokens(text), lambda t: t.rlike("[a-z]"))
    count, sents = F.size(words), F.greatest(F.size(sentences(text)), F.lit(1))
    syll = F.aggregate(words, F.lit(0), lambda a, w: a + syllables(w))
    return F.when((language == "en") & (count > 0), 206.835 - 1.015 * (count / sents) - 84.6 * (syll / count))


def _lcs(a: list[str], b: list[str]) -> int:
    """Longest common subsequence by bit vectors: one machine word operation covers a whole row of the table."""
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    return _lcs_of(at, len(a), b)


def _lcs_of(at: dict[str, int], n: int, b: list[str]) -> int:
    """M6 from the places of the tokens of a text of ``n``, as bits."""
    row = full = (1 << n) - 1
    for y in b:
        m = at.get(y)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return n - row.bit_count()


@F.pandas_udf(T.IntegerType())
def lcs_length(ref: pd.Series, pred: pd.Series) -> pd.Series:
    """M6."""
    return pd.Series([_lcs(list(a), list(b)) for a, b in zip(ref, pred, strict=True)], dtype="int32")


def _bleu(ref: list[str], pred: list[str]) -> float:
    """M7: sentence BLEU-4, exponential smoothing of orders without a match, brevity penalty; in 0 to 1."""
    grams = lambda t, n: Counter(zip(*(t[i:] for i in range(n)), strict=False))
    return _bleu_of([(grams(pred, n) & grams(ref, n)).total() for n in range(1, 5)], len(ref), len(pred))


def _bleu_of(matches: list[int], of_ref: int, of_pred: int) -> float:
    """M7 from the matches of each order and the numbers of tokens."""
    if not of_ref or not of_pred:
        return 0.0
    logs, halve = [], 1.0
    for n, hits in enumerate(matches, 1):
        total = of_pred - n + 1
        if total <= 0:
            break
        if not hits:
            halve *= 2
        logs.append(math.log(100 * hits / total if hits else 100 / (halve * total)))
    if len(logs) < 4:
        return 0.0
    brevity = 1.0 if of_pred >= of_ref else math.exp(1 - of_ref / of_pred)
    return brevity * math.exp(sum(logs) / 4) / 100


@F.pandas_udf(T.DoubleType())
def bleu(ref: pd.Series, pred: pd.Series) -> pd.Series:
    return pd.Series([_bleu(list(a), list(b)) for a, b in zip(ref, pred, strict=True)], dtype="float64")


def _meteor(ref: list[str], pred: list[str]) -> float:
    """M8: exact matches, each to the first free place of the reference; chunks are runs of the sorted places."""
    from collections import defaultdict

    free = defaultdict(list)
    for i in range(len(ref) - 1, -1, -1):
        free[ref[i]].append(i)
    return _meteor_of(sorted(free[t].pop() for t in pred if free.get(t)), len(ref), len(pred))


def _meteor_of(places: list[int], of_ref: int, of_pred: int) -> float:
    """M8 from the sorted places and the numbers of tokens."""
    if not places:
        return 0.0
    m = len(places)
    p, r = m / of_pred, m / of_ref
    chunks = 1 + sum(b != a + 1 for a, b in zip(places, places[1:], strict=False))
    return 10 * p * r / (r + 9 * p) * (1 - 0.5 * (chunks / m) ** 3)


@F.pandas_udf(T.DoubleType())
def meteor(ref: pd.Series, pred: pd.Series) -> pd.Series:
    return pd.Series([_meteor(list(a), list(b)) for a, b in zip(ref, pred, strict=True)], dtype="float64")


def _automaton(source: list[str]) -> list[dict[str, int]]:
    """The transitions of the suffix automaton: from state 0, exactly the pieces of the source can be read."""
    to: list[dict[str, int]] = [{}]
    link, size, last = [-1], [0], 0
    for token in source:
        new, at = len(to), last
        to.append({})
        size.append(size[last] + 1)
        link.append(0)
        while at >= 0 and token not in to[at]:
            to[at][token] = new
            at = link[at]
        if at >= 0:
            known = to[at][token]
            if size[known] == size[at] + 1:
                link[new] = known
            else:  # the shorter pieces of ``known`` get a state of their own
                copy = len(to)
                to.append(dict(to[known]))
                size.append(size[at] + 1)
                link.append(link[known])
                while at >= 0 and to[at].get(token) == known:
                    to[at][token] = copy
                    at = link[at]
                link[known] = link[new] = copy
        last = new
    return to


def _pieces(to: list[dict[str, int]], summary: list[str]) -> tuple[float, float]:
    """From left to right the longest piece that the source has too; its words' share, and squared lengths per word."""
    if not summary or not to[0]:
        return 0.0, 0.0
    at, covered, squares = 0, 0, 0
    while at < len(summary):
        state, best = 0, 0
        while at + best < len(summary) and (new := to[state].get(summary[at + best])) is not None:
            state, best = new, best + 1
        covered, squares, at = covered + best, squares + best * best, at + max(1, best)
    return covered / len(summary), squares / len(summary)


def _reduced(source: list[str], used: set[str]) -> list[str | None]:
    """The source with one None in place of each stretch of words that no summary has: the pieces of a summary are the same."""
    out: list[str | None] = []
    for token in source:
        if token in used:
            out.append(token)
        elif out and out[-1] is not None:
            out.append(None)
    return out


@lru_cache(maxsize=65536)
def _parts_words(sign: str) -> bool:
    """Whether a character other than white space is no part of a token."""
    return not (sign.isalnum() or sign in "_'-" or sign.isspace())


_CJK, _CJK_TOKENS = re.compile(CJK), re.compile(rf"(?={CJK})\w|(?:(?!{CJK})[\w'-])+")
_ASCII = {c: " " for c in range(128) if _parts_words(chr(c))}


def words(text: str) -> list[str]:
    """M1's tokens of a text in lower case. Without CJK characters they are what is left when other signs are blanks: many times faster than a search."""
    if text.isascii():
        return text.translate(_ASCII).split()
    if _CJK.search(text):
        return _CJK_TOKENS.findall(text)
    for sign in set(text):
        if _parts_words(sign):
            text = text.replace(sign, " ")
    return text.split()


_HELD = [T.StructField(k, T.IntegerType()) for k in ("distinct", "shared", "held1", "held2")]
_PIECES = [T.StructField(k, T.DoubleType()) for k in ("coverage", "density")]


def _held(source: list[str], near: list[str | None], many: list[list[str]]) -> list[dict]:
    """``near``: the source as ``_reduced`` by all its summaries, which has the tokens and 2-grams that a summary can share."""
    known, pairs = set(source), set(zip(near, near[1:], strict=False))
    return [{"distinct": len(known), "shared": len(known.intersection(b)), "held1": sum(x in known for x in b), "held2": sum(p in pairs for p in zip(b, b[1:], strict=False))} for b in many]


def _cut(to: list[dict[str, int]], many: list[list[str]]) -> list[dict]:
    return [dict(zip(("coverage", "density"), _pieces(to, b), strict=True)) for b in many]


@F.pandas_udf(T.ArrayType(T.StructType(_PIECES)))
def fragments_of(source: pd.Series, summaries: pd.Series) -> pd.Series:
    """M11 of each summary of a source, whose automaton is made once and of the summaries' words only."""
    out = []
    for a, many in zip(source, summaries, strict=True):
        many = [list(b) for b in many]
        out.append(_cut(_automaton(_reduced(a.tolist(), set().union(*many))), many))
    return pd.Series(out)


@F.pandas_udf(T.ArrayType(T.StructType(_HELD)))
def held_by(source: pd.Series, summaries: pd.Series) -> pd.Series:
    """Of each summary of a source: the source's distinct tokens, those of them that the summary has, and the summary's tokens and 2-grams that the source has."""
    out = []
    for a, many in zip(source, summaries, strict=True):
        a, many = a.tolist(), [list(b) for b in many]
        out.append(_held(a, _reduced(a, set().union(*many)), many))
    return pd.Series(out)


#: Tokens of a source times those of a summary beyond which the source's automaton is read: it takes linear time whatever repeats.
MANY = 1 << 22


def _found(source: list[str], many: list[list[str]], pieces: bool) -> list[dict]:
    """``_held`` and ``_cut`` of each summary of a source, from sets and searches of the source."""
    known, pairs, text, to, out = set(source), set(zip(source, source[1:], strict=False)), f" {' '.join(source)} ", None, []
    for b in many:
        row = {"distinct": len(known), "shared": len(known.intersection(b)), "held1": sum(map(known.__contains__, b)), "held2": sum(map(pairs.__contains__, zip(b, b[1:], strict=False)))}
        if pieces:
            if len(source) * len(b) > MANY:
                to = to or _automaton(_reduced(source, set().union(*many)))
                row["coverage"], row["density"] = _pieces(to, b)
            else:
                row["coverage"], row["density"] = _searched(text, known, pairs, b)
        out.append(row)
    return out


def _searched(text: str, known: set[str], pairs: set[tuple[str, str]], b: list[str]) -> tuple[float, float]:
    """``_pieces`` by searches: a piece with one more token is no earlier in the text than the piece."""
    at, covered, squares, end = 0, 0, 0, len(b)
    while at < end:
        best = 0
        if b[at] in known:
            best = 1
            if at + 1 < end and (b[at], b[at + 1]) in pairs:
                best, piece = 2, f" {b[at]} {b[at + 1]} "
                place = text.find(piece)
                while at + best < end:
                    piece += b[at + best] + " "
                    place = text.find(piece, place)
                    if place < 0:
                        break
                    best += 1
        covered, squares, at = covered + best, squares + best * best, at + max(1, best)
    return (covered / end, squares / end) if end else (0.0, 0.0)


def _structs(rows: list[dict], fields: list[T.StructField]) -> pa.StructArray:
    """Columns of Arrow: no table of pandas in between."""
    kinds = {"int": pa.int32(), "double": pa.float64()}
    return pa.StructArray.from_arrays([pa.array([x[f.name] for x in rows], kinds[f.dataType.simpleString()]) for f in fields], names=[f.name for f in fields])


def _read(source: pa.Array, summaries: pa.Array, pieces: bool) -> pa.StructArray:
    n, ends, out = [], [0], []
    for text, texts in zip(source.to_pylist(), summaries.to_pylist(), strict=True):
        a = words(text)
        n.append(len(a))
        out += _found(a, [words(t) for t in texts], pieces)
        ends.append(len(out))
    made = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _structs(out, [*_HELD, *_PIECES] if pieces else _HELD))
    return pa.StructArray.from_arrays([pa.array(n, pa.int32()), made], names=["n", "made"])


@F.arrow_udf(T.StructType([T.StructField("n", T.IntegerType()), T.StructField("made", T.ArrayType(T.StructType(_HELD)))]))
def text_held_by(source: pa.Array, summaries: pa.Array) -> pa.Array:
    """The number of a text's tokens, and ``held_by`` of each of its summaries, from texts in lower case: no token array of a source leaves or enters the JVM."""
    return _read(source, summaries, False)


@F.arrow_udf(T.StructType([T.StructField("n", T.IntegerType()), T.StructField("made", T.ArrayType(T.StructType([*_HELD, *_PIECES])))]))
def text_held_by_pieces(source: pa.Array, summaries: pa.Array) -> pa.Array:
    """``text_held_by`` with M11."""
    return _read(source, summaries, True)


@lru_cache(maxsize=65536)
def _sounds(word: str) -> int:
    """``syllables``; 0 of a token without a-z."""
    w = re.sub("[^a-z]", "", word)
    groups = len(re.findall("[aeiouy]+", w))
    return max(1, groups - (groups > 1 and w.endswith("e"))) if w else 0


def _sizes(low: str) -> list[int]:
    """Tokens of each sentence: a mark ends one; what follows the last mark is one if it isn't blank."""
    for sign in "!?" if low.isascii() else "!?。！？؟":
        low = low.replace(sign, ".")
    *ended, rest = low.split(".")
    return [len(words(p)) for p in (*ended, rest)] if rest.strip() else [len(words(p)) for p in ended]


def _style(low: str, toks: list[str], english: bool) -> dict:
    """M9 of 3-grams, M12 and M14 (English only) of a summary in lower case."""
    sizes = _sizes(low)
    mean = sum(sizes) / len(sizes) if sizes else 0.0
    squares = 0.0
    for n in sizes:
        squares += (n - mean) * (n - mean)
    flesch_ = None
    sounds = [x for x in map(_sounds, toks) if x] if english else []
    if sounds:
        flesch_ = 206.835 - 1.015 * (len(sounds) / max(1, len(sizes))) - 84.6 * (sum(sounds) / len(sounds))
    return {"mean": mean, "std": math.sqrt(squares / len(sizes)) if sizes else 0.0, "flesch": flesch_, "repetition": _repeated(toks)}


def _repeated(toks: list[str]) -> float:
    """M9 of 3-grams."""
    n = len(toks) - 2
    return 1 - len(set(zip(toks, toks[1:], toks[2:], strict=False))) / n if n > 0 else 0.0


class _Reference:
    """A reference's tokens, their places and how often it has each n-gram of 2 to ``orders`` tokens, made once for all its summaries."""

    def __init__(self, low: str, orders: int):
        self.low, self.tokens = low, words(low)
        self.places: dict[str, list[int]] = {}
        for i, x in enumerate(self.tokens):
            self.places.setdefault(x, []).append(i)
        self.bits = {x: sum(1 << i for i in at) for x, at in self.places.items()} if orders > 2 else {}
        self.times = [Counter(zip(*(self.tokens[i:] for i in range(n)), strict=False)) for n in range(2, orders + 1)]

    def matched(self, b: list[str]) -> list[int]:
        """M8's matches: each token of the summary to the first free place, in the summary's order."""
        out, taken = [], {}
        for x in b:
            at = self.places.get(x)
            if at:
                k = taken.get(x, 0)
                if k < len(at):
                    taken[x] = k + 1
                    out.append(at[k])
        return out

    def hits(self, one: int, b: list[str]) -> list[int]:
        """Sizes of the multiset intersections with a summary's n-grams, of which ``one`` are of single tokens; where an order has none, higher ones have none."""
        out = [one]
        for n, times in enumerate(self.times, 2):
            hits, seen = 0, {}
            if out[-1]:
                for g in zip(*(b[i:] for i in range(n)), strict=False):
                    if g in times:
                        k = seen.get(g, 0)
                        if k < times[g]:
                            seen[g] = k + 1
                            hits += 1
            out.append(hits)
        return out


def _compared(ref: pa.Array, pred: pa.Array, orders: int) -> Iterator[tuple[_Reference, list[str], list[int], list[int], dict]]:
    known = None
    for low, other in zip(ref.to_pylist(), pred.to_pylist(), strict=True):
        if known is None or known.low != low:  # summaries of one reference follow one another
            known = _Reference(low, orders)
        b = words(other)
        places = known.matched(b)
        hits = known.hits(len(places), b)
        yield known, b, places, hits, {"r": len(known.tokens), "g": len(b), "distinct": len(set(b)), "one": hits[0], "two": hits[1]}


_SIZES = [T.StructField(k, T.IntegerType()) for k in ("r", "g", "distinct", "one", "two")]


_COMPARED = [*_SIZES, T.StructField("repetition", T.DoubleType())]
_FULLY = [*_SIZES, *[T.StructField(k, T.DoubleType()) for k in ("repetition", "mean", "std", "flesch", "bleu", "meteor")], T.StructField("lcs", T.IntegerType())]


@F.arrow_udf(T.StructType(_COMPARED))
def compared(ref: pa.Array, pred: pa.Array) -> pa.Array:
    """From texts in lower case: numbers of tokens of both, distinct ones of the summary, tokens and 2-grams shared, M9."""
    return _structs([x | {"repetition": _repeated(b)} for _, b, _, _, x in _compared(ref, pred, 2)], _COMPARED)


@F.arrow_udf(T.StructType(_FULLY))
def compared_fully(ref: pa.Array, pred: pa.Array, english: pa.Array) -> pa.Array:
    """``compared`` with M6, M7, M8, M12 and M14: a summary's tokens are made once for all of them."""
    rows = [
        x | _style(low, b, en) | {"bleu": _bleu_of(hits, len(a.tokens), len(b)), "meteor": _meteor_of(sorted(places), len(a.tokens), len(b)), "lcs": _lcs_of(a.bits, len(a.tokens), b)}
        for (a, b, places, hits, x), low, en in zip(_compared(ref, pred, 4), pred.to_pylist(), english.to_pylist(), strict=True)
    ]
    return _structs(rows, _FULLY)


def _fragments(source: list[str], summary: list[str]) -> tuple[float, float]:
    return _pieces(_automaton(source), summary)


@F.pandas_udf(T.StructType([T.StructField("coverage", T.DoubleType()), T.StructField("density", T.DoubleType())]))
def fragments(source: pd.Series, summary: pd.Series) -> pd.DataFrame:
    out, known, to = [], None, [{}]
    for a, b in zip(source, summary, strict=True):
        if (tokens_ := list(a)) != known:  # rows of one source follow one another
            known, to = tokens_, _automaton(tokens_)
        out.append(_pieces(to, list(b)))
    return pd.DataFrame(out, columns=["coverage", "density"], dtype="float64")
