"""Training-time metrics and labels (M18, D9): stems by Porter's rules, ROUGE on stems, and truncated, padded and masked token arrays."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions import metrics as m

# --- fixed values: Porter's suffixes, steps 2 to 4 --------------------------------------------------
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
#: Words of so many letters stay as they are.
SHORT = 3
#: What labels have in place of padding, so that it doesn't count.
IGNORED = -100


def _form(word: str) -> str:
    """v for a vowel, c for a consonant; y is a vowel behind a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or ch == "y" and out.endswith("c") else "c"
    return out


def _measure(word: str) -> int:
    """How many times vowels are followed by consonants."""
    return _form(word).count("vc")


def _short_end(word: str) -> bool:
    """Consonant, vowel, consonant (not w, x, y) at the end."""
    return _form(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _longest(word: str, suffixes) -> str:
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """Porter's stem of a lower-case word."""
    if len(word) <= 2:
        return word
    # plurals
    for suffix, put in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix):
            word = word[: -len(suffix)] + put
            break
    # past and present participles
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    else:
        for suffix in ("ed", "ing"):
            base = word[: -len(suffix)]
            if word.endswith(suffix) and "v" in _form(base):
                if base.endswith(("at", "bl", "iz")):
                    base += "e"
                elif len(base) > 1 and base[-1] == base[-2] and _form(base)[-1] == "c" and base[-1] not in "lsz":
                    base = base[:-1]
                elif _measure(base) == 1 and _short_end(base):
                    base += "e"
                word = base
                break
    if word.endswith("y") and "v" in _form(word[:-1]):
        word = word[:-1] + "i"
    for table in (STEP2, STEP3):
        suffix = _longest(word, table)
        if suffix and _measure(word[: -len(suffix)]):
            word = word[: -len(suffix)] + table[suffix]
    suffix = _longest(word, STEP4)
    if suffix and _measure(word[: -len(suffix)]) > 1 and (suffix != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(suffix)]
    if word.endswith("e") and (_measure(word[:-1]) > 1 or _measure(word[:-1]) == 1 and not _short_end(word[:-1])):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


@F.pandas_udf(T.ArrayType(T.StringType()))
def stemmed(words: pd.Series) -> pd.Series:
    return pd.Series([None if w is None else [stem(x) if len(x) > SHORT else x for x in w] for w in words], dtype=object)


def words(text: Column) -> Column:
    """Lower-case runs of a to z and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def rouge(reference: Column, prediction: Column) -> dict[str, Column]:
    """ROUGE-1, -2 and -L F1 in per cent of two columns of (stemmed) words."""
    f = lambda n: m.rouge_n(reference, prediction, n)[2]
    return {"rouge1": 100 * f(1), "rouge2": 100 * f(2), "rougeL": 100 * m.prf(m.lcs_length(reference, prediction), F.size(prediction), F.size(reference))[2]}


# --- D9: token arrays --------------------------------------------------------------------------------


def truncated(ids: Column, most: int, end: int | None = None) -> Column:
    """At most ``most`` tokens; with ``end``, that token is the last one in any case."""
    if end is None:
        return F.slice(ids, 1, most)
    return F.concat(F.slice(ids, 1, most - 1), F.array(F.lit(end)))


def padded(ids: Column, size: int, pad: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad), F.greatest(F.lit(0), size - F.size(ids))))


def mask(ids: Column, size: int) -> Column:
    """1 for each token and 0 for padding."""
    return F.concat(F.array_repeat(F.lit(1), F.least(F.lit(size), F.size(ids))), F.array_repeat(F.lit(0), F.greatest(F.lit(0), size - F.size(ids))))


def labels(ids: Column, size: int, pad: int) -> Column:
    """Padded labels, padding ignored."""
    return F.transform(padded(ids, size, pad), lambda x: F.when(x == pad, IGNORED).otherwise(x))


def readable(ids: Column, pad: int) -> Column:
    """Labels back to tokens: what is ignored is padding."""
    return F.transform(ids, lambda x: F.when(x == IGNORED, pad).otherwise(x))


def length(ids: Column, pad: int) -> Column:
    """M18's length: tokens that are no padding."""
    return F.size(F.filter(ids, lambda x: x != pad))
