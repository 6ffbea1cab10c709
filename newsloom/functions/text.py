"""Column functions over text: normalisation, counting, splitting and detection. All but unescape stay in the JVM.

"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = r"[\s\p{Z}\x1c-\x1f\x85]"
WORD = r"[\p{L}\p{N}_]"
#: A word with inner apostrophes and hyphens.
TOKEN = rf"{WORD}(?:[\p{{L}}\p{{N}}_'-]*{WORD})?"
LEFT, RIGHT = rf"(?<!{WORD})", rf"(?!{WORD})"
CJK = r"[一-鿿぀-ヿ가-힣]"
CJK_WIDE = r"[㐀-䶿一-鿿豈-﫿぀-ヿ가-힯]"
SENTENCE_END = r"(?<=[.!?…。！？؟])\s*"

# --- fixed values (word lists and patterns whose members decide results) ---------------------------------

MOJIBAKE_SINGLE = ("â", "Ã", "Â", "ã\u0080", "ã\u0081", "ã\u0082", "ã\u0083", "ä¸", "å­", "æ\u0097", "ð\u009f")
MOJIBAKE_SEQUENCES = ("ÄŸ", "Äž", "Ä±", "Ä°", "ÅŸ", "Åž", "Ã¼", "Ãœ", "Ã¶", "Ã–", "Ã§", "Ã‡", "Ã¢", "Ãª", "Ã®", "Ã»", "â€™", "â€œ", "â€", "â€“", "â€”", "â€¦")
MOJIBAKE_PATTERNS = (r"[ÂÃâã][\u0080-¿]", r"[ä-é][\u0080-¿]{2,}")
BOILERPLATE = (
    r"cookie(?:s)?", r"privacy policy", r"terms of use", r"subscribe", r"subscription", r"newsletter", r"advertisement", r"sponsored", r"sign in", r"log in",
    r"most read", r"related (?:articles?|stories)", r"share this", r"click here", r"çerez(?:ler)?", r"gizlilik politikası", r"kullanım koşulları",
    r"kişisel veriler(?:in korunması)?", r"abone ol", r"üye ol", r"reklam", r"sponsorlu", r"daha fazla oku", r"en çok okunanlar", r"accessibility links",
    r"open navigation menu", r"close navigation menu", r"expand/collapse submenu", r"skip to main content", r"skip to content", r"skip links?",
    r"keyboard shortcuts for audio player", r"npr shop", r"reklamsız cumhuriyet", r"cumhuriyet tv", r"son dakika türkiye haberleri", r"gram altın",
)
BOILERPLATE_OPEN = (r"dolar\s+\d", r"euro\s+\d", r"sterlin\s+\d", r"bitcoin\s+\d")
NAV_SHORT = ("haberler", "video", "foto(?:ğraf|galeri)", "canlı", "gündem", "ekonomi", "spor", "weather", "travel", "menu")
NAV_WORDS = (
    "home", "news", "national", "world", "politics", "business", "health", "science", "climate", "culture", "books", "movies", "television", "music",
    "podcasts", "shows", "newsletters", "shop", "gündem", "yazarlar", "siyaset", "ekonomi", "dünya", "yaşam", "kültür", "sanat", "eğitim", "teknoloji",
    "yerel", "egazete", "reklamsız", "cumhuriyet",
)
CODE_NOISE = (
    r"/\*!\s*sc\*/", rf"{LEFT}data-styled{RIGHT}", rf"{LEFT}object-fit\s*:", rf"{LEFT}font-family\s*:", rf"{LEFT}position\s*:\s*(?:absolute|relative|fixed){RIGHT}",
    r"@media\s+screen", rf"{LEFT}display\s*:\s*(?:block|flex|grid){RIGHT}", r'\{"@context"', r'"@context"\s*:\s*"https?://schema\.org"',
    r'"@type"\s*:\s*"(?:liveblogposting|newsarticle|imageobject|breadcrumblist|organization)"', r'"contenturl"\s*:',
    rf"<(?:div|a|span|li|ul|script|style){RIGHT}", rf"<path{RIGHT}", rf"{LEFT}currentcolor{RIGHT}", rf"{LEFT}aria-label\s*=", rf"{LEFT}datetime\s*=",
)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


# --- normalisation ---------------------------------------------------------------------------------


def collapse(text: Column) -> Column:
    """Null is empty; white space becomes single spaces, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", " "))


def without_references(value: str, rounds: int) -> str:
    import html

    for _ in range(rounds):
        value, before = html.unescape(value), value
        if value == before:
            break
    return value


@F.pandas_udf(T.StringType())
def _unescaped(col: pd.Series, rounds: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else without_references(v, n) for v, n in zip(col, rounds, strict=True)], dtype=object)


def unescape(text: Column, rounds: int = 1) -> Column:
    """HTML character references, up to ``rounds`` times. Of a text without & only a null goes to the Python worker and comes back."""
    return F.when(F.contains(text, F.lit("&")), _unescaped(F.when(F.contains(text, F.lit("&")), text), F.lit(rounds))).otherwise(text)


def normalize(text: Column) -> Column:
    """One round of unescape, then collapse."""
    return collapse(unescape(F.coalesce(text, F.lit(""))))


def without_controls(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("​"), F.lit(" ")), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]", " ")


def clean(text: Column) -> Column:
    """T5 for text that has no mojibake and no character references: zero-width and control characters, then white space."""
    return collapse(without_controls(F.coalesce(text, F.lit(""))))


def strip_html(text: Column) -> Column:
    """Tags become spaces."""
    return clean(F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", " "))


# --- counts -------------------------------------------------------------------------------------------


def occurrences(text: Column, part: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / F.lit(len(part))


def mojibake_count(text: Column) -> Column:
    """Overlapping on purpose; every marker, sequence and pattern counts by itself."""
    parts = [occurrences(text, m) for m in (*MOJIBAKE_SINGLE, *MOJIBAKE_SEQUENCES)] + [F.regexp_count(text, F.lit(p)) for p in MOJIBAKE_PATTERNS]
    firsts = "".join(sorted({m[0] for m in (*MOJIBAKE_SINGLE, *MOJIBAKE_SEQUENCES)}))
    return F.when(text.rlike(f"[{firsts}ä-é]"), reduce(lambda a, b: a + b, parts)).otherwise(0).cast("long")


#: Letters that patterns take for ASCII ones when they ignore case, and these.
FOLDED = ("İıſK", "iisk")


def stem(pattern: str) -> str:
    """The literal beginning of a pattern, in lower case: a text without it has no match."""
    out, rest = "", pattern.removeprefix(LEFT).removeprefix("(?:").removeprefix(LEFT)
    while rest:
        if rest[0] == "\\" and len(rest) > 1 and not rest[1].isalnum():
            out, rest = out + rest[1], rest[2:]
        elif rest[0] in "\\([.|^$)":
            return "" if rest[0] == "|" else out
        elif rest[0] in "?*{":
            return out[:-1]
        elif rest[0] == "+":
            return out
        else:
            out, rest = out + rest[0], rest[1:]
    return out


def hits(text: Column, patterns) -> Column:
    """Matches of all patterns, ignoring case, each counted by itself; a pattern is tried only where its stem occurs."""

    def total(low: Column) -> Column:
        counts = []
        for p in patterns:
            count = F.regexp_count(text, F.lit(f"(?iu){p}"))
            counts.append(F.when(low.contains(s), count).otherwise(0) if (s := stem(p).translate(str.maketrans(*FOLDED)).lower()) else count)
        return reduce(lambda a, b: a + b, counts)

    return let(F.lower(F.translate(text, *FOLDED)), total)


def cjk_count(text: Column) -> Column:
    """T7."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(CJK))


def word_like_count(text: Column) -> Column:
    """Words with inner apostrophes and hyphens, or half the CJK characters if those are more. ``text`` is clean."""
    return F.greatest(F.regexp_count(text, F.lit(TOKEN)), F.floor(cjk_count(text) / 2).cast("int"))


def token_like_count(text: Column) -> Column:
    """CJK characters (wider class) one by one, and the words of the rest."""
    t = collapse(text)
    return F.regexp_count(t, F.lit(CJK_WIDE)) + F.regexp_count(F.regexp_replace(t, CJK_WIDE, " "), F.lit(f"{WORD}+"))


def sentences(text: Column) -> Column:
    """Split behind closing marks (also inside 3.14); the whole text if nothing is left. ``text`` is clean."""
    parts = F.filter(F.transform(F.split(text, SENTENCE_END), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(text == "", F.array().cast("array<string>")).when(F.size(parts) == 0, F.array(text)).otherwise(parts)


def word_set(text: Column) -> Column:
    """Distinct lower-case words of more than two characters."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1)), lambda w: F.length(w) > 2))


def overlap(a: Column, b: Column) -> Column:
    """Shared part of the smaller of two word sets; null if one is empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b)))


def near_duplicate(a: Column, b: Column, threshold: float = 0.82) -> Column:
    """T12 on clean texts."""
    alike = let(F.struct(word_set(a).alias("a"), word_set(b).alias("b")), lambda s: F.coalesce(overlap(s["a"], s["b"]) >= threshold, F.lit(False)))
    return (a != "") & (b != "") & ((F.lower(a) == F.lower(b)) | alike)


# --- detection ---------------------------------------------------------------------------------------


def _any(text: Column, patterns) -> Column:
    return text.rlike("(?iu)(?:" + "|".join(patterns) + ")")


def code_noise(text: Column) -> Column:
    """T9."""
    n = lambda part: occurrences(text, part)
    braces = (n("{") + n("}") >= 2) & (n(";") >= 2) & (n(":") >= 3)
    objects = (n('{"') >= 2) & (n('":') >= 5)
    lists = (n('","') >= 5) & (n(":") >= 8)
    script = (F.length(text) <= 240) & text.rlike(rf"(?iu){LEFT}(?:function|const|let|var){RIGHT}")
    return (text != "") & (script | (text.contains(":") & (braces | objects | lists)) | _any(text, CODE_NOISE))


def boilerplate(text: Column) -> Column:
    """T10 on clean text: empty, code, a boilerplate phrase, a cluster of menu words, or a short line of menu words."""

    def test(low: Column) -> Column:
        words = F.split(low, " ")
        cluster = F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in NAV_WORDS]))) >= 6
        short = reduce(lambda a, b: a + b, [low.rlike(f"(?iu){LEFT}{p}{RIGHT}").cast("int") for p in NAV_SHORT]) >= 2
        phrase = _any(low, [f"{LEFT}(?:{'|'.join(BOILERPLATE)}){RIGHT}", f"{LEFT}(?:{'|'.join(BOILERPLATE_OPEN)})"])
        return (low == "") | ((F.length(low) <= 64) & short) | ((F.length(low) <= 420) & cluster) | phrase | code_noise(low)

    return let(F.lower(text), test)


def sentence_ending(text: Column) -> Column:
    """A closing mark, perhaps with closing quotes or brackets behind it."""
    return F.rtrim(text).rlike(r"""[.!?…。！？؟]["'”’»)\]]*$""")


#: Month names and markers of publish dates.
MONTHS_TR = ("ocak", "subat", "şubat", "mart", "nisan", "mayis", "mayıs", "haziran", "temmuz", "agustos", "ağustos", "eylul", "eylül", "ekim", "kasim", "kasım", "aralik", "aralık")
MONTHS_EN = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
MARKERS = (
    "last updated", "updated:", "published:", "publish date", "publication date", "giriş tarihi", "yayınlanma tarihi", "yayinlanma tarihi", "güncelleme tarihi",
    "guncelleme tarihi", "son güncelleme", "son guncelleme", "oluşturulma tarihi", "olusturulma tarihi",
)
MARKERS_TR = ("giriş:", "yayınlanma:", "yayinlanma:", "güncellenme:", "guncellenme:", "saat:")
DATE_WORDS = ("date", "updated", "published", "giriş", "yayın", "yayin", "güncelle", "guncelle", "saat")
DATE_SHAPES = (r"[0-3]?\d[./-][0-1]?\d[./-](?:\d{4}|\d{2})", r"\d{4}[./-][0-1]?\d[./-][0-3]?\d", r"[0-2]?\d:[0-5]\d")


def datetime_like(text: Column) -> Column:
    """T14 on normalised text."""
    return _any(text, [f"{LEFT}(?:{'|'.join((*DATE_SHAPES, *MONTHS_TR, *MONTHS_EN))}){RIGHT}"])


def metadata_sentence(text: Column, language: str) -> Column:
    """T15 on normalised text: publish or update notes rather than prose."""
    markers = (*MARKERS, *MARKERS_TR) if language == "tr" else MARKERS

    def test(low: Column) -> Column:
        size = F.length(low)
        marked = _any(low, [m.replace(".", "[.]") for m in markers])
        short = (size <= 64) & (F.regexp_count(low, F.lit(TOKEN)) <= 7)
        named = _any(low, [f"{LEFT}(?:{'|'.join(DATE_WORDS)}){RIGHT}"])
        bare = low.rlike(rf"^(?:\d|{SPACE}|[:./|-])+$")
        dated = datetime_like(low)
        return F.when(low == "", True).when(size > 240, False).otherwise((marked & (size <= 110)) | (dated & (marked | short | named)) | bare)

    return let(F.lower(text), test)


# --- bytes and encodings: sequential trials, in Arrow UDFs ----------------------------------------------


def _cleaned(value: str) -> str:
    """T5 without the repair."""
    import html
    import re

    for _ in range(4):
        value, before = html.unescape(value), value
        if value == before:
            break
    value = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\u200b\xa0]", " ", value)
    return " ".join(value.split())


def _bad(value: str) -> int:
    import re

    return sum(value.count(m) for m in (*MOJIBAKE_SINGLE, *MOJIBAKE_SEQUENCES)) + sum(len(re.findall(p, value)) for p in MOJIBAKE_PATTERNS)


def _signs(value: str) -> int:
    return sum("\u4e00" <= c <= "\u9fff" or "\u3040" <= c <= "\u30ff" or "\uac00" <= c <= "\ud7a3" for c in value)


def _repaired(value: str | None) -> str:
    """T4: the reading as UTF-8 of the bytes that one of three encodings gives, with the fewest marks of damage."""
    value = value or ""
    found = [(_bad(value), -1, value)]
    for i, name in enumerate(("latin-1", "cp1252", "cp1254")) if found[0][0] else ():
        try:
            other = value.encode(name).decode("utf-8")
        except UnicodeError:
            continue
        if len(other) >= int(len(value) * 0.9) or _signs(other) >= 6:
            found.append((_bad(other), i, other))
    return min(found)[2]


@F.pandas_udf(T.StringType())
def repair_mojibake(col: pd.Series) -> pd.Series:
    return col.map(_repaired)


@F.pandas_udf(T.StringType())
def normalize_extracted(col: pd.Series) -> pd.Series:
    """References to the end, damage repaired, control characters and white space."""
    import html

    def full(value):
        value = value or ""
        for _ in range(4):
            value, before = html.unescape(value), value
            if value == before:
                break
        return _cleaned(_repaired(value))

    return col.map(full)


#: Encodings that are tried for East Asian pages, hints at them, and the weights of a reading.
CJK_ENCODINGS = ("cp932", "shift_jis", "euc-jp", "cp949", "euc-kr", "gb18030", "gbk", "big5")
CJK_HINTS = ("shift_jis", "shift-jis", "sjis", "cp932", "euc-jp", "iso-2022-jp", "cp949", "euc-kr", "gb18030", "gbk", "gb2312", "big5")


#: Weights of a reading: a character, a lost one, a mark of damage, valid UTF-8, an East Asian sign where they are expected, a Western encoding.
PER_CHAR, LOST, DAMAGE, VALID, ASIAN, WESTERN = 0.001, 8, 4, 6, 0.35, 1.5


def charset_of(header: Column) -> Column:
    """From a Content-Type header."""
    return F.regexp_extract(F.coalesce(header, F.lit("")), r"(?i)charset\s*=\s*([A-Za-z0-9._-]+)", 1)


def _meta_charset(data: bytes) -> str:
    """From the first 16 KB of a page."""
    import re

    m = re.search(rb"""(?is)<meta\b[^>]*?charset\s*=\s*["']?\s*([A-Za-z0-9._-]+)""", data[:16384])
    return m[1].decode().lower() if m else ""


def _decoded(data: bytes | None, header: str | None, language: str | None) -> str:
    """The reading with the best score among declared, usual and, where hinted, East Asian encodings."""
    import re

    if not data:
        return ""
    found = re.search(r"(?i)charset\s*=\s*([A-Za-z0-9._-]+)", header or "")
    declared = [_meta_charset(data), found[1].lower() if found else ""]
    language = (language or "").lower()
    asian = language in ("ja", "ko", "zh")
    names = [*declared, "utf-8", "cp1254", "cp1252", "latin-1"]
    if asian or not language and any(h in d for d in declared for h in CJK_HINTS):
        names += CJK_ENCODINGS
    try:
        data.decode("utf-8")
        valid = True
    except UnicodeDecodeError:
        valid = False

    def score(name: str, value: str) -> float:
        signs = _signs(value)
        total = len(value) * PER_CHAR - LOST * value.count("\ufffd") - DAMAGE * _bad(value) + VALID * (name == "utf-8" and valid)
        kana, hangul = len(re.findall("[\u3040-\u30ff]", value)), len(re.findall("[\uac00-\ud7af]", value))
        if asian:
            total += ASIAN * signs
            if language == "ja" and hangul > 12 and hangul > 0.6 * kana:
                total -= min(420.0, 8.0 * hangul)
        else:
            mixed = len(re.findall("[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]", value))
            total -= (min(420.0, 6.0 * signs) if signs > 8 else 0) + (min(320.0, 14.0 * mixed) if mixed >= 3 else 0)
        return total - (WESTERN if name in ("latin-1", "iso-8859-1", "cp1252") and not signs else 0)

    readings = []
    for name in dict.fromkeys(filter(None, names)):
        try:
            value = _cleaned(_repaired(data.decode(name, "replace")))
        except LookupError:
            continue
        if value:
            readings.append((score(name, value), -len(readings), value))
    return max(readings)[2] if readings else ""


@F.pandas_udf(T.StringType())
def decode_html(data: pd.Series, header: pd.Series, language: pd.Series) -> pd.Series:
    return pd.Series([_decoded(*row) for row in zip(data, header, language, strict=True)], dtype=object)
