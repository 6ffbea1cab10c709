"""Article text: sequential cleaning, scoring and extractive summaries, as folds over sentence arrays (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions import prose
from newsloom.functions import text as tx
from newsloom.functions.prose import MAX_ARTICLE_CHARS

NOTHING = "cast(array() as array<struct<s: string, low: string, words: array<string>, bits: bigint>>)"
#: Clean-up patterns for every source, by source key and by site.
CLEANUP = (
    "(?<![\\p{L}\\p{N}_])(read more|continue reading|devamı için tıklayın)(?![\\p{L}\\p{N}_])",
    "(?<![\\p{L}\\p{N}_])(this is a developing story|story continues below)(?![\\p{L}\\p{N}_])",
    "(?<![\\p{L}\\p{N}_])follow us on (?:twitter|x|facebook|instagram|telegram)(?![\\p{L}\\p{N}_])",
    "(?<![\\p{L}\\p{N}_])join our (?:newsletter|channel)(?![\\p{L}\\p{N}_])",
    "(?<![\\p{L}\\p{N}_])related (?:stories|news|articles?)(?![\\p{L}\\p{N}_])",
    "(?:menu|メニュー)\\s*(?:close|閉じる)",
)
CLEANUP_BY_SITE = {
    "bbc.com": ("get all the latest .*? on the bbc", "listen to this article"),
    "cnn.com": ("watch this video", "cnn's .*? newsletter"),
    "hurriyet.com.tr": ("hürriyet\\.com\\.tr'ye dön", "son dakika haberleri için tıklayınız"),
    "ntv.com.tr": ("ntv uygulamasını indir",),
    "trthaber.com": ("trt haber mobil uygulamasını",),
    "vnexpress.net": ("xem thêm",),
}
CLEANUP_BY_SOURCE = {
    "tr_hurriyet": ("Hürriyet Gazetecilik ve Matbaacılık A\\.Ş\\.", "Hürriyet Son Dakika"),
    "tr_ntv": ("ntv\\.com\\.tr farkıyla",),
    "fr_lemonde": ("le monde avec afp",),
    "de_spiegel": ("spiegel\\+ abonnieren",),
    "es_elpais": ("lea también",),
    "it_repubblica": ("continua a leggere",),
    "ru_ria": ("читайте также",),
    "ja_nhk": ("NHK NEWS WEB",),
}


def _profiled(segments: Column) -> Column:
    """Each segment with what comparisons need, computed once; a bit of ``bits`` is set if a word has that hash."""
    bits = lambda words: F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a.bitwiseOR(_bit(w)))
    return F.transform(segments, lambda s: tx.let(tx.word_set(s), lambda words: F.struct(s.alias("s"), F.lower(s).alias("low"), words.alias("words"), bits(words).alias("bits"))))


def _bit(word: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(word), F.lit(64)).cast("int"))


def _may_share(a: Column, b: Column, threshold: float) -> Column:
    """False only where too many words of one can't be in the other: a bit that it lacks is a word that it lacks."""
    left = lambda x, y: F.size(x["words"]) - F.bit_count(x["bits"].bitwiseAND(F.bitwise_not(y["bits"])))
    return F.least(left(a, b), left(b, a)) >= threshold * F.least(F.size(a["words"]), F.size(b["words"])) - 1e-9


def _alike(a: Column, b: Column, threshold: float) -> Column:
    return (a["low"] == b["low"]) | F.when(_may_share(a, b, threshold), F.coalesce(tx.overlap(a["words"], b["words"]) >= threshold, F.lit(False))).otherwise(False)


def unlike_recent(segments: Column, last: int, threshold: float) -> Column:
    """Keeps a segment if it is like none of the ``last`` kept before it."""

    def step(kept: Column, x: Column) -> Column:
        recent = F.slice(kept, F.greatest(F.lit(1), F.size(kept) - (last - 1)), F.lit(last))
        return F.when(F.exists(recent, lambda y: _alike(x, y, threshold)), kept).otherwise(F.concat(kept, F.array(x)))

    return F.transform(F.aggregate(_profiled(segments), F.expr(NOTHING), step), lambda x: x["s"])


def dedupe_segments(segments: Column) -> Column:
    return unlike_recent(F.filter(F.transform(segments, tx.clean), lambda s: s != ""), 8, 0.9)


def filter_noise(text: Column) -> Column:
    """T18 of a text, which is cleaned first: in Python; what that leaves, by columns."""
    return F.coalesce(prose.filtered(text.cast("binary")), tx.let(tx.clean(text), filter_noise_by_columns))


def filter_noise_by_columns(text: Column) -> Column:
    """T18 on clean text: sentences that are prose and new; the whole text when too little would be left."""
    chunks = F.flatten(F.transform(F.split(text, rf"{tx.SPACE}+\|{tx.SPACE}+"), lambda b: tx.sentences(tx.clean(b))))
    note = lambda s: (F.length(s) <= 140) & (tx.metadata_sentence(s, "en") | tx.metadata_sentence(s, "tr"))
    said = F.filter(chunks, lambda s: (F.length(s) >= 18) & ~tx.code_noise(s) & ~tx.boilerplate(s) & ~note(s))

    def choose(kept: Column) -> Column:
        little = F.length(kept) < F.greatest(F.lit(80), F.floor(F.length(text) * 0.35))
        return F.when(~little | (text == ""), kept).otherwise(F.when(tx.boilerplate(text), kept).otherwise(text))

    return tx.let(F.array_join(unlike_recent(said, 6, 0.92), " "), choose)


def score(text: Column) -> Column:
    """T19 on clean text."""
    size = F.length(text)
    letters = F.regexp_count(text, F.lit("[A-Za-zÀ-ÖØ-öø-ÿÇĞİÖŞÜçğıöşüА-Яа-я一-龯ぁ-んァ-ン]"))
    phrases = [f"{tx.LEFT}(?:{p}){tx.RIGHT}" for p in tx.BOILERPLATE] + [f"{tx.LEFT}{p}" for p in tx.BOILERPLATE_OPEN]

    def total(sents: Column) -> Column:
        repeated = F.greatest(F.lit(0), F.size(sents) - F.size(dedupe_segments(sents)))
        plus = F.least(size, F.lit(MAX_ARTICLE_CHARS)) * 0.12 + F.size(sents) * 32 + letters / F.greatest(F.lit(1), size) * 170
        minus = tx.hits(text, phrases) * 180 + tx.hits(text, tx.CODE_NOISE) * 260 + tx.mojibake_count(text) * 85 + repeated * 130
        short = F.when(size < 160, 320).otherwise(0) + F.when(tx.word_like_count(text) < 40, 120).otherwise(0) + F.when(F.size(sents) < 2, 140).otherwise(0)
        return plus - minus - short

    return F.when(text == "", -10000.0).otherwise(tx.let(tx.sentences(text), total))


def pick_best(candidates: Column) -> Column:
    """The best cleaned candidate by score, then length, then place; cut to the limit. In Python; what that leaves by columns."""
    return F.coalesce(prose.picked(candidates.cast("array<binary>")), pick_best_by_columns(candidates))


def pick_best_by_columns(candidates: Column) -> Column:
    graded = F.transform(F.transform(candidates, lambda c: filter_noise_by_columns(tx.clean(c))), lambda t, i: F.struct(score(t).alias("score"), F.length(t).alias("n"), (-i).alias("place"), t.alias("text")))
    best = F.array_max(F.filter(graded, lambda g: g["text"] != ""))
    return F.coalesce(F.left(best["text"], F.lit(MAX_ARTICLE_CHARS)), F.lit(""))


def source_cleanup(text: Column, source: Column, url: Column) -> Column:
    """Generic phrases go, and those of the source key and of sites whose name ends the host."""
    host = F.regexp_replace(F.lower(F.coalesce(F.try_parse_url(url, F.lit("AUTHORITY")), F.lit(""))), r"^www\d*\.", "")
    whole = lambda ps: "|".join(f"{tx.LEFT}(?:{p}){tx.RIGHT}" for p in ps)
    own = [F.when(source == k, whole(p)) for k, p in CLEANUP_BY_SOURCE.items()] + [F.when(host.endswith(k), whole(p)) for k, p in CLEANUP_BY_SITE.items()]
    # one pattern for each row; patterns that don't apply are null and drop out
    pattern = F.concat(F.lit("(?iu)"), F.concat_ws("|", F.lit("|".join(CLEANUP)), *own))
    return F.regexp_replace(tx.collapse(F.regexp_replace(tx.clean(text), pattern, F.lit(" "))), r"^[ .,\-|]+|[ .,\-|]+$", "")


#: Notes in Turkish news that aren't prose.
_TR_DATE = r"(?:[0-3]?\d[./-][0-1]?\d[./-](?:\d{4}|\d{2})(?:\s+[0-2]?\d:[0-5]\d)?|[^|]{1,40})"
TURKISH_NOTES = (
    rf"{tx.LEFT}(?:Giriş Tarihi|Son Güncelleme|Yayınlanma Tarihi|Güncelleme Tarihi)\s*:\s*{_TR_DATE}",
    rf"{tx.LEFT}[0-3]?\d\.[0-1]?\d\.\d{{4}}\s+[0-2]?\d:[0-5]\d{tx.RIGHT}",
    rf"{tx.LEFT}Foto(?:ğraf|graf)\s*:\s*[^.]{{1,100}}",
    rf"{tx.LEFT}Kaynak\s*:\s*[^.]{{1,100}}",
    rf"{tx.LEFT}EN ÇOK OKUNANLAR(?:\s*[:|–—-]\s*)?",
    rf"{tx.LEFT}SON DAK[İI]KA(?:\s+HABERLER[İI])?(?:\s*[:|–—-]\s*)",
    rf"[^.]{{0,120}}{tx.LEFT}hesab[ıiuü]ndan konuya ilişkin açıklama yapıldı\.?",
)
_MARKER = "(?:giriş(?: tarihi)?|yayınlanma tarihi|yayinlanma tarihi|son güncelleme|son guncelleme|güncelleme tarihi|guncelleme tarihi|updated|last updated|published)"
_DATE = rf"(?:\d{{1,2}}[./-]\d{{1,2}}[./-](?:\d{{4}}|\d{{2}})|\d{{4}}[./-]\d{{1,2}}[./-]\d{{1,2}}|(?:{'|'.join(tx.MONTHS_EN)})\s+\d{{1,2}},?\s+\d{{4}}|(?:{'|'.join(tx.MONTHS_TR)})\s+\d{{1,2}}\s+\d{{4}})(?:\s+[0-2]?\d:[0-5]\d)?"


def strip_prefix(sentence: Column) -> Column:
    """A leading "updated: date" goes."""
    return F.trim(F.regexp_replace(sentence, rf"(?iu)^\s*{_MARKER}\s*[:\-]\s*(?:{_DATE})?\s*(?:[|–—-]\s*)?", ""))


def without_title(parts: Column, title: Column) -> Column:
    """Leading sentences that only repeat the title go; one that adds eight words, or is much longer, stays and ends this."""
    more = lambda x: (F.regexp_count(F.lower(x), F.lit(tx.TOKEN)) - F.regexp_count(F.lower(title), F.lit(tx.TOKEN)) >= 8) | (F.length(x) >= F.floor(F.length(title) * 1.45))
    first = F.array_position(F.transform(parts, lambda x: tx.near_duplicate(x, title) & ~more(x)), F.lit(False))
    return F.when((title == "") | (first == 0), parts).otherwise(F.slice(parts, F.greatest(first, F.lit(1)).cast("int"), F.greatest(F.size(parts), F.lit(1))))


def clean_for_summary(text: Column, language: Column, title: Column, source: Column, url: Column) -> Column:
    """Source phrases, Turkish notes, the repeated title, and notes among the first six sentences go."""
    base = source_cleanup(text, source, url)
    noted = lambda b: F.when(language == "tr", tx.collapse(F.regexp_replace(b, "(?iu)" + "|".join(TURKISH_NOTES), " "))).otherwise(b)
    parts = tx.let(tx.sentences(tx.let(base, noted)), lambda p: without_title(p, title))
    split = F.flatten(F.transform(parts, lambda p: F.filter(F.transform(F.split(p, rf"{tx.SPACE}+\|{tx.SPACE}+"), lambda x: F.trim(x)), lambda x: x != "")))
    note = lambda s: F.when(language == "tr", tx.metadata_sentence(s, "tr")).otherwise(tx.metadata_sentence(s, "en"))

    def kept(bare: Column) -> Column:
        good = F.filter(bare, lambda s, i: F.when(s == "", False).when(i >= 6, True).otherwise(~note(s)))
        return tx.let(good, lambda k: F.when(F.size(k) > 0, F.array_join(k, " ")).otherwise(F.array_join(bare, " ")))

    joined = tx.let(F.transform(split, strip_prefix), kept)
    return F.regexp_replace(source_cleanup(joined, source, url), r"^[ .,\-]+|[ .,\-]+$", "")


def postprocess(summary: Column, title: Column, language: Column) -> Column:
    """A title in front goes if enough is left, a summary that is only the title is empty; then as T21, its stop restored."""

    def body(x: Column) -> Column:
        s, t = x["s"], x["t"]
        leads = (t != "") & F.startswith(F.lower(s), F.lower(t))
        tail = F.regexp_replace(F.substring(s, F.length(t) + 1, F.length(s)), r"^[ .:\-]+", "")
        cut = tx.let(tail, lambda y: F.when(F.length(y) >= 24, F.concat(F.upper(F.left(y, F.lit(1))), F.substring(y, F.lit(2), F.length(y)))).otherwise(s))
        return F.struct(F.when(leads, cut).when((t != "") & tx.near_duplicate(s, t), "").otherwise(s).alias("s"), t.alias("t"))

    def stop(x: Column) -> Column:
        def close(done: Column) -> Column:
            bare = F.regexp_replace(done, "[ ,;:-]+$", "")
            return F.when((done != "") & ~tx.sentence_ending(done) & tx.sentence_ending(x["s"]), F.when(bare != "", F.concat(bare, F.lit("."))).otherwise("")).otherwise(done)

        return tx.let(clean_for_summary(x["s"], language, x["t"], F.lit(""), F.lit("")), close)

    return tx.let(tx.let(F.struct(tx.collapse(summary).alias("s"), tx.collapse(title).alias("t")), body), stop)


# --- summaries -----------------------------------------------------------------------------------------


def cut_at_space(text: Column, n: int) -> Column:
    """The first ``n`` characters without the last, broken word, and an ellipsis."""
    head = F.left(text, F.lit(n))
    return F.concat(F.when(head.contains(" "), F.regexp_replace(head, " [^ ]*$", "")).otherwise(head), F.lit("..."))


def extractive(text: Column, n: int = 280, avoid: Column | None = None) -> Column:
    """G1: leading sentences, not like ``avoid``, as many as fit; an overlong first one is cut."""

    def step(state: Column, x: Column) -> Column:
        longer = F.when(state["s"] == "", x).otherwise(F.concat(state["s"], F.lit(" "), x))
        fits = state["open"] & (F.length(longer) <= n)
        return F.struct(F.when(fits, longer).otherwise(state["s"]).alias("s"), fits.alias("open"))

    def lead(parts: Column) -> Column:
        taken = F.aggregate(parts, F.struct(F.lit("").alias("s"), F.lit(True).alias("open")), step)["s"]
        return F.when(F.size(parts) == 0, "").otherwise(tx.let(taken, lambda t: F.when(t == "", cut_at_space(F.get(parts, F.lit(0)), n)).otherwise(t)))

    def unlike(parts: Column) -> Column:
        other = F.filter(parts, lambda p: ~tx.near_duplicate(p, avoid))
        return tx.let(other, lambda o: F.when(F.size(o) > 0, o).otherwise(parts))

    parts = tx.sentences(tx.collapse(text))
    return tx.let(parts if avoid is None else tx.let(parts, unlike), lead)


def degenerate(summary: Column) -> Column:
    """Too few different words, or one too often; pairs of CJK characters stand in for words in short texts."""
    low = F.lower(summary)
    signs = F.regexp_extract_all(low, F.lit(f"({tx.CJK})"), F.lit(1))
    doubled = lambda c: F.when(F.size(c) >= 16, F.transform(F.sequence(F.lit(0), F.size(c) - 2), lambda i: F.concat(F.get(c, i), F.get(c, i + 1)))).otherwise(F.array().cast("array<string>"))
    toks = tx.let(F.regexp_extract_all(low, F.lit(f"({tx.TOKEN})"), F.lit(1)), lambda words: F.when(F.size(words) >= 8, words).otherwise(tx.let(signs, doubled)))
    state = lambda x, run, most, distinct: F.struct(x.alias("x"), run.alias("run"), most.alias("most"), distinct.alias("distinct"))

    def step(s: Column, x: Column) -> Column:
        again = s["x"] == x
        run = F.when(again, s["run"] + 1).otherwise(1)
        return state(x, run, F.greatest(s["most"], run), s["distinct"] + F.when(again, 0).otherwise(1))

    def test(found: Column) -> Column:
        n = F.size(found)
        runs = F.aggregate(found, state(F.lit(""), F.lit(0), F.lit(0), F.lit(0)), step)
        return (n >= 8) & tx.let(runs, lambda r: (r["distinct"] < 0.38 * n) | (r["most"] > F.greatest(F.lit(6), F.floor(n / 3))))

    return tx.let(F.array_sort(toks), test)


def finalize(summary: Column, source: Column) -> Column:
    """A clean ending: as it is, cut at the last closing mark, the leading sentences of the source, or with a stop."""
    s = tx.collapse(summary)
    last = F.length(s) - F.length(F.regexp_extract(s, r"([^.!?…]*)$", 1))
    cut = F.left(s, last)
    enough = s.rlike("[.!?…]") & (last - 1 >= F.floor(F.length(s) * 0.55)) & (F.length(cut) >= 30)
    stop = lambda t: F.concat(F.regexp_replace(t, "[ ,;:-]+$", ""), F.lit("."))
    lead = tx.collapse(extractive(source, 320))
    return F.when((s == "") | tx.sentence_ending(s), s).when(enough, cut).when(lead != "", F.when(tx.sentence_ending(lead), lead).otherwise(stop(lead))).otherwise(stop(s))


def summarize(text: Column, title: Column) -> Column:
    """G4, G6 without a model: the extractive summary that avoids the title, with a clean ending."""
    return finalize(extractive(text, 280, title), text)
