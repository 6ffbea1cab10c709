"""HTML main-text extraction by wrapper induction with union-free regular expressions.

A page becomes a stream of structural tokens: opening and closing block elements (unclosed ones are closed where HTML
would) and text. For each host the streams of all its pages are aligned: runs of equal
groups fold into repeated groups, what only some streams have becomes an optional group, texts are slots. Streams that fold alike are one before they meet,
and wrappers of ``FAN`` or so of them are aligned in turn until a host has one. The result
is a wrapper without alternatives. A page is matched by an automaton of the wrapper that follows all ways at once (linear in the
page), and the accepting way says which slot each of its texts fills.

Over all pages a slot's text is fixed (nine in ten of ``FIXED_PAGES`` different pages or more that have the slot have it there: the host's template) or
varying. Pages whose articles are the same are one page here, so a story that a host keeps under many ids is no template. The main
region is the element with the article's varying slots. A page that its host's wrapper matches is read through it: the texts of the region
but for fixed ones that read like a notice (``NOTICE``) or that the template has outside the region too; other constant text inside the article
(a byline, a heading) is content. Any other page (also of a host seen once) gets its region from its own
texts. Menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts and styles are left out by element.
Class and id words only break ties: they leave out elements inside the region or beside it, never one that holds the region or
half of its text, but for words of comments and adverts. A header inside an article is the article's headline.

Every page is read whole three times: for its structure, for what its slots hold, and for its text; no model or count comes from a sample. Slots' texts are
counted by articles in joins and grouped sums, as hashes of 64 bits; only a host's distinct structures, paths and fixed texts come together. Wrappers go to the workers once, not
with every row: as a broadcast up to ``SMALL`` characters together, beyond that each host's pages are dealt to chunks that its wrapper goes ahead of.

Defined cases: null or empty html gives an empty text of 0 characters; a null url belongs to the host ""; pages
without an article-like part give all text that isn't left out; a quote that never closes is text of its tag, a tag that never
closes ends with the page; repeated rows are read alike; extra columns are ignored.
"""

from __future__ import annotations

import difflib
import hashlib
import html
import json
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import TYPE_CHECKING

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm._shared import Stored, lean, slices

if TYPE_CHECKING:  # workers of Arrow functions don't need it
    import pandas as pd

#: Wrappers of a host that are aligned at once, about. Different pages that make a slot fixed, and the tenths of those with the slot that have the text.
FAN, FIXED_PAGES, TENTHS = 12, 3, 9
#: Characters of all wrappers that are broadcast; pages of a chunk where they aren't.
SMALL, CHUNK = 16 << 20, 5000
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg math object title".split())
LEFT_OUT = frozenset("head nav header footer aside form menu dialog select option button".split())
LEFT_OUT_WORDS = frozenset("discussion ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert newsletter subscribe subscription signup login share sharing social sidebar related recommended recommendations menu nav navbar navigation breadcrumb breadcrumbs comment comments disqus reply replies respond footer header masthead popup modal overlay widget toolbar pagination pager skip".split())
ARTICLE_WORDS = frozenset("article articlebody post entry story content maintext bodytext".split())
CLOSES_P = BLOCKS - {"option", "select"}
#: Elements that end an open one of the same kind (or of those listed) when they start.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}, "body": set()}
#: Possessive throughout, so a tag takes time in proportion to its length. Quotes count behind an equals sign only.
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][\w:-]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)(?:>|\Z)""", re.S)
NAMES = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
HIDDEN = re.compile(r"""\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
WORD = re.compile(r"[a-z]+")
#: Class names that say what is around an element, not what it is.
MODIFIER = re.compile(r"(?:with|has|no|without|is)[-_]")
#: Words of elements that are left out however much text they hold.
ALWAYS_OUT = frozenset({"comment", "comments", "disqus", "reply", "replies", "respond", "discussion", "ad", "ads", "advert", "adverts", "advertisement", "cookie", "cookies"})
#: What template text inside an article says if it isn't content.
NOTICE = re.compile(r"\b(?:sign(?:ing)? up|subscrib\w*|newsletter|share this|follow us|read more|read also|click here|log ?in|advertis\w+|sponsored|cookies?|all rights reserved|copyright|related (?:articles?|stories)|most read|download our app|join our)\b|©", re.I)
STRICT_WORDS = frozenset({"comment", "comments", "ad", "ads", "advert", "notice"})
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@lru_cache(maxsize=65536)
def step_of(tag: str, attributes: str) -> tuple[str, bool, bool, bool]:
    """Name of the element in paths; whether it is left out for certain, or by its words; whether it looks like the article."""
    names = [t for m in NAMES.findall(attributes) for t in CAMEL.sub(" ", "".join(m)).lower().split()] if attributes else []
    words = WORD.findall(" ".join(names))
    telling = set(WORD.findall(" ".join(n for n in names if not MODIFIER.match(n))))
    hard = tag in LEFT_OUT or bool(attributes) and bool(HIDDEN.search(attributes))
    strict = tag in ("article", "p")
    soft = tag not in ("html", "body", "main") and bool((STRICT_WORDS if strict else LEFT_OUT_WORDS) & telling)
    like = tag in ("article", "main") or "main" in words and "role" in attributes or "".join(words) == "articlebody" or tag in ("div", "section") and bool(ARTICLE_WORDS & set(words))
    return (tag + "." + ".".join(sorted(set(words))) if words else tag), hard, soft, like and not hard and not soft


class Page:
    """Blocks of text in page order: path number, text. Paths: tuples of element names, and what is known of each."""

    def __init__(self, source: str):
        self.paths: list[tuple[str, ...]] = [()]
        self.hard, self.like, self.inside = [False], [False], [False]
        self.soft: list[tuple[int, ...]] = [()]  # depths of the elements whose words leave them out
        self.children: dict[tuple[int, str], int] = {}
        self.blocks: list[tuple[int, str]] = []
        self.tokens: list[str] = []
        self._read(source)

    def _child(self, at: int, tag: str, attributes: str) -> int:
        name, hard, soft, like = step_of(tag, attributes)
        got = self.children.get((at, name))
        if got is None:
            got = self.children[at, name] = len(self.paths)
            self.paths.append((*self.paths[at], name))
            self.hard.append(self.hard[at] or hard and not (tag == "header" and self.inside[at]))
            self.like.append(like and not self.hard[at])
            self.inside.append(self.inside[at] or self.like[got])
            self.soft.append((*self.soft[at], len(self.paths[got])) if soft else self.soft[at])
        return got

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int]] = []  # open block elements
        text: list[str] = []
        tokens, here, at, end = self.tokens, 0, 0, len(source)
        endless: set[str] = set()  # elements that the rest of the page doesn't close

        def flush() -> None:
            if text:
                block = " ".join(html.unescape("".join(text)).split())
                text.clear()
                if block:
                    self.blocks.append((here, block))
                    tokens.append("#")

        def close(depth: int) -> None:
            nonlocal here
            flush()
            while len(stack) > depth:
                tag, _ = stack.pop()
                tokens.append(f"</{tag}>")
            here = stack[-1][1] if stack else 0

        def after(tag: str, at: int) -> int | None:
            if tag in endless:
                return None
            stop = re.compile(rf"</{tag}\b[^>]*+(?:>|\Z)", re.I).search(source, at)
            if not stop:
                endless.add(tag)
            return stop and stop.end()

        while at < end:
            m = TAG.search(source, at)
            if not m:
                text.append(source[at:])
                break
            if m.start() > at:
                text.append(source[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            shut, tag, attributes = m[1], m[2].lower(), m[3]
            if tag in RAW and not shut:
                at = after(tag, at) or end
                continue
            if tag not in BLOCKS:
                if tag == "br":
                    text.append(" ")
                elif tag not in VOID and not shut and tag in LEFT_OUT:  # a button's label
                    at = after(tag, at) or at
                continue
            if shut:
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] == tag:
                        close(depth)
                        break
                else:
                    flush()
                continue
            flush()
            if tag == "hr":
                continue
            if tag in CLOSES_P and stack and stack[-1][0] == "p":
                close(len(stack) - 1)
            if tag in SIBLINGS:
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] in SIBLINGS[tag]:
                        close(depth)
                        break
                    if stack[depth][0] in SCOPE[tag]:
                        break
            here = self._child(here, tag, attributes)
            stack.append((tag, here))
            tokens.append(f"<{self.paths[here][-1]}>")
        close(0)

    def masses(self, gone: set[int] | frozenset[int] = frozenset()) -> tuple[dict[tuple[str, ...], int], dict[tuple[str, ...], int]]:
        """Characters by path, but for the texts ``gone``: all that isn't left out for certain, and of them those that no class word leaves out."""
        every: dict[tuple[str, ...], int] = defaultdict(int)
        plain: dict[tuple[str, ...], int] = defaultdict(int)
        for k, (i, text) in enumerate(self.blocks):
            if not self.hard[i] and k not in gone:
                every[self.paths[i]] += len(text)
                if not self.soft[i]:
                    plain[self.paths[i]] += len(text)
        return every, plain

    def filled(self, slots: list[int], by: set[tuple[int, int]] | frozenset[tuple[int, int]]) -> set[int]:
        """Numbers of the texts that fill a slot with one of the given texts (by hash)."""
        some = {slot for slot, _ in by}
        return {k for k, (slot, (_, text)) in enumerate(zip(slots, self.blocks, strict=False)) if slot in some and (slot, hashed(text)) in by}

    def likely(self) -> set[tuple[str, ...]]:
        return {p for p, x in zip(self.paths, self.like, strict=True) if x}

    def texts(self, region: tuple[str, ...], gone: frozenset[int] | set[int] = frozenset()) -> list[str]:
        """The region's texts, without those of the numbers ``gone``."""
        n = len(region)
        inside = [(k, i, t) for k, (i, t) in enumerate(self.blocks) if not self.hard[i] and self.paths[i][:n] == region]
        held: dict[tuple[str, ...], int] = defaultdict(int)
        for _, i, t in inside:
            for d in self.soft[i]:
                if d > n:
                    held[self.paths[i][:d]] += len(t)
        half = sum(len(t) for *_, t in inside) / 2
        out = {e for e, size in held.items() if size < half or ALWAYS_OUT & set(e[-1].split(".")[1:])}
        return [t for k, i, t in inside if k not in gone and not any(self.paths[i][:d] in out for d in self.soft[i] if d > n)]


# --- wrappers -----------------------------------------------------------------------------------
# An item is a token, ("+", items) or ("?", items).


def fold(items: list) -> list:
    """Adjacent equal groups become one repeated group, short groups first, until nothing changes."""
    changed = True
    while changed:
        changed = False
        for width in range(1, 25):
            if 2 * width > len(items):
                break
            out, i = [], 0
            while i < len(items):
                group = items[i : i + width]
                n = 1
                while len(group) == width and items[i + n * width : i + (n + 1) * width] == group:
                    n += 1
                if n > 1 and not (width == 1 and group[0] == "#"):
                    out.append(group[0] if width == 1 and group[0][0] == "+" else ("+", tuple(group)))
                    i += n * width
                    changed = True
                else:
                    out.append(items[i])
                    i += 1
            items = out
        items, again = absorb(items)
        changed |= again
    return items


def absorb(items: list) -> tuple[list, bool]:
    """A copy of a repeated group beside it, optional or not, belongs to it."""
    for i, x in enumerate(items):
        if isinstance(x, tuple) and x[0] == "+":
            body, n = list(x[1]), len(x[1])
            if items[i + 1 : i + 1 + n] == body:
                return items[: i + 1] + items[i + 1 + n :], True
            if i >= n and items[i - n : i] == body:
                return items[: i - n] + items[i:], True
            for j in (i - 1, i + 1):
                if 0 <= j < len(items) and isinstance(items[j], tuple) and items[j][0] == "?" and tuple(items[j][1]) in (x[1], (x,)):
                    return items[:j] + items[j + 1 :], True
    return items, False


def hashed(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _bare(items: list) -> tuple:
    return tuple(items[0][1]) if len(items) == 1 and isinstance(items[0], tuple) else tuple(items)


def align(wrapper: list, stream: list) -> list:
    """The wrapper made to match the stream too, or all that another wrapper matches."""
    out: list = []
    for op, a, b, c, d in difflib.SequenceMatcher(None, wrapper, stream, autojunk=False).get_opcodes():
        left, right = wrapper[a:b], stream[c:d]
        if op == "equal":
            out += left
        elif left and right and _bare(left) == _bare(right):  # once here, repeated there
            signs = {x[0][0] for x in (left, right) if len(x) == 1 and isinstance(x[0], tuple)}
            group = ("+", _bare(left)) if "+" in signs else ("?", _bare(left))
            out.append(("?", (group,)) if signs == {"+", "?"} else group)
        else:
            for part in (left, right):
                if part:
                    out.append(part[0] if len(part) == 1 and isinstance(part[0], tuple) and part[0][0] == "?" else ("?", tuple(part)))
    return fold(out)


def infer(streams: list[list[str]]) -> list:
    wrapper: list = []
    for i, s in enumerate(streams):
        folded = fold(list(s))
        wrapper = folded if i == 0 else align(wrapper, folded)
    return wrapper


class Matcher:
    """An automaton of a wrapper: all ways through its optional and repeated groups are followed together, and met sets of places are remembered."""

    MOST = 20_000  # remembered steps

    def __init__(self, items: list):
        self.code: list[tuple] = []  # ("token", t), ("either", place, place)
        self._compile(items)
        self.end = len(self.code)
        self.known: dict[tuple, tuple] = {}
        self.first = self._closure([(0, 0)])[0]

    def _compile(self, items) -> None:
        for x in items:
            if isinstance(x, tuple | list) and x[0] in ("+", "?"):
                at = len(self.code)
                if x[0] == "?":
                    self.code.append(())
                    self._compile(x[1])
                    self.code[at] = ("either", at + 1, len(self.code))
                else:
                    self._compile(x[1])
                    self.code.append(("either", at, len(self.code) + 1))
            else:
                self.code.append(("token", x))

    def _closure(self, places: list[tuple[int, int]]) -> tuple[tuple[int, ...], tuple[int, ...]]:
        """Places that wait for a token (or are the end) and, for each, the number of the way that led there."""
        out: dict[int, int] = {}
        seen: set[int] = set()
        for place, way in places:
            todo = [place]
            while todo:
                at = todo.pop()
                if at in seen:
                    continue
                seen.add(at)
                if at < self.end and self.code[at][0] == "either":
                    todo += [self.code[at][2], self.code[at][1]]
                else:
                    out[at] = way
        return tuple(out), tuple(out.values())

    def _step(self, places: tuple[int, ...], token: str) -> tuple[tuple[int, ...], tuple[int, ...]]:
        got = self.known.get((places, token))
        if got is None:
            if len(self.known) >= self.MOST:
                self.known.clear()
            got = self.known[places, token] = self._closure([(p + 1, i) for i, p in enumerate(places) if p < self.end and self.code[p][1] == token])
        return got

    def slots(self, tokens: list[str]) -> list[int] | None:
        """The slot of every text of a stream, None if the wrapper doesn't match it."""
        steps, places = [], self.first
        for t in tokens:
            before = places
            places, ways = self._step(before, t)
            if not places:
                return None
            steps.append((before, ways))
        if self.end not in places:
            return None
        at, out = places.index(self.end), []
        for (before, ways), token in zip(reversed(steps), reversed(tokens), strict=True):
            at = ways[at]
            if token == "#":
                out.append(before[at])
        return out[::-1]


def region(mass: dict[tuple[str, ...], int], like: set[tuple[str, ...]]) -> tuple[str, ...]:
    """The element with the article: the most text under an article-like element, else the deepest one with most of all text."""
    total: dict[tuple[str, ...], int] = defaultdict(int)
    for path, n in mass.items():
        for k in range(len(path) + 1):
            total[path[:k]] += n
    best = max((p for p in total if p in like), key=lambda p: (total[p], -len(p), p), default=None)
    if best is not None and total[best] * 4 >= total[()]:
        return best
    at: tuple[str, ...] = ()
    while True:
        below = [p for p in total if len(p) == len(at) + 1 and p[: len(at)] == at and p[-1].split(".")[0] not in ("p", "h1", "h2", "h3", "li", "blockquote", "pre", "td")]
        best = max(below, key=lambda p: (total[p], p), default=None)
        if best is None or total[best] * 10 < total[at] * 7:
            return at
        at = best


def weighed(every: dict[tuple[str, ...], int], plain: dict[tuple[str, ...], int]) -> dict[tuple[str, ...], int]:
    """Class words count only where they leave a quarter of the text at least: a word on a frame around everything says nothing."""
    return plain if sum(plain.values()) * 4 >= sum(every.values()) else every


def own_region(page: Page) -> tuple[str, ...]:
    return region(weighed(*page.masses()), page.likely())


@lru_cache(maxsize=4096)
def folded(tokens: tuple[str, ...]) -> str:
    return json.dumps(fold(list(tokens)))


def _tuples(x):
    return tuple(map(_tuples, x)) if isinstance(x, list) else x


def aligned(rows: pd.DataFrame) -> pd.DataFrame:
    """One wrapper of some structures or wrappers of a host, those of most pages first."""
    import pandas as pd

    wrapper: list | None = None
    for source in rows.sort_values(["n", "items"], ascending=[False, True])["items"]:
        items = list(_tuples(json.loads(source)))
        wrapper = items if wrapper is None else align(wrapper, items)
    return pd.DataFrame({"host": [rows["host"].iloc[0]], "items": [json.dumps(wrapper)], "n": [rows["n"].sum()]})


def framed(rows: pd.DataFrame) -> pd.DataFrame:
    """A host's wrapper from its items, the mass of its paths, and its fixed texts: the region of its main slots, and the (slot, text) pairs to leave out."""
    import pandas as pd

    every: dict[tuple[str, ...], int] = defaultdict(int)
    plain: dict[tuple[str, ...], int] = defaultdict(int)
    like: set[tuple[str, ...]] = set()
    for source, mass in rows.loc[rows["kind"] == "mass", ["path", "mass"]].itertuples(index=False):
        names, likes, _, soft = json.loads(source)
        path = tuple(names)
        like |= {path[:k] for k in likes}
        every[path] += int(mass)
        if not soft:
            plain[path] += int(mass)
    where = region(weighed(every, plain), like)
    fixed = list(rows.loc[rows["kind"] == "fixed", ["path", "slot", "text", "notice"]].itertuples(index=False))
    outside = {text for source, _, text, _ in fixed if tuple(json.loads(source)[0][: len(where)]) != where}
    gone = sorted({(int(slot), int(text)) for _, slot, text, notice in fixed if notice or text in outside})
    items = json.loads(rows.loc[rows["kind"] == "items", "path"].iloc[0])
    return pd.DataFrame({"host": [rows["host"].iloc[0]], "wrapper": [json.dumps({"items": items, "region": where, "gone": gone})]})


class Wrapper:
    """A host's wrapper, read once for all its pages."""

    def __init__(self, source: str):
        known = json.loads(source)
        self.matcher, self.region, self.gone = Matcher(known["items"]), tuple(known["region"]), frozenset(map(tuple, known["gone"]))


@lru_cache(maxsize=512)
def _wrapper(source: str) -> Wrapper:
    return Wrapper(source)


def main_text(source: str, wrapper: str | None = None) -> str:
    """The page's main text, through the wrapper if it matches."""
    page = Page(source)
    texts: list[str] = []
    if wrapper:
        host = _wrapper(wrapper)
        slots = host.matcher.slots(page.tokens)
        if slots is not None:
            texts = page.texts(host.region, page.filled(slots, host.gone))
    if not texts:
        texts = page.texts(own_region(page))
    if not texts:  # nothing there: what the page has elsewhere
        texts = [t for i, t in page.blocks if not page.hard[i] and not page.soft[i]] or [t for i, t in page.blocks if not page.hard[i]]
    return "\n\n".join(texts)


def host_of(url: str):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][\w+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1)), F.lit(""))


def structures(hosted: DataFrame) -> DataFrame:
    """host, items (JSON of a folded stream), n: pages of the host that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch["host"], pa.array([folded(tuple(Page(x).tokens)) for x in batch["html"].to_pylist()], pa.string())], names=["host", "items"])

    return hosted.select("host", "html").mapInArrow(lean(run), "host string, items string").groupBy("host", "items").agg(F.count("*").alias("n"))


def grown(parts: DataFrame) -> DataFrame:
    """host, items, n: one wrapper for each host, from those of any number of structures."""
    parts = Stored(parts).df
    while True:
        counts = parts.groupBy("host").agg(F.count("*").alias("parts"))
        if counts.where("parts > 1").isEmpty():
            return parts
        dealt = parts.join(counts, "host").withColumn("bin", F.pmod(F.xxhash64("items"), F.ceil(F.col("parts") / FAN)))
        parts = Stored(dealt.select("host", "bin", "items", "n").groupBy("host", "bin").applyInPandas(aligned, "host string, items string, n long")).df


_FACTS = {"host": pa.string(), "article": pa.int64(), "slot": pa.int32(), "path": pa.string(), "text": pa.int64(), "n": pa.int64(), "size": pa.int64(), "notice": pa.bool_()}


def _facts(batch: pa.RecordBatch, wrappers_: list[str | None]) -> pa.RecordBatch:
    """What the pages' slots hold: a row for each text of a slot and path, with its times; the article's hash; paths as JSON of names, article-like depths, left out for certain and by words."""
    rows: list[tuple] = []
    for host, source, wrapper in zip(batch["host"].to_pylist(), batch["html"].to_pylist(), wrappers_, strict=True):
        page = Page(source or "")
        slots = _wrapper(wrapper).matcher.slots(page.tokens) if wrapper else None
        article = hashed("\n\n".join(page.texts(own_region(page)) or [f"{i} {t}" for i, t in page.blocks]))
        likely, names = page.likely(), {}
        for i in {i for i, _ in page.blocks}:
            path = page.paths[i]
            names[i] = json.dumps([path, [k for k in range(len(path) + 1) if path[:k] in likely], page.hard[i], bool(page.soft[i])])
        times = Counter((slot, names[i], text) for slot, (i, text) in zip(slots or [-1] * len(page.blocks), page.blocks, strict=True))
        rows += [(host, article, slot, path, hashed(text), n, len(text), bool(NOTICE.search(text))) for (slot, path, text), n in times.items()]
    columns = zip(*rows, strict=True) if rows else [()] * len(_FACTS)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _FACTS.values(), strict=True)], names=list(_FACTS))


def wrappers(hosted: DataFrame, small: int = SMALL) -> DataFrame:
    """host, wrapper (JSON of its items, region, and slots and hashes of texts to leave out), one row for each host, from all its pages."""
    some = hosted.where("html <> ''")
    items = grown(structures(some))
    bare = items.select("host", F.concat(F.lit('{"items": '), "items", F.lit(', "region": [], "gone": []}')).alias("wrapper"))
    found = through(some, bare, _facts, "host string, article long, slot int, path string, text long, n long, size long, notice boolean", small)
    facts = Stored(found.groupBy("host", "article", "slot", "path", "text").agg(*[F.max(c).alias(c) for c in ("n", "size", "notice")])).df  # pages of one article count once
    slotted = facts.where("slot >= 0")
    of_text = Stored(slotted.select("host", "slot", "text", "article").distinct().groupBy("host", "slot", "text").agg(F.count("*").alias("have"))).df
    of_slot = slotted.select("host", "slot", "article").distinct().groupBy("host", "slot").agg(F.count("*").alias("all"))
    slots = Stored(of_slot.join(of_text.groupBy("host", "slot").agg(F.min("have").alias("least")), ["host", "slot"])).df
    varied = slots.where("least < all").select("host").distinct()  # where nothing varies no template is told from content
    often = of_text.where(f"10 * have >= {TENTHS * FIXED_PAGES}").join(slots, ["host", "slot"])  # others are fixed nowhere
    fixed = Stored(often.where(f"10 * have >= {TENTHS} * all and all >= {FIXED_PAGES}").join(varied, "host", "left_semi").select("host", "slot", "text")).df
    hard = F.get_json_object("path", "$[2]") == "true"
    masses = facts.where(~hard).join(fixed, ["host", "slot", "text"], "left_anti").groupBy("host", "path").agg(F.sum(F.col("n") * F.col("size")).alias("mass"))
    stays = facts.join(fixed, ["host", "slot", "text"], "left_semi").groupBy("host", "path", "slot", "text").agg(F.max("notice").alias("notice"))
    rows = items.select(F.lit("items").alias("kind"), "host", F.col("items").alias("path"))
    rows = rows.unionByName(masses.withColumn("kind", F.lit("mass")), allowMissingColumns=True).unionByName(stays.withColumn("kind", F.lit("fixed")), allowMissingColumns=True)
    # numbers beyond 2^53 stay whole: no column of numbers has nulls
    rows = rows.select("kind", "host", "path", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("mass", "slot", "text")], F.coalesce("notice", F.lit(False)).alias("notice"))
    return rows.groupBy("host").applyInPandas(framed, "host string, wrapper string")


OUT = "page_id long, url string, text string, n_chars long"


def _out(ids: pa.Array, urls: pa.Array, texts: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def _texts(batch: pa.RecordBatch, wrappers_: list[str | None]) -> pa.RecordBatch:
    return _out(batch["page_id"], batch["url"], [main_text(x or "", w) for x, w in zip(batch["html"].to_pylist(), wrappers_, strict=True)])


def _ahead(make: Callable) -> Callable:
    """Rows sorted by host and chunk come in, a wrapper (page null, wrapper set) before its chunk's pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, wrapper = None, None
        for batch in slices(batches):
            keep, found = [], []
            for k, (host, chunk, rest, w) in enumerate(zip(*(batch[c].to_pylist() for c in ("host", "chunk", "rest", "wrapper")), strict=True)):
                if (host, chunk) != key:
                    key, wrapper = (host, chunk), None
                if rest:
                    keep.append(k)
                    found.append(wrapper)
                else:
                    wrapper = w
            yield make(batch.take(pa.array(keep, pa.int64())), found)

    return run


def through(hosted: DataFrame, known: DataFrame, make: Callable, schema: str, small: int) -> DataFrame:
    """What ``make`` says of pages and their hosts' wrappers. ``small``: characters of all wrappers that are broadcast."""
    size = known.agg(F.sum(F.length("wrapper") + F.length("host") + 64).alias("n")).first().n or 0
    if size <= small:
        by = hosted.sparkSession.sparkContext.broadcast({r.host: r.wrapper for r in known.collect()})  # of a checked size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                yield make(batch, [by.value.get(h) for h in batch["host"].to_pylist()])

        return hosted.mapInArrow(lean(run), schema)
    counts = hosted.groupBy("host").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    counts = Stored(counts).df
    none = F.lit(None)
    dealt = hosted.join(counts, "host").select("host", F.pmod(F.xxhash64("page_id", "url"), F.col("chunks")).cast("int").alias("chunk"), F.lit(1).alias("rest"), "page_id", "url", "html", none.cast("string").alias("wrapper"))
    heads = known.join(counts, "host").select("host", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("rest"), none.cast("long").alias("page_id"), none.cast("string").alias("url"), none.cast("string").alias("html"), "wrapper")
    return dealt.unionByName(heads).repartition("host", "chunk").sortWithinPartitions("host", "chunk", "rest").mapInArrow(lean(_ahead(make)), schema)


def extract(pages: DataFrame, small: int = SMALL) -> DataFrame:
    """page_id, url, text, n_chars, one row for each page. ``small``: characters of all wrappers that are broadcast."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    hosted = pages.withColumn("host", host_of("url"))
    return through(hosted, Stored(wrappers(hosted, small)).df, _texts, OUT, small)
