"""Wrappers: they match the pages they were made from, repeated stories are no template, constant content stays, hosts may be many."""

import random

import pytest

from newsloom.llm import html_wrapper as hw

COLUMNS = "page_id long, url string, html string"


def texts(spark, pages, **options):
    rows = [(i, f"http://h.example/{i}", x) for i, x in enumerate(pages)]
    return [r.text for r in sorted(hw.extract(spark.createDataFrame(rows, COLUMNS), **options).collect(), key=lambda r: r.page_id)]


def irregular(rng, n):
    """A page of optional, repeated and nested parts."""
    out = []
    for _ in range(n):
        kind = rng.randrange(5)
        body = f"text {rng.random()}"
        out.append([f"<p>{body}</p>", f"<ul>{''.join(f'<li>{i}' for i in range(rng.randrange(1, 4)))}</ul>", f"<h2>{body}</h2><p>{body}</p>", f"<div class=a><div class=b>{body}</div>{'<p>x</p>' * rng.randrange(3)}</div>", "<hr><p>same"][kind])
    return f"<body><article>{''.join(out)}</article></body>"


def test_own_samples_match():
    rng = random.Random(1)
    for _ in range(60):
        pages = [hw.Page(irregular(rng, rng.randrange(1, 12))) for _ in range(6)]
        matcher = hw.Matcher(hw.infer([p.tokens for p in pages]))
        for p in pages:
            slots = matcher.slots(p.tokens)
            assert slots is not None and len(slots) == len(p.blocks)
            assert all(matcher.code[s] == ("token", "#") for s in slots)


def test_a_greedy_group_gives_back():
    """(ab)? in front of ab: the optional group must not eat what the next part needs."""
    assert hw.Matcher([("?", ("<a>", "#")), "<a>", "#"]).slots(["<a>", "#"]) == [4]
    assert hw.Matcher([("+", ("<a>",)), "<a>", "#"]).slots(["<a>", "<a>", "#"]) == [3]


def test_matching_takes_linear_time():
    wrapper = [("+", (("?", ("<a>",)), ("+", ("<a>", "#"))))]
    assert len(hw.Matcher(wrapper).slots(["<a>", "#"] * 50_000)) == 50_000


STORY = [
    # a story that the host keeps under several ids, with a counter elsewhere
    (lambda i: f'<body><div class="meta">Views {i}</div><article><div>First passage of it.</div><div>Second passage of it.</div></article></body>', lambda i: "First passage of it.\n\nSecond passage of it."),
    # constant content in elements of their own
    (lambda i: f'<article><div class="byline">By Jane Doe</div><p>Story {i} tells a lot.</p></article>', lambda i: f"By Jane Doe\n\nStory {i} tells a lot."),
    (lambda i: f'<article><div class="intro">What you need to know</div><p>Story {i} tells a lot.</p></article>', lambda i: f"What you need to know\n\nStory {i} tells a lot."),
    # readers' comments under another name, and a class word on what holds most of the text
    (lambda i: f'<article><p>Story {i} tells a lot.</p><section id="discussion"><p>I agree {i}, and so does everybody that I know of here.</p></section></article>', lambda i: f"Story {i} tells a lot."),
    (lambda i: f'<article><h1>Head {i}</h1><div class="related-topics story-body"><p>The whole text of story {i} stands here.</p></div></article>', lambda i: f"Head {i}\n\nThe whole text of story {i} stands here."),
    # a notice goes in any element if all pages have it, and what the template has outside too
    (lambda i: f"<article><p>Story {i} tells a lot.</p><p>Share this story with friends</p></article>", lambda i: f"Story {i} tells a lot."),
    (lambda i: f"<article><p>Story {i} tells a lot.</p><div>Share this story with friends</div></article>", lambda i: f"Story {i} tells a lot."),
    (lambda i: f"<body><div><b>The Daily</b></div><article><p>Story {i} tells a lot.</p><div>The Daily</div></article></body>", lambda i: f"Story {i} tells a lot."),
]


@pytest.mark.parametrize("page,want", STORY)
def test_hosts(spark, page, want):
    assert texts(spark, [page(i) for i in range(5)]) == [want(i) for i in range(5)]


def test_wrappers_ahead_of_chunks(spark, monkeypatch):
    """Beyond the size that is broadcast, with hosts of several chunks, the texts are the same."""
    monkeypatch.setattr(hw, "CHUNK", 7)
    rows = [(i, f"http://h{i % 3}.example/{i}", STORY[1 + i % 3][0](i)) for i in range(60)] + [(None, None, None), (70, "http://solo/1", STORY[1][0](70)), (71, "http://h1.example/x", None)]
    df = spark.createDataFrame(rows, COLUMNS).repartition(5)
    one, two = (sorted((str(tuple(r)) for r in hw.extract(df, small=n).collect())) for n in (hw.SMALL, 0))
    assert one == two and len(one) == len(rows)


def test_wrappers_come_from_all_pages(spark):
    """One odd page in a hundred doesn't change the template, and structures that few pages have are matched too."""
    page = lambda i: f"<body><article><p>Story {i} tells a lot.</p><div>{'Our own cookies' if i == 77 else 'Share this story'}</div>{'<ul><li>Rare point</ul>' * (i in (5, 42))}</article></body>"
    got = texts(spark, [page(i) for i in range(100)])
    assert got == [f"Story {i} tells a lot.{chr(10) * 2 + 'Our own cookies' if i == 77 else ''}{chr(10) * 2 + 'Rare point' if i in (5, 42) else ''}" for i in range(100)]
    hosted = spark.createDataFrame([(i, f"http://h.example/{i}", page(i)) for i in range(100)], COLUMNS).withColumn("host", hw.host_of("url"))
    (wrapper,) = hw.wrappers(hosted).collect()
    assert all(hw.Wrapper(wrapper.wrapper).matcher.slots(hw.Page(page(i)).tokens) for i in range(100))


def test_wrappers_of_many_structures_meet(spark, monkeypatch):
    """Whatever the order and number of rounds, a host's wrapper matches every page of it."""
    monkeypatch.setattr(hw, "FAN", 3)
    rng = random.Random(2)
    pages = [irregular(rng, rng.randrange(1, 6)) for _ in range(40)]
    hosted = spark.createDataFrame([(i, f"http://h{i % 2}.example/{i}", x) for i, x in enumerate(pages)], COLUMNS).withColumn("host", hw.host_of("url"))
    parts = hw.structures(hosted)
    assert parts.count() > 12
    found = {r.host: hw.Matcher(list(hw._tuples(hw.json.loads(r.items)))) for r in hw.grown(parts).collect()}
    assert len(found) == 2 and all(found[f"h{i % 2}.example"].slots(hw.Page(x).tokens) is not None for i, x in enumerate(pages))
    both = hw.Matcher(hw.align(["<z>", ("+", ("<a>", "#"))], ["<z>", ("?", ("<a>", "#"))]))
    assert both.slots(["<z>"]) == [] and len(both.slots(["<z>", "<a>", "#", "<a>", "#"])) == 2
