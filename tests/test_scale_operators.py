"""Selection of ranks, distribution functions, the similarity join and fragments against plain Python, also where one group or value has all."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.functions import metrics as m
from newsloom.functions import text as tx
from newsloom.operators import ranks
from newsloom.plans import similarity
from newsloom.storage import Stored

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("limits", [(1024, 4096), (32, 10)])
def test_percentiles(spark, monkeypatch, limits):
    monkeypatch.setattr(ranks, "RANGES", limits[0])
    monkeypatch.setattr(ranks, "SORTED", limits[1])
    rng = np.random.default_rng(0)
    groups = {
        "flat": rng.random(500), "ties": rng.integers(0, 5, 400).astype(float), "same": np.full(300, 7.0), "one": np.array([3.5]), "two": np.array([1.0, 2.0]),
        "wide": np.array([-1.7e308, 1.7e308, 0, 1, 2, 3e-300]), "skewed": np.exp(rng.normal(0, 8, 300)), None: rng.normal(size=50),
    }
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("flat", None), ("flat", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    fractions = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    got = {r.g: r for r in ranks.percentiles(df, ["g"], "v", fractions).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        s = np.sort(vs)
        for name, f in fractions.items():
            at = f * (len(s) - 1)
            low, high = s[int(np.floor(at))], s[int(np.ceil(at))]
            want = low if low == high else low * (1 - at % 1) + high * (at % 1)
            assert got[g][name] == pytest.approx(want, rel=1e-12), (g, name)


def test_ecdf(spark):
    rng = np.random.default_rng(1)
    rows = [("hot", float(x)) for x in np.r_[np.full(400, 2.0), rng.integers(0, 50, 300)]] + [("b", 1.0), (None, 5.0), (None, 6.0)]
    got = ranks.ecdf(spark.createDataFrame(rows, "g string, v double").repartition(5), ["g"], "v").collect()
    by = {}
    for g, v in rows:
        by.setdefault(g, []).append(v)
    assert len(got) == len(rows) and all(r.ecdf == pytest.approx(sum(x <= r.v for x in by[r.g]) / len(by[r.g])) for r in got)


def alike(a, b):
    return len(a & b) / min(len(a), len(b)) >= 0.82


def test_similar_texts_equal_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"word{i}" for i in range(60)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 25))] for _ in range(60)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)]
    for i, b in enumerate(base):
        cut = [w for w in b if rng.random() < 0.9] + rng.sample(vocabulary, rng.randint(0, 3))
        rows += [(100 + i, " ".join(cut)), (200 + i, " ".join(reversed(b)).upper())]
    rows += [(900, "a b"), (901, "A  b"), (902, ""), (903, None), (904, "a c")]
    got = [tuple(r) for r in similarity.similar(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()]
    sets = {i: frozenset(w.lower() for w in (t or "").split() if len(w) > 2) for i, t in rows}
    low = {i: " ".join((t or "").lower().split()) for i, t in rows}
    key = {i: sets[i] or low[i] for i in sets if low[i]}
    rep = {i: min(j for j in key if key[j] == key[i]) for i in key}
    heads = sorted(set(rep.values()))
    want = [(a, b, len(sets[a] & sets[b]), False) for a in heads for b in heads if a < b and sets[a] and sets[b] and alike(sets[a], sets[b])]
    want += [(rep[i], i, len(sets[i]), True) for i in key if rep[i] != i]
    assert sorted(got) == sorted(want) and len(want) > 60


def test_candidates_are_few(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = similarity.classes(d, "doc_id", "text").where("id = rep and size(w) > 0").select("rep", "w")
    n = sets.count()
    assert similarity.candidates(similarity.rare_first(sets), 0.82).count() < 0.05 * n * (n - 1) / 2


def plain_fragments(source, summary):
    at, covered, squares = 0, 0, 0
    while at < len(summary):
        best = max((k for k in range(1, len(summary) - at + 1) if any(source[i : i + k] == summary[at : at + k] for i in range(len(source)))), default=0)
        covered, squares, at = covered + best, squares + best * best, at + max(1, best)
    return (covered / len(summary), squares / len(summary)) if summary and source else (0.0, 0.0)


def test_fragments_by_automaton(spark):
    rng = random.Random(5)
    rows = [([rng.choice("abc") for _ in range(rng.randint(0, 30))], [rng.choice("abcd") for _ in range(rng.randint(0, 15))]) for _ in range(200)]
    assert [m._fragments(a, b) for a, b in rows] == [plain_fragments(a, b) for a, b in rows]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, a array<string>, b array<string>")
    assert [tuple(r.f) for r in df.select("i", m.fragments("a", "b").alias("f")).orderBy("i").collect()] == [plain_fragments(a, b) for a, b in rows]
    same = ["w"] * 100_000
    assert m._fragments(same, same) == (1.0, 100_000.0)


def test_overlaps_of_repeated_words(spark):
    rng = random.Random(6)
    rows = [([rng.choice("abcd") for _ in range(rng.randint(0, 12))], [rng.choice("abce") for _ in range(rng.randint(0, 12))]) for _ in range(80)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, a array<string>, b array<string>")
    got = df.select("i", m.clipped(F.col("a"), F.col("b")).alias("n"), m.novelty_of(F.col("a"), F.col("b")).alias("v")).orderBy("i").collect()
    for r, (a, b) in zip(got, rows, strict=True):
        assert r.n == sum(min(a.count(x), b.count(x)) for x in set(a)) and r.v == pytest.approx(1 - sum(x in b for x in a) / len(a) if a else 0)


def test_degenerate_is_linear(spark):
    from newsloom.functions import article

    words = " ".join(f"word{i}" for i in range(40_000))
    rows = [("many", words), ("same", "again " * 40_000), ("few", "one two three"), ("turns", "a b c d " * 3), ("cjk", "日本" * 20), ("ok", "the quick brown fox jumps over a lazy dog")]
    df = spark.createDataFrame(rows, "k string, t string").withColumn("t", tx.collapse(F.col("t")))
    assert {r.k: r.d for r in df.select("k", article.degenerate(F.col("t")).alias("d")).collect()} == {"many": False, "same": True, "few": False, "turns": True, "cjk": True, "ok": False}


def test_only_similar_pairs_leave_a_cell(spark, monkeypatch):
    """Candidates are the result already: none is carried with its words to be checked elsewhere. Blocks and words with equal checksums don't change it."""
    monkeypatch.setattr(similarity, "BLOCK", (400, 700))
    rng = random.Random(5)
    vocabulary = [f"word{i}" for i in range(40)] + ["plumless", "buckeroo"]  # the last two have one crc32
    sets = {i: sorted(set(rng.choices(vocabulary, k=rng.randint(1, 30)))) for i in range(150)} | {1000: ["plumless"], 1001: ["buckeroo"]}
    ranked = similarity.rare_first(spark.createDataFrame(list(sets.items()), "rep long, w array<string>"))
    found = similarity.candidates(ranked, 0.82)
    assert found.columns == ["x", "y", "shared"]
    key = lambda i: (len(sets[i]), i)
    want = {(x, y, len(set(sets[x]) & set(sets[y]))) for x in sets for y in sets if key(x) < key(y) and alike(set(sets[x]), set(sets[y]))}
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert (1000, 1001) not in {(x, y) for x, y, _ in want}


def _shuffled(spark) -> int:
    """Records that all stages so far have written to shuffles."""
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty()
    none = context._jvm.java.util.ArrayList
    stages = context._jsc.sc().statusStore().stageList(none(), False, False, context._gateway.new_array(context._jvm.double, 0), none())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_no_set_is_shuffled_for_a_block(spark, monkeypatch):
    """Each set was written once for every block of the other side, so disk grew with the square of the input."""
    monkeypatch.setattr(similarity, "BLOCK", (300, 700))
    rows = [(i, [f"word{(i * 7 + k) % 500}" for k in range(3 + i % 9)]) for i in range(600)]
    ranked = Stored(similarity.rare_first(spark.createDataFrame(rows, "rep long, w array<string>"))).df
    before = _shuffled(spark)
    found = {tuple(r) for r in similarity.candidates(ranked, 0.82).collect()}
    assert _shuffled(spark) - before < 100
    sets = {i: set(w) for i, w in rows}
    assert found == {(x, y, len(sets[x] & sets[y])) for x in sets for y in sets if (len(sets[x]), x) < (len(sets[y]), y) and alike(sets[x], sets[y])}


def test_blocks_cut_sizes_evenly():
    sizes = [(1, 10), (2, 1000), (50, 1), (60, 20)]
    starts = similarity.bounds(sizes, 500)
    assert starts[0] == (1, 0) and len(starts) == 7 and starts == sorted(starts) and sum(n == 2 for n, _ in starts) == 4
    assert similarity.bounds([(3, 1)], 500) == [(3, 0)] and similarity.bounds([], 500) == []
