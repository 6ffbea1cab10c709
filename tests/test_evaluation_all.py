"""The aggregates over all 25 metrics against pandas on the same metric rows, and hooks without SQL on literal rows."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from newsloom.functions import metrics as m
from newsloom.plans import evaluation as ev

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return ev.QUERIES["m15_evaluation_rows"](spark, SF).toPandas()[["sample_id", "language", "model", *ev.METRICS]]


def same(got: pd.DataFrame, want: pd.DataFrame, keys: list[str]) -> None:
    got, want = (d.sort_values(keys, ignore_index=True) for d in (got, want))
    assert got[keys].astype(str).equals(want[keys].astype(str))
    for c in want.columns.difference(keys):
        assert np.allclose(got[c].astype(float), want[c].astype(float), equal_nan=True, atol=1e-9), c


def test_25_metrics():
    assert len(ev.METRICS) == len(set(ev.METRICS)) == 25 and set(ev.CORE) < set(ev.METRICS)


def test_by_language_and_macro(spark, rows):
    by = rows.groupby(["language", "model"])[list(ev.METRICS)].agg(["mean", "std"])
    by.columns = [f"{c}_{n}" for c, n in by.columns]
    by["samples"] = rows.groupby(["language", "model"]).size()
    same(ev.QUERIES["a1_all_metrics"](spark, SF).toPandas(), by.reset_index(), ["language", "model"])
    means = by.reset_index().groupby("model")[[f"{c}_mean" for c in ev.METRICS]].mean()
    means["samples"], means["languages"] = rows.groupby("model").size(), rows.groupby("model")["language"].nunique()
    got = ev.QUERIES["a2_all_metrics"](spark, SF).toPandas()
    same(got, means.reset_index(), ["model"])
    assert got["capability_overall_mean"].is_monotonic_decreasing


def test_statistics_and_correlations(spark, rows):
    long = rows.melt(["sample_id", "language", "model"], list(ev.METRICS), "metric")
    want = long.groupby(["metric", "model"])["value"].agg(["mean", "median", "std"]).reset_index()
    same(ev.QUERIES["a9_all_metrics"](spark, SF).toPandas(), want, ["metric", "model"])
    got = ev.QUERIES["a10_all_metrics"](spark, SF).toPandas().set_index(["model", "a", "b"])["r"]
    assert len(got) == 4 * 300
    for a, b in list(combinations(ev.METRICS, 2))[::17]:
        x = rows.dropna(subset=[a, b])
        if x[a].std() > 1e-12 and x[b].std() > 1e-12 and len(x) == len(rows):
            assert abs(got["all", a, b] - np.corrcoef(x[a], x[b])[0, 1]) < 1e-6


def test_wins_ranks_and_deltas(spark, rows):
    sign = lambda c: -1 if c in ev.LOWER_IS_BETTER else 1
    won = ev.QUERIES["a11_all_metrics"](spark, SF).toPandas().set_index(["metric", "language", "model"])["wins"]
    ranks = ev.QUERIES["o8_all_metrics"](spark, SF).toPandas().set_index(["metric", "language", "model"])["rank"]
    deltas = ev.QUERIES["r5_all_metrics"](spark, SF).toPandas().set_index(["language", "metric", "pair"])["delta"]
    one = ev.QUERIES["r6_all_metrics"](spark, SF).toPandas().set_index(["language", "sample_id", "metric", "pair"])["delta"]
    assert len(one) == len(one.index.drop_duplicates())
    for c in ("rougeL_fmeasure", "latency_seconds", "bleu", "repetition_3gram", "quality_factuality"):
        wide = rows.pivot(index=["language", "sample_id"], columns="model", values=c)
        first = (wide[sorted(wide.columns)] * sign(c)).idxmax(axis=1).reset_index(name="model").groupby(["language", "model"]).size()
        assert {k[1:]: n for k, n in won.items() if k[0] == c} == first.to_dict()
        means = rows.groupby(["language", "model"])[c].mean().unstack()
        want = (means * sign(c)).rank(axis=1, method="min", ascending=False)
        close = (means.diff(axis=1).abs().iloc[:, 1:] < 1e-9).any(axis=1)
        for lang in means.index[~close]:
            assert all(ranks[c, lang, m] == want.loc[lang, m] for m in means.columns)
        for a, b in combinations(ev.MODELS, 2):
            for lang in means.index:
                assert abs(deltas[lang, c, f"{a} - {b}"] - (means.loc[lang, a] - means.loc[lang, b])) < 1e-9


def test_scatter_is_the_same_each_time(spark):
    a, b = (sorted(map(tuple, ev.QUERIES["p12_scatter"](spark, SF).collect())) for _ in range(2))
    assert a == b and 0 < len(a) <= 2000


def test_seeded_sample(spark):
    from newsloom.plans import corpus

    got = corpus.QUERIES["r1_seeded_sample"](spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("lang", "doc_id").toPandas()
    assert got.groupby("lang").size().to_dict() == docs.groupby("lang").size().clip(upper=5).to_dict()
    assert set(map(tuple, got.to_numpy())) <= set(map(tuple, docs.to_numpy()))


def test_a_source_is_searched_once_for_all_its_summaries(spark):
    """Counts, fragments and overlaps of several summaries of one source equal those of each by itself, also for empty ones and signs of East Asian scripts."""
    texts = [("a b c x a b d", ["a b x y", "", "c x a b d q d"]), ("", ["a b", "a", ""]), ("It's 漢字 。・ a-b ok 漢字", ["漢字 ok", "it's a-b 漢", "字 字"])]
    rows = [(i, s, g) for i, (s, gs) in enumerate(texts) for g in gs]
    df = spark.createDataFrame(rows, "i int, s string, g string").select("i", "s", "g", m.tokens(F.col("s")).alias("a"), m.tokens(F.col("g")).alias("b"))
    plain = df.select("i", "a", "b", m.novelty(F.col("b"), F.col("a"), 1).alias("n1"), m.novelty(F.col("b"), F.col("a"), 2).alias("n2"), m.clipped(F.col("a"), F.col("b")).alias("c1"), m.clipped(m.ngrams(F.col("a"), 2), m.ngrams(F.col("b"), 2)).alias("c2"))
    plain = {(r.i, tuple(r.b)): (r.n1, r.n2, r.c1, r.c2, *m._fragments(r.a, r.b)) for r in plain.collect()}
    many = df.groupBy("i", "a").agg(F.collect_list("b").alias("bs")).withColumns({"h": m.held_by("a", "bs"), "f": m.fragments_of("a", "bs")})
    each = many.select("i", "a", F.explode(F.arrays_zip("bs", "h", "f")).alias("x")).select("i", F.col("x.bs").alias("b"), "x.f", F.col("x.h").alias("h"), m.overlaps(F.col("a"), F.col("x.bs")).alias("o"))
    size = F.size("b")
    got = each.select("i", "b", m.new_share(F.col("h.held1"), size).alias("n1"), m.new_share(F.col("h.held2"), F.greatest(size - 1, F.lit(0))).alias("n2"), "o", "f").collect()
    assert {(r.i, tuple(r.b)): (r.n1, r.n2, r.o.one, r.o.two, *r.f) for r in got} == plain


def test_evaluation_reads_no_source_for_each_model(spark):
    """The source's tokens end before the models' rows are made."""
    plan = ev._all(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "held_by" in plan and "Expand" not in plan


def test_sources_are_read_as_texts(spark):
    """Sources reach the worker as texts, once, and its tokens are those of the column function, CJK characters and marks among them."""
    texts = ["It's a well-known fact, isn't it? 12½ ⅷ", "日本語のテキスト、ー゠ab漢字c'd-", "한국어 text가 있다 ", "", "İstanbul ΣΑΣ ﬁne _x_ --' é é", "a​b c٠๑ \U0001d400\U00020000"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(F.lower("t").alias("low"), m.tokens(F.col("t")).alias("w")).collect()
    assert [m.words(r.low) for r in got] == [r.w for r in got]
    plan = ev.o8_all_metrics(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "text_held_by_pieces(lower" in plan and "regexp_extract_all(lower(coalesce(source_text" not in plan


def test_one_pass_over_a_summary_equals_the_column_functions(spark):
    """M5 to M9, M12 and M14 in one function; no token array of a summary is made in the JVM."""
    texts = ["It's 3.14 here. Isn't it?! Yes…  no", "漢字。かな！ ok ok ok ok", "", " . ", "The table made some noise. Rhythm, queue e", "İstanbul a b a b a b c。 d"]
    rows = [(a, b, lang) for a in texts for b in texts for lang in ("en", "tr")]
    t = spark.createDataFrame(rows, "a string, b string, lang string")
    r, g, n = m.tokens(F.col("a")), m.tokens(F.col("b")), m.sentence_lengths(F.col("b"))
    plain = [F.size(r), F.size(g), F.size(F.array_distinct(g)), m.clipped(r, g), m.clipped(m.ngrams(r, 2), m.ngrams(g, 2)), m.repetition(g, 3), n["mean"], n["std"], m.flesch(F.col("b"), F.col("lang")), m.bleu(r, g), m.meteor(r, g), m.lcs_length(r, g)]
    got = t.select("a", "b", "lang", F.struct(*[c.alias(f"c{i}") for i, c in enumerate(plain)]).alias("p"), m.compared_fully(F.lower("a"), F.lower("b"), F.col("lang") == "en").alias("x")).collect()
    assert all(tuple(x.p) == tuple(x.x) for x in got)
    plan = ev.o8_all_metrics(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "compared_fully" in plan and "regexp_extract_all" not in plan


def test_a_source_is_searched_without_its_automaton(monkeypatch):
    """Pieces by searches equal those by the automaton, which only long pairs of texts need; counts of n-grams by a shared reference equal plain ones."""
    rng, automaton, made = random.Random(5), m._automaton, []
    monkeypatch.setattr(m, "_automaton", lambda source: made.append(source) or automaton(source))
    for _ in range(300):
        a, *many = ([rng.choice("abcdé") * rng.randrange(1, 3) for _ in range(rng.randrange(k))] for k in (40, 12, 12, 3))
        found = m._found(a, many, True)
        assert [(x["coverage"], x["density"]) for x in found] == [m._pieces(automaton(a), b) for b in many]
        assert [{k: v for k, v in x.items() if k not in ("coverage", "density")} for x in found] == m._held(a, a, many)
        ref = m._Reference(" ".join(a), 4)
        for b in many:
            places = ref.matched(b)
            assert ref.hits(len(places), b) == [(Counter(zip(*(a[i:] for i in range(n)))) & Counter(zip(*(b[i:] for i in range(n))))).total() for n in range(1, 5)]
            assert m._meteor_of(sorted(places), len(a), len(b)) == m._meteor(a, b) and m._lcs_of(ref.bits, len(a), b) == m._lcs(a, b)
    assert not made
    monkeypatch.setattr(m, "MANY", 10)
    assert m._found(["a", "b"] * 20, [["b", "a", "c"]], True)[0]["density"] == 4 / 3 and made


def test_deltas_unpivot_means_only(spark):
    """Rows of samples aren't made long."""
    for name in ("r5_all_metrics", "r6_all_metrics"):
        plan = ev.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Expand") == 1 and "Aggregate" in plan[plan.index("Expand") :]


def test_statistics_store_long_rows_once(spark, monkeypatch):
    """The long rows are written once; what else is stored is a few rows of each group."""
    from newsloom.operators import ranks

    sizes, plain = [], ev.Stored
    kept = lambda df: (made := plain(df), sizes.append(made.df.count()))[0]
    monkeypatch.setattr(ev, "Stored", kept)
    monkeypatch.setattr(ranks, "Stored", kept)
    rows = spark.range(5000).selectExpr("'a' metric", "'b' model", "cast(id as double) value")
    assert tuple(ev.statistics(rows).first())[:4] == ("a", "b", 2499.5, 2499.5)
    assert sizes.count(5000) == 1
