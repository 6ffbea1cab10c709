"""Plot data over all metrics against pandas, densities against a direct sum, the catalog's checks on literal rows."""

import numpy as np
import pytest
from test_evaluation_all import rows, same  # noqa: F401

from newsloom.operators.catalog import Catalog
from newsloom.operators.densities import densities
from newsloom.plans import evaluation as ev
from newsloom.plans import plots

SF = "/root/testdata/sf0.001"


def test_means_ranks_and_runs(spark, rows):  # noqa: F811
    got = plots.QUERIES["p8_small_multiples"](spark, SF).toPandas()
    means = rows.groupby(["language", "model"])[list(ev.METRICS)].mean().reset_index().melt(["language", "model"], var_name="metric", value_name="mean")
    of = {m: g for g, ms in plots.GROUPS.items() for m in ms}
    want = means[means["metric"].isin(of)].assign(group=lambda d: d["metric"].map(of))
    same(got, want[["group", "metric", "language", "model", "mean"]], ["group", "metric", "language", "model"])
    ranked = plots.QUERIES["o7_all_metrics"](spark, SF).toPandas()
    by = rows.groupby("model")[list(ev.METRICS)].mean()
    assert len(ranked) == 25 * len(by) and all(np.isclose(r.value, by.loc[r.model, r.metric]) for r in ranked.itertuples())
    for metric in ("rougeL_fmeasure", "latency_seconds"):
        order = by[metric].rank(method="min", ascending=metric in ev.LOWER_IS_BETTER)
        if by[metric].nunique() == len(by):
            assert {r.model: r.rank for r in ranked.itertuples() if r.metric == metric} == order.astype(int).to_dict()
    deltas = plots.QUERIES["r7_all_metrics"](spark, SF).toPandas()
    split = rows.assign(run=rows["sample_id"].astype(int) % 2).groupby(["run", "language", "model"])[list(ev.METRICS)].mean()
    want = (split.loc[1] - split.loc[0]).reset_index().melt(["language", "model"], var_name="metric", value_name="delta").dropna()
    same(deltas[["language", "model", "metric", "delta"]], want, ["language", "model", "metric"])


def test_points(spark, rows):  # noqa: F811
    got = plots.QUERIES["p12_scatter_pairs"](spark, SF).toPandas()
    assert set(zip(got.x_metric, got.y_metric, strict=True)) == set(plots.PAIRS) and len(plots.PAIRS) == 12
    known = rows.set_index(["sample_id", "model"])
    drawn = set(zip(got.sample_id, got.model, strict=True))
    assert len(drawn) == min(len(rows), plots.PLOT_ROWS)
    for r in got.head(400).itertuples():
        assert np.isclose(known.loc[(r.sample_id, r.model), r.x_metric], r.x) and np.isclose(known.loc[(r.sample_id, r.model), r.y_metric], r.y)
    pair = plots.QUERIES["p13_pair_plot"](spark, SF).toPandas()
    assert len(pair) == min(plots.PAIRPLOT_ROWS, len(rows.dropna(subset=list(plots.CENTRAL)))) and set(plots.CENTRAL) < set(pair.columns)


def test_densities_equal_the_direct_sum(spark):
    rng = np.random.default_rng(3)
    groups = {"normal": rng.normal(5, 2, 800), "two": np.r_[rng.normal(0, 1, 300), rng.normal(9, 0.5, 200)], "ties": rng.integers(0, 4, 500).astype(float), "same": np.full(20, 3.0), "one": np.array([1.0]), None: rng.random(50)}
    data = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("one", None), ("normal", float("nan"))]
    got = densities(spark.createDataFrame(data, "g string, v double").repartition(4), ["g"], "v").toPandas()
    for g, vs in groups.items():
        mine = got[got["g"].isna() if g is None else got["g"] == g].sort_values("x")
        if len(set(vs)) == 1:
            assert len(mine) == 1 and mine["density"].isna().all() and mine["x"].iloc[0] == vs[0]
            continue
        width = vs.std(ddof=1) * len(vs) ** -0.2
        x = np.linspace(vs.min(), vs.max(), 100)
        want = np.exp(-0.5 * ((x[:, None] - vs) / width) ** 2).sum(1) / (len(vs) * width * np.sqrt(2 * np.pi))
        assert np.allclose(mine["x"], x) and np.allclose(mine["bandwidth"], width)
        assert np.abs(mine["density"].to_numpy() - want).max() < 1e-4 * want.max()


def test_catalog(spark):
    data = [("a", "en", "sports", "US", "americas"), ("b", "fr", "general", "FR", "europe"), ("b", "fr", "general", "FR", ""), ("c", "xx", "", None, None), (None, "en", "world", "US", "americas"), (" ", None, "world", "US", "americas")]
    c = Catalog(spark.createDataFrame(data, "source_key string, language string, topic string, country string, region string"), {"m1": "path1", "m2": "path2"}, default_model_key="m2", default_language_key="xx")
    assert (c.default_model, c.default_language) == ("m2", "en") and c.is_valid_model("m1") and not c.is_valid_model("m3") and c.is_valid_language("en") and not c.is_valid_language("xx")
    assert Catalog(c.sources, {"m1": "p"}, default_model_key="gone", default_language_key="fr").default_model == "m1" and Catalog(c.sources, {}).default_model == ""
    assert c.available("country") == ["FR", "US"] and c.available("region") == ["americas", "europe"] and c.available("topic") == ["general", "sports", "world"]
    got = sorted((str(r.source_key), tuple(r.wrong), r.valid) for r in c.valid_sources().collect())
    assert got == sorted([("a", (), True), ("b", ("repeated_key",), False), ("b", ("repeated_key",), False), ("c", ("language", "no_topic"), False), ("None", ("no_key",), False), (" ", ("no_key", "language"), False)])


@pytest.mark.parametrize("name", ["p10_densities"])
def test_all_metrics_have_densities(spark, name):
    got = plots.QUERIES[name](spark, SF).toPandas()
    assert set(got["metric"]) == set(ev.METRICS) and (got["density"].dropna() >= 0).all()
