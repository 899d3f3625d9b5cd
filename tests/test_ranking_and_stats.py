import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratafold.operators import classify, coverage, curves, ensemble, ordering, ranking, stats


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture
def scored(spark):
    return frame(spark, [(1, 0, 0.1), (2, 0, 0.8), (3, 1, 0.7), (4, 1, 0.9)], "id long, label int, score double")


def test_ranking_metrics(scored):
    row = ranking.ranking_metrics(scored, [], "score", "label").first()
    assert row["roc_auc"] == pytest.approx(0.75) and row["average_precision"] == pytest.approx(0.8333333, abs=1e-6)


def test_single_class_has_no_ranking(spark):
    row = ranking.ranking_metrics(frame(spark, [(1, 1, 0.2), (2, 1, 0.3)], "id long, label int, score double"), [], "score", "label").first()
    assert row["roc_auc"] is None and row["average_precision"] is None


def test_top_fraction(spark):
    data = frame(spark, [(i, 1 if i in (0, 5, 7) else 0, 1.0 - i / 10) for i in range(10)], "id long, label int, score double")
    rows = {r["fraction"]: r for r in ranking.top_fraction(data, [], "score", "label", "id", (0.01, 0.10)).collect()}
    for f in (0.01, 0.10):
        assert rows[f]["capture"] == pytest.approx(1 / 3) and rows[f]["precision"] == 1.0


@pytest.mark.parametrize("large", [False, True])
def test_ties_at_the_cut_are_broken_by_id(spark, large, request):
    if large:
        request.getfixturevalue("large_paths")
    # Two thirds of the rows share one score.
    data = frame(spark, [(i, i % 2, 0.5 if i % 3 else 0.9) for i in range(300)], "id long, label int, score double")
    row = ranking.top_fraction(data, [], "score", "label", "id", (0.5,)).first()
    order = sorted(((0.5 if i % 3 else 0.9), -i) for i in range(300))[::-1][:150]
    assert row["captured"] == sum(-i % 2 for _, i in order)


def test_rank_normalize(spark):
    data = frame(spark, [("a", 0.2), ("b", 0.8), ("c", 0.5)], "id string, s double")
    got = {r["id"]: r["r"] for r in ranking.rank_normalize(data, [], "s", "r").collect()}
    assert got == {"a": 0.0, "b": 1.0, "c": 0.5}
    with pytest.raises(Exception, match="missing score"):
        ranking.rank_normalize(frame(spark, [("a", None), ("b", 1.0)], "id string, s double"), [], "s", "r").collect()


def test_threshold_metrics_edge_cases(spark):
    data = frame(spark, [(0, 0.1), (0, 0.2)], "label int, p double")
    row = classify.threshold_metrics(data, [], "p", "label").first()
    assert row["precision"] == 0 and row["recall"] == 0 and row["mcc"] == 0 and row["balanced_accuracy"] == 1.0


def test_holm(spark):
    data = frame(spark, [(i, p) for i, p in enumerate([0.01, 0.03, 0.04, 0.20, None])], "id int, p double")
    got = {r["id"]: r["p_holm"] for r in stats.holm(data, [], "p", "id").collect()}
    assert [round(got[i], 10) for i in range(4)] == [0.04, 0.09, 0.09, 0.20] and got[4] is None


def test_rank_biserial(spark):
    data = frame(spark, [("x", d) for d in (0.3, 0.2, -0.1, 0.0)], "k string, diff double")
    assert stats.rank_biserial(data, ["k"]).first()["rank_biserial"] == pytest.approx(2 / 3)


def test_wilcoxon(spark):
    rows = [("five", d) for d in (0.1, 0.2, 0.3, 0.4, -0.05)] + [("flat", 0.0), ("flat", 0.0)] + [("many", 0.1 * i - 1.0 + 0.001 * i * i) for i in range(60)]
    got = {r["k"]: r for r in stats.wilcoxon(frame(spark, rows, "k string, diff double"), ["k"]).collect()}
    assert got["five"]["statistic"] == 1.0 and got["five"]["p_raw"] == pytest.approx(0.125)
    assert (got["flat"]["statistic"], got["flat"]["p_raw"]) == (0.0, 1.0)
    diffs = np.array([d for k, d in rows if k == "many"])
    ranks = np.abs(diffs).argsort().argsort() + 1.0
    w, n = min(ranks[diffs > 0].sum(), ranks[diffs < 0].sum()), len(diffs)
    z = (w - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    assert got["many"]["p_raw"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), rel=1e-6)


def test_bootstrap_is_deterministic_and_brackets_the_mean(spark):
    data = frame(spark, [("m", i, float(i)) for i in range(12)], "k string, id int, v double")
    one, two = (stats.bootstrap_mean_ci(data, ["k"], "v", "id", draws=300).first() for _ in range(2))
    assert one == two and one["ci_low"] < 5.5 < one["ci_high"]
    spread = np.std(np.arange(12.0)) / math.sqrt(12)
    assert one["ci_low"] == pytest.approx(5.5 - 1.96 * spread, abs=0.6) and one["ci_high"] == pytest.approx(5.5 + 1.96 * spread, abs=0.6)


def test_exact_stays_exact_beyond_fifty(spark):
    data = frame(spark, [("all", float(i + 1)) for i in range(60)], "k string, diff double")
    assert stats.wilcoxon(data, ["k"], "exact").first()["p_raw"] == pytest.approx(2.0 ** -59, rel=1e-9)
    mixed = [(-1) ** (i % 3) * (i + 1.0) for i in range(14)]
    low = min(sum(abs(v) for v in mixed if v > 0), sum(abs(v) for v in mixed if v < 0))
    sums = [sum(r + 1 for r in range(14) if mask >> r & 1) for mask in range(1 << 14)]
    got = stats.wilcoxon(frame(spark, [("m", v) for v in mixed], "k string, diff double"), ["k"], "exact").first()
    assert got["p_raw"] == pytest.approx(min(1.0, 2 * sum(s <= low for s in sums) / 2**14))


def test_groups_without_values_stay(spark):
    data = frame(spark, [("a", 1.0), ("a", 3.0), ("b", None), (None, 2.0)], "k string, v double")
    want = {"a": (2, 2.0), "b": (0, None), None: (1, 2.0)}
    for table in (stats.metric_summary(data, ["k"], "v"), coverage.distribution_summary(data, ["k"], "v")):
        assert {r["k"]: (r["n"], r["median"]) for r in table.collect()} == want
    diffs = stats.difference_summary(data.withColumnRenamed("v", "diff"), ["k"])
    assert {r["k"]: (r["n"], r["median_diff"]) for r in diffs.collect()} == want
    bounds = {r["k"]: r["ci_low"] for r in stats.bootstrap_mean_ci(data.withColumn("i", F.lit(1)), ["k"], "v", "i", draws=50).collect()}
    assert bounds["b"] is None and bounds[None] == 2.0


def test_probability_scores_need_both_classes(spark):
    data = frame(spark, [("one", 0, 0.2), ("one", 0, 0.4), ("two", 0, 0.2), ("two", 1, 0.8)], "k string, y int, p double")
    got = {r["k"]: r for r in classify.threshold_metrics(data, ["k"], "p", "y").collect()}
    assert got["one"]["brier"] is None and got["one"]["log_loss"] is None and got["two"]["brier"] == pytest.approx(0.04)


def test_chi2_tail(spark):
    got = frame(spark, [(3.0, 4.0), (3.0, 3.0), (10.0, 5.0)], "x double, k double").select(stats.chi2_tail("x", "k").alias("p")).collect()
    for row, want in zip(got, (0.5578254, 0.3916252, 0.0752352)):
        assert row["p"] == pytest.approx(want, abs=1e-6)


def test_weight_grid_and_selection(spark):
    assert ensemble.weight_grid(spark, ["a", "b", "c"], 0.5).count() == 6
    with pytest.raises(ValueError):
        ensemble.weight_grid(spark, ["a", "b"], 0.3)
    rows = [(i, label, r, r, r, r) for i, (label, r) in enumerate([(0, 0.0), (0, 1 / 3), (1, 2 / 3), (1, 1.0)])]
    data = frame(spark, rows, "id long, label int, rank_rf double, rank_gt double, rank_net double, rank_geo double")
    best = ensemble.select_weights(data, [], "label", "id", {n: f"rank_{n}" for n in ("rf", "gt", "net", "geo")}, 0.5, "geo").first()
    assert (best["w_rf"], best["w_gt"], best["w_net"], best["w_geo"]) == (1.0, 0.0, 0.0, 0.0) and best["average_precision"] == 1.0


def test_component_merge(spark):
    schema = "sample_id string, label int, x double, y double, partition string, score double"
    a = frame(spark, [("s1", 1, 0.0, 0.0, "test", 0.4), ("s2", 0, 1.0, 1.0, "test", 0.3), ("s3", 0, 1.0, 2.0, "train", 0.3)], schema)
    geo = frame(spark, [("s1", 1, 0.0, 0.0, 0.7), ("s2", 0, 2.0, 1.0, 0.1)], "sample_id string, label int, x double, y double, score double")
    good, bad = ensemble.merge_components({"rf": a}, geo, "test")
    assert [r["sample_id"] for r in good.collect()] == ["s1"]
    assert [(r["sample_id"], r["problem"]) for r in bad.collect()] == [("s2", "coordinate")]
    twice = a.unionByName(a.where("sample_id = 's1'"))
    assert ("s1", "duplicate") in [tuple(r) for r in ensemble.merge_components({"rf": twice}, geo, "test")[1].collect()]


def test_member_moments(spark):
    members = [[0.1, 0.5, 0.9], [0.2, 0.5, 0.7], [0.6, 0.5, 0.2]]
    rows = [(m, c, v) for m, values in enumerate(members) for c, v in enumerate(values)]
    got = {r["cell"]: r for r in ensemble.member_moments(frame(spark, rows, "member int, cell int, p double"), ["cell"], "p").collect()}
    for c in range(3):
        column = [m[c] for m in members]
        assert got[c]["mean"] == pytest.approx(np.mean(column)) and got[c]["std"] == pytest.approx(np.std(column, ddof=1))
    one = ensemble.member_moments(frame(spark, [(0, 0, 0.3)], "member int, cell int, p double"), ["cell"], "p").first()
    assert one["std"] == 0.0


def test_interpolation_matches_numpy(spark):
    rng = np.random.default_rng(3)
    xs, ys = np.sort(np.round(rng.random(40), 3)), rng.random(40)
    best = {}
    for x, y in zip(xs, ys):
        best[x] = max(best.get(x, -1), y)
    got = curves.interpolate_on_grid(frame(spark, [("k", float(x), float(y)) for x, y in zip(xs, ys)], "k string, x double, y double"), ["k"], "x", "y", 301)
    want = np.interp(np.linspace(0, 1, 301), list(best), list(best.values()))
    values = [r["value"] for r in got.orderBy("step").collect()]
    assert np.allclose(values, want, atol=1e-9)


@pytest.mark.parametrize("large", [False, True])
def test_prefix_totals_with_one_hot_group(spark, large, request):
    if large:
        request.getfixturevalue("large_paths")
    rows = [("hot" if i % 3 else f"g{i % 5}", i, float(i % 7)) for i in range(2000)]
    got = ordering.prefix_totals(
        frame(spark, rows, "k string, i long, v double"), ["k"], [F.col("v").desc(), F.col("i").asc()],
        sums={"s": F.col("v")}, maxima={"m": F.col("i")}, totals={"t": F.col("v")}, position="p")
    want = {}
    for k, i, v in sorted(rows, key=lambda r: (r[0], -r[2], r[1])):
        s, m, p = want.get(k, [(0.0, -1, 0)])[-1][-3:] if k in want else (0.0, -1, 0)
        want.setdefault(k, []).append((i, s + v, max(m, i), p + 1))
    flat = {(k, i): (s, m, p) for k, entries in want.items() for i, s, m, p in entries}
    for r in got.collect():
        assert (r["s"], r["m"], r["p"]) == flat[(r["k"], r["i"])]


@pytest.mark.parametrize("large", [False, True])
def test_exact_quantiles(spark, large, request):
    if large:
        request.getfixturevalue("large_paths")
    values = [float(v) for v in np.random.default_rng(1).integers(0, 30, 501)]
    got = ordering.exact_quantiles(frame(spark, [("a", v) for v in values] + [("b", 2.0), ("b", 4.0)], "k string, v double"), ["k"], "v", {"q": 0.05, "m": 0.5, "h": 0.95})
    rows = {r["k"]: r for r in got.collect()}
    assert rows["b"]["m"] == 3.0
    for name, p in (("q", 0.05), ("m", 0.5), ("h", 0.95)):
        assert rows["a"][name] == pytest.approx(np.quantile(values, p))


def test_histogram_bounds_hold_the_precision(spark):
    """Bounds of every vector hold its exact average precision, with ties, and few vectors are evaluated."""
    import random
    rng = random.Random(12)
    rows = [(i % 2, i, int(rng.random() < 0.2), round(rng.random(), 2), rng.random(), round(rng.random(), 1)) for i in range(1200)]
    rows = [(k, i, y, min(1.0, a + 0.3 * y), b, c) for k, i, y, a, b, c in rows]
    data = frame(spark, rows, "run long, id long, label int, rank_a double, rank_b double, rank_c double")
    names, ranks, units = ["a", "b", "c"], ["rank_a", "rank_b", "rank_c"], 10
    vector = [f"_u_{n}" for n in names]
    wide = ensemble._with_weights(data, names, units).withColumn("s", ensemble._score(names, ranks, units))
    exact = ranking.ranking_metrics(wide, ["run", *vector], "s", "label")
    for bins in (4, 64):
        bounds = ensemble.precision_bounds(wide, ["run"], vector, F.col("s"), "label", bins)
        assert exact.join(bounds, ["run", *vector]).where("average_precision < low - 1e-12 OR average_precision > high + 1e-12").count() == 0
    left = ensemble.surviving_vectors(data, ["run"], names, ranks, "label", units, (64, 1024))
    assert 2 <= left.count() < 0.3 * 2 * 66
    best = {r["run"]: r for r in ensemble.select_weights(data, ["run"], "label", "id", dict(zip(names, ranks)), 0.1).collect()}
    top = {r["run"]: r["m"] for r in exact.groupBy("run").agg(F.max("average_precision").alias("m")).collect()}
    assert {k: r["average_precision"] for k, r in best.items()} == top


def test_weights_of_runs_without_positives(spark):
    data = frame(spark, [(1, i, 0, i / 9, 1 - i / 9) for i in range(10)], "run long, id long, label int, rank_a double, rank_b double")
    best = ensemble.select_weights(data, ["run"], "label", "id", {"a": "rank_a", "b": "rank_b"}, 0.5).first()
    assert best["average_precision"] is None and best["w_a"] + best["w_b"] == 1


def test_counts_by_part_without_multiplied_rows(spark):
    """Blocks of rows, each counted for one vector after another, give the bounds of rows multiplied by vectors; NULL runs too."""
    rows = [(None if i % 3 == 0 else i % 3, (i * 7) % 11 < 4, (i * 37 % 101) / 100, (i * 53 % 101) / 100) for i in range(300)]
    data = spark.createDataFrame(rows, "run int, hit boolean, a double, b double").withColumn("label", F.col("hit").cast("int"))
    names, vector = ["a", "b"], ["_u_a", "_u_b"]
    left = ensemble._with_weights(data.select("run").distinct(), names, 10)
    found = ensemble.part_counts(data, left, ["run"], names, names, "label", 10, 16, 4)
    wide = ensemble._with_weights(data, names, 10).withColumn("s", ensemble._score(names, names, 10))
    want = {tuple(r) for r in ensemble.precision_bounds(wide, ["run"], vector, F.col("s"), "label", 16).collect()}
    got = {tuple(r) for r in ensemble.bounds_of(found, ["run", *vector]).collect()}
    assert len(got) == 33 and {r[:3] for r in got} == {r[:3] for r in want}
    near = {r[:3]: r[3:] for r in want}
    assert all(r[3:] == pytest.approx(near[r[:3]], abs=1e-12) for r in got)
