import json
import math
import re

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from stratafold.functions import text
from stratafold.operators import audit, experiments, features, models, neighbours, polygons, scoring, splits
from stratafold.operators.ranking import ranking_metrics
from stratafold.sources import files, rasters, runs, vectors
from stratafold.streaming import moments


def test_preprocessor_is_fitted_on_training_rows_only(spark):
    train = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (None, 5.0)], "a double, b double")
    held = spark.createDataFrame([(500.0, 9.0)], "a double, b double")
    fitted = features.fit_preprocessor(train, ["a", "b"])
    assert fitted.kept == ("a",) and fitted.medians["a"] == 1.5
    assert fitted.transform(train).agg(F.avg("a")).first()[0] == pytest.approx(0)
    assert fitted.transform(held).first()["a"] > 100
    again = features.Preprocessor.from_frame(fitted.to_frame(spark))
    assert again == fitted
    with pytest.raises(ValueError):
        features.fit_preprocessor(train.select("b"), ["b"])


@pytest.mark.parametrize("large", [False, True])
def test_column_quantiles(spark, large, request):
    if large:
        request.getfixturevalue("large_paths")
    data = spark.createDataFrame([(float(i), float(i * i) if i % 3 else None) for i in range(50)], "a double, b double")
    got = {r["feature"]: r["m"] for r in features.column_quantiles(data, ["a", "b"], {"m": 0.5}).collect()}
    assert got["a"] == 24.5 and got["b"] == pytest.approx(np.median([i * i for i in range(50) if i % 3]))


def brute(queries, reference, k, exclude):
    out = {}
    for q, v in queries:
        gap = lambda r: float(np.sqrt(((np.array(v) - np.array(r)) ** 2).sum()))  # noqa: B023, E731
        order = sorted((gap(r), i) for i, r in reference if not (exclude and i == q))
        out[q] = [i for _, i in order[:k]]
    return out


@pytest.mark.parametrize("exclude", [False, True])
def test_knn_with_a_third_of_identical_points(spark, exclude):
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, 1.0] if i % 3 == 0 else [float(v) for v in rng.normal(size=2).round(2)]) for i in range(300)]
    data = spark.createDataFrame(rows, "id long, vec array<double>")
    # Tiny cells and blocks, so that many cells and blocks meet.
    found = neighbours.knn_join(data, data, 5, exclude_self=exclude, cell_rows=20, block_rows=7)
    got = {}
    for r in found.orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["neighbour"])
    assert got == brute(rows, rows, 5, exclude)
    with pytest.raises(ValueError):
        neighbours.knn_join(data.limit(3), data.limit(3), 5)


def test_ego_graph_excludes_self(spark):
    rows = [(i, [float(i), 0.0], [float(i), i * 2.0, 1.0]) for i in range(4)]
    data = spark.createDataFrame(rows, "id long, vec array<double>, feat array<double>")
    found = neighbours.knn_join(data, data, 2, payload="feat", exclude_self=True)
    graphs = {r["id"]: r["graph"] for r in neighbours.ego_graphs(data, found, "id", "feat", "feat").collect()}
    assert {len(g) for g in graphs.values()} == {3} and {len(n) for g in graphs.values() for n in g} == {3}
    assert all(graphs[i][0] == rows[i][2] and rows[i][2] not in graphs[i][1:] for i in range(4))


def net_data(n=400):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(n, 3))
    return x, (x[:, 0] + 0.5 * x[:, 1] > 0).astype(int), rng.random((n, 3))


def test_network_gradient_matches_differences():
    x, y, prior = net_data(20)
    config = models.NetConfig(hidden=(5, 4), prior_weight=0.3)
    net = models.new_net(3, config, 3)
    net.tensors["log_sigma"] = np.array([0.1, -0.2, 0.3])
    w = np.where(y == 1, 1.5, 0.7)
    _, grad = models.loss_and_gradient(net.tensors, x, y, w, prior, config)
    for name, value in net.tensors.items():
        for at in np.ndindex(value.shape):
            kept, step = value[at], 1e-6
            value[at] = kept + step
            up = models.loss_and_gradient(net.tensors, x, y, w, prior, config)[0]
            value[at] = kept - step
            down = models.loss_and_gradient(net.tensors, x, y, w, prior, config)[0]
            value[at] = kept
            assert grad[name][at] == pytest.approx((up - down) / (2 * step), abs=1e-6)


def test_zero_weight_and_frozen_sigmas():
    x, y, prior = net_data(30)
    base = models.new_net(3, models.preset("prior_mlp"), 3)
    w = np.ones(30)
    zero = models.loss_and_gradient(base.tensors, x, y, w, prior, models.preset("prior_mlp", prior_weight=0.0))
    plain = models.loss_and_gradient(base.tensors, x, y, w, np.zeros((30, 0)), models.preset("mlp"))
    assert zero[0] == plain[0] and all(np.array_equal(zero[1][k], plain[1][k]) for k in plain[1] if k != "log_sigma")
    assert not zero[1]["log_sigma"].any()
    frozen = models.loss_and_gradient(base.tensors, x, y, w, prior, models.preset("prior_mlp", fixed_prior_weights=True))
    assert not frozen[1]["log_sigma"].any()
    assert sum(v.size for k, v in models.new_net(9, models.preset("prior_mlp"), 3).tensors.items()) == 2_789


def test_network_learns_a_separable_set(spark):
    x, y, prior = net_data()
    rows = [([float(v) for v in a], int(b), [float(v) for v in c]) for a, b, c in zip(x, y, prior)]
    data = spark.createDataFrame(rows, "features array<double>, label int, priors array<double>").repartition(4)
    net = models.train_net(data, data, models.preset("prior_mlp", epochs=6, lr=0.02, batch=32, prior_weight=0.01))
    assert max(h["val_pr_auc"] for h in net.history) > 0.95
    summary = {r["tensor"]: r["n"] for r in models.parameter_summary(spark, net).collect()}
    assert summary["w1"] == 3 * 64 and summary["log_sigma"] == 3


def test_trees_and_attribution(spark):
    x, y, _ = net_data(300)
    data = spark.createDataFrame([(i, *map(float, a), int(b)) for i, (a, b) in enumerate(zip(x, y))], "id long, a double, b double, c double, label int")
    model = models.fit_tree(data, ["a", "b", "c"], "rf", 1, {"numTrees": 10, "maxDepth": 4})
    score = lambda df: models.score_tree(model, df, ["a", "b", "c"])
    values = models.shapley_values(score, data.where("id < 100"), data.where("id between 100 and 120"), ["a", "b", "c"], "id", samples=10)
    assert values.count() == 63
    ranked = [r["feature"] for r in models.importance(values).collect()]
    assert ranked[0] == "a" and ranked[-1] == "c"
    assert models.search_trials("rf", 3, 1) == models.search_trials("rf", 3, 1)
    with pytest.raises(ValueError):
        models.resolve_family("rf", "mlp")
    assert models.resolve_family(None, " GNN ") == "gnn"


def test_attribution_adds_up(spark):
    data = spark.createDataFrame([(i, float(i), float(i % 3)) for i in range(6)], "id long, a double, b double")
    score = lambda df: df.withColumn("probability", 2 * F.col("a") - F.col("b"))
    values = models.shapley_values(score, data.where("id = 0"), data, ["a", "b"], "id", samples=4)
    got = {(r["id"], r["feature"]): r["value"] for r in values.collect()}
    assert got[(5, "a")] == pytest.approx(10.0) and got[(5, "b")] == pytest.approx(-2.0)


def test_ensemble_rasters(spark):
    a = spark.createDataFrame([(0, 0, 0.2), (0, 1, None)], "r int, c int, probability double")
    b = spark.createDataFrame([(0, 0, 0.4), (0, 1, 0.5)], "r int, c int, probability double")
    got = {(r["r"], r["c"]): (r["members"], r["mean"], r["std"]) for r in scoring.ensemble_raster([(a, ["x"]), (b, ["x"])]).collect()}
    assert got[(0, 0)] == (2, pytest.approx(0.3), pytest.approx(math.sqrt(0.02))) and got[(0, 1)] == (1, 0.5, 0.0)
    with pytest.raises(ValueError):
        scoring.ensemble_raster([(a, ["x"]), (b, ["y"])])


def test_early_stopping_counts_from_the_last_improvement(spark):
    # Steps below 1e-6 add up: the third one beats the last improvement.
    scores = [0.5, 0.5 + 6e-7, 0.5 + 1.2e-6, None, 0.4, 0.6, 0.1, 0.1, 0.1, 0.9]
    data = spark.createDataFrame([(i + 1, s) for i, s in enumerate(scores)], "epoch long, s double")
    row = experiments.best_checkpoint(data, [], "epoch", "s", 3).first()
    assert (row["best_epoch"], row["stop_epoch"]) == (6, 9) and row["best_score"] == 0.6
    early = experiments.best_checkpoint(data, [], "epoch", "s", 2).first()
    assert (early["best_epoch"], early["stop_epoch"]) == (3, 5)


def test_experiment_matrix(spark):
    matrix = experiments.experiment_matrix(spark)
    assert matrix.count() == 72 and experiments.repeated_keys(matrix).count() == 0
    counts = {(r["axis"], r["prior_weight"] == 0): r["count"] for r in matrix.groupBy("axis", "prior_weight").count().collect()}
    assert counts == {("negative_realization", False): 40, ("negative_realization", True): 10, ("prior_scale", False): 6,
                      ("initialization", False): 9, ("spatial_grid", False): 6, ("baseline", False): 1}
    assert experiments.benchmark_matrix(spark, 10, ["a"] * 7).count() == 70


def test_inventory(spark):
    expected = spark.createDataFrame([("r0", "metrics.json"), ("r1", "metrics.json"), ("r1", "a.csv")], "run string, file string")
    present = spark.createDataFrame([("r0", "metrics.json")], "run string, file string")
    got = {r["run"]: r["missing"] for r in files.inventory(expected, present, ["run"]).collect()}
    assert got == {"r0": "", "r1": "a.csv;metrics.json"}


def test_content_findings(spark):
    token = "gh" + "p_" + "a" * 36
    rows = [
        ("src/a.py", b"print(1)", "100644"), ("../b.py", b"x", "100644"), ("data/c.py", b"x", "100644"), ("d.png", b"\xff\xfe\x00", "100644"),
        ("e.py", f"t = {token}".encode(), "100644"), (".env.local", b"x", "120000"), ("f.py", b"a\x00b", "100755"), (".gitignore", b"x", "100644"),
        ("big.txt", b"x" * 2_000_001, "100644"),
    ]
    got = {}
    for r in audit.content_findings(spark.createDataFrame(rows, "path string, content binary, mode string")).collect():
        got.setdefault(r["path"], set()).add(r["finding"])
    assert got == {
        "../b.py": {"non-relative path"}, "data/c.py": {"controlled data/output/dependency directory"},
        "d.png": {"non-source artifact type", "binary or non-UTF-8 content"}, "e.py": {"GitHub credential"},
        ".env.local": {"symlink, submodule or unsupported Git mode", "environment/credential file", "non-source artifact type"},
        "f.py": {"binary content"}, "big.txt": {"oversized source file; review required"}}
    assert token not in str(got)


def test_selection_protocol(spark):
    rows = [("rf", "none", None, None, None, None), ("rf", "bayes", None, None, None, None), ("mlp", None, "pr_auc", "pr_auc", 0.5, 0.5 + 1e-12),
            ("mlp", None, "roc_auc", "pr_auc", 0.5, 0.5), ("mlp", None, "pr_auc", "pr_auc", 0.5, 0.6), ("zz", None, None, None, None, None)]
    data = spark.createDataFrame(rows, "algorithm string, optimizer string, configured_metric string, recorded_metric string, selected_score double, validation_ap double")
    got = [r["protocol"] for r in audit.selection_protocol(data, ["rf"], ["mlp"]).collect()]
    assert got == ["single_fit_no_checkpoint", None, "validation_pr_auc_checkpoint", None, None, None]


def test_text_helpers(spark):
    row = spark.range(1).select(
        text.int_list(F.lit("3, 1,,3")).alias("i"), text.string_list(F.lit(" B,a ,b")).alias("s"), text.to_number(F.lit("nan")).alias("n"),
        text.fixed(F.lit("1.23456")).alias("f"), text.fixed(F.lit("x")).alias("g"), text.percent(F.lit(0.12345)).alias("p"),
        text.algorithm_key(F.lit(" NetA "), {"neta": "net_a"}).alias("k"), text.algorithm_label(F.lit("abc")).alias("l"),
        text.json_field(F.lit('{"a":{"b":1}}'), "$.a.b").alias("j"), text.json_field(F.lit("{}"), "$.a", "d").alias("d"),
        text.first_token(F.array(F.lit("x/Metrics.json"), F.lit("roc_curve.csv")), ["roc", "metrics"]).alias("t")).first()
    assert row["i"] == [1, 3] and row["s"] == ["a", "b"] and row["n"] is None and row["f"] == "1.2346" and row["g"] == "-"
    assert row["p"] in ("12.35%", "12.34%") and row["k"] == "net_a" and row["l"] == "ABC" and row["j"] == "1" and row["d"] == "d" and row["t"] == "roc_curve.csv"


def test_geojson_round_trip(spark, tmp_path):
    square = [[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]]
    hole = [[[[5, 5], [9, 5], [9, 9], [5, 9], [5, 5]], [[6, 6], [7, 6], [7, 7], [6, 7], [6, 6]]]]
    document = {"type": "FeatureCollection", "crs": {"properties": {"name": "EPSG:32733"}}, "features": [
        {"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": square}},
        {"type": "Feature", "properties": {}, "geometry": {"type": "MultiPolygon", "coordinates": hole}}]}
    path = tmp_path / "zones.geojson"
    path.write_text(json.dumps(document, indent=1))
    layer = vectors.read_geojson_polygons(spark, str(path))
    assert [len(r["rings"]) for r in layer.orderBy("zone_id").collect()] == [1, 2]
    from stratafold.operators import polygons
    points = spark.createDataFrame([(0, 1.0, 1.0), (1, 6.5, 6.5), (2, 8.0, 8.0)], "id long, x double, y double")
    assert sorted(r["id"] for r in polygons.within(points, layer, "id").collect()) == [0, 2]
    out = str(tmp_path / "points")
    vectors.write_points(points, out, "geojson")
    lines = [json.loads(r[0]) for r in spark.read.text(out).collect()]
    assert sorted(f["geometry"]["coordinates"] for f in lines) == [[1.0, 1.0], [6.5, 6.5], [8.0, 8.0]]
    with pytest.raises(Exception):
        vectors.write_points(points, out, "geojson")
    bad = dict(document, features=[{"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 1], [2, 2]]]}}])
    path.write_text(json.dumps(bad))
    with pytest.raises(ValueError, match="invalid polygon"):
        vectors.read_geojson_polygons(spark, str(path))


def test_layers_and_partition_pruning(spark, tmp_path):
    pixels = spark.createDataFrame([("dome_dist.tif", 0, 0, 1.0), ("fault.tif", 0, 0, 2.0)], "raster string, r int, c int, value double")
    path = str(tmp_path / "pixels")
    rasters.write_pixels(pixels, path)
    one = rasters.read_pixels(spark, path, ["fault.tif"])
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert one.count() == 1 and "isnotnull(raster" in plan.split("PushedFilters")[0] and "PushedFilters: []" in plan
    names = rasters.layer_names(rasters.read_pixels(spark, path))
    assert rasters.find_layer(names, "FAULT.tif") == "fault.tif" and rasters.find_layer(names, "dome, xx") == "dome_dist.tif"
    for pattern in ("zzz", "dome,fault"):
        with pytest.raises(ValueError):
            rasters.find_layer(names, pattern)


def test_run_folders(spark, tmp_path):
    folder = tmp_path / "realization_03" / "rf" / "seed_2026"
    folder.mkdir(parents=True)
    (folder / "test_predictions.csv").write_text("row_index,sample_id,partition,block_id,label,x,y,probability,prediction\n0,s,test,1,1,0.0,0.0,0.7,1\n")
    (folder / "metrics.json").write_text(json.dumps({"test_metrics": {"pr_auc": 0.5}, "validation_metrics": {"pr_auc": 0.4}}, indent=2))
    row = runs.read_predictions(spark, str(tmp_path)).first()
    assert (row["realization"], row["algorithm"], row["probability"]) == (3, "rf", 0.7)
    ledger = spark.createDataFrame([(3, "rf", "completed"), (4, "rf", "failed")], "realization int, algorithm string, status string")
    got = {r["split"]: r["value"] for r in runs.read_metrics(spark, str(tmp_path), ledger).collect()}
    assert got == {"test": 0.5, "validation": 0.4}
    for bounds in ([0, 0, 10, 20], {"min_x": 0, "min_y": 0, "max_x": 10, "max_y": 20}):
        manifest = tmp_path / "split.json"
        manifest.write_text(json.dumps({"split_mode": "spatial_block", "grid_size": 5, "bounds": bounds, "partitions": {"train": [1, 2], "test": [3]}}))
        rows = runs.read_split_manifest(spark, str(manifest)).collect()
        assert sorted((r["partition"], r["block_id"], r["max_y"]) for r in rows) == [("test", 3, 20.0), ("train", 1, 20.0), ("train", 2, 20.0)]


def test_predictions_of_a_rerun_replace_its_own_folders(spark, tmp_path):
    """A run over several files comes back whole, a rerun leaves the other runs alone."""
    root = str(tmp_path / "runs")
    names = [part.split()[0] for part in runs.PREDICTIONS.split(", ")]
    rows = spark.range(60).selectExpr(
        "id AS row_index", "concat('s', id) AS sample_id", "'test' AS partition", "id % 5 AS block_id", "id % 2 AS label", "id / 3 AS x",
        "CAST(NULL AS DOUBLE) AS y", "1 / (id + 1) AS probability", "id % 2 AS prediction", "CAST(id % 2 AS INT) AS realization", "'rf' AS algorithm")
    runs.write_predictions(rows, root, rows_per_file=10)
    back = runs.read_predictions(spark, root, "*.csv")
    assert back.select("_metadata.file_path").distinct().count() > 2
    key = lambda frame: sorted(map(str, frame.select(*names, "realization", "algorithm").collect()))
    assert key(back) == key(rows)
    runs.write_predictions(rows.where("realization = 1").limit(3), root)
    assert {r["realization"]: r["count"] for r in runs.read_predictions(spark, root, "*.csv").groupBy("realization").count().collect()} == {0: 30, 1: 3}


def test_split_manifest_file_is_written_once(spark, tmp_path):
    path = str(tmp_path / "manifest")
    blocks = spark.createDataFrame([(4, "train"), (2, "train"), (9, "test")], "block_id bigint, partition string")
    box = polygons.bounds(spark.createDataFrame([(0.0, 1.0), (5.0, None), (2.0, 7.0)], "x double, y double"))
    runs.write_split_manifest(blocks, box, 5, 7, path)
    got = sorted(tuple(r) for r in runs.read_split_manifest(spark, path).collect())
    assert got == [("test", 9, 5, 0.0, 1.0, 5.0, 7.0), ("train", 2, 5, 0.0, 1.0, 5.0, 7.0), ("train", 4, 5, 0.0, 1.0, 5.0, 7.0)]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        runs.write_split_manifest(blocks, box, 5, 7, path)


def test_within_bounds_keeps_edges(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 4.0, 3.0), (3, 4.1, 3.0), (4, None, 1.0)], "id int, x double, y double")
    box = polygons.bounds(points.where("id <= 2"))
    assert sorted(r["id"] for r in polygons.within_bounds(points, box).collect()) == [1, 2]
    assert polygons.within_bounds(points, polygons.bounds(points.where("id > 9"))).count() == 0
    keyed = points.withColumn("k", F.col("id") % 2)
    boxes = polygons.bounds(keyed.where("id = 1"), ["k"])
    assert [r["id"] for r in polygons.within_bounds(keyed, boxes, ["k"]).collect()] == [1]


def test_run_stamp_is_utc(spark):
    stamp = spark.range(1).select(text.utc_stamp().alias("t")).first()["t"]
    assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\+00:00", stamp)


def test_hashes_and_owned_partitions(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.shp").write_bytes(b"abc")
    (tmp_path / "in" / "a.dbf").write_bytes(b"x")
    before = files.hash_files(spark, str(tmp_path / "in"))
    (tmp_path / "in" / "sub").mkdir()
    (tmp_path / "in" / "sub" / "empty.txt").write_bytes(b"")
    hashes = files.hash_files(spark, str(tmp_path / "in"))
    lone = hashes.where("bytes = 0").first()
    assert lone["path"].endswith("sub/empty.txt") and lone["sha256"].startswith("e3b0c442")
    assert [r["change"] for r in files.archive_changes(before, hashes).collect()] == ["added"]
    hashes = hashes.where("bytes > 0")
    grouped = files.dataset_hashes(hashes).first()
    assert [f["suffix"] for f in grouped["files"]] == [".dbf", ".shp"]
    assert grouped["files"][1]["sha256"].startswith("ba7816bf")
    out = str(tmp_path / "out")
    files.write_owned(spark.createDataFrame([(0, 1), (1, 1)], "k int, v int"), out, ["k"])
    files.write_owned(spark.createDataFrame([(1, 2)], "k int, v int"), out, ["k"])
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(out).collect()) == [(0, 1), (1, 2)]


def test_manifest_split_counts(spark):
    """A 5 x 5 block manifest gives 30/10/10 of two rows per block."""
    parts = {"train": 15, "validation": 5, "test": 5}
    blocks, at = [], 0
    for name, n in parts.items():
        blocks += [(at + i, name) for i in range(n)]
        at += n
    rows = spark.createDataFrame([(b * 2 + j, b, j) for b in range(25) for j in (0, 1)], "id long, block_id int, label int")
    got = {r["partition"]: (r["rows"], r["positives"]) for r in splits.split_counts(splits.assign_partitions(rows, spark.createDataFrame(blocks, "block_id int, partition string"))).collect()}
    assert got == {"train": (30, 15), "validation": (10, 5), "test": (10, 5)}


def test_streamed_moments_over_arriving_files(spark, tmp_path):
    source, seen = str(tmp_path / "members"), {}
    for member in range(3):
        spark.createDataFrame([(member, 0, c, 0.1 * (member + c)) for c in range(2)], moments.MEMBER_SCHEMA).write.mode("append").parquet(source)
        stream = moments.running_moments(moments.read_members(spark, source))

        def store(batch, epoch):
            for r in batch.collect():
                seen[(r["r"], r["c"])] = (r["members"], r["mean"], r["std"])

        moments.start(stream, str(tmp_path / "state"), store).awaitTermination()
        values = [0.1 * m for m in range(member + 1)]
        want = np.std(values, ddof=1) if member else 0.0
        assert seen[(0, 0)] == (member + 1, pytest.approx(np.mean(values)), pytest.approx(want))


def test_ledger_merge(spark):
    old = spark.createDataFrame([(0, "failed"), (1, "completed")], "run int, status string")
    new = spark.createDataFrame([(0, "completed"), (2, "failed")], "run int, status string")
    merged = experiments.merge_ledger(old, new, ["run"])
    assert sorted(tuple(r) for r in merged.collect()) == [(0, "completed"), (1, "completed"), (2, "failed")]


def test_neighbour_features_against_brute_force(spark):
    rng = np.random.default_rng(4)
    known = [(i, float(x), float(y), float(v)) for i, (x, y, v) in enumerate(rng.random((60, 3)))]
    cells = [(1000 + i, float(x), float(y), 0.5) for i, (x, y) in enumerate(rng.random((20, 2)))]
    got = scoring.neighbour_features(
        spark.createDataFrame(cells, "cell long, x double, y double, f double"), spark.createDataFrame(known, "id long, x double, y double, f double"), ["f"], 3)
    for r in got.collect():
        _, cx, cy, own = cells[r["cell"] - 1000]
        near = sorted(known, key=lambda p: math.hypot(p[1] - cx, p[2] - cy))[:3]
        assert r["features"] == [own, pytest.approx(np.mean([p[3] for p in near]))]


def test_versioned_sink_survives_a_restart(spark, tmp_path):
    """Two batches with a restart between them, and a batch that runs twice, leave the moments of all members."""
    source, place = str(tmp_path / "members"), str(tmp_path / "store")
    frames = {m: [(m, 0, c, 0.1 * (m + c)) for c in range(m, 4)] for m in range(3)}
    for member, rows in frames.items():
        spark.createDataFrame(rows, moments.MEMBER_SCHEMA).coalesce(1).write.mode("append").parquet(source)
        state = moments.running_moments(moments.read_members(spark, source))
        sink = moments.versioned(place, ["r", "c"])

        def twice(batch, epoch):
            sink(batch, epoch)
            sink(batch, epoch)

        moments.start(state, str(tmp_path / "state"), twice).awaitTermination()
    got = {r["c"]: (r["members"], r["mean"]) for r in moments.latest(spark, place, state.schema).collect()}
    for c in range(4):
        own = [v for rows in frames.values() for _, _, x, v in rows if x == c]
        assert got[c] == (len(own), pytest.approx(sum(own) / len(own)))


def test_early_stop_over_a_series_that_always_improves(spark):
    """Every epoch is a record, and no list of them is built."""
    n = 200_000
    rows = spark.range(n).select((F.col("id") % 2).alias("run"), "id", (F.col("id") * 1.0).alias("score"))
    got = {r["run"]: r for r in experiments.best_checkpoint(rows, ["run"], "id", "score", 5).collect()}
    assert {k: (r["best_epoch"], r["stop_epoch"], r["best_score"]) for k, r in got.items()} == {k: (n - 2 + k, n - 2 + k, float(n - 2 + k)) for k in (0, 1)}
    alone = experiments.best_checkpoint(rows.drop("run"), [], "id", "score", 5).first()
    assert (alone["best_epoch"], alone["stop_epoch"]) == (n - 1, n - 1)


def test_knn_queries_are_copied_to_blocks_not_cells(spark, monkeypatch):
    """Vectors of many dimensions, where no cell can be left out: a query meets each block once, whatever it holds."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=24).tolist(), [float(i)]) for i in range(400)]
    data = spark.createDataFrame(rows, "id long, vec array<double>, feat array<double>")
    sizes, cut = [], neighbours.cut
    monkeypatch.setattr(neighbours, "cut", lambda df: (lambda out: (sizes.append(out.count()) if "cells" in out.columns else None, out)[1])(cut(df)))
    found = neighbours.knn_join(data, data, 4, payload="feat", exclude_self=True, cell_rows=10, block_rows=100)
    got = {}
    for r in found.orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["neighbour"])
        assert r["feat"] == [float(r["neighbour"])]
    assert got == brute([r[:2] for r in rows], [r[:2] for r in rows], 4, True)
    assert len(sizes) == 1 and sizes[0] <= 400 * 5  # 40 cells in about 4 blocks


def test_knn_of_repeated_rows(spark):
    """Blocks of several cells: no neighbour is found twice, and a row that comes twice counts twice."""
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=2).tolist()) for i in range(120)]
    data = spark.createDataFrame(rows + [rows[5]], "id long, vec array<double>")
    got = {}
    for r in neighbours.knn_join(spark.createDataFrame(rows[10:], data.schema), data, 6, cell_rows=10, block_rows=60).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["neighbour"])
    assert got == brute(rows[10:], rows + [rows[5]], 6, False)


def test_attribution_scores_the_end_of_all_walks_once(spark):
    """Each row's own score is taken once, every other step of its walks once; sums by row need no second exchange."""
    data = spark.createDataFrame([(i, float(i), float(i % 3)) for i in range(6)], "id long, a double, b double")
    passed = []

    def score(df):
        passed.append(df.count())
        return df.withColumn("probability", F.col("a") * F.col("b") - F.col("b"))
    values = models.shapley_values(score, data, data, ["a", "b"], "id", samples=4)
    own = {r["id"]: r["a"] * r["b"] - r["b"] for r in data.collect()}
    got = {(r["id"], r["feature"]): r["value"] for r in values.collect()}
    assert sum(passed) == 6 + 6 * 4 * 2
    means = models.shapley_values(score, data.where("id = 4"), data, ["a", "b"], "id", samples=4).groupBy("id").agg(F.sum("value")).collect()
    assert {r[0]: r[1] for r in means} == pytest.approx({i: v - own[4] for i, v in own.items()})
    assert len(got) == 12


def test_attribution_of_repeated_and_unnamed_rows(spark):
    """Rows that share an id are summed, rows without one are a row of their own."""
    data = spark.createDataFrame([(1, 2.0), (1, 3.0), (None, 5.0)], "id long, a double")
    score = lambda df: df.withColumn("probability", F.col("a"))
    values = models.shapley_values(score, spark.createDataFrame([(0, 1.0)], "id long, a double"), data, ["a"], "id", samples=3)
    assert {r["id"]: r["value"] for r in values.collect()} == pytest.approx({1: 3.0, None: 4.0})


def test_search_prepares_its_rows_once(spark, monkeypatch):
    x, y, _ = net_data(120)
    data = spark.createDataFrame([(*map(float, a), int(b)) for a, b in zip(x, y)], "a double, b double, c double, label int")
    calls, spread = [], models.spread
    monkeypatch.setattr(models, "spread", lambda df: calls.append(1) or spread(df))
    ranges = {"numTrees": (2, 4, False), "maxDepth": [2, 3]}
    tried = models.random_search(data, data, ["a", "b", "c"], "rf", 3, 1, ranges).collect()
    assert len(calls) == 1 and [r["trial"] for r in tried] == [0, 1, 2]
    fitted = models.fit_tree(data, ["a", "b", "c"], "rf", 1, models.search_trials("rf", 3, 1, ranges)[1])
    metrics = ranking_metrics(models.score_tree(fitted, data, ["a", "b", "c"]), [], "probability", "label").first()
    assert tried[1]["val_roc_auc"] == pytest.approx(metrics["roc_auc"])


def test_scores_of_one_column_are_those_of_the_model(spark):
    x, y, _ = net_data(60)
    data = spark.createDataFrame([(*map(float, a), int(b)) for a, b in zip(x, y)], "a double, b double, c double, label int")
    for family, params in (("rf", {"numTrees": 3, "maxDepth": 3}), ("xgboost", {"maxIter": 3, "maxDepth": 2})):
        model = models.fit_tree(data, ["a", "b", "c"], family, 1, params)
        plain = model.transform(models.assembled(data, ["a", "b", "c"])).select("a", vector_to_array("probability")[1].alias("p")).collect()
        scored = models.score_tree(model, data, ["a", "b", "c"])
        assert scored.columns == ["a", "b", "c", "label", "probability"]
        assert sorted((r["a"], r["probability"]) for r in scored.collect()) == sorted((r["a"], r["p"]) for r in plain)


def test_search_query_makes_every_trial_over_the_full_ranges(spark, monkeypatch):
    from stratafold.plans import study_plans
    asked = []

    def search(train, valid, features, family, trials=25, seed=2026, ranges=None):
        asked.append(models.search_trials(family, trials, seed, ranges))
        return spark.createDataFrame([(i, 0.5) for i in range(trials)], "trial int, val_roc_auc double")
    monkeypatch.setattr(models, "random_search", search)
    assert study_plans.random_search(spark, "/root/testdata/sf0.001").count() == 25
    assert asked == [models.search_trials("rf", 25, study_plans.SEED)]


def test_search_fits_large_forests_in_parts(spark, monkeypatch):
    assert models.forest_parts(10, 30, 1, 100, 600) == [3, 3, 3, 1] and models.forest_parts(5, 2, 1, 100, 600) == [5]
    assert models.forest_parts(2, 30, 1, 10**9, 600) == [1, 1]
    x, y, _ = net_data(200)
    data = spark.createDataFrame([(*map(float, a), int(b)) for a, b in zip(x, y)], "a double, b double, c double, label int")
    ranges = {"numTrees": (12, 12, False), "maxDepth": [4], "bootstrap": [True]}
    whole = models.random_search(data, data, ["a", "b", "c"], "rf", 1, 1, ranges).first()
    trees, made = [], models.tree_model
    monkeypatch.setattr(models, "SEARCH_NODES", 8 * 5 * 32)
    monkeypatch.setattr(models, "tree_model", lambda family, seed, params: trees.append(params["numTrees"]) or made(family, seed, params))
    parts = models.random_search(data, data, ["a", "b", "c"], "rf", 1, 1, ranges).first()
    assert sum(trees) == 12 and len(trees) > 1
    assert parts["parameters"] == whole["parameters"] and abs(parts["val_roc_auc"] - whole["val_roc_auc"]) < 0.02


def test_plane_search_is_the_neighbour_search(spark, monkeypatch):
    """Tiles give the rows of the pivots for near, far, tied and repeated places, and no pivots are drawn."""
    rng = np.random.default_rng(4)
    places = rng.integers(0, 40, (500, 2)).astype(float) * [1.0, 3.0]
    rows = [(i, p, [float(i), 1.0]) for i, p in enumerate(places.tolist())]
    rows += [(600, [20.0, 20.0], [600.0, 1.0]), (3, places[4].tolist(), [3.5, 1.0])]
    asks = [(i, p) for i, p in enumerate((rng.random((80, 2)) * 160 - 20).tolist())]
    asks += [(100, [5e6, -4e6]), (101, [10.5, -9e5]), (102, places[0].tolist()), (1, [7.0, 9.0])]
    ref = spark.createDataFrame(rows, "id long, vec array<double>, load array<double>")
    queries = spark.createDataFrame(asks, "id long, vec array<double>")
    monkeypatch.setattr(neighbours, "TILE_ROWS", 20)
    monkeypatch.setattr(neighbours, "TILE_QUERIES", 3)
    listed = lambda df: sorted((r["id"], r["rank"], r["neighbour"], round(r["distance"], 6), tuple(r["load"])) for r in df.collect())
    pivots = listed(neighbours.knn_join(queries, ref, 6, payload="load"))
    drawn, join = [], neighbours.knn_join
    monkeypatch.setattr(neighbours, "knn_join", lambda *a, **kw: drawn.append(1) or join(*a, **kw))
    assert listed(neighbours.plane_join(queries, ref, 6, payload="load")) == pivots and not drawn
    monkeypatch.setattr(neighbours, "MOST_ROWS", 2)
    assert listed(neighbours.plane_join(queries, ref, 6, payload="load")) == pivots and drawn


def test_evaluated_rows_move_once_not_once_a_sample(spark):
    """The exchange that meets the background holds ids and positions, not the evaluated values."""
    data = spark.createDataFrame([(i, float(i), float(i % 3)) for i in range(40)], "id long, a double, b double")
    score = lambda df: df.withColumn("probability", F.col("a") - F.col("b"))
    values = models.shapley_values(score, data, data, ["a", "b"], "id", samples=4)
    plan = values._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2
    values.collect()
    met = [line for line in plan.splitlines() if "SortMergeJoin [_at" in line]
    assert len(met) == 1
    lookups = plan[plan.index(met[0]):].splitlines()
    generated = next(line for line in lookups if "Generate explode" in line)
    assert "_x0" not in generated and "_end" not in generated
