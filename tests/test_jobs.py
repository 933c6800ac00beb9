"""Model jobs and sources: behaviour that has no SQL twin."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumbre.operators import correlation as C
from lumbre.operators import metrics as M
from lumbre.operators import models as L
from lumbre.operators import preparation_models as R
from lumbre.plans import QUERIES, model_queries
from lumbre.sources import readers, writers
from lumbre.streaming.freshness import collect_new_artifacts, fold_metric_stream


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(600).select(
        "id", (F.col("id") % 3 + 1).cast("int").alias("fold"), (F.pmod(F.col("id") * 31, F.lit(97)) / 97.0).alias("u"),
        F.when(F.col("id") % 10 != 0, F.pmod(F.col("id") * 17, F.lit(89)) / 89.0).alias("v"),
    )
    return df.select("*", (F.col("u") > 0.6).cast("int").alias("y"), (F.col("u") < 0.3).cast("int").alias("z")).withColumn(
        "none", (F.col("y") + F.col("z") == 0).cast("int")
    )


def test_preparation_matches_numpy(rows):
    pdf = rows.toPandas()
    p = R.fit_preparation(rows, ["u", "v"], R.nullable_columns(rows, ["u", "v"]))
    filled = pdf["v"].fillna(pdf["v"].median())
    assert p.fill["v"] == pytest.approx(pdf["v"].median())
    assert p.shift["v"] == pytest.approx(filled.mean()) and p.scale["v"] == pytest.approx(filled.std(ddof=0))
    assert "u" not in p.fill


def test_scores_separate_the_classes(rows):
    for candidate in (L.Candidate("logistic_regression", (("maxIter", 20),), True), L.Candidate("decision_tree"), L.Candidate("linear_svm", (("maxIter", 10),))):
        oof = L.cross_validated_scores(rows, [1, 2, 3], ["u", "v"], "y", ["id"], candidate)
        assert oof.count() == 600
        assert M.score_metrics(oof, ["label"]).first()["roc_auc"] > 0.95


def test_one_class_gives_a_constant(rows):
    train = rows.filter("y = 0")
    got = L.fit_score(train, rows, ["u", "v"], "y", ["id"], L.Candidate("decision_tree")).select("score").distinct().collect()
    assert [r[0] for r in got] == [0.0]
    assert L.inner_threshold(train, ["u"], "y", ["id"], L.Candidate("decision_tree")) == (0.5, 0)


def test_nested_cross_validation_covers_every_row_once(rows):
    oof = L.nested_cross_validation(rows, [1, 2, 3], ["u", "v"], "y", ["id"], [L.Candidate("dummy"), L.Candidate("decision_tree", (("maxDepth", 3),))], "pu_elkan_noto")
    assert oof.count() == 600 and oof.select("id").distinct().count() == 600
    assert {r[0] for r in oof.select("family").distinct().collect()} == {"decision_tree"}


def test_gaussian_nb_is_close_to_numpy(rows):
    pdf = rows.select("id", "fold", "u", "y").toPandas()
    got = {r["id"]: r["score"] for r in L.gaussian_nb_scores(rows, ["id"], ["u"], ["y"]).collect()}
    train, test = pdf[pdf.fold != 1], pdf[pdf.fold == 1]
    eps = 1e-9 * train.u.var(ddof=0)
    logs = []
    for c in (0, 1):
        part = train[train.y == c].u
        var = part.var(ddof=0) + eps
        logs.append(np.log(len(part)) - 0.5 * np.log(2 * np.pi * var) - (test.u - part.mean()) ** 2 / (2 * var))
    want = 1 / (1 + np.exp(-(logs[1] - logs[0])))
    assert max(abs(got[i] - w) for i, w in zip(test.id, want)) < 1e-8


def test_pca_component_count(rows):
    frame = rows.select((F.col("u") * 3).alias("a"), (F.col("u") * 3 + F.coalesce("v", F.lit(0.5)) * 0.01).alias("b"), F.coalesce("v", F.lit(0.5)).alias("c"))
    x = frame.toPandas().to_numpy()
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    _, _, count, explained = R.fit_pca(frame, ["a", "b", "c"], 0.90)
    assert explained == pytest.approx(list(values / values.sum()), abs=1e-8)
    assert count == int(np.searchsorted(np.cumsum(values / values.sum()), 0.90, side="right")) + 1
    assert len(R.apply_pca(frame, R.fit_pca(frame, ["a", "b", "c"], 0.90)).first()["components"]) == count


def test_correlation_is_pairwise_complete(rows):
    pdf = rows.select("u", "v").toPandas()
    r = C.correlation_pairs(rows.select("u", "v"), ["u", "v"]).first()
    assert r["n"] == int(pdf.v.notna().sum()) and r["r"] == pytest.approx(pdf.corr().iloc[0, 1])


def test_run_summaries_and_freshness(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.json").write_text('{"run": "r1", "f1": 0.5}\n')
    (tmp_path / "two.json").write_text("{broken\n")
    schema = T.StructType([T.StructField("run", T.StringType()), T.StructField("f1", T.DoubleType())])
    good, bad = readers.read_run_summaries(spark, str(tmp_path), schema)
    assert good.count() == 1 and bad.count() == 1
    assert readers.read_run_summaries(spark, str(tmp_path), schema, newer_than="2999-01-01T00:00:00")[0].count() == 0
    assert readers.stale_files(spark, str(tmp_path), "2999-01-01 00:00:00", "*.json").count() == 2
    assert readers.list_files(spark, str(tmp_path), "*.json").count() == 2


def test_csv_readability_and_sniffing(spark, tmp_path):
    (tmp_path / "good.csv").write_text("﻿ID Paciente;y\n1;0\n2;1\n", encoding="utf-8")
    (tmp_path / "empty.csv").write_text("ID Paciente;y\n")
    got = {r["name"]: r["readable"] for r in readers.readability(spark, str(tmp_path), "ID Paciente").collect()}
    assert got == {"good.csv": 1, "empty.csv": 0}
    assert readers.read_labels_csv(spark, str(tmp_path / "good.csv")).columns == ["ID Paciente", "y"]


def test_stream_collects_each_artifact_once(spark, tmp_path):
    source, table, mark = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "mark")
    source.mkdir()
    schema = T.StructType([T.StructField("run", T.StringType()), T.StructField("fold", T.IntegerType()), T.StructField("f1", T.DoubleType())])
    for i in (1, 2):
        (source / f"fold{i}.json").write_text('{"run": "r", "fold": %d, "f1": 0.%d}\n' % (i, i))
        collect_new_artifacts(fold_metric_stream(spark, str(source), schema), table, mark).awaitTermination()
    rows = writers.latest_rows(spark, table, ["run", "fold"]).orderBy("fold").collect()
    assert [(r["fold"], r["f1"]) for r in rows] == [(1, 0.1), (2, 0.2)]
    assert spark.read.parquet(table).count() == 2


def test_neighbours_with_many_leaves_and_a_crowded_one(spark):
    from lumbre.operators import neighbours as NB

    # Small leaves, and a third of the points in one spot.
    rng = np.random.default_rng(5)
    pts = np.concatenate([rng.normal(size=(200, 3)), np.tile([[2.0, 2.0, 2.0]], (100, 1)) + rng.normal(size=(100, 3)) * 1e-3])
    df = spark.createDataFrame([("g", i, [float(x) for x in p]) for i, p in enumerate(pts)], "g string, id long, v array<double>")
    got = {}
    for r in NB.exact_neighbours(df, "g", "id", "v", 4, leaf=100).collect():
        got.setdefault(r["id"], {})[r["position"]] = r["neighbour"]
    d = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    want = np.argsort(d, axis=1, kind="stable")[:, :4]
    assert len(got) == 300 and all([got[i][p] for p in (1, 2, 3, 4)] == list(want[i]) for i in range(300))


def test_synthetic_rows_balance_and_lie_between(spark):
    from lumbre.operators.neighbours import smote

    rows = [("g", i, [float(i), float(i * i)], int(i < 4)) for i in range(15)]
    out = smote(spark.createDataFrame(rows, "g string, id long, v array<double>, y int"), "g", "id", "v", "y", 5, 1).collect()
    assert len(out) == 7 and all(r["base"] < 4 and r["neighbour"] < 4 and r["base"] != r["neighbour"] for r in out)
    for r in out:
        assert r["v"][0] == pytest.approx(r["base"] + r["gap"] * (r["neighbour"] - r["base"]))


# ---- guards of sources and sinks, shared writes --------------------------------------------------


def test_two_appends_at_once_keep_all_rows(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from pyspark.sql import functions as F

    from lumbre.session import ContractError
    from lumbre.sources import writers as W

    path = str(tmp_path / "metrics")
    with pytest.raises(ContractError):
        W.latest_rows(spark, path, ["run", "fold"])

    def append(k):
        W.append_fold_rows(spark.range(50).select(F.lit(f"r{k % 2}").alias("run"), (F.col("id") + 100 * k).alias("fold"), F.lit(1.0 * k).alias("f1")), path)

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(append, range(4)))
    (tmp_path / "metrics" / "write=broken" / "run=r0").mkdir(parents=True)
    rows = W.latest_rows(spark, path, ["run", "fold"])
    assert rows.count() == 200 and len(W.committed_writes(spark, path)) == 4


def test_old_files_and_headers(spark, tmp_path):
    from lumbre.session import ContractError
    from lumbre.sources import readers as R

    (tmp_path / "a.csv").write_text("id,x\n1,2\n")
    (tmp_path / "b.csv").write_text("x,y\n1,2\nid,3\n")
    (tmp_path / "c.csv").write_text('"id";y\n1;2\n3;4\n')
    got = {r.name: r.readable for r in R.readability(spark, str(tmp_path), "id", 5).collect()}
    assert got == {"a.csv": 1, "b.csv": 0, "c.csv": 1}
    R.assert_fresh(spark, str(tmp_path), "2001-01-01 00:00:00")
    with pytest.raises(ContractError):
        R.assert_fresh(spark, str(tmp_path), "2101-01-01 00:00:00")


def test_guards(spark):
    from lumbre.operators import eda as E
    from lumbre.operators import geometry as V
    from lumbre.operators import joins as J
    from lumbre.session import ContractError

    left, right = spark.createDataFrame([(1, "a"), (2, "b")], "id int, x string"), spark.createDataFrame([(2, 5), (1, 4)], "id int, y int")
    assert sorted(map(tuple, J.aligned(left, right, "id").collect())) == [(1, "a", 4), (2, "b", 5)]
    for bad in (right.filter("id = 1"), right.unionByName(right), spark.createDataFrame([(None, 1), (1, 2), (2, 3)], "id int, y int")):
        with pytest.raises(ContractError):
            J.aligned(left, bad, "id")
    assert E.cohort_integrity(left, "id", 2).first()["n_ids"] == 2
    with pytest.raises(ContractError):
        E.cohort_integrity(left, "id", 3)
    slices = spark.createDataFrame([(1, z, 0, None) for z in range(9)], "id int, z int, area int, score double")
    assert sorted(r.z for r in V.representative_slices(slices, ["id"], "z", "area", "score", 3).collect()) == [3, 4, 5]
    labels = spark.createDataFrame([("P-1", 1), ("p 1", 0)], "name string, t int")
    with pytest.raises(ContractError):
        J.cascading_join(spark.createDataFrame([("P1",)], "pid string"), labels, "pid", "name", ["t"])
    cheap = {r.column: r for r in E.dataset_profile(left, ["id", "x"], cheap=True).collect()}
    assert (cheap["id"].n_unique, cheap["id"].least, cheap["x"].least) == (2, 1.0, None)


def test_a_null_key_keeps_its_group(spark):
    from lumbre.operators import eda as E

    df = spark.createDataFrame([(None, 1.0), (None, 2.0), ("a", 5.0), (None, 90.0), (None, 1.5)], "k string, v double")
    assert {r.k for r in E.moments(df, ["k"], "v").collect()} == {None, "a"}
    assert {(r.k, r.n, r.n_outliers) for r in E.outlier_share(df, ["k"], "v").collect()} == {(None, 4, 1), ("a", 1, 0)}
    assert {r.k for r in E.grouped_summary(df, ["v"], ["k"]).collect()} == {None, "a"}


def test_train_fold_steps_of_a_model_job(spark):
    from lumbre.operators import models as L
    from lumbre.operators import pu as U
    from lumbre.session import ContractError

    rows = spark.range(240).select(
        "id", (F.col("id") % 8 == 0).cast("int").alias("y"), (F.col("id") % 3 + 1).cast("int").alias("fold"),
        (F.when(F.col("id") % 8 == 0, 3.0).otherwise(0.0) + F.sin(F.col("id") * 1.7)).alias("signal"),
        *[F.sin(F.col("id") * (k + 2.3)).alias(f"noise{k}") for k in range(4)],
    )
    features = ["signal", *[f"noise{k}" for k in range(4)]]
    tree = (("maxDepth", 3),)
    for steps in ({"sampler": "random"}, {"sampler": "smote", "k_best": 2}, {"k_best": 1}, {"pca": 0.99, "sampler": "random"}):
        out = L.cross_validated_scores(rows, [1, 2, 3], features, "y", ["id"], L.Candidate("decision_tree", tree, **steps))
        scored = out.collect()
        assert len(scored) == 240
        good = [r.score for r in scored if r.y_true == 1]
        assert sum(good) / len(good) > 2 * sum(r.score for r in scored if r.y_true == 0) / 210
    with pytest.raises(ContractError):
        L.build_estimator(L.Candidate("mlp", (), True), 3, 0)
    with pytest.raises(ContractError):
        U.class_prior(spark.createDataFrame([("a", 0, 0.5)], "k string, y_true int, score double"), ["k"], empty="error").count()
    member = rows.withColumn("m", (F.col("id") % 2 == 0).cast("int"))
    arms = L.specialised_and_general(member, [1, 2, 3], features, "y", ["id"], "m", L.Candidate("decision_tree", tree), thresholds=True)
    deltas = L.arm_deltas(arms, ["label"], ["f1"]).first()
    assert deltas["delta_f1"] == pytest.approx(deltas["specialised_f1"] - deltas["general_f1"]) and deltas["general_f1"] > 0.5


def test_permutation_p_can_fall_below_five_percent(spark):
    from lumbre.plans import QUERIES

    ps = [r.p_adjusted for r in QUERIES["subgroup_permutation_p"](spark, "/root/testdata/sf0.001").select("p_adjusted").collect()]
    assert all(abs(p * 1001 - round(p * 1001)) < 1e-5 for p in ps)
    assert 0 < min(ps) < 0.05


# -- jobs side by side ------------------------------------------------------------------------------------------------


def test_jobs_side_by_side_keep_order_properties_and_errors(spark):
    import threading
    import time

    from lumbre.operators.parallel import side_by_side

    context, seen = spark.sparkContext, []
    context.setLocalProperty("lumbre.test", "here")

    def call(k):
        time.sleep(0.2 if k == 0 else 0)
        seen.append((threading.current_thread().name, context.getLocalProperty("lumbre.test")))
        # A nested loop runs in its caller's thread.
        inner = side_by_side([lambda: threading.current_thread().name] * 2)
        assert set(inner) == {threading.current_thread().name}
        return spark.range(k + 1).count()

    assert side_by_side([lambda k=k: call(k) for k in range(6)], 3) == [1, 2, 3, 4, 5, 6]
    assert {p for _, p in seen} == {"here"} and len({n for n, _ in seen}) > 1
    begun = []

    def fails(k):
        begun.append(k)
        if k == 1:
            raise ValueError("one")
        time.sleep(0.1)

    with pytest.raises(ValueError):
        side_by_side([lambda k=k: fails(k) for k in range(50)], 2)
    assert len(begun) < 10
    context.setLocalProperty("lumbre.test", None)


@pytest.mark.parametrize("family", ["random_forest", "gradient_boosting", "mlp", "gaussian_nb"])
def test_every_family_is_fitted(rows, family):
    params = {"random_forest": (("numTrees", 5),), "gradient_boosting": (("maxIter", 5),), "mlp": (("hidden", [4]), ("maxIter", 60))}.get(family, ())
    oof = L.cross_validated_scores(rows, [1, 2, 3], ["u", "v"], "y", ["id"], L.Candidate(family, params))
    assert oof.count() == 600 and M.score_metrics(oof, ["label"]).first()["roc_auc"] > 0.9


# -- contents ---------------------------------------------------------------------------------------------------------


def test_content_parts_are_digests_of_byte_ranges(spark, tmp_path):
    import hashlib
    import random

    data = b"".join(random.Random(k).randbytes(k % 700) + (b"\n" if k % 3 else b"\r\n") for k in range(400)) + b"\xff\xfe no break at the end"
    (tmp_path / "a.bin").write_bytes(data)
    (tmp_path / "b.bin").write_bytes(data)
    (tmp_path / "c.bin").write_bytes(data + b"\n")
    (tmp_path / "d.bin").write_bytes(data[:5000] + b"x" + data[5001:])
    (tmp_path / "empty.bin").write_bytes(b"")
    size = 4096
    parts = [(r.begin, r.length, r.sha256) for r in readers.content_parts(spark, str(tmp_path), "a.bin", size).orderBy("begin").collect()]
    # Lines belong to the range in which they begin.
    want, at = {}, 0
    for line in data.split(b"\n"):
        begin = (at - 1) // size * size if at else 0
        want.setdefault(begin, b"")
        want[begin] += line + b"\n"
        at += len(line) + 1
    assert parts == [(b, len(x), hashlib.sha256(x).hexdigest()) for b, x in sorted(want.items())] and len(parts) > 10
    got = {r.name: (r.length, r.n_parts, r.sha256) for r in readers.content_hashes(spark, str(tmp_path), "*", size).collect()}
    assert got["a.bin"] == got["b.bin"] and len({v[2] for v in got.values()}) == 3 and "empty.bin" not in got
    assert got["a.bin"][2] == hashlib.sha256(f"{len(data)}:{''.join(p[2] for p in parts)}".encode()).hexdigest()


def test_content_hashes_do_not_follow_the_settings(spark, tmp_path):
    (tmp_path / "x.txt").write_text("".join(f"line {k}\n" for k in range(9000)))
    first = readers.content_hashes(spark, str(tmp_path), "*", 8192).first()
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
        assert readers.content_hashes(spark, str(tmp_path), "*", 8192).first() == first and first.n_parts > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


# -- ball tree --------------------------------------------------------------------------------------------------------


def _all_pairs(rows, k):
    want = {}
    for g in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == g]
        v = np.array([r[2] for r in own])
        for i, (_, a, x) in enumerate(own):
            d = np.sqrt(((v - np.array(x)) ** 2).sum(axis=1))
            want[g, a] = sorted((d[j], own[j][1]) for j in range(len(own)) if j != i)[:k]
    return want


@pytest.mark.parametrize("leaf", [60, 2_000])
def test_neighbours_in_64_dimensions_equal_all_pairs(spark, leaf):
    """Clusters, noise, equal points and ties, and a thousand small groups."""
    from lumbre.operators.neighbours import exact_neighbours

    rng = np.random.default_rng(1)
    parts = [rng.normal(c, 0.1, (60, 64)) for c in rng.normal(0, 5, (5, 64))] + [rng.normal(0, 1, (80, 64)), np.zeros((70, 64)), np.round(rng.normal(0, 1, (40, 64)))]
    rows = [("big", i, v.tolist()) for i, v in enumerate(np.concatenate(parts))] + [("equal", i, [1.0] * 64) for i in range(90)]
    rows += [(f"g{k}", i, rng.normal(0, 1, 64).tolist()) for k in range(1000 if leaf > 100 else 10) for i in range(k % 5 + 1)]
    got = {}
    for r in exact_neighbours(spark.createDataFrame(rows, "g string, id long, v array<double>").repartition(8), "g", "id", "v", 4, leaf).collect():
        got.setdefault((r.g, r.id), []).append((r.position, r.distance, r.neighbour))
    for key, near in _all_pairs(rows, 4).items():
        mine = [(d, n) for _, d, n in sorted(got.get(key, []))]
        assert mine == near, key


def test_the_tree_prunes_pairs_of_leaves(spark):
    from pyspark.sql import functions as F

    from lumbre.operators.neighbours import BallTree

    rng = np.random.default_rng(2)
    rows = [("g", i, v.tolist()) for i, v in enumerate(np.concatenate([rng.normal(c, 0.01, (40, 16)) for c in rng.normal(0, 10, (24, 16))]))]
    tree = BallTree(spark.createDataFrame(rows, "g string, id long, v array<double>"), 60)
    leaves = tree.leaves()
    n = leaves.count()
    assert n > 8 and leaves.agg(F.sum("n")).first()[0] == len(rows)
    pairs = tree.near_pairs(leaves.select("g", "node", F.lit(0.2).alias("bound"))).count()
    assert n <= pairs < n * n / 3


def test_one_pair_of_positives_serves_very_many_rows(spark):
    from lumbre.operators.neighbours import smote

    df = spark.range(300_000).select(F.lit("g").alias("g"), "id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v"), (F.col("id") < 2).cast("int").alias("y"))
    out = smote(df, "g", "id", "v", "y", 5, 1)
    r = out.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("number").alias("d"), F.min("number").alias("a"), F.max("number").alias("b"), F.count_if((F.col("v")[0] < 0) | (F.col("v")[0] > 1)).alias("out")).first()
    assert (r.n, r.d, r.a, r.b, r.out) == (299_996, 299_996, 1, 299_996, 0)


def _five_folds(spark):
    """Folds of ten rows with 1, 2, 3, 4 and 5 positives."""
    return spark.createDataFrame([(10 * f + i, f, float(i), int(i < f)) for f in range(1, 6) for i in range(10)], "id long, fold int, u double, y int")


def test_inner_folds_are_all_folds_but_the_outer_one(spark):
    """The prior model's c is the mean share of the inner train parts, weighted by the positives of the inner folds."""
    got = L.nested_selection(_five_folds(spark), [1, 2, 3], ["u"], "y", ["id"], [L.Candidate("dummy")], "pu_elkan_noto").collect()
    assert sorted(r["outer_fold"] for r in got) == [1, 2, 3]
    for r in got:
        inner = [f for f in range(1, 6) if f != r["outer_fold"]]
        shares = {f: sum(g for g in inner if g != f) / 30 for f in inner}
        assert r["c"] == pytest.approx(sum(f * shares[f] for f in inner) / sum(inner))


def _outer_folds(spark, monkeypatch, query, operator):
    """Outer folds that a query asks an operator for."""
    seen = []
    monkeypatch.setattr(model_queries, "_model_rows", lambda *_: _five_folds(spark))
    monkeypatch.setattr(L, operator, lambda rows, folds, *_, **__: seen.append((folds, sorted(r[0] for r in rows.select("fold").distinct().collect()))) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        QUERIES[query](spark, "unread")
    return seen[0]


def test_nested_selection_has_every_fold_of_the_rows(spark, monkeypatch):
    asked, there = _outer_folds(spark, monkeypatch, "nested_candidate_selection", "nested_selection")
    assert asked == there


def test_subgroup_deltas_have_every_fold_of_the_rows(spark, monkeypatch):
    asked, there = _outer_folds(spark, monkeypatch, "subgroup_model_deltas", "specialised_and_general")
    assert asked == there


def test_one_look_at_the_train_rows_before_a_fit(spark, monkeypatch):
    """Share, scales and the choice of features come from one aggregation."""
    looks = spark.sparkContext.accumulator(0)

    def counted(y: int) -> int:
        looks.add(1)
        return y

    train = spark.range(60).select("id", (F.col("id") % 7).cast("double").alias("u"), (F.col("id") % 5).cast("double").alias("v"), F.udf(counted, "int")((F.col("id") % 2).cast("int")).alias("y"))
    monkeypatch.setattr(L, "build_estimator", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        L.fit_score(train, train, ["u", "v"], "y", ["id"], L.Candidate("decision_tree", k_best=1), nullable=[])
    assert looks.value == 60


def test_anova_of_prepared_rows_from_raw_moments(spark):
    """Missing and constant features; the F values are those of the prepared rows themselves."""
    rows = [(i, i % 3 - i % 2 * 0.5, None if i % 4 == 0 else float(i * i % 11), 0.1, int(i % 2 == 0)) for i in range(50)]
    train = spark.createDataFrame(rows, "id long, u double, v double, w double, y int")
    features = ["u", "v", "w"]
    moments = R.class_moments(train, features, "y")
    prepared = R.fit_preparation(train, features, ["v"], moments=moments)
    assert prepared.kept == ["u", "v"] and moments.positive_share() == 0.5
    filled = train.toPandas()
    filled["v"] = filled["v"].fillna(filled["v"].median())
    assert [prepared.scale[f] for f in ("u", "v")] == pytest.approx([filled[f].std(ddof=0) for f in ("u", "v")])
    got = {r["feature"]: r["f_value"] for r in R.anova_of_moments(R.prepared_moments(train, prepared, moments, "y"), []).collect()}
    long = {r["feature"]: r["f_value"] for r in R.anova_f(prepared.apply(train).select("y", "u", "v").unpivot(["y"], ["u", "v"], "feature", "value"), [], "y").collect()}
    for f in ("u", "v"):
        parts = [filled[filled.y == c][f] for c in (0, 1)]
        between = sum(len(p) * (p.mean() - filled[f].mean()) ** 2 for p in parts)
        want = between / (sum(((p - p.mean()) ** 2).sum() for p in parts) / 48)
        assert got[f] == pytest.approx(want) and long[f] == pytest.approx(want)


def test_formulations_look_for_missing_values_once(spark, monkeypatch):
    looks, rows = [], _five_folds(spark).select("id", "fold", F.col("y").alias("returned"), F.lit(0).alias("open_line"), "u")
    monkeypatch.setattr(model_queries, "_model_rows", lambda *_: rows)
    monkeypatch.setattr(model_queries, "_MODEL_FEATURES", ["u"])
    for module in (L, R):
        monkeypatch.setattr(module, "nullable_columns", lambda *_: looks.append(1) or [])
    monkeypatch.setattr(L, "_fold_scores", lambda df, *_: df.select("fold", "id", F.lit(0.5).alias("score")))
    QUERIES["pu_formulations_under_concealment"](spark, "unread")
    assert len(looks) == 1
