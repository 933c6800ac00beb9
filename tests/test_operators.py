"""Hand-computed cases and invariants of the operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumbre.functions import numeric as N
from lumbre.functions import text as X
from lumbre.operators import association as A
from lumbre.operators import eda as E
from lumbre.operators import geometry as V
from lumbre.operators import joins as J
from lumbre.operators import metrics as M
from lumbre.operators import ordered as O
from lumbre.operators import prepare as P
from lumbre.operators import pu as U
from lumbre.operators import results as R
from lumbre.operators import splits as S
from lumbre.operators import subgroups as G
from lumbre.operators import thresholds as T
from lumbre.session import ContractError, durable


def oof(spark, y, s, pred=None):
    rows = [("r", i, "a", yi, float(si), int(p)) for i, (yi, si, p) in enumerate(zip(y, s, pred or [0] * len(y)))]
    return spark.createDataFrame(rows, "run string, id int, label string, y_true int, score double, pred int")


# ---- association ------------------------------------------------------------------------------------


def test_fisher_exact_by_hand(spark):
    t = spark.createDataFrame([("f", 3, 1, 1, 3), ("g", 0, 0, 3, 4), ("h", 5, 0, 0, 5)], "feature string, a long, b long, c long, d long")
    out = {r["feature"]: r for r in A.fisher_exact(A.with_rates(t), ["feature"]).collect()}
    assert out["f"]["p_two_sided"] == pytest.approx(34 / 70, abs=1e-12)
    assert out["f"]["p_greater"] == pytest.approx(17 / 70, abs=1e-12)
    assert out["f"]["odds_ratio"] == 9.0
    assert out["g"]["p_two_sided"] == pytest.approx(1.0) and out["g"]["odds_ratio"] is None
    assert out["h"]["odds_ratio"] == math.inf


def test_fisher_exact_against_factorials_and_large_margins(spark):
    cases = [(10, 2, 3, 15), (100, 200, 300, 500), (7, 9, 0, 4), (1, 999, 0, 1000)]
    big = (30_000_000, 70_000_000, 30_010_000, 69_990_000)
    t = spark.createDataFrame([(i, *c) for i, c in enumerate([*cases, big])], "k int, a long, b long, c long, d long")
    out = {r["k"]: r for r in A.fisher_exact(t, ["k"]).collect()}
    for i, (a, b, c, d) in enumerate(cases):
        def pk(k):
            return math.comb(a + b, k) * math.comb(c + d, a + c - k) / math.comb(a + b + c + d, a + c)

        ks = range(max(0, a - d), min(a + b, a + c) + 1)
        two = sum(pk(k) for k in ks if pk(k) <= pk(a) * (1 + 1e-7))
        assert out[i]["p_two_sided"] == pytest.approx(two, rel=1e-9)
        assert out[i]["p_greater"] == pytest.approx(sum(pk(k) for k in ks if k >= a), rel=1e-9)
    a, b, c, d = big
    p = (a + c) / (a + b + c + d)
    z = abs(a / (a + b) - c / (c + d)) / math.sqrt(p * (1 - p) * (1 / (a + b) + 1 / (c + d)))
    assert out[len(cases)]["p_two_sided"] == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-3)


def test_benjamini_hochberg(spark):
    t = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None), ("e", 0.5)], "feature string, p double")
    out = {r["feature"]: r["p_adjusted"] for r in A.benjamini_hochberg(t, "p", [], ["feature"]).collect()}
    assert out["a"] == pytest.approx(0.04) and out["c"] == pytest.approx(0.16 / 3) and out["b"] == pytest.approx(0.16 / 3)
    assert out["e"] == pytest.approx(0.5) and out["d"] is None


# ---- order building blocks ---------------------------------------------------------------------------


def test_exact_quantiles_match_interpolation(spark):
    values = [5.0, 1.0, 4.0, 4.0, 9.0, 2.5, None, float("nan")]
    df = spark.createDataFrame([("k", v) for v in values], "k string, v double")
    q = O.exact_quantiles(df, ["k"], "v", [0.0, 0.25, 0.5, 0.75, 1.0]).first()
    assert q["n_values"] == 6 and q["quantiles"] == pytest.approx([1.0, 2.875, 4.0, 4.75, 9.0])


def test_exact_quantiles_collapse_large_groups(spark):
    # More rows than the sketch keeps exactly, with one value that fills half of the group.
    n = 60_000
    df = spark.range(n).select(F.lit("k").alias("k"), F.when(F.col("id") % 2 == 0, 7.0).otherwise(F.pmod(F.col("id") * 7919, F.lit(n)).cast("double")).alias("v"))
    want = df.agg(F.percentile("v", F.array(*[F.lit(p) for p in (0.01, 0.25, 0.5, 0.9)]))).first()[0]
    got = O.exact_quantiles(df, ["k"], "v", [0.01, 0.25, 0.5, 0.9], accuracy=1_000).first()["quantiles"]
    assert got == pytest.approx(want)


def test_hash_rank_is_a_permutation_and_partition_independent(spark):
    df = spark.range(1000).withColumn("k", (F.col("id") % 3 == 0).cast("int"))
    a = {r["id"]: r["rank"] for r in O.hash_rank(df, ["k"], ["id"], 1).collect()}
    b = {r["id"]: r["rank"] for r in O.hash_rank(df.repartition(13), ["k"], ["id"], 1).collect()}
    assert a == b and sorted(v for i, v in a.items() if i % 3 == 0) == list(range(1, 335))


def test_row_rank_with_a_hot_leading_value(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, 5.0).otherwise(F.col("id").cast("double")).alias("lead"), (-F.col("id")).alias("second"))
    got = {r["id"]: r["rank"] for r in O.row_rank(df, [], [("lead", False), ("second", True)]).collect()}
    rows = sorted(((i, 5.0 if i % 3 else float(i)) for i in range(3000)), key=lambda t: (-t[1], -t[0]))
    assert got == {i: n for n, (i, _) in enumerate(rows, 1)}


def test_previous_value_crosses_buckets(spark):
    df = spark.range(500).select(F.lit("k").alias("k"), (F.col("id") * F.col("id")).cast("double").alias("p"))
    gaps = {r["p"]: r["previous"] for r in O.previous_value(df.repartition(9), ["k"], "p").collect()}
    assert gaps[0.0] is None and all(gaps[float(i * i)] == float((i - 1) ** 2) for i in range(1, 500))


# ---- metrics and thresholds ---------------------------------------------------------------------------


def test_confusion_by_hand(spark):
    df = oof(spark, [1, 1, 0, 0], [0.9, 0.2, 0.8, 0.1], [1, 0, 1, 0])
    r = M.with_confusion_metrics(M.confusion(df, ["run"])).first()
    assert (r["tp"], r["fn"], r["fp"], r["tn"]) == (1, 1, 1, 1) and r["gmean"] == 0.5


def test_auc_symmetry_ties_and_single_class(spark):
    y, s = [0, 1, 1, 0, 1, 0, 0], [0.1, 0.4, 0.4, 0.4, 0.9, 0.2, 0.95]
    pairs = [(a, b) for a, ya in zip(s, y) if ya for b, yb in zip(s, y) if not yb]
    want = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in pairs) / len(pairs)
    up = M.score_metrics(oof(spark, y, s), ["run"]).first()["roc_auc"]
    down = M.score_metrics(oof(spark, y, [-v for v in s]), ["run"]).first()["roc_auc"]
    assert up == pytest.approx(want) and up + down == pytest.approx(1.0)
    one = M.score_metrics(oof(spark, [1, 1], [0.3, 0.4]), ["run"]).first()
    assert one["roc_auc"] is None and one["average_precision"] is None
    bad = M.score_metrics(oof(spark, [1, 0], [float("nan"), 0.4]), ["run"]).first()
    assert bad["roc_auc"] is None


def test_average_precision_by_hand(spark):
    r = M.score_metrics(oof(spark, [1, 0, 1, 0], [0.9, 0.8, 0.7, 0.1]), ["run"]).first()
    assert r["average_precision"] == pytest.approx(0.5 * 1.0 + 0.5 * 2 / 3)


def test_metrics_do_not_depend_on_partitions(spark):
    df = spark.range(2000).select(
        F.lit("r").alias("run"), "id", F.lit("a").alias("label"), (F.col("id") % 3 == 0).cast("int").alias("y_true"),
        (F.pmod(F.col("id") * 37, F.lit(101)) / 101).alias("score"), F.lit(0).alias("pred"),
    )
    a, b = M.score_metrics(df.repartition(1), ["run"]).first(), M.score_metrics(df.repartition(17), ["run"]).first()
    assert a["roc_auc"] == pytest.approx(b["roc_auc"], abs=1e-12)


def test_observed_threshold_by_hand(spark):
    r = T.observed_threshold(oof(spark, [0, 0, 1, 1], [0.1, 0.4, 0.6, 0.9]), ["run"]).first()
    assert 0.4 < r["threshold"] <= 0.6 and r["gmean"] == 1.0


def test_grid_threshold_ties_go_to_the_middle_then_lower(spark):
    r = T.grid_threshold_curve(oof(spark, [0, 1], [0.0, 1.0]), ["run"]).filter("selected = 1").first()
    assert r["threshold"] == 0.5
    r = T.grid_threshold_curve(oof(spark, [0, 1, 0], [0.44, 0.46, 0.1]), ["run"]).filter("selected = 1").first()
    assert r["threshold"] == 0.45


def test_joint_thresholds_keep_the_default_on_ties(spark):
    df = oof(spark, [0, 1], [0.0, 1.0]).unionByName(oof(spark, [0, 1], [0.0, 1.0]).withColumn("label", F.lit("b")))
    r = T.joint_thresholds(df, ["run"], ["a", "b"]).first()
    assert (r["threshold_a"], r["threshold_b"]) == (0.5, 0.5)


def test_derived_state_and_its_score_policies(spark):
    df = oof(spark, [1, 0], [0.9, 0.2], [1, 0]).unionByName(oof(spark, [0, 0], [0.3, 0.4], [0, 0]).withColumn("label", F.lit("b")))
    none = {r["id"]: r for r in M.with_derived_state(df, ["run"], "id", "none", "none").filter("label = 'none'").collect()}
    both = {r["id"]: r for r in M.with_derived_state(df, ["run"], "id", "none", "complement").filter("label = 'none'").collect()}
    assert [none[i]["y_true"] for i in (0, 1)] == [0, 1] and none[0]["score"] is None
    assert both[1]["score"] == pytest.approx(0.6)


# ---- splits and positive-unlabeled operators -------------------------------------------------------------


def test_folds_cover_exactly_and_balance(spark):
    df = spark.range(503).select("id", (F.col("id") % 4 == 0).cast("int").alias("a"), (F.col("id") % 7 == 0).cast("int").alias("b"))
    folds = S.stratified_folds(S.with_strata(df, ["a", "b"], 5), ["id"], ["stratum"], 5, 3)
    assert S.split_violations(S.split_table(folds, ["id"], 5), df, 5).isEmpty()
    sizes = [r["count"] for r in folds.groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 1
    per = folds.groupBy("stratum", "fold").count().groupBy("stratum").agg((F.max("count") - F.min("count")).alias("d")).collect()
    assert all(r["d"] <= 1 for r in per)


def test_strict_policy_and_strata_errors(spark):
    df = spark.createDataFrame([(i, int(i == 0)) for i in range(10)], "id int, a int")
    with pytest.raises(ContractError):
        S.policy_folds(df, ["id"], ["a"], 5, 1, "labelset_stratified")
    assert S.policy_folds(df, ["id"], ["a"], 5, 1, "auto").select("fold").distinct().count() == 5
    with pytest.raises(ContractError):
        S.with_strata(df.limit(3), ["a"], 5)


def test_validator_rejects_a_removed_test_row(spark):
    ids = spark.range(10)
    folds = S.plain_folds(ids, ["id"], 5, 1)
    splits = S.split_table(folds, ["id"], 5)
    assert S.split_violations(splits, ids, 5).isEmpty()
    broken = splits.filter("NOT (id = 3 AND split = 'test')")
    kinds = {r["violation"] for r in S.split_violations(broken, ids, 5).collect()}
    assert kinds == {"id missing from fold", "not in exactly one test fold"}


def test_concealment_keeps_truth_and_never_hides_all(spark):
    df = spark.range(20).select("id", (F.col("id") < 3).cast("int").alias("y"))
    out = U.conceal_positives(df, [], ["id"], "y", 0.9, 1)
    r = out.agg(F.sum("y_true"), F.sum("is_hidden"), F.sum("y_observed"), F.max(F.col("is_hidden") * (1 - F.col("y_true")))).first()
    assert tuple(r) == (3, 2, 1, 0)
    assert U.conceal_positives(df, [], ["id"], "y", 0.0, 1).filter("is_hidden = 1").isEmpty()
    with pytest.raises(ContractError):
        U.conceal_positives(df, [], ["id"], "y", 1.0, 1)


def test_label_frequency_by_hand(spark):
    df = oof(spark, [1, 0, 1, 0], [0.4, 0.2, 0.8, 0.9])
    assert U.label_frequency(df, ["run"]).first()["c"] == pytest.approx(0.6)
    assert U.label_frequency(oof(spark, [0, 0], [0.4, 0.2]), ["run"]).first()["c"] == 1.0


def test_oversampling_balances(spark):
    df = spark.range(17).select("id", (F.col("id") < 5).cast("int").alias("y"))
    n = {r["y"]: r["count"] for r in U.oversample(df, [], ["id"], "y", 1).groupBy("y").count().collect()}
    assert n == {0: 12, 1: 12}


# ---- subgroup discovery ------------------------------------------------------------------------------------


def test_subgroup_metrics_by_hand(spark):
    counts = spark.createDataFrame([(5, 3, 2, 2), (3, 0, 2, 0)], "n_rows long, n_covered long, n_positive long, n_positive_covered long")
    full, empty = G.subgroup_metrics(counts).collect()
    assert full["coverage"] == 3 / 5 and full["sensitivity"] == 1.0 and full["wracc"] == pytest.approx(3 / 5 * (2 / 3 - 2 / 5))
    assert empty["subgroup_prevalence"] is None and empty["lift"] is None and empty["wracc"] == 0.0


def _search(spark, rows, schema, features, depth=2):
    df = spark.createDataFrame(rows, schema).withColumn("s", F.lit("x"))
    sel = G.make_selectors(df, ["s"], features)
    pat = G.durable(G.make_patterns(df, ["s"], features, ["y"], sel, ["s"]))
    return sel, pat, G.beam_search(pat, sel, ["s"], ["s"], [G.Arm("y", "y", 0.1)], depth)


def test_beam_search_finds_the_separating_feature(spark):
    rows = [(i % 2, (i // 2) % 2, float(i), i % 2) for i in range(40)]
    _, _, rules = _search(spark, rows, "risk int, noise int, age double, y int", ["risk", "noise", "age"])
    top = rules.filter("rank = 1").first()
    assert "risk == 1" in top["rule_key"] and top["wracc"] == pytest.approx(0.25)


def test_identical_features_give_one_diverse_rule(spark):
    rows = [(i % 2, i % 2, i % 2) for i in range(20)]
    _, pat, rules = _search(spark, rows, "a int, b int, y int", ["a", "b"])
    assert G.diverse_rules(rules, pat, ["s"]).count() == 1


def test_selector_conditions_and_missing_values(spark):
    df = spark.createDataFrame([(59.0,), (61.0,), (100.0,), (None,), (float("nan"),)], "age double")
    got = [r[0] for r in df.select(P.selector_condition("age", ">", 60.0)).collect()]
    assert got == [False, True, True, False, False]
    sel = G.make_selectors(df.withColumn("s", F.lit("x")), ["s"], ["age"])
    pat = G.make_patterns(df.withColumn("s", F.lit("x")).withColumn("y", F.lit(1)), ["s"], ["age"], ["y"], sel, ["s"])
    assert pat.filter(F.size("pattern") == 0).first()["n"] == 2


def test_empty_sets_have_jaccard_one(spark):
    members = spark.createDataFrame([("k", "a", 1), ("k", "b", 1), ("k", "a", 2)], "k string, r string, id int")
    sizes = spark.createDataFrame([("k", "a", 2), ("k", "b", 1), ("k", "c", 0), ("k", "d", 0)], "k string, r string, size long")
    got = {(r["a"], r["b"]): r["jaccard"] for r in G.jaccard_pairs(members, ["k"], "r", "id", sizes).collect()}
    assert got[("a", "b")] == 0.5 and got[("c", "d")] == 1.0 and got[("a", "c")] == 0.0


# ---- preparation, joins, results ----------------------------------------------------------------------------


def test_or_groups_replace_their_sources(spark):
    rows = [(1, 0, None, 0, 5), (0, 0, 1, 1, 6), (None, None, 0, 1, 7), (None, None, None, None, 8)]
    df = spark.createDataFrame(rows, "urgent int, early int, heavy int, discounted int, amount int")
    out = P.group_flags(df, {"hurried": ["urgent", "early"], "any_mark": ["heavy", "discounted"]})
    got = {r["amount"]: (r["hurried"], r["any_mark"]) for r in out.collect()}
    assert got == {5: (1, 0), 6: (0, 1), 7: (0, 1), 8: (0, 0)} and set(out.columns) == {"amount", "hurried", "any_mark"}


def test_binary_targets_reject_other_values(spark):
    with pytest.raises(ContractError):
        P.binary_targets(spark.createDataFrame([("1",), ("2",)], "y string"), ["y"])
    assert P.binary_targets(spark.createDataFrame([("1",), ("no",), (None,)], "y string"), ["y"]).count() == 1


def test_one_to_one_contract(spark):
    left = spark.createDataFrame([(1,), (2,)], "id int")
    with pytest.raises(ContractError):
        J.one_to_one(left, spark.createDataFrame([(1, 5), (1, 6)], "id int, v int"), "id", ["v"])
    with pytest.raises(ContractError):
        J.one_to_one(left, spark.createDataFrame([(1, 5)], "id int, v int"), "id", ["v"])
    assert J.one_to_one(left, spark.createDataFrame([(2, 5), (1, 7)], "id int, v int"), "id", ["v"]).orderBy("id").collect()[0]["v"] == 7


def test_cascading_join_uses_one_strategy_for_all_rows(spark):
    feats = spark.createDataFrame([("P-001",), ("P-002",)], "pid string")
    direct = spark.createDataFrame([("P-001", 1), ("p2", 0)], "id string, y int")
    out, report = J.cascading_join(feats, direct, "pid", "id", ["y"])
    assert report.first()["strategy"] == "direct" and out.filter("y is null").count() == 1
    mapped = spark.createDataFrame([("Z9", 1)], "id string, y int")
    mapping = spark.createDataFrame([("P-002", " Z9 ")], "pid string, id string")
    assert J.cascading_join(feats, mapped, "pid", "id", ["y"], mapping)[1].first()["strategy"] == "mapping"
    with pytest.raises(ContractError):
        J.cascading_join(feats, mapped, "pid", "id", ["y"])


def test_unpaired_methods_are_an_error(spark):
    df = spark.createDataFrame([(1, "PN", 0.5), (1, "PU", 0.7), (2, "PN", 0.1)], "task int, m string, ap double")
    with pytest.raises(ContractError):
        J.paired_deltas(df, ["task"], "m", "PN", "PU", ["ap"])
    assert J.paired_deltas(df.filter("task = 1"), ["task"], "m", "PN", "PU", ["ap"]).first()["delta_ap"] == pytest.approx(0.2)


def test_column_resolution_ignores_case_accents_and_bom(spark):
    df = spark.createDataFrame([(1,)], ["﻿ID  Paciénte"])
    assert P.rename_like(df, "patient_id", "id paciente").columns == ["patient_id"]


def test_prediction_ties_are_tolerated(spark):
    df = oof(spark, [1, 0, 1], [0.5 - 1e-9, 0.3, 0.9], [1, 0, 0])
    r = R.prediction_check(df, ["run"], F.lit(0.5)).first()
    assert (r["n_ties"], r["n_invalid"]) == (1, 1) and r["max_difference"] == pytest.approx(0.4)


def test_incomplete_candidates_do_not_compete(spark):
    rows = [("a", "ok", 5, 0.9, 0.5), ("b", "ok", 4, 0.99, 0.9), ("c", "failed", 5, 1.0, 1.0), ("d", " OK", 5, 0.9, 0.6), ("e", "ok", 5, float("nan"), 0.6)]
    df = spark.createDataFrame(rows, "config_id string, status string, n_folds int, f1_micro double, f1_macro double")
    assert R.best_complete_candidate(df, 5).first()["config_id"] == "d"


def test_text_cells(spark):
    df = spark.createDataFrame([(" b, a ,b",), ("X",), ("",), (None,)], "c string")
    assert [r[0] for r in df.select(X.split_labels(F.col("c"))).collect()] == [["a", "b"], [], [], []]
    h = spark.createDataFrame([("DimSize = 3 4 5\nOffset = 1.5 x 2",)], "t string").select(X.header_map(F.col("t")).alias("m"))
    assert h.select(X.number_list(F.col("m")["DimSize"]), X.number_list(F.col("m")["Offset"])).first() == ([3.0, 4.0, 5.0], [1.5, None, 2.0])


def test_rounding_and_approx_equal(spark):
    r = spark.range(1).select(N.half_even(F.lit(0.125), 2), N.rounded(F.lit(0.125), 2), N.approx_equal(F.lit(1.0), F.lit(1.0 + 1e-9)), N.approx_equal(F.lit(None).cast("double"), F.lit(1.0))).first()
    assert tuple(r) == (0.12, 0.13, True, False)


def test_manifest_order_and_subsets(spark):
    m = J.manifest(spark, {"a": ["x", "y"], "b": [1, 2, 3]}).orderBy("task_id").collect()
    assert [(r["a"], r["b"]) for r in m] == [("x", 1), ("x", 2), ("x", 3), ("y", 1), ("y", 2), ("y", 3)]
    assert J.non_empty_subsets(spark, ["p", "q", "r"]).count() == 7


def test_far_from_and_nearest_distance(spark):
    pts = spark.createDataFrame([("s", 1, 0.0, 0.0), ("s", 2, 30.0, 0.0), ("t", 3, 0.0, 0.0)], "k string, id int, x double, y double")
    others = spark.createDataFrame([("s", 15.0, 0.0), ("s", 3.0, 4.0)], "k string, x double, y double")
    assert {r["id"] for r in V.far_from(pts, others, ["k"], ["x", "y"], 15.0).collect()} == {2, 3}
    d = {r["id"]: r["distance"] for r in V.nearest_distance(pts, others, ["k"], ["id"], ["x", "y"]).collect()}
    assert d == {1: 5.0, 2: 15.0, 3: None}


def test_series_geometry_by_hand(spark):
    df = spark.createDataFrame([("s", v) for v in (0.0, 1.0, 1.0, 3.0, 4.0)], "k string, p double")
    r = E.series_geometry(df, ["k"], "p").first()
    assert (r["n_positions"], r["n_duplicates"], r["median_gap"], r["coverage"]) == (4, 1, 1.0, 5.0)


def test_bucketed_running_totals_equal_plain_ones(spark):
    # One key holds most rows; another is null.
    df = spark.range(4000).select(
        F.when(F.col("id") % 10 == 0, F.lit(None).cast("string")).when(F.col("id") % 10 == 1, "b").otherwise("a").alias("k"),
        (F.pmod(F.col("id") * 7919, F.lit(4001)) / 7.0).alias("score"), (F.col("id") % 3).alias("pos"),
    )
    bucketed = O.running_totals(df, ["k"], "score", ["pos"], O.quantile_bounds(df, "score", 32))
    plain = O.running_totals(df, ["k"], "score", ["pos"], [])
    key = lambda r: (str(r["k"]), r["score"])
    a, b = sorted(bucketed.collect(), key=key), sorted(plain.collect(), key=key)
    assert [(r["k"], r["score"], r["cum_pos"], r["total_pos"]) for r in a] == [(r["k"], r["score"], r["cum_pos"], r["total_pos"]) for r in b]


# ---- values that are not finite, digits, nulls in order --------------------------------------------------


NAN, INF = float("nan"), float("inf")


def planted_oof(spark):
    rows = [("a", 1, NAN), ("a", 0, 0.2), ("a", 1, 0.8), ("a", 0, 0.1), ("b", 1, NAN), ("b", 0, None), ("c", 1, INF), ("c", 0, 0.3), ("c", 1, 0.9)]
    return spark.createDataFrame([(run, k, "x", y, s) for k, (run, y, s) in enumerate(rows)], "run string, id int, label string, y_true int, score double")


def test_scores_that_are_not_numbers_reach_no_threshold(spark):
    rows = planted_oof(spark)
    chosen = {r.run: r for r in T.observed_threshold(rows, ["run"]).collect()}
    assert chosen["a"].threshold == 0.8 and chosen["a"].gmean == pytest.approx(0.5**0.5)
    assert chosen["b"].threshold == 0.5 and chosen["b"].gmean == 0
    assert chosen["c"].threshold == 0.9 and chosen["c"].gmean == 1
    grid = {(r.run, r.threshold): r for r in T.grid_threshold_curve(rows, ["run"]).collect()}
    assert (grid["a", 0.5].tp, grid["a", 0.5].fn, grid["b", 0.5].tp, grid["b", 0.5].fn, grid["c", 0.5].tp) == (1, 1, 0, 1, 2)
    pred = T.apply_thresholds(rows, spark.createDataFrame([("a", 0.5), ("b", 0.5), ("c", 0.5)], "run string, threshold double"), ["run"])
    assert {r.id: r.pred for r in pred.collect()} == {0: 0, 1: 0, 2: 1, 3: 0, 4: 0, 5: 0, 6: 1, 7: 0, 8: 1}
    stored = R.prediction_check(rows.withColumn("pred", F.lit(0)), ["run"], F.lit(0.5)).collect()
    assert {r.run: r.n_invalid for r in stored} == {"a": 1, "b": 0, "c": 2}


def test_infinite_values_leave_other_pairs_alone(spark, monkeypatch):
    from lumbre.operators import correlation as C

    rows = [(float(k), float(k * k), -float(k), float(k % 3)) for k in range(20)] + [(INF, 1.0, 2.0, 0.0), (3.0, NAN, -3.0, 1.0), (None, 5.0, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    whole = {(r.i, r.j): (r.n, r.r) for r in C.correlation_pairs(df, ["a", "b", "c", "d"]).collect()}
    assert len(whole) == 6 and whole[0, 2] == (21, pytest.approx(-1.0))
    monkeypatch.setattr(C, "TILE", 3)
    tiled = {(r.i, r.j): (r.n, pytest.approx(r.r)) for r in C.correlation_pairs(df, ["a", "b", "c", "d"]).collect()}
    assert tiled == whole


def test_bins_whose_edges_agree_in_six_digits(spark):
    from lumbre.operators import eda as E

    df = spark.createDataFrame([(1234561.0, 1), (1234563.0, 0)], "v double, y int")
    rows = sorted(E.rates_per_bin(df, "v", [1234560, 1234562, 1234564], ["y"]).collect())
    assert [(r.n, r.rate) for r in rows] == [(1, 1.0), (1, 0.0)] and rows[0].bin == "[1.23456e+06, 1234562.0)"


@pytest.mark.parametrize("up", [True, False])
def test_nulls_rank_last(spark, up):
    from lumbre.operators.ordered import row_rank

    df = spark.createDataFrame([(k, None if k % 5 == 0 else float(k % 7)) for k in range(200)], "id int, v double")
    ranked = row_rank(df, [], [("v", up), ("id", True)]).collect()
    want = sorted(ranked, key=lambda r: (r.v is None, (r.v if up else -r.v) if r.v is not None else 0, r.id))
    assert [r["rank"] for r in want] == list(range(1, 201))


def test_distance_of_points_without_a_coordinate(spark):
    points = spark.createDataFrame([(1, "k", 0.0, 0.0), (2, "k", None, 0.0), (3, "k", NAN, 1.0), (4, "m", 1.0, 1.0)], "id int, key string, x double, y double")
    others = spark.createDataFrame([("k", 3.0, 4.0), ("k", None, 0.0), ("m", NAN, 1.0)], "key string, x double, y double")
    got = {r.id: r.distance for r in V.nearest_distance(points, others, ["key"], ["id"], ["x", "y"]).collect()}
    assert got == {1: 5.0, 2: None, 3: None, 4: None}


def test_accents_of_any_letter(spark):
    from lumbre.functions.text import normalise_text

    df = spark.createDataFrame([("Čeština  şehir ŐRÜLT été Ñandú Ågö",)], "t string")
    assert df.select(normalise_text(F.col("t"))).first()[0] == "cestina sehir orult ete nandu ago"


def test_one_positive_among_many_is_copied_in_pieces(spark):
    df = spark.range(10_000).select(F.col("id"), (F.col("id") == 77).cast("int").alias("y"))
    out = U.oversample(df, [], ["id"], "y", 3).filter("y = 1")
    assert out.count() == 9_999 and out.select("copy").distinct().count() == 9_999 and out.agg(F.max("copy")).first()[0] == 9_999


# ---- orders by range partitions --------------------------------------------------------------------------


@pytest.mark.parametrize("up", [True, False])
def test_row_rank_of_a_hot_value_by_a_text_column(spark, up):
    rows = [(k, "hot" if k % 5 else None, 1.0 if k % 3 else None, f"t{k * 7919 % 4000:04d}") for k in range(4000)]
    df = spark.createDataFrame(rows, "id int, g string, v double, t string").repartition(11)
    got = O.row_rank(df, ["g"], [("v", up), ("t", not up)], "place", "size").collect()
    want = {}
    for g in ("hot", None):
        own = [r for r in rows if r[1] == g]
        own.sort(key=lambda r: r[3], reverse=up)
        own.sort(key=lambda r: r[2] is None)
        want.update({r[0]: (n, len(own)) for n, r in enumerate(own, 1)})
    assert {r.id: (r.place, r["size"]) for r in got} == want
    # No partition of the sort has more than its share of the hot value.
    sizes = [r["count"] for r in O.range_sorted(df, ["g"], [("v", up), ("t", True)]).groupBy("__part").count().collect()]
    assert max(sizes) < 3 * len(rows) / len(sizes)


def test_equal_rows_are_spread(spark):
    df = spark.range(20_000).select(F.lit("k").alias("k"), F.lit(1.0).alias("v")).repartition(8)
    assert sorted(r["rank"] for r in O.row_rank(df, ["k"], [("v", True)]).collect()) == list(range(1, 20_001))
    # Without merging of small partitions.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in O.range_sorted(df, ["k"], [("v", True)]).groupBy("__part").count().collect()]
        assert len(sizes) > 4 and max(sizes) < 6_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_previous_value_of_many_keys_and_nulls(spark):
    rows = [(f"k{i % 7}" if i % 7 else None, float(i * i % 1009 + i * 2000)) for i in range(900)]
    got = {(r.k, r.p): r.previous for r in O.previous_value(spark.createDataFrame(rows, "k string, p double").repartition(5), ["k"], "p").collect()}
    want = {}
    for k in {k for k, _ in rows}:
        own = sorted(p for q, p in rows if q == k)
        want.update({(k, p): b for p, b in zip(own, [None, *own])})
    assert got == want


@pytest.mark.parametrize("scope", [[], ["s"]])
def test_adjustment_over_many_tests_equals_the_plain_form(spark, scope):
    rows = [(i, "a" if i % 4 else None, None if i % 11 == 0 else (i * 37 % 500) / 500.0) for i in range(3000)]
    df = spark.createDataFrame(rows, "feature int, s string, p double").repartition(7)
    few = {r.feature: r.p_adjusted for r in A.benjamini_hochberg(df, "p", scope, ["feature"]).collect()}
    many = {r.feature: r.p_adjusted for r in A.benjamini_hochberg(df, "p", scope, ["feature"], few=0).collect()}
    assert few.keys() == many.keys() and all((a is None) == (many[k] is None) and (a is None or abs(a - many[k]) < 1e-12) for k, a in few.items())


@pytest.mark.parametrize("shape", ["even", "skewed", "few values"])
def test_quantile_brackets_narrow_in_rounds(spark, shape):
    value = {"even": F.rand(3), "skewed": F.exp(40 * F.rand(3)) * F.when(F.rand(4) < 0.5, -1).otherwise(1), "few values": F.floor(F.rand(3) * 5)}[shape]
    df = durable(spark.range(60_000).select(F.when(F.col("id") % 6 > 0, "hot").alias("k"), value.cast("double").alias("v")))
    probs = [0.0, 0.01, 0.5, 0.501, 0.99, 1.0]
    got = {r.k: r.quantiles for r in O.exact_quantiles(df, ["k"], "v", probs, accuracy=100, limit=50).collect()}
    for k in ("hot", None):
        own = np.array([r.v for r in df.filter(F.col("k").eqNullSafe(k)).collect()])
        assert np.allclose(got[k], np.quantile(own, probs), rtol=1e-12)


def test_narrowed_brackets_hold_few_rows(spark):
    df = durable(spark.range(50_000).select(F.lit(0).alias("k"), F.exp(30 * F.rand(1)).alias("__v")))
    whole = spark.createDataFrame([(0, 50_000, [float("-inf")] * 2, [float("inf")] * 2)], "__b_k int, __n long, __lo array<double>, __hi array<double>")
    r = O._narrowed(df, ["k"], whole, [0.25, 0.9], 100).first()
    for low, high in zip(r["__lo"], r["__hi"]):
        assert df.filter(F.col("__v").between(low, high)).count() <= 100


# ---- distances through the pyramid of cells --------------------------------------------------------------


def crowds(seed, n):
    """Two crowded neighbouring cells, a line, far strays and places that repeat."""
    rng = np.random.default_rng(seed)
    parts = [rng.normal((0, 0, 0), 1e-3, (n, 3)), rng.normal((1e-2, 0, 0), 1e-3, (n, 3)), np.c_[np.linspace(0, 50, n), np.zeros(n), np.zeros(n)], rng.uniform(-50, 50, (20, 3)), np.zeros((30, 3))]
    return np.concatenate(parts)


@pytest.mark.parametrize("leaf", [8, 64])
def test_distances_equal_all_pairs(spark, leaf):
    from lumbre.operators.cell_pyramid import CellPyramid

    schema = "k string, x double, y double, z double"
    targets = {"a": crowds(1, 300), "b": np.array([[5.0, 5.0, 5.0]]), "c": np.zeros((0, 3))}
    points = {"a": np.concatenate([crowds(2, 80), np.random.default_rng(3).uniform(-1e8, 1e8, (40, 3))]), "b": crowds(4, 20), "c": crowds(5, 3)}
    rows = lambda d: [(k, *map(float, p)) for k, v in d.items() for p in v]
    t, p = (spark.createDataFrame(rows(d) + [("a", None, 0.0, 0.0), ("b", NAN, 0.0, 0.0)], schema).repartition(4) for d in (targets, points))
    want = {(k, *map(float, q)): np.sqrt(((targets[k] - q) ** 2).sum(axis=1)).min() for k, v in points.items() for q in v if len(targets[k])}
    pyramid = CellPyramid(t, ["k"], ["x", "y", "z"], leaf)
    got = {(r.k, r.x, r.y, r.z): r.distance for r in pyramid.nearest(p).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - d) <= 1e-9 * d for k, d in want.items())
    for limit in (0.5,):
        near = {(r.k, r.x, r.y, r.z) for r in pyramid.nearest(p, limit).collect()}
        assert near == {k for k, d in want.items() if d < limit}


def test_far_points_meet_boxes_and_not_targets(spark):
    from lumbre.operators.cell_pyramid import CellPyramid

    targets = spark.range(300_000).select(F.lit("k").alias("k"), (F.col("id") % 600).cast("double").alias("x"), F.floor(F.col("id") / 600).cast("double").alias("y"))
    points = spark.range(500).select(F.lit("k").alias("k"), (F.col("id") * 1e4 + 1e6).alias("x"), (F.col("id") % 499).cast("double").alias("y"))
    got = CellPyramid(targets, ["k"], ["x", "y"]).nearest(points).collect()
    assert len(got) == 500 and all(abs(r.distance - (r.x - 599)) < 1e-6 for r in got)
    kept = V.far_from(points, targets, ["k"], ["x", "y"], 1e6)
    assert kept.count() == 499
