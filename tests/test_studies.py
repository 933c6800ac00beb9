"""Bitmap covers, permutation cuts, keyed logistic regression and the hidden-positive study against plain versions."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumbre.operators import covers
from lumbre.operators import hidden_positives as H
from lumbre.operators import keyed_logistic as K
from lumbre.operators import splits as S
from lumbre.operators import subgroups as G
from lumbre.session import ContractError, durable

# -- permutations -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("cell_rows", [10_000, 3])
def test_cuts_give_the_positives_of_ranked_permutations(spark, cell_rows):
    df = durable(spark.range(700).select("id", (F.col("id") % 4 == 0).cast("int").alias("y")))
    ranked = S.permuted_labels(df, ["id"], "y", 6, 5).filter("y_permuted = 1").select("id", "permutation")
    cuts = S.permutation_cuts(df, ["id"], 6, 5, 175, cell_rows)
    met = df.join(cuts, how="cross").filter(F.md5(F.concat_ws("|", F.lit("5"), F.col("permutation"), F.col("id"))) <= F.col("cut")).select("id", "permutation")
    assert met.exceptAll(ranked).count() == 0 and met.count() == ranked.count() == 6 * 175


def test_cuts_for_none_and_for_more_than_there_are(spark):
    df = spark.range(5)
    assert {r.cut for r in S.permutation_cuts(df, ["id"], 2, 1, 0).collect()} == {""}
    assert {r.cut for r in S.permutation_cuts(df, ["id"], 2, 1, 9).collect()} == {"g"}


def test_permuted_patterns_add_up_like_joined_rows(spark):
    rng = random.Random(3)
    df = durable(spark.createDataFrame([(i, 1, rng.randint(0, 1), rng.randint(0, 1), float(rng.randint(0, 9)), int(i % 3 == 0)) for i in range(300)], "id long, all int, a int, b int, v double, y int"))
    selectors = durable(G.make_selectors(df, ["all"], ["a", "b", "v"]))
    each = durable(G.make_patterns(df, ["id", "all"], ["a", "b", "v"], ["y"], selectors, ["all"]))
    got = G.permuted_patterns(each, S.permutation_cuts(df, ["id"], 4, 7, 100), ["id"], "y", 7).collect()
    pattern = {r.id: tuple(r.pattern) for r in each.collect()}
    sizes = Counter(pattern.values())
    positive = {(r.permutation, r.id) for r in S.permuted_labels(df, ["id"], "y", 4, 7).filter("y_permuted = 1").collect()}
    hits = Counter((s, pattern[i]) for s, i in positive) + Counter((0, pattern[i]) for i in range(300) if i % 3 == 0)
    assert {(r.s, tuple(r.pattern)): (r.n, r.y) for r in got} == {(s, p): (n, hits[s, p]) for p, n in sizes.items() for s in range(5)}


# -- covers -----------------------------------------------------------------------------------------------------------


def test_extensions_equal_plain_counts(spark, monkeypatch):
    """Several blocks of patterns and several lists of parents for each search."""
    monkeypatch.setattr(covers, "BLOCK", 16)
    monkeypatch.setattr(covers, "CHUNK", 2)
    monkeypatch.setattr(covers, "broadcast_if_small", lambda df, *_: df)
    rng = random.Random(1)
    rows = [(s, sorted(rng.sample(range(1, 9), rng.randint(0, 8))), rng.randint(1, 5)) for s in ("x", "y") for _ in range(120)]
    rows = list({(s, tuple(p)): (s, p, n) for s, p, n in rows}.values())
    df = spark.createDataFrame([(s, p, n, n // 2) for s, p, n in rows], "s string, pattern array<int>, n bigint, y bigint")
    df = df.withColumns({"__h1": F.xxhash64("pattern"), "__h2": F.xxhash64(F.lit("second"), "pattern")})
    parents = [("x", [], 0, []), ("x", [2], 2, [2, 3]), ("x", [1, 4], 4, [1, 4]), ("y", [3], 3, [3]), ("y", [8], 8, [8]), ("y", [], 0, [])]
    got = covers.extension_counts(covers.pattern_blocks(df, ["s"], ["y"]), spark.createDataFrame(parents, "s string, rule array<int>, last int, used array<int>"), ["s"], ["y"]).collect()
    want, cover = {}, {}
    for s, rule, last, used in parents:
        for sel in range(last + 1, 9):
            met = [(tuple(p), n) for t, p, n in rows if t == s and sel in p and set(rule) <= set(p)]
            if met and sel not in used:
                want[s, tuple(rule), sel] = (sum(n for _, n in met), sum(n // 2 for _, n in met))
                cover[s, tuple(rule), sel] = frozenset(met)
    assert {(r.s, tuple(r.rule), r.sel): (r.n_covered, r.y) for r in got} == want
    # Hashes are equal where the covers are.
    ids = {(r.s, tuple(r.rule), r.sel): (r["__c1"], r["__c2"]) for r in got}
    for a, b in itertools.combinations([k for k in ids if k[0] == "x"], 2):
        assert (ids[a] == ids[b]) == (cover[a] == cover[b])


def search(spark, arms, depth, **kw):
    rng = random.Random(2)
    rows = [("s", "train", *(rng.randint(0, 1) for _ in range(5)), float(rng.randint(0, 30))) for _ in range(400)]
    df = spark.createDataFrame([(*r, int(r[2] + r[3] + (r[7] > 15) + rng.random() > 2)) for r in rows], "s string, part string, a int, b int, c int, d int, e int, v double, y int")
    sel = durable(G.make_selectors(df, ["s"], list("abcde") + ["v"]))
    pat = durable(G.make_patterns(df, ["s"], list("abcde") + ["v"], ["y"], sel, ["s"]))
    return sorted((r.arm, r["rank"], r.rule_key, r.n_covered, r.n_positive_covered) for r in G.beam_search(pat, sel, ["s"], ["s"], arms, depth, **kw).collect())


def test_search_without_any_broadcast(spark, monkeypatch):
    want = search(spark, [G.Arm("y", "y", 0.1)], 3)
    monkeypatch.setattr(covers, "broadcast_if_small", lambda df, *_: df)
    monkeypatch.setattr(G, "broadcast_if_small", lambda df, *_: df)
    monkeypatch.setattr(G, "BROADCAST_ROW_LIMIT", 0)
    monkeypatch.setattr(covers, "BLOCK", 32)
    monkeypatch.setattr(covers, "CHUNK", 3)
    assert search(spark, [G.Arm("y", "y", 0.1)], 3) == want and len(want) > 50


def test_depth_of_an_arm_is_its_own(spark):
    both = search(spark, [G.Arm("one", "y", 0.1, 1), G.Arm("two", "y", 0.1, 2)], 2)
    assert [r[1:] for r in both if r[0] == "one"] == [r[1:] for r in search(spark, [G.Arm("one", "y", 0.1)], 1)]
    assert [r[1:] for r in both if r[0] == "two"] == [r[1:] for r in search(spark, [G.Arm("two", "y", 0.1)], 2)]


def test_structure_stability_by_hand(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)], "v double")
    selectors = spark.createDataFrame([(1, 1, 1, "<=", 4.0), (2, 1, 1, "<=", 6.0), (3, 1, 1, "<=", 4.0)], "s int, idx int, pos int, op string, value double")
    rules = spark.createDataFrame([(s, "t", "v <=", f"v <= {s}", [1]) for s in (1, 2, 3)], "s int, arm string, k string, rule_key string, rule array<int>")
    r = G.structure_stability(df, ["v"], rules, selectors, ["s"], ["arm", "k"]).first()
    assert (r.n_pairs, r["min"], r["max"], r["median"]) == (3, 5 / 7, 1.0, 5 / 7) and r["mean"] == pytest.approx((5 / 7 + 5 / 7 + 1) / 3)


# -- keyed logistic regression ----------------------------------------------------------------------------------------


def plain_fit(x, y, c):
    """Coefficients of the balanced, regularised objective by plain Newton steps on standardised rows."""
    mean, sd = x.mean(axis=0), x.std(axis=0)
    a = np.c_[np.ones(len(x)), (x - mean) / np.where(sd > 0, sd, 1) * (sd > 0)]
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    beta = np.zeros(a.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-a @ beta))
        g = beta + c * a.T @ (weight * (p - y))
        beta = beta - 0.5 * np.linalg.solve(np.eye(len(beta)) + c * (a.T * (weight * p * (1 - p))) @ a, g)
    return beta


def small_study(spark, n=300, **kw):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        u, v, f = rng.gauss(0, 1), rng.gauss(2, 3), rng.randint(0, 1)
        rows.append((i, i % 3 + 1, int(u + f + rng.gauss(0, 1) > 1), int(v > 3 + rng.gauss(0, 2)), u, None if i % 9 == 0 else v, f, 7.0))
    df = spark.createDataFrame(rows, "id long, fold int, y int, z int, u double, v double, f int, same double")
    return rows, H.prepare_study(df, ["id"], ["y", "z"], {"one": ["u", "same"], "all": ["u", "v", "f", "same"]}, folds=3, **kw)


@pytest.mark.parametrize("few", [K.FEW_ROWS, 0])
def test_keys_equal_plain_fits(spark, monkeypatch, few):
    """Masks, folds, missing values, constant features and bags, with the keys dealt to tasks or not."""
    monkeypatch.setattr(K, "FEW_ROWS", few)
    rows, study = small_study(spark, fractions=[0.0, 0.4], seeds=2)
    entries = [(c, i, -1, v, 1.0) for c in study.cells for i in (0, 2) if i != c["outer_fold"] for v in (0.01, 10.0)]
    entries += [(c, 0, b, 1.0, 0.5) for c in study.cells[:4] for b in range(2)]
    keys = H._keys(study, entries)
    fits = K.fit_keys(K._dealt(study.rows), keys, study.design)
    assert fits.gradient.max() < 1e-9
    table = {r.id: r for r in study.rows.collect()}
    names = ["u", "same", "v", "f"]
    place = {"u": 4, "v": 5, "f": 6, "same": 7}
    for k, (cell, inner, bag, c, share) in enumerate(entries):
        own = [r for r in rows if r[1] not in (cell["outer_fold"], inner)]
        true = {r[0]: r[2 + cell["target_no"]] for r in own}
        seen = {i: t - int(cell["mask"] >= 0 and table[i].hidden[cell["mask"]]) for i, t in true.items()}
        median = np.median([r[5] for r in own if r[5] is not None])
        if bag >= 0:
            units = K.hash_units(np.array([table[r[0]].hash for r in own], np.int64).view(np.uint64), np.array([keys.order[k]]))[0]
            own = [r for r, d in zip(own, units) if seen[r[0]] or d < share]
        x = np.array([[median if r[place[n]] is None else r[place[n]] for n in names] for r in own], float) * study.design.sets[cell["set_no"]]
        want = plain_fit(x, np.array([seen[r[0]] for r in own]), c)
        assert np.allclose(fits.beta[k], want, atol=1e-7), (cell, inner, bag)
        assert fits.rows[k] == len(own) and fits.positives[k] == sum(seen[r[0]] for r in own)


def test_concealment_rules(spark):
    assert [H.n_concealed(*a) for a in ((0, 0.5), (1, 0.9), (2, 0.1), (10, 0.25), (10, 0.0), (10, 0.99))] == [0, 0, 1, 3, 0, 9]
    assert H.concealment_tasks([0.0, 0.2], 3) == [(0.0, 0), (0.2, 0), (0.2, 1), (0.2, 2)]
    with pytest.raises(ContractError):
        H.concealment_tasks([1.0], 1)
    rows, study = small_study(spark, fractions=[0.0, 0.1, 0.4], seeds=2)
    hidden = {r.id: r.hidden for r in study.rows.collect()}
    truth = {r[0]: r for r in rows}
    for cell in study.cells:
        if cell["mask"] < 0:
            assert cell["hide_fraction"] == 0
            continue
        gone = [i for i, h in hidden.items() if h[cell["mask"]]]
        own = [i for i, r in truth.items() if r[1] != cell["outer_fold"] and r[2 + cell["target_no"]] == 1]
        # Only positives of the outer train part are concealed, as many as the fraction says.
        assert set(gone) <= set(own) and len(gone) == H.n_concealed(len(own), cell["hide_fraction"])


def test_equal_precision_takes_the_first_penalty(spark):
    rows = [(cell * 3 + c, y, score) for cell in (0, 1) for c, scores in enumerate(([0.1, 0.9], [0.2, 0.8], [0.9, 0.1] if cell else [0.3, 0.7])) for y, score in zip((0, 1), scores)]
    got = H.choose_c(spark.createDataFrame(rows, "`group` long, y_observed int, score double"), 3).collect()
    assert {(r.cell, r.c_index, r.average_precision) for r in got} == {(0, 0, 1.0), (1, 0, 1.0)}


def test_study_covers_every_row_once(spark):
    rows, study = small_study(spark, fractions=[0.0, 0.3], seeds=2)
    tables = H.run_study(study, [0.1, 1.0], bags=3, folds=3)
    per = tables.predictions.groupBy("target", "hide_fraction", "concealment_seed", "feature_set", "method").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"), F.sum("y_true").alias("p"))
    assert {(r.n, r.ids) for r in per.collect()} == {(300, 300)} and per.count() == 2 * 3 * 2 * 2
    # The test parts keep their true labels.
    assert {(r.target, r.p) for r in per.collect()} == {("y", sum(r[2] for r in rows)), ("z", sum(r[3] for r in rows))}
    assert tables.selection.filter("method = 'PN'").count() == tables.selection.filter("method = 'Bagging_PU'").count() == len(study.cells)
    metrics = H.task_metrics(tables)
    deltas = H.study_deltas(metrics).collect()
    assert {(r.target, r.hide_fraction, r.n_pairs) for r in deltas} == {(t, f, 2 if f else 1) for t in ("y", "z") for f in (0.0, 0.3)}
    good = metrics.filter("method = 'PN' AND hide_fraction = 0 AND feature_set = 'all'").collect()
    assert all(r.roc_auc > 0.7 for r in good)


def test_gradients_from_the_rows_agree(spark):
    _, study = small_study(spark, fractions=[0.0, 0.3], seeds=1)
    cells, _, fits = H.final_fits(study, [0.1, 10.0])
    found = H.largest_gradients(study, cells, fits).collect()
    assert len(found) == len(cells) and max(r.gradient for r in found) < 1e-9
    # A changed coefficient is noticed.
    fits.beta[:, 0] += 1e-6
    assert min(r.gradient for r in H.largest_gradients(study, cells, fits).collect()) > 1e-7


def test_a_key_without_positives_is_an_error(spark):
    df = spark.createDataFrame([(i, i % 3 + 1, 0, float(i)) for i in range(30)], "id long, fold int, y int, u double")
    study = H.prepare_study(df, ["id"], ["y"], {"one": ["u"]}, [0.0], folds=3)
    with pytest.raises(ContractError):
        H.final_fits(study)
