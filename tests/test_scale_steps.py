"""Steps that were cut down to one look at the rows: permutation hashes, patterns, folds, gradients."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumbre.functions.digests import Messages
from lumbre.operators import geometry as V
from lumbre.operators import hidden_positives as H
from lumbre.operators import keyed_logistic as K
from lumbre.operators import metrics as M
from lumbre.operators import models as L
from lumbre.operators import neighbours as NB
from lumbre.operators import ordered as O
from lumbre.operators import subgroups as G
from lumbre.plans import split_queries as Q
from lumbre.session import durable


def test_digests_of_many_texts_with_one_prefix():
    texts = [str(random.Random(i).randrange(10 ** (1 + i % 18))) for i in range(200)] + ["", "x" * 60, "ä|ö"]
    for prefix in ("99|1|", "99|1000|"):
        head, rest = Messages(texts).hashes(prefix)
        assert [f"{a:016x}{b:016x}" for a, b in zip(head.tolist(), rest.tolist())] == [hashlib.md5((prefix + t).encode()).hexdigest() for t in texts]


def _each(spark):
    rng = random.Random(3)
    # Ids that repeat and one that is missing.
    rows = [(i // 2 if i < 20 else None if i == 20 else i, 1, rng.randint(0, 1), float(rng.randint(0, 9)), int(i % 3 == 0)) for i in range(400)]
    df = durable(spark.createDataFrame(rows, "id long, all int, a int, v double, y int"))
    selectors = durable(G.make_selectors(df, ["all"], ["a", "v"]))
    return df, durable(G.make_patterns(df, ["id", "all"], ["a", "v"], ["y"], selectors, ["all"]))


@pytest.mark.parametrize("spread", [5.0, 0.01])
def test_one_look_gives_the_patterns_of_the_cuts(spark, spread):
    """A span that is too narrow is widened, so both give what the exact cuts give."""
    from lumbre.operators import splits as S

    df, each = _each(spark)
    wanted = df.agg(F.sum("y").alias("p")).first()["p"]
    plain = G.permuted_patterns(each, S.permutation_cuts(df, ["id"], 5, 7, wanted), ["id"], "y", 7)
    made = G.permutation_patterns(each, ["id"], "y", 7, 5, spread)
    key = lambda r: (r.s, tuple(r.pattern), r.n, r.y)
    assert sorted(map(key, made.collect())) == sorted(map(key, plain.collect()))


def _executed(spark, query, monkeypatch) -> int:
    """How often ``query`` reads the cohort."""
    seen = []
    original = Q.cohort
    monkeypatch.setattr(Q, "cohort", lambda *a: seen.append(1) or original(*a))
    frame = query(spark, "/root/testdata/sf0.001")
    text = frame._jdf.queryExecution().optimizedPlan().toString()
    return text.count("l_orderkey")


def test_folds_do_not_read_the_lines_again(spark, monkeypatch):
    """Ranks, strata sizes and both sides of the checks read written rows: no scan of the line items is left in the plan."""
    assert _executed(spark, Q._folds, monkeypatch) == 0
    assert _executed(spark, Q.split_violations, monkeypatch) == 0


def test_selectors_read_their_input_columns_once_for_the_kinds(spark):
    df = spark.createDataFrame([(1, 0.5, 1), (0, 1.5, None), (1, float("nan"), 1), (None, 2.5, 1)], "a int, v double, b int").withColumn("s", F.lit("x"))
    found = {(r.feature, r.op, r.value) for r in G.make_selectors(df, ["s"], ["a", "v", "b"]).collect()}
    assert found == {("a", "==", 1.0), ("b", "==", 1.0)} | {("v", op, c) for op in ("<=", ">") for c in (1.0, 1.5, 2.0)}


def test_fits_end_where_rounding_keeps_the_gradient(spark, monkeypatch):
    """No gradient reaches a tolerance of zero; the keys end with their last useful step and not with the last round."""
    rng = random.Random(8)
    rows = [(i, i % 3 + 1, int(rng.random() < 0.3), rng.gauss(100_000, 30_000), rng.gauss(0, 1)) for i in range(300)]
    study = H.prepare_study(spark.createDataFrame(rows, "id long, fold int, y int, u double, v double"), ["id"], ["y"], {"all": ["u", "v"]}, [0.0], folds=3)
    keys = H._keys(study, [(c, 0, -1, v, 1.0) for c in study.cells for v in (0.01, 10.0)])
    rounds = []
    plain = K.key_sums
    monkeypatch.setattr(K, "key_sums", lambda *a: rounds.append(1) or plain(*a))
    fits = K.fit_keys(K._dealt(study.rows), keys, study.design, tolerance=0.0, rounds=40)
    assert len(rounds) < 25 and fits.gradient.max() < 1e-9


def test_keys_with_the_same_rows_are_looked_up_once(spark):
    rng = np.random.default_rng(2)
    n, of = 50, 12
    rows = {"products": rng.normal(size=(n, 3)), "y": rng.random((1, n)) < 0.4, "hidden": np.zeros((1, n), bool), "fold": rng.integers(1, 4, n), "hash": rng.integers(0, 2**60, n).astype(np.uint64)}
    zero = np.zeros(of, np.int64)
    bag = np.repeat([-1, 0, 1], 4)
    keys = K.Keys(zero, zero - 1, zero + 1, zero, bag, np.maximum(bag, 0), zero, np.ones(of), np.where(bag < 0, 1.0, 0.5), np.zeros((of, 1)))
    runs = list(K.member_runs(rows, keys))
    assert [(a, b) for a, b, *_ in runs] == [(0, 4), (4, 8), (8, 12)]
    for a, _, observed, others in runs:
        inside = rows["fold"] != 1
        drawn = np.ones(n, bool) if bag[a] < 0 else K.hash_units(rows["hash"], np.array([bag[a]]))[0] < 0.5
        assert observed.tolist() == np.flatnonzero(inside & rows["y"][0]).tolist()
        assert others.tolist() == np.flatnonzero(inside & ~rows["y"][0] & drawn).tolist()


def test_scores_of_small_keys_are_ranked_in_one_pass(spark):
    rng = random.Random(5)
    rows = [(f"k{i % 7}", int(rng.random() < 0.3), rng.choice([rng.random(), 0.5])) for i in range(900)]
    rows += [("gone", 1, None), ("gone", 0, float("nan")), ("some", 1, None), ("some", 0, 0.2), ("some", 1, 0.7), ("high", 1, float("inf")), ("high", 0, 0.1), ("one", 1, 0.4)]
    df = spark.createDataFrame(rows, "k string, y_true int, score double")
    out = [{r.k: (r.roc_auc, r.average_precision, r.n_positive, r.n_negative) for r in M.score_metrics(df, ["k"], most).collect()} for most in (None, 1_000)]
    assert out[0].keys() == out[1].keys() and len(out[0]) == 11
    for k, want in out[0].items():
        assert out[1][k] == pytest.approx(want), k
    assert O.bounds_if_large(df.filter("score is not null"), "score", ["k"], small=200) == []
    assert O.bounds_if_large(df.filter("score < 1"), "score", ["k"], small=100)


def test_boundary_voxels_are_found_from_bits_of_lines(spark):
    rng = random.Random(6)
    voxels = {(k, z, y, x): rng.random() < 0.2 for k in "ab" for z in range(-1, 2) for y in range(-2, 2) for x in range(-70, 70) if rng.random() < 0.7}
    df = spark.createDataFrame([(k, z, y, x, int(on)) for (k, z, y, x), on in voxels.items()] + [("a", None, 0, 0, 1), ("a", 0, 0, None, 0)], "id string, z int, y int, x long, on int")
    near = [(0, 0, 1), (0, 0, -1), (0, 1, 0), (0, -1, 0), (1, 0, 0), (-1, 0, 0)]
    want = sorted(v for v, on in voxels.items() if not on and any(voxels.get((v[0], v[1] + a, v[2] + b, v[3] + c)) for a, b, c in near))
    for frame in (df, df.withColumn("x", F.col("x").cast("double"))):
        out = V.boundary_voxels(frame.filter("on = 1"), frame.filter("on = 0"), ["id"], ["z", "y", "x"])
        assert out.columns == ["id", "z", "y", "x", "on"] and sorted((r.id, r.z, r.y, int(r.x)) for r in out.collect()) == want
    # A full line of 64 voxels was 384 rows; it is two cells, the two beside them, and two for each step across.
    line = spark.range(64).select(F.lit(0).alias("z"), F.lit(0).alias("y"), F.col("id").alias("x"))
    assert V.neighbour_cells(line, [], ["z", "y", "x"]).count() == 12


def test_neighbours_beside_missing_and_far_points(spark):
    """Rounding of the products must not decide: points far from zero and close to each other, ties, and vectors that are not finite."""
    rng = np.random.default_rng(4)
    v = np.concatenate([1e6 + rng.integers(0, 3, (150, 8)) * 1e-3, rng.normal(size=(60, 8)), [[np.nan] * 8, [np.inf] * 8]])
    df = spark.createDataFrame([("g", i, [float(x) for x in p]) for i, p in enumerate(v)], "g string, id long, v array<double>")
    got = {}
    for r in NB.exact_neighbours(df.filter("id < 210"), "g", "id", "v", 4).collect():
        got.setdefault(r.id, {})[r.position] = (r.neighbour, r.distance)
    d = np.sqrt(((v[:210, None] - v[None, :210]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    want = np.argsort(d, axis=1, kind="stable")[:, :4]
    assert all([got[i][p][0] for p in (1, 2, 3, 4)] == want[i].tolist() and got[i][4][1] == d[i, want[i, 3]] for i in range(210))
    assert {r.id for r in NB.exact_neighbours(df, "g", "id", "v", 4).collect()} == set(range(210))


def test_scores_of_all_cells_meet_their_labels_in_one_join(spark):
    """A union of joins by one key has the sorts of all cells in one task."""
    df = spark.range(120).select("id", (F.col("id") % 3 + 1).cast("int").alias("fold"), (F.col("id") % 7 / 7).alias("u"), (F.col("id") % 2).cast("int").alias("m"))
    df = df.withColumns({"y": (F.col("u") > 0.5).cast("int"), "z": (F.col("u") < 0.3).cast("int")}).withColumn("none", 1 - F.col("y")).localCheckpoint()
    tree, twice = L.Candidate("decision_tree", (("maxDepth", 2),)), df.unionByName(df.filter("id < 3"))
    made = {
        "arms": L.specialised_and_general(twice, [1, 2, 3], ["u"], "y", ["id"], "m", tree),
        "labels": L.multi_label_scores(twice, [1, 2, 3], ["u"], ["y", "z"], ["id"], tree),
        "bags": L.cross_validated_scores(twice, [1, 2, 3], ["u"], "y", ["id"], tree, formulation="pu_bagging", bags=2),
    }
    for name, oof in made.items():
        plan = oof._jdf.queryExecution().optimizedPlan().toString()
        assert (plan.count("Join Inner"), plan.count("Aggregate [")) == (1, int(name == "bags")), name
    # An id that comes twice meets each of its rows.
    assert made["arms"].count() == 2 * (60 + 3) and made["labels"].count() == 2 * (120 + 9)
    truth = {r.id: {"y": r.y, "z": r.z} for r in df.collect()}
    for name in ("arms", "labels"):
        rows = made[name].collect()
        assert all(r.y_true == truth[r.id][r.label] and r.fold == r.id % 3 + 1 for r in rows)
    assert {r.label for r in rows} == {"y", "z"}
