"""Splits, concealment, bags and resampling over the order cohort."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumbre.functions.numeric import rounded
from lumbre.operators import pu as U
from lumbre.operators import splits as S
from lumbre.plans.base import COHORT_SQL, LABELS, OOF_SQL, cohort, oof, sql_md5, table
from lumbre.plans.registry import query
from lumbre.session import durable

# Stratified folds in SQL: rank in hash order within the stratum, shifted by the earlier strata.
_STRATA_SQL = "strata AS (SELECT id, returned, open_line, returned || '|' || open_line AS stratum FROM cohort)"


def folds_sql(seed: str = "'11'") -> str:
    return f"""{_STRATA_SQL},
sizes AS (SELECT stratum, coalesce(sum(count(*)) OVER (ORDER BY stratum ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM strata GROUP BY stratum),
folds AS (SELECT s.id, s.returned, s.open_line, s.stratum,
  CAST((row_number() OVER (PARTITION BY s.stratum ORDER BY {sql_md5(seed, 's.id')}, s.id) - 1 + start) % 5 + 1 AS INT) AS fold
  FROM strata s JOIN sizes ON s.stratum = sizes.stratum)"""


def _folds(spark, sf_dir, k: int = 5, rows=None):
    """Stratified folds of the cohort, or of ``rows`` of it that the caller has written; strata, ranks and sizes read them several times."""
    rows = durable(cohort(spark, sf_dir).select("id", *LABELS)) if rows is None else rows.select("id", *LABELS)
    strata = S.with_strata(rows, LABELS, k)
    return S.stratified_folds(strata, ["id"], ["stratum"], k, 11)


@query("label_strata", f"WITH {COHORT_SQL}, {_STRATA_SQL} SELECT stratum, count(*) AS n FROM strata GROUP BY stratum")
def label_strata(spark, sf_dir):
    return S.with_strata(cohort(spark, sf_dir), LABELS, 5).groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))


@query(
    "pooled_rare_strata",
    """WITH p AS (SELECT p_partkey, CASE WHEN p_size = 1 THEN 1 ELSE 0 END AS a, CASE WHEN p_partkey = 17 THEN 1 ELSE 0 END AS b FROM part),
c AS (SELECT a || '|' || b AS s, count(*) AS n FROM p GROUP BY 1)
SELECT CASE WHEN n < 2 THEN 'RARE_LABELSET' ELSE s END AS stratum, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1""",
)
def pooled_rare_strata(spark, sf_dir):
    p = table(spark, sf_dir, "part").select((F.col("p_size") == 1).cast("int").alias("a"), (F.col("p_partkey") == 17).cast("int").alias("b"))
    return S.with_simple_strata(p, ["a", "b"]).groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))


@query("stratified_folds", f"WITH {COHORT_SQL}, {folds_sql()} SELECT id, stratum, fold FROM folds")
def stratified_folds(spark, sf_dir):
    return _folds(spark, sf_dir).select("id", "stratum", "fold")


@query(
    "repeated_stratified_folds",
    f"""WITH {COHORT_SQL}, {_STRATA_SQL}, r AS (SELECT * FROM strata, (VALUES (0), (1), (2)) t(repeat)),
sizes AS (SELECT repeat, stratum, coalesce(sum(count(*)) OVER (PARTITION BY repeat ORDER BY stratum ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM r GROUP BY repeat, stratum),
f AS (SELECT r.id, r.repeat, r.stratum, (row_number() OVER (PARTITION BY r.repeat, r.stratum ORDER BY {sql_md5("'11'", 'r.repeat', 'r.id')}, r.id) - 1 + start) % 5 + 1 AS fold
  FROM r JOIN sizes ON r.repeat = sizes.repeat AND r.stratum = sizes.stratum)
SELECT CAST(repeat AS INT) AS repeat, CAST(fold AS INT) AS fold, stratum, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM f GROUP BY ALL""",
)
def repeated_stratified_folds(spark, sf_dir):
    strata = S.with_strata(cohort(spark, sf_dir).select("id", *LABELS), LABELS, 5)
    folds = S.repeated_stratified_folds(strata, ["id"], "stratum", 5, 3, 11)
    return folds.groupBy("repeat", "fold", "stratum").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


@query(
    "plain_folds",
    f"""SELECT o_orderkey, CAST((row_number() OVER (ORDER BY {sql_md5("'3'", 'o_orderkey')}, o_orderkey) - 1) % 10 + 1 AS INT) AS fold FROM orders""",
)
def plain_folds(spark, sf_dir):
    return S.policy_folds(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], [], 10, 3, "kfold")


@query(
    "policy_folds",
    f"""WITH {COHORT_SQL}, {folds_sql("'5'")} SELECT fold, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM folds GROUP BY fold""",
)
def policy_folds(spark, sf_dir):
    out = S.policy_folds(cohort(spark, sf_dir).select("id", *LABELS), ["id"], LABELS, 5, 5, "auto")
    return out.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


@query(
    "split_table",
    f"""WITH {COHORT_SQL}, {folds_sql()}, t AS (SELECT f.f AS fold, CASE WHEN fold = f.f THEN 'test' ELSE 'train' END AS split, id FROM folds, (SELECT unnest(range(1, 6)) AS f) f)
SELECT CAST(fold AS INT) AS fold, split, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM t GROUP BY ALL""",
)
def split_table(spark, sf_dir):
    return S.split_table(_folds(spark, sf_dir), ["id"], 5).groupBy("fold", "split").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


@query(
    "nested_split",
    f"""WITH {COHORT_SQL}, {folds_sql()}, p AS (SELECT a.f AS outer_fold, b.f AS inner_fold FROM (SELECT unnest(range(1, 6)) AS f) a, (SELECT unnest(range(1, 6)) AS f) b WHERE a.f <> b.f)
SELECT CAST(outer_fold AS INT) AS outer_fold, CAST(inner_fold AS INT) AS inner_fold,
  CASE WHEN fold = outer_fold THEN 'test_outer' WHEN fold = inner_fold THEN 'val_inner' ELSE 'train_inner' END AS split, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM folds, p GROUP BY ALL""",
)
def nested_split(spark, sf_dir):
    out = S.nested_split(_folds(spark, sf_dir), ["id"], 5)
    return out.groupBy("outer_fold", "inner_fold", "split").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


@query(
    "stratified_holdout",
    f"""WITH {COHORT_SQL}, {_STRATA_SQL}, r AS (SELECT id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY {sql_md5("'8'", 'id')}, id) AS i, count(*) OVER (PARTITION BY stratum) AS n FROM strata)
SELECT id, stratum, CASE WHEN i <= round(n * 0.2) THEN 'val' ELSE 'train' END AS split FROM r""",
)
def stratified_holdout(spark, sf_dir):
    strata = S.with_strata(cohort(spark, sf_dir).select("id", *LABELS), LABELS, 5).select("id", "stratum")
    return S.holdout(strata, ["id"], "stratum", 0.2, 8)


@query(
    "group_split",
    f"""WITH g AS (SELECT o_custkey, row_number() OVER (ORDER BY {sql_md5("'4'", 'o_custkey')}, o_custkey) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT o_custkey FROM orders))
SELECT o_orderkey, CASE WHEN i <= greatest(1, round_even(n * 0.15, 0)) THEN 'val' ELSE 'train' END AS split FROM orders o JOIN g ON o.o_custkey = g.o_custkey""",
)
def group_split(spark, sf_dir):
    return S.group_split(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 0.15, 4).select("o_orderkey", "split")


# A split table with planted faults: ids in both parts, ids left out of a fold, an unknown part name.
_FAULTY_SQL = f"""{folds_sql()}, sp AS (SELECT f.f AS fold, CASE WHEN fold = f.f THEN 'test' ELSE 'train' END AS split, id FROM folds, (SELECT CAST(unnest(range(1, 6)) AS INT) AS f) f),
faulty AS (SELECT fold, CASE WHEN id % 1000 = 3 AND fold = 2 THEN 'dev' ELSE split END AS split, id FROM sp WHERE NOT (id % 1000 = 1 AND split = 'test')
  UNION ALL SELECT fold, 'train', id FROM sp WHERE id % 1000 = 2 AND split = 'test')"""


def _faulty(spark, sf_dir):
    # Both parts of the table, its checks and the wanted ids read the folds.
    folds = durable(_folds(spark, sf_dir).select("id", "fold"))
    splits = S.split_table(folds, ["id"], 5)
    rest = F.col("id") % 1000
    kept = splits.filter(~((rest == 1) & (F.col("split") == "test")))
    kept = kept.withColumn("split", F.when((rest == 3) & (F.col("fold") == 2), "dev").otherwise(F.col("split")))
    return kept.unionByName(splits.filter((rest == 2) & (F.col("split") == "test")).withColumn("split", F.lit("train"))), folds.select("id")


@query(
    "split_violations",
    f"""WITH {COHORT_SQL}, {_FAULTY_SQL}, per AS (SELECT fold, id, count(CASE WHEN split = 'train' THEN 1 END) AS train, count(CASE WHEN split = 'test' THEN 1 END) AS test,
  count(CASE WHEN split NOT IN ('train', 'test') THEN 1 END) AS other FROM faulty GROUP BY fold, id),
want AS (SELECT id, CAST(f AS INT) AS fold FROM cohort, (SELECT unnest(range(1, 6)) AS f)),
v AS (SELECT w.fold, w.id, CASE WHEN p.id IS NULL THEN 'id missing from fold' WHEN other > 0 THEN 'unknown split name' WHEN train > 0 AND test > 0 THEN 'train and test overlap' END AS violation
  FROM want w LEFT JOIN per p ON w.fold = p.fold AND w.id = p.id)
SELECT * FROM v WHERE violation IS NOT NULL UNION ALL
SELECT NULL, id, 'not in exactly one test fold' FROM per GROUP BY id HAVING count(CASE WHEN test > 0 THEN 1 END) <> 1""",
)
def split_violations(spark, sf_dir):
    faulty, ids = _faulty(spark, sf_dir)
    return S.split_violations(faulty, ids, 5)


@query(
    "exact_cover_check",
    f"""WITH {COHORT_SQL}, {folds_sql()} SELECT count(*) AS n_ids, CAST(0 AS BIGINT) AS n_violations FROM folds""",
)
def exact_cover_check(spark, sf_dir):
    folds = durable(_folds(spark, sf_dir).select("id", "fold"))
    bad = S.split_violations(S.split_table(folds, ["id"], 5), folds.select("id"), 5).agg(F.count(F.lit(1)).alias("n_violations"))
    return folds.agg(F.count(F.lit(1)).alias("n_ids")).join(F.broadcast(bad), how="cross")  # one row each


@query(
    "assignment_violations",
    """WITH s AS (SELECT doc_id, CASE WHEN doc_id % 50 = 7 THEN 'holdout' WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM labels WHERE doc_id % 30 <> 4
  UNION ALL SELECT doc_id, 'val' FROM labels WHERE doc_id % 40 = 9 AND doc_id % 30 <> 4),
p AS (SELECT doc_id, count(*) AS n, count(CASE WHEN split NOT IN ('train', 'val', 'test') THEN 1 END) AS unknown FROM s GROUP BY doc_id)
SELECT l.doc_id, CASE WHEN p.doc_id IS NULL THEN 'missing id' WHEN unknown > 0 THEN 'unknown split name' ELSE 'id in several splits' END AS violation
FROM labels l LEFT JOIN p ON l.doc_id = p.doc_id WHERE p.doc_id IS NULL OR unknown > 0 OR n > 1""",
)
def assignment_violations(spark, sf_dir):
    ids = table(spark, sf_dir, "labels").select("doc_id")
    d = F.col("doc_id")
    part = F.when(d % 50 == 7, "holdout").when(d % 5 == 0, "test").otherwise("train")
    kept = ids.filter(d % 30 != 4)
    splits = kept.withColumn("split", part).unionByName(kept.filter(d % 40 == 9).withColumn("split", F.lit("val")))
    return S.assignment_violations(splits, ids, ["train", "val", "test"], "doc_id")


@query(
    "oof_completeness",
    f"""WITH {OOF_SQL}, one AS (SELECT * FROM oof WHERE NOT (run = 'r1' AND label = 'returned' AND fold = 4) AND NOT (run = 'r3' AND fold = 2)),
dup AS (SELECT run, label, id, fold FROM one UNION ALL SELECT run, label, id, fold FROM one WHERE run = 'r2' AND id % 100 = 5), per AS (SELECT run, label, id, count(*) AS n FROM dup GROUP BY ALL),
k AS (SELECT DISTINCT run, label FROM oof)
SELECT k.run, k.label, CAST(c.id AS VARCHAR) AS subject, CASE WHEN p.id IS NULL THEN 'missing id' ELSE 'duplicate id' END AS violation
FROM cohort c CROSS JOIN k LEFT JOIN per p ON c.id = p.id AND p.run = k.run AND p.label = k.label WHERE p.id IS NULL OR n > 1
UNION ALL SELECT k.run, k.label, CAST(f AS VARCHAR), 'missing fold' FROM k, range(1, 6) q(f) WHERE NOT EXISTS (SELECT 1 FROM one WHERE one.run = k.run AND one.label = k.label AND one.fold = f)""",
)
def oof_completeness(spark, sf_dir):
    """All runs and labels: one run lacks a fold for one label, one lacks a fold for both, one has rows twice."""
    kept = oof(spark, sf_dir).filter("NOT (run = 'r1' AND label = 'returned' AND fold = 4) AND NOT (run = 'r3' AND fold = 2)").select("run", "label", "id", "fold")
    doubled = kept.unionByName(kept.filter("run = 'r2' AND id % 100 = 5"))
    return S.oof_violations(doubled, cohort(spark, sf_dir).select("id"), 5, keys=["run", "label"])


@query(
    "aligned_stored_folds",
    f"""WITH {COHORT_SQL}, {folds_sql()}, now AS (SELECT id FROM cohort WHERE amount > 100000), st AS (SELECT f.f AS fold, CASE WHEN fold = f.f THEN 'test' ELSE 'train' END AS split, id
  FROM folds, (SELECT unnest(range(1, 6)) AS f) f WHERE NOT (f.f = 3 AND fold <> 3)),
k AS (SELECT fold, split, id FROM st WHERE id IN (SELECT id FROM now)
  UNION ALL SELECT 3, 'train', id FROM now WHERE id NOT IN (SELECT id FROM st WHERE fold = 3))
SELECT CAST(fold AS INT) AS fold, split, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM k GROUP BY ALL""",
)
def aligned_stored_folds(spark, sf_dir):
    stored = S.split_table(_folds(spark, sf_dir), ["id"], 5).filter("NOT (fold = 3 AND split = 'train')")
    now = cohort(spark, sf_dir).filter("amount > 100000").select("id")
    return S.align_splits(stored, now).groupBy("fold", "split").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


@query(
    "permuted_labels",
    f"""WITH {COHORT_SQL}, r AS (SELECT id, returned, p, row_number() OVER (PARTITION BY p ORDER BY {sql_md5("'9'", 'p', 'id')}, id) AS i, sum(returned) OVER (PARTITION BY p) AS k
  FROM cohort, (SELECT unnest(range(1, 4)) AS p))
SELECT CAST(p AS INT) AS permutation, returned, CASE WHEN i <= k THEN 1 ELSE 0 END AS y_permuted, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM r GROUP BY ALL""",
)
def permuted_labels(spark, sf_dir):
    out = S.permuted_labels(cohort(spark, sf_dir), ["id"], "returned", 3, 9)
    return out.groupBy("permutation", "returned", "y_permuted").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


# ---- positive-unlabeled operators -----------------------------------------------------------------

_CONCEAL_SQL = f"""cr AS (SELECT f.*, row_number() OVER (PARTITION BY fold, returned ORDER BY {sql_md5("'21'", 'id')}, id) AS i, count(*) OVER (PARTITION BY fold, returned) AS p FROM folds f),
hid AS (SELECT id, fold, returned AS y_true, CASE WHEN returned = 1 AND i <= least(greatest(1, floor(p * 0.3 + 0.5)), p - 1) THEN 1 ELSE 0 END AS is_hidden FROM cr)"""


@query(
    "concealed_positives",
    f"""WITH {COHORT_SQL}, {folds_sql()}, {_CONCEAL_SQL}
SELECT fold, y_true, is_hidden, CASE WHEN is_hidden = 1 THEN 0 ELSE y_true END AS y_observed, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM hid GROUP BY ALL""",
)
def concealed_positives(spark, sf_dir):
    out = U.conceal_positives(_folds(spark, sf_dir), ["fold"], ["id"], "returned", 0.3, 21)
    return out.groupBy("fold", "y_true", "is_hidden", "y_observed").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


@query(
    "concealment_violations",
    f"""WITH {COHORT_SQL}, {folds_sql()}, {_CONCEAL_SQL}, h AS (SELECT id FROM hid WHERE is_hidden = 1 AND fold <> 1 UNION ALL SELECT id FROM folds WHERE id % 500 = 10)
SELECT id, 'in test part' AS violation FROM h WHERE id IN (SELECT id FROM folds WHERE fold = 1)
UNION ALL SELECT id, 'outside train part' FROM h WHERE id NOT IN (SELECT id FROM folds WHERE fold <> 1)
UNION ALL SELECT id, 'not positive' FROM h WHERE id IN (SELECT id FROM folds WHERE fold <> 1 AND returned = 0)""",
)
def concealment_violations(spark, sf_dir):
    folds = _folds(spark, sf_dir)
    hidden = U.conceal_positives(folds, ["fold"], ["id"], "returned", 0.3, 21).filter("is_hidden = 1 AND fold <> 1").select("id")
    claimed = hidden.unionByName(folds.filter("id % 500 = 10").select("id"))
    return U.concealment_violations(claimed, folds.filter("fold <> 1"), folds.filter("fold = 1"), "id", "returned")


@query(
    "clean_negative_subset",
    f"""WITH {COHORT_SQL} SELECT 'supervised_clean_negatives' AS formulation, returned, count(*) AS n FROM cohort WHERE returned = 1 OR returned + open_line = 0 GROUP BY returned
UNION ALL SELECT 'pu_naive', returned, count(*) FROM cohort GROUP BY returned""",
)
def clean_negative_subset(spark, sf_dir):
    rows = cohort(spark, sf_dir).withColumn("none", (F.col("returned") + F.col("open_line") == 0).cast("int"))
    parts = [
        U.training_subset(rows, "returned", "none", f).select(F.lit(f).alias("formulation"), "returned") for f in ("supervised_clean_negatives", "pu_naive")
    ]
    return parts[0].unionByName(parts[1]).groupBy("formulation", "returned").agg(F.count(F.lit(1)).alias("n"))


@query(
    "label_frequency_and_prior",
    f"""WITH {OOF_SQL}, c AS (SELECT run, label, least(greatest(avg(CASE WHEN y_true = 1 THEN score END), 0.05), 1.0) AS c, avg(y_true) AS share FROM oof GROUP BY run, label)
SELECT run, label, round(c, 9) AS c, round(least(greatest(share / c, 0.001), 0.99), 9) AS prior FROM c""",
)
def label_frequency_and_prior(spark, sf_dir):
    out = U.class_prior(oof(spark, sf_dir), ["run", "label"])
    return out.select("run", "label", rounded(F.col("c")).alias("c"), rounded(F.col("prior")).alias("prior"))


@query(
    "elkan_noto_scores",
    f"""WITH {OOF_SQL}, c AS (SELECT run, fold, label, least(greatest(avg(CASE WHEN y_true = 1 THEN score END), 0.001), 1.0) AS c FROM oof GROUP BY ALL)
SELECT o.run, o.label, count(*) AS n, round(avg(least(greatest(score / c, 0.0), 1.0)), 9) AS mean_adjusted FROM oof o JOIN c ON o.run = c.run AND o.fold = c.fold AND o.label = c.label GROUP BY ALL""",
)
def elkan_noto_scores(spark, sf_dir):
    rows = oof(spark, sf_dir)
    keys = ["run", "fold", "label"]
    joined = rows.join(U.label_frequency(rows, keys).select(*keys, "c"), keys)
    return joined.groupBy("run", "label").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.avg(U.adjust_scores(F.col("score"), F.col("c")))).alias("mean_adjusted")
    )


@query(
    "pu_bags",
    f"""WITH {COHORT_SQL}, {folds_sql()}, b AS (SELECT CAST(unnest(range(1, 6)) AS INT) AS bag), p AS (SELECT fold, sum(discountless) AS p FROM (SELECT fold, returned AS discountless FROM folds) GROUP BY fold),
u AS (SELECT f.fold, bag, id, row_number() OVER (PARTITION BY f.fold, bag ORDER BY {sql_md5("'31'", 'bag', 'id')}, id) AS i FROM folds f, b WHERE returned = 0),
a AS (SELECT fold, bag, 1 AS returned, id FROM folds, b WHERE returned = 1 UNION ALL SELECT u.fold, bag, 0, id FROM u JOIN p ON u.fold = p.fold WHERE i <= greatest(1, round_even(p.p * 0.5, 0)))
SELECT fold, bag, returned, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM a GROUP BY ALL""",
)
def pu_bags(spark, sf_dir):
    out = U.pu_bags(_folds(spark, sf_dir), ["fold"], ["id"], "returned", 5, 0.5, 31)
    return out.groupBy("fold", "bag", "returned").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


@query(
    "negative_sampling",
    f"""WITH n AS (SELECT event_id, event_type, row_number() OVER (ORDER BY {sql_md5("'77'", 'event_id')}, event_id) AS i FROM events WHERE event_type <> 'purchase'),
p AS (SELECT count(*) AS p FROM events WHERE event_type = 'purchase')
SELECT event_id, 1 AS y FROM events WHERE event_type = 'purchase' UNION ALL SELECT event_id, 0 FROM n, p WHERE i <= p * 2""",
)
def negative_sampling(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("event_type") == "purchase").cast("int").alias("y"))
    return U.sample_negatives(rows, ["event_id"], "y", 2, 77)


@query(
    "random_oversampling",
    f"""WITH {COHORT_SQL}, {folds_sql()}, s AS (SELECT fold, sum(open_line) AS p, sum(1 - open_line) AS n FROM folds GROUP BY fold),
r AS (SELECT f.fold, open_line, id, row_number() OVER (PARTITION BY f.fold, open_line ORDER BY {sql_md5("'13'", 'id')}, id) AS i, count(*) OVER (PARTITION BY f.fold, open_line) AS m, greatest(p, n) AS goal
  FROM folds f JOIN s ON f.fold = s.fold),
c AS (SELECT *, goal // m + CASE WHEN i <= goal % m THEN 1 ELSE 0 END AS copies FROM r)
SELECT fold, open_line, CAST(sum(copies) AS BIGINT) AS n, CAST(sum(copies * id) AS BIGINT) AS ids FROM c GROUP BY ALL""",
)
def random_oversampling(spark, sf_dir):
    out = U.oversample(_folds(spark, sf_dir), ["fold"], ["id"], "open_line", 13)
    return out.groupBy("fold", "open_line").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


@query(
    "balanced_subset",
    f"""WITH {COHORT_SQL}, r AS (SELECT id, returned, row_number() OVER (PARTITION BY returned ORDER BY {sql_md5("'15'", 'id')}, id) AS i FROM cohort) SELECT id, returned FROM r WHERE i <= 200""",
)
def balanced_subset(spark, sf_dir):
    return U.balanced_subset(cohort(spark, sf_dir).select("id", "returned"), ["id"], "returned", 400, 15)


# ---- synthetic minority rows over the embeddings --------------------------------------------------------

_KNN_SQL = """e AS (SELECT CAST(label % 2 AS VARCHAR) AS part, vec_id, CASE WHEN label < 4 THEN 1 ELSE 0 END AS y, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
nn AS (SELECT a.part, a.vec_id, b.vec_id AS neighbour, list_distance(a.v, b.v) AS distance,
  row_number() OVER (PARTITION BY a.part, a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS position FROM e a JOIN e b ON a.part = b.part AND a.y = 1 AND b.y = 1 AND a.vec_id <> b.vec_id
  QUALIFY row_number() OVER (PARTITION BY a.part, a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) <= 5)"""


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        (F.col("label") % 2).cast("string").alias("part"), "vec_id", (F.col("label") < 4).cast("int").alias("y"), F.transform("embedding", lambda x: x.cast("double")).alias("v")
    )


@query("minority_neighbours", f"WITH {_KNN_SQL} SELECT part, vec_id, neighbour, round(distance, 9) AS distance, CAST(position AS INT) AS position FROM nn")
def minority_neighbours(spark, sf_dir):
    from lumbre.operators.neighbours import exact_neighbours

    out = exact_neighbours(_vectors(spark, sf_dir).filter("y = 1"), "part", "vec_id", "v", 5)
    return out.withColumn("distance", rounded(F.col("distance")))


@query(
    "synthetic_minority_rows",
    f"""WITH {_KNN_SQL}, c AS (SELECT part, sum(y) AS p, sum(1 - y) AS n FROM e GROUP BY part),
r AS (SELECT e.part, vec_id, v, p, n, row_number() OVER (PARTITION BY e.part ORDER BY {sql_md5("'6'", 'vec_id')}, vec_id) AS rank FROM e JOIN c ON e.part = c.part WHERE y = 1),
m AS (SELECT part, vec_id AS base, v, unnest(range(rank, CAST(n - p + 1 AS BIGINT), CAST(p AS BIGINT))) AS number FROM r),
s AS (SELECT m.*, least(5, (SELECT max(p) FROM c WHERE c.part = m.part) - 1) AS kk,
  CAST('0x' || substr(md5('6|neighbour|' || m.part || '|' || number), 1, 8) AS UBIGINT) / 4294967296.0 AS u, CAST('0x' || substr(md5('6|gap|' || m.part || '|' || number), 1, 8) AS UBIGINT) / 4294967296.0 AS gap FROM m),
j AS (SELECT s.part, s.number, s.base, nn.neighbour, gap, s.v AS bv, e.v AS nv FROM s JOIN nn ON nn.part = s.part AND nn.vec_id = s.base AND nn.position = floor(u * kk) + 1 JOIN e ON e.vec_id = nn.neighbour)
SELECT part, number, base, neighbour, round(gap, 9) AS gap, CAST(i - 1 AS INT) AS axis, round(bv[i] + gap * (nv[i] - bv[i]), 9) AS value FROM j, unnest(range(1, len(bv) + 1)) x(i)""",
)
def synthetic_minority_rows(spark, sf_dir):
    from lumbre.operators.neighbours import smote

    out = smote(_vectors(spark, sf_dir), "part", "vec_id", "v", "y", 5, 6)
    rows = out.select("part", "number", "base", "neighbour", rounded(F.col("gap")).alias("gap"), F.posexplode("v").alias("axis", "value"))
    return rows.withColumn("value", rounded(F.col("value")))
