"""Quality classifier by co-training two views of a document.

One view reads the text, the other the fields beside it (language, source, stated length, lines).  Both start on labelled rows; in every
round each view labels the rows of an unlabelled pool that it is sure of, and those join the training rows of the other view.
At the end each view is calibrated on labelled rows that neither was trained on, the calibrated views are combined, and all
documents are scored by expressions inside the scan.

The classifiers are fitted on bounded samples: at most about MAX_LABELLED labelled rows and MAX_POOL unlabelled ones, chosen by hash of the id.
Scoring reads every document whole.

Defined cases: a null text is empty; null fields are a value of their own; rows without a label, or with labels that differ, train nothing;
without labelled rows of both kinds every document scores the share of good labels (0.5 without labels); repeated rows score alike;
an empty table gives an empty table; other columns are kept, but text_score, field_score,
quality_score and quality_kept are replaced.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumbre.llm.common import SPACE, WORD, shared_table, text_of

MAX_LABELLED = 20_000
MAX_POOL = 20_000
ROUNDS = 3
#: A view is sure of a row from this probability on.
SURE = 0.97
#: Of a hundred labelled rows so many calibrate.
CALIBRATION_PERCENT = 25
SOURCE_BUCKETS = 16
LANGS = ["en", "de", "fr", "es"]
KEEP_FROM = 0.5


def _share(text: str, pattern: str, total: Column) -> Column:
    return F.length(F.regexp_replace(text, f"[^{pattern}]+", "")) / F.greatest(total, F.lit(1))


def _repeated(values: str) -> Column:
    return 1 - F.size(F.array_distinct(values)) / F.greatest(F.size(values), F.lit(1))


def with_views(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", length_col: str = "n_chars") -> DataFrame:
    """(_row, _text_view, _field_view): each row as one struct, so that no column of the user meets a name of this module, and its two arrays of numbers."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    out = docs.select(whole, text_of(f"`{text_col}`").alias("_t"), *[F.col(f"`{c}`").alias(n) for n, c in (("_lang", lang_col), ("_source", source_col), ("_length", length_col))])
    out = out.withColumn("_words", F.transform(F.regexp_extract_all("_t", F.lit(f"({WORD})"), F.lit(1)), lambda w: F.xxhash64(w)))
    n = F.greatest(F.size("_words") - 1, F.lit(0))
    out = out.withColumn("_pairs", F.zip_with(F.slice("_words", F.lit(1), n), F.slice("_words", F.lit(2), n), lambda x, y: F.xxhash64(x, y)))
    out = out.withColumn("_lines", F.filter(F.split("_t", "\n"), lambda x: x.rlike(f"[^{SPACE}]")))
    chars, words, lines = F.length("_t"), F.size("_words"), F.size("_lines")
    root = lambda c: F.sqrt(c)
    text = [
        F.log1p(words), (words < 20).cast("double"), chars / F.greatest(words, F.lit(1)) / 10,
        root(_share("_t", "#*$%&<>", chars)), root(_share("_t", "|", chars)), root(_share("_t", "!", chars)), root(_share("_t", "A-ZÀ-Þ", chars)), root(_share("_t", "0-9", chars)),
        _repeated("_words"), _repeated("_words") * F.log1p(words) / 5, _repeated("_pairs"), root(_repeated("_pairs")), _repeated("_lines"),
    ]
    lang, source = F.coalesce(F.col("_lang").cast("string"), F.lit("")), F.coalesce(F.col("_source").cast("string"), F.lit(""))
    stated = F.coalesce(F.col("_length").cast("double"), F.lit(0.0))
    bucket = F.pmod(F.xxhash64(source), F.lit(SOURCE_BUCKETS))
    fields = [
        F.log1p(F.greatest(stated, F.lit(0.0))), F.log1p(lines.cast("double")), F.log1p(F.abs(stated) / F.greatest(lines, F.lit(1))), (F.abs(stated - chars) > 0).cast("double"),
        *[(lang == x).cast("double") for x in LANGS], *[(bucket == k).cast("double") for k in range(SOURCE_BUCKETS)],
    ]
    numbers = lambda xs: F.transform(F.array(*[x.cast("double") for x in xs]), lambda x: F.coalesce(x, F.lit(0.0)))
    return out.select("_row", numbers(text).alias("_text_view"), numbers(fields).alias("_field_view"))


def logit(view: str, model: tuple[list[float], float]) -> Column:
    """Weighted sum of a view's numbers."""
    weights, bias = model
    return sum((F.col(view)[k] * F.lit(w) for k, w in enumerate(weights)), F.lit(bias))


def _fit(rows: DataFrame, view: str, label: str, regularisation: float = 1e-3) -> tuple[list[float], float]:
    train = rows.select(array_to_vector(view).alias("features"), F.col(label).cast("double").alias("label"))
    model = LogisticRegression(maxIter=40, regParam=regularisation, standardization=True).fit(train)
    return [float(x) for x in model.coefficients], float(model.intercept)


def _sample(rows: DataFrame, id_col: str, most: int, count: int, seed: int) -> DataFrame:
    """About ``most`` of ``count`` rows by hash of the id; all if there are fewer."""
    share = min(1.0, most / max(1, count))
    return rows.filter(F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1_000_000)) < math.ceil(share * 1_000_000))


def train_views(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", max_labelled: int = MAX_LABELLED, max_pool: int = MAX_POOL, rounds: int = ROUNDS, **columns: str
) -> dict | None:
    """Models of both views, their calibration and their combination; None without labels of both kinds."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_lid")).agg(F.min(label_col).alias("_low"), F.max(label_col).alias("_y"))
    agreed = known.filter("_low = _y").select("_lid", "_y")
    names = {"text_col": "text", "lang_col": "lang", "source_col": "source", "length_col": "n_chars"}
    plain = docs.select(F.col(f"`{id_col}`").alias("_lid"), *[F.col(f"`{columns.get(k, default)}`").alias(f"c_{k}") for k, default in names.items()])
    own_names = {k: f"c_{k}" for k in names}
    # About ``max_labelled`` ids at most: sent to the documents, whose texts stay where they are.
    chosen = F.broadcast(_sample(agreed, "_lid", max_labelled, agreed.count(), 1))
    views = ["_text_view", "_field_view"]
    labelled = with_views(plain.join(chosen, "_lid"), **own_names)
    held = F.pmod(F.xxhash64(F.lit(3), F.col("_row._lid")), F.lit(100)) < CALIBRATION_PERCENT
    # Only the narrow views are dealt to few files.
    labelled = shared_table(labelled.select(*views, F.col("_row._y").alias("_y"), held.alias("_held")).repartition(4))
    sampled = with_views(_sample(plain, "_lid", max_pool, docs.count(), 2), **own_names)
    pool = shared_table(sampled.select(*views, F.col("_row._lid").alias("_lid")).join(known, "_lid", "left_anti").select(*views).repartition(4))
    seen = {(r["_held"], r["_y"]) for r in labelled.select("_held", "_y").distinct().collect()}
    if len(seen) < 4:
        return None
    own = labelled.filter("NOT _held").select(*views, "_y")
    train, models = {v: own for v in views}, {}
    for step in range(rounds + 1):
        models = {v: _fit(train[v], v, "_y") for v in views}
        if step < rounds:
            odds = math.log(SURE / (1 - SURE))
            for v, other in zip(views, reversed(views)):
                sure = pool.select(*views, logit(v, models[v]).alias("_z")).filter(F.abs("_z") >= odds).select(*views, (F.col("_z") > 0).cast("int").alias("_y"))
                train[other] = own.unionByName(sure)
    held_rows = labelled.filter("_held")
    calibrated = {v: _fit(held_rows.select(F.array(logit(v, models[v])).alias("_z"), "_y"), "_z", "_y") for v in views}
    both = held_rows.select(F.array(*[_calibrated(v, models, calibrated) for v in views]).alias("_z"), "_y")
    return {"models": models, "calibrated": calibrated, "combined": _fit(both, "_z", "_y")}


def _calibrated(view: str, models: dict, calibrated: dict) -> Column:
    (slope,), shift = calibrated[view]
    return logit(view, models[view]) * F.lit(slope) + F.lit(shift)


def _probability(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def score_documents(docs: DataFrame, trained: dict | None, share: float = 0.5, keep_from: float = KEEP_FROM, **columns: str) -> DataFrame:
    """``docs`` with text_score, field_score, quality_score and quality_kept."""
    if trained is None:
        return docs.withColumns({c: F.lit(share) for c in ("text_score", "field_score", "quality_score")}).withColumn("quality_kept", F.lit(True))
    own = {"text_score", "field_score", "quality_score", "quality_kept"}
    kept = [F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in own]
    out = with_views(docs, **columns)
    z = {v: _calibrated(v, trained["models"], trained["calibrated"]) for v in ("_text_view", "_field_view")}
    (a, b), c = trained["combined"]
    out = out.withColumns({"_zt": z["_text_view"], "_zf": z["_field_view"]})
    score = _probability(F.col("_zt") * F.lit(a) + F.col("_zf") * F.lit(b) + F.lit(c))
    out = out.select(*kept, _probability(F.col("_zt")).alias("text_score"), _probability(F.col("_zf")).alias("field_score"), score.alias("quality_score"))
    return out.withColumn("quality_kept", F.col("quality_score") >= keep_from)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", keep_from: float = KEEP_FROM, **columns: str) -> DataFrame:
    """Train on ``labels`` and score all ``docs``."""
    trained = train_views(docs, labels, id_col, label_col, **columns)
    share = labels.agg(F.avg(F.when(F.col(label_col).isin(0, 1), F.col(label_col)))).first()[0] if trained is None else None
    return score_documents(docs, trained, 0.5 if share is None else float(share), keep_from, **columns)
