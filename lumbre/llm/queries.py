"""Registered queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumbre.llm import bloom_dedup, cotraining, curriculum, lattice_lm, main_text, merkle, minhash, nbest, notices, prefix_targets, quality_rules, repair, warc
from lumbre.llm.common import read_table, shared_path, text_of

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(function, sql: str | None = None):
    QUERIES[function.__name__] = function
    if sql:
        ORACLES[function.__name__] = sql
    return function


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.line_frequency_verdicts(read_table(spark, sf_dir, "documents"), host_col="source").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


_query(op2_quality_rules, quality_rules.SQL)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_dedup.exact_dedup(read_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


_query(
    op10_exact_dedup,
    r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
""",
)


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), words=4).select("doc_id", "n_shingles", "component_id", "kept")


_query(op9_minhash_near_dedup)


def op1_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.lattice_scores(read_table(spark, sf_dir, "documents"))


_query(op1_lattice_lm)


def op8_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = nbest.encode_n_best(read_table(spark, sf_dir, "documents").select("doc_id", text_of("text").alias("text")), n=4, decoded=True)
    return encoded.select(
        "doc_id",
        F.size("piece_ids").cast("long").alias("n_pieces"),
        F.sha2(F.array_join("piece_ids", " "), 256).alias("piece_ids_sha256"),
        F.transform("n_best", lambda w: w["score"]).alias("scores"),
        F.col("n_best").alias("n_best"),
        (F.col("decoded") == F.col("text")).alias("round_trip"),
    )


_query(op8_sentencepiece_nbest)


def op7_cotraining_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = cotraining.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "text_score", "field_score", F.col("quality_score").alias("score"), F.col("quality_kept").alias("kept"))


_query(op7_cotraining_quality)


def op5_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = curriculum.schedule_documents(read_table(spark, sf_dir, "documents"))
    first, last = (F.round(f("positions"), 9) for f in (F.array_min, F.array_max))
    shown = plan.select("doc_id", "size", "source_size", "target", "taken", first.alias("first_position"), last.alias("last_position"))
    return shown.orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


_query(op5_curriculum_mix, curriculum.SQL)


def op3_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notices.scan_notices(read_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")


_query(op3_license_notices)


def op4_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], turns.schema)
    formatted = prefix_targets.format_conversations(turns.unionByName(extra))
    return prefix_targets.digests(formatted).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


_query(op4_prefix_targets, prefix_targets.SQL)


def op6_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract_main_text(read_table(spark, sf_dir, "pages"))


_query(op6_html_main_text)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = merkle.documents_manifest(read_table(spark, sf_dir, "documents"))
    return merkle.prove(manifest).withColumnRenamed("id", "doc_id")


_query(op11_merkle_manifest, merkle.SQL)


def op13_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "archives")
    warc.write_archives(read_table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


_query(op13_warc_archives, warc.SQL.replace("SELECT page_id, payload_bytes, payload_digest, CASE", "SELECT page_id, payload_bytes, payload_digest, true AS intact, CASE"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_damaged(read_table(spark, sf_dir, "conversations"))


_query(op12_conversation_repair, repair.SQL)
