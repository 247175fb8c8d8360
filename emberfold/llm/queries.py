"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, bpe, ctw, mixing, quality_classifier, quality_rules, sharding, simhash, token_files, toxicity
from .common import bucket_of, cut, documents, ship
from .quality_sql import quality_sql


def op1_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, totals = ctw.score(ctw.split_by_key(documents(spark, sf_dir)))
    bits_per_byte = -F.col("score") / F.col("n_bytes") / F.log10(F.lit(2.0))
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(totals.train_tokens).cast("long").alias("train_tokens"), "base_score", "score", bits_per_byte.alias("bits_per_byte"))


def op2_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    slim = cut(quality_rules.features(documents(spark, sf_dir)).select("doc_id", "lang", quality_rules.BASE, quality_rules.MEASURE))
    known = quality_rules.references(slim)
    base = F.col(quality_rules.BASE)
    return quality_rules.judge(slim, known).select("doc_id", *(base[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))


def op3_subset_sum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mixing.marked(documents(spark, sf_dir).select("doc_id", "source", "text")).drop("text", "source")
    slim = cut(docs)
    wanted = cut(mixing.targets(slim))
    taken = mixing.apply_plan(slim, mixing.plan(slim, wanted)).join(wanted, "__ef_source")
    return taken.select("doc_id", F.col("__ef_size").alias("size"), "source_size", "target", (F.col("__ef_size") * F.col("__ef_copies")).alias("taken"))


def op4_byte_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_by_bytes(sharding.sized(documents(spark, sf_dir)))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op5_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = documents(spark, sf_dir, "labels").where(bucket_of("doc_id", 3) != 1)
    machine = toxicity.fit(docs, labels)
    scored, score = toxicity.score(docs, machine), F.col("__ef_toxic.score")
    return scored.select("doc_id", (bucket_of("doc_id", 3) == 1).alias("held_out"), score.alias("score"), (score >= 0.7).cast("int").alias("predicted"), F.col("__ef_toxic.worst").alias("worst_word"))


def op6_backtracking_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.encode_and_decode(documents(spark, sf_dir), keep=["doc_id"])
    ids, decoded = F.col("__ef_bpe.ids"), F.col("__ef_bpe.decoded")
    return done.select("doc_id", (F.octet_length(ids) / 4).cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(decoded.cast("binary"), 256).alias("decoded_sha256"))


def op7_quadratic_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = cut(quality_classifier.with_statistics(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", (bucket_of("doc_id", 5) == 0).alias("held_out"), "__ef_stats"))
    labels = documents(spark, sf_dir, "labels").select("doc_id", "quality").where(bucket_of("doc_id", 5) != 0)
    model = quality_classifier.fit(stats.where("not held_out").join(labels, "doc_id"))
    scored = quality_classifier.score(stats, model)
    return scored.select("doc_id", "held_out", F.col("__ef_score").alias("score"), (F.col("__ef_score") >= 0.3).cast("int").alias("predicted"))


def op8_pfor_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.folder_for(spark)
    files = cut(token_files.write(documents(spark, sf_dir), folder))
    return token_files.read(files, folder).select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op9_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("__ef_audio")
    done = audio.with_audio(documents(spark, sf_dir).select("doc_id", "text"))
    n = F.octet_length(a["payload"])
    feature = F.format_string("frames=%d;segments=%d;first=%.3f;last=%.3f;db=%.2f;tensors=%08x", a["frames"], F.size(a["segments"]), F.coalesce(F.get(a["segments"], F.lit(0))["start"], F.lit(0.0)), F.coalesce(F.get(a["segments"], F.size(a["segments"]) - 1)["end"], F.lit(0.0)), a["mean_db"], F.crc32(a["tensors"]))
    return done.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        n.cast("long").alias("payload_bytes"),
        F.sha2(a["payload"], 256).alias("payload_sha256"),
        F.crc32(F.substring(a["payload"], n - 15, F.lit(16))).alias("tail_crc32"),
        F.octet_length(a["media"]).cast("long").alias("media_bytes"),
        F.sha2(a["media"], 256).alias("media_sha256"),
        feature.alias("feature"),
    )


def op10_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = cut(documents(spark, sf_dir).select(F.col("doc_id").alias("member"), simhash.fingerprint().alias("bits")))
    return simhash.label(members).select(F.col("member").alias("doc_id"), simhash.hex_of(F.col("bits")).alias("fingerprint"), F.col("first").alias("component_id"))


_OPERATORS = (
    op1_context_tree_weighting,
    op2_quality_divergence,
    op3_subset_sum_mix,
    op4_byte_balanced_shards,
    op5_string_kernel_toxicity,
    op6_backtracking_bpe,
    op7_quadratic_discriminant,
    op8_pfor_token_files,
    op9_audio_features,
    op10_simhash_pivots,
)


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {f.__name__: _shipped(f) for f in _OPERATORS}
#: The other operators have no SQL: DuckDB lacks CRC-32 and XXH64, or the method is iterative. Tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op2_quality_divergence": quality_sql()}
