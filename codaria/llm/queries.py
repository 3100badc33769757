"""The dealt operators applied to their whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codaria.sources.io import spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(found) if name == "documents" else found


def _counted(rows: DataFrame) -> DataFrame:
    """Rows with the number of all spans and of added ones in the place of found."""
    n = F.size("found").cast("long").alias("n_spans")
    return rows.select(*[c for c in rows.columns if c != "found"], n, F.size(F.filter("found", lambda s: s["added"])).cast("long").alias("n_added"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codaria.llm.pii import find_pii

    return _counted(find_pii(_table(spark, sf_dir, "documents")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codaria.llm.toxicity import toxicity_scores

    return toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codaria.llm.substring_dedup import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents")).drop("kept_text")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from codaria.llm.secret_scan import SecretConfig, scan_secrets

    return scan_secrets(_table(spark, sf_dir, "documents"), SecretConfig(vocabulary=public_tokenizers.path("byte_bpe_50k.tiktoken"))).transform(_counted)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codaria.llm.mixing import mix_sources

    return mix_sources(_table(spark, sf_dir, "documents")).drop("source")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codaria.llm.near_dedup import NearDedupConfig, near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), NearDedupConfig(percent=85))


def op7_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codaria.llm.preference import format_pairs, reply_pairs

    return format_pairs(reply_pairs(_table(spark, sf_dir, "conversations")))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codaria.llm.decontaminate import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by a cache that an earlier call has filled with the counts of the Spanish ones; so some are hits."""
    import public_tokenizers

    from codaria.llm.storage import new_path
    from codaria.llm.token_counts import count_tokens, fill_cache

    docs, model, cache = _table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), new_path(spark, "token-cache")
    fill_cache(docs.filter("lang = 'es'"), model, cache)
    return count_tokens(docs, model, cache)


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codaria.llm.ann import nearest

    vectors = _table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 20 = 0"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": op1_pii,
        "op2_toxicity": op2_toxicity,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_secret_scan": op4_secret_scan,
        "op5_mixing": op5_mixing,
        "op6_near_dedup": op6_near_dedup,
        "op7_preference": op7_preference,
        "op8_decontamination": op8_decontamination,
        "op9_token_counts": op9_token_counts,
        "op10_nearest": op10_nearest,
    }


def oracle_sql() -> dict[str, str]:
    from codaria.llm import oracles

    return {
        "op3_substring_dedup": oracles.SUBSTRING,
        "op5_mixing": oracles.MIXING,
        "op6_near_dedup": oracles.NEAR,
        "op7_preference": oracles.PREFERENCE,
        "op8_decontamination": oracles.DECONTAMINATION,
    }
