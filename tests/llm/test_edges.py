"""Every operator on columns with the names that it uses itself, on nulls everywhere, on long texts, repeats and empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import prose

CLASHING = "chunk block band bands hub root place size key n text_key kind bits row_key word words content tokenizer added_by gram h _w _p label found spans score shard dim id v rank mix_key source_key copy taken target n_words n_shingles pair_id chosen".split()
LONG = prose(5, 60_000)


def with_clashes(df):
    for name in CLASHING:
        if name not in df.columns:
            df = df.withColumn(name, F.lit(7))
    return df


@pytest.fixture(scope="module")
def table(spark):
    rows = [(None, None, None, "en"), (None, "x y", "s", None), (1, None, "s", "en"), (2, "", "s", "es"), (3, " \n ", "t", "es"), (4, "same text here", "t", "en"), (4, "same text here", "t", "en"), (4, "another text", "t", "en"), (5, LONG, None, "es"), (6, LONG + " more", "t", "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")


def runs(spark, tmp_path):
    from codaria.llm import ann, decontaminate, mixing, near_dedup, pii, preference, secret_scan, substring_dedup, token_counts, toxicity

    tokenizers = pytest.importorskip("public_tokenizers")
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    items = spark.createDataFrame([(0, " ".join(LONG.split()[30_000:30_020])), (1, "text here"), (None, "x y"), (2, None)], "item_id long, text string")
    return {
        "pii": pii.find_pii,
        "toxicity": lambda d: toxicity.toxicity_scores(d, with_clashes(labels)),
        "drop_toxic": lambda d: toxicity.drop_toxic(d, with_clashes(labels)),
        "substring": substring_dedup.remove_repeats,
        "secrets": secret_scan.scan_secrets,
        "redact": secret_scan.redact_secrets,
        "mixing": mixing.mix_sources,
        "mixed": mixing.mixed_documents,
        "near": near_dedup.near_duplicates,
        "decontamination": lambda d: decontaminate.contaminated(d, with_clashes(items), decontaminate.DecontaminationConfig(piece=1000)),
        "tokens": lambda d: token_counts.count_tokens(d, tokenizers.path("piece_bpe_32k.model"), f"{tmp_path}/cache-{random.random()}"),
        "preference": lambda d: preference.format_pairs(preference.reply_pairs(d.select(F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("assistant").alias("role"), "text", *[c for c in CLASHING if c in d.columns]))),
        "nearest": lambda d: ann.nearest(*[d.select(F.col("doc_id").alias("vec_id"), F.array(F.lit(1.0), F.col("doc_id").cast("double")).alias("embedding"), *[c for c in CLASHING if c in d.columns])] * 2),
    }


NAMES = ["pii", "toxicity", "drop_toxic", "substring", "secrets", "redact", "mixing", "mixed", "near", "decontamination", "tokens", "preference", "nearest"]


@pytest.mark.parametrize("name", NAMES)
def test_clashing_columns_change_nothing(spark, table, tmp_path, name):
    run = runs(spark, tmp_path)[name]
    plain, clashing = run(table), run(with_clashes(table))
    own = plain.columns
    kept = [c for c in own if c not in CLASHING or name not in ("drop_toxic", "redact", "mixed")]
    rows = lambda df: sorted(map(str, df.select(*kept).collect()))
    assert rows(plain) == rows(clashing)
    n = plain.count()
    if name in ("pii", "toxicity", "substring", "secrets", "redact", "mixing", "near", "tokens"):
        assert n == table.count()
    if name == "decontamination":
        assert sorted(tuple(r) for r in plain.select("doc_id", "item_id").collect()) == [(4, 1), (5, 0), (6, 0)]
    if name == "near":
        assert {(r["doc_id"], r["component_id"]) for r in plain.collect()} >= {(5, 5), (6, 5), (None, None)}
    if name == "substring":
        assert {r["doc_id"]: r["n_removed"] for r in plain.collect()}[5] == 60_000
    assert run(table.limit(0)).count() == 0 and run(table.limit(0)).columns == own
