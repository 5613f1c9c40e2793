"""The registered queries of this subpackage: opN_<name>(spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .tables import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_documents

    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"))


def op4_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_io import round_trip

    return round_trip(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import search

    return search(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_documents

    return scan_documents(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import mine, shifted_label

    return mine(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0", shifted_label())


def op12_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES

    return dict(ORACLES)
