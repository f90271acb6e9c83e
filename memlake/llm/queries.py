"""The registered queries of the training-data operators, with production parameters, and their DuckDB SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, linededup, lm, media, minhash, packing, passages, phrases, pii, quality, secrets, urls, whitening
from .common import table

PACK_TOKENIZER = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_dedup(table(spark, sf_dir, "documents"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.secrets_digest(docs, secrets.markov_ratios(secrets.labelled_samples(spark, docs)))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(table(spark, sf_dir, "documents"), public_tokenizers.path(PACK_TOKENIZER))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media_digest(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_digest(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lattice_scores(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.jaccard_join(table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.judged(pages, urls.junk_sites(pages))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_dedup, op2_benchmark_decontamination, op3_secret_scans, op4_best_fit_packing, op5_media_columns, op6_pii, op7_quality_classifier, op8_substring_dedup, op9_lm_scoring, op10_ngram_jaccard_join, op11_embedding_whitening, op12_url_filters, op13_phrase_collocations, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": linededup.ORACLE, "op2_benchmark_decontamination": decontaminate.ORACLE, "op12_url_filters": urls.ORACLE, "op13_phrase_collocations": phrases.ORACLE}
