"""The contract queries of the corpus operators, and SQL for those that SQL can state."""

from __future__ import annotations

from . import bpe, decontaminate, language_id, line_dedup, lm_score, media, near_dedup, secrets, toxicity, url_filter
from .common import table


def op1_secret_scan(spark, sf_dir):
    return secrets.digest(table(spark, sf_dir, "documents"))


def op2_lm_score(spark, sf_dir):
    return lm_score.digest(table(spark, sf_dir, "documents"))


def op3_decontamination(spark, sf_dir):
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_toxicity(spark, sf_dir):
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op6_bpe(spark, sf_dir):
    return bpe.digest(table(spark, sf_dir, "documents"))


def op7_simhash_near_dedup(spark, sf_dir):
    return near_dedup.digest(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark, sf_dir):
    return line_dedup.digest(table(spark, sf_dir, "documents"))


def op9_language_id(spark, sf_dir):
    return language_id.digest(table(spark, sf_dir, "documents"))


def op10_media_columns(spark, sf_dir):
    return media.digest(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_lm_score": op2_lm_score,
    "op3_decontamination": op3_decontamination,
    "op4_toxicity": op4_toxicity,
    "op5_url_filter": op5_url_filter,
    "op6_bpe": op6_bpe,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_line_dedup": op8_line_dedup,
    "op9_language_id": op9_language_id,
    "op10_media_columns": op10_media_columns,
}

ORACLES: dict[str, str] = {
    "op3_decontamination": decontaminate.ORACLE,
    "op5_url_filter": url_filter.oracle(),
    "op8_line_dedup": line_dedup.ORACLE,
}
