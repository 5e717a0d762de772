"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .packing import pack
from .simhash import simhash_groups
from .secrets import scan
from .tiff import media_features
from .html import extract_pages
from .warc import ORACLE as WARC_ORACLE
from .warc import archive_pages
from .decontam import leaks
from .toxicity import score
from .language import identify
from .token_output import token_output


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(spark, table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(spark, table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, table(spark, sf_dir, "documents"))


def op5_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(spark, table(spark, sf_dir, "documents"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark, table(spark, sf_dir, "pages"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(spark, table(spark, sf_dir, "pages"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_output": op1_token_output,
    "op10_packing": op10_packing,
    "op4_simhash": op4_simhash,
    "op6_secrets": op6_secrets,
    "op5_tiff": op5_tiff,
    "op2_html": op2_html,
    "op3_warc": op3_warc,
    "op9_decontamination": op9_decontamination,
    "op8_toxicity": op8_toxicity,
    "op7_language": op7_language,
}

ORACLES: dict[str, str] = {
    "op3_warc": WARC_ORACLE,
}
