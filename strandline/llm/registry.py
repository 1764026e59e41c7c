"""The corpus operators' queries over the tables of one folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandline.llm.common import table
from strandline.llm.decontaminate import contaminated
from strandline.llm.lines import ORACLE_SQL as LINES_SQL
from strandline.llm.lines import dedup_lines
from strandline.llm.mixing import mix_sources
from strandline.llm.neighbours import ORACLE_SQL as NEIGHBOURS_SQL
from strandline.llm.neighbours import nearest
from strandline.llm.quality import score_quality
from strandline.llm.secrets import scan_secrets
from strandline.llm.sentences import remove_spans
from strandline.llm.simhash import near_duplicates
from strandline.llm.suffixes import remove_repeats
from strandline.llm.toxicity import score_toxicity


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op5_sentence_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_spans(table(spark, sf_dir, "documents"), fewest=1)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op8_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_classifier, op2_benchmark_decontamination, op3_mix_sources, op4_suffix_array_dedup, op5_sentence_span_dedup, op6_toxicity, op7_nearest_neighbours, op8_simhash_near_duplicates, op9_line_dedup, op10_secret_scan)}


def oracle_sql() -> dict[str, str]:
    return {"op7_nearest_neighbours": NEIGHBOURS_SQL, "op9_line_dedup": LINES_SQL}
