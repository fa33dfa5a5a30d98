"""Queries of the training-data problems; each runs with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import cross_split, keyed_splits, leakage, packing, pair_defects, scan_repair, text_quality, visual_text
from corpusloom.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return visual_text.unseen_by_machine(table(spark, d, "visual_facts"), table(spark, d, "mapped_cases"))


def p1_canonical_terms(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct required term and the canonical member of its class."""
    terms = visual_text.required_terms(table(spark, d, "visual_facts")).select("term")
    return visual_text.canonical_members(terms, "term")


def p1_group_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Per case, groups of which a reader finds some term, and groups of which a plain comparison does."""
    presence = visual_text.term_presence(table(spark, d, "visual_facts"), table(spark, d, "mapped_cases"))
    groups = presence.groupBy("case_id", "group_no").agg(F.max(F.col("visible").cast("long")).alias("v"), F.max(F.col("exact").cast("long")).alias("e"))
    return groups.groupBy("case_id").agg(F.count(F.lit(1)).alias("term_groups"), F.sum("v").alias("seen_groups"), F.sum("e").alias("matched_groups"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return scan_repair.scan_noise(table(spark, d, "elements"))


def p2_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return scan_repair.repaired_paragraphs(table(spark, d, "elements"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return keyed_splits.torn_components(table(spark, d, "catalog_entries"))


def p3_components(spark: SparkSession, d: str) -> DataFrame:
    return keyed_splits.related_documents(table(spark, d, "catalog_entries"))


def p3_assignment(spark: SparkSession, d: str) -> DataFrame:
    return keyed_splits.assign_splits(table(spark, d, "catalog_entries"), table(spark, d, "split_targets"))


def p3_split_totals(spark: SparkSession, d: str) -> DataFrame:
    return keyed_splits.split_totals(p3_assignment(spark, d), table(spark, d, "split_targets"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return pair_defects.broken_pairs(table(spark, d, "mapped_cases"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return cross_split.overlapping_cases(table(spark, d, "mapped_cases"))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return cross_split.overlap_report(table(spark, d, "mapped_cases"))


def p6_assignment(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_containers(table(spark, d, "documents"), table(spark, d, "pack_capacities"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.container_fill(p6_assignment(spark, d), table(spark, d, "pack_capacities"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaking_documents(table(spark, d, "documents"), table(spark, d, "heldout_items"))


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Each evaluation item with the number of documents that leak it and the largest share of it in one."""
    leaks = leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "heldout_items"))
    by_item = leaks.groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.max("share").alias("largest_share"))
    items = table(spark, d, "heldout_items").where("item_id is not null").select("item_id", "split", "source").distinct()
    return items.join(by_item, "item_id", "left").select("item_id", "split", "source", F.coalesce("documents", F.lit(0)).alias("documents"), "largest_share")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return text_quality.not_prose(table(spark, d, "documents"))


def p8_statistics(spark: SparkSession, d: str) -> DataFrame:
    plain = ("mean_word_length", "symbol_share", "punctuated_line_share", "common_word_share")
    statistics = text_quality.quality_statistics(table(spark, d, "documents"), table(spark, d, "common_words"))
    return statistics.select("doc_id", "words", *[F.round(c, 6).alias(c) for c in plain])


def p8_layout(spark: SparkSession, d: str) -> DataFrame:
    return text_quality.quality_statistics(table(spark, d, "documents"), table(spark, d, "common_words")).drop(
        "words", "mean_word_length", "symbol_share", "punctuated_line_share", "common_word_share"
    )


def queries() -> dict[str, Query]:
    own = (
        p1_found, p1_canonical_terms, p1_group_coverage, p2_found, p2_paragraphs, p3_found, p3_components, p3_assignment, p3_split_totals, p4_found, p5_found, p5_report,
        p6_assignment, p6_fill, p7_found, p7_items, p8_found, p8_statistics, p8_layout,
    )
    return {q.__name__: q for q in own}
