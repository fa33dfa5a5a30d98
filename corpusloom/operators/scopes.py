"""Index scopes and gates: what a rebuild reuses, what a scope adds or omits, whether versions hold what they state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.elements import clean_text, latest

#: Texts of one embedding request.
BATCH = 10
FORMATS = ("md", "txt", "pdf")


def count_of(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def reject_code(path: Column, doc_format: Column, split: Column, deliveries: Column) -> Column:
    """Why a catalogue row may not be read, or null: the first broken rule. A null path or format breaks its rule."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    unsafe = path.isNull() | path.rlike(r"^/|[\\:\x00]|(?:^|/)\.\.(?:/|$)") | (name == "") | (F.length(name) > 180)
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    sound = F.coalesce(doc_format.isin(*FORMATS) & (suffix == F.concat(F.lit("."), doc_format)), F.lit(False))
    return F.when(deliveries > 1, "manifest_conflict").when(F.coalesce(split, F.lit("")) != "dev", "split_not_allowed").when(unsafe, "unsafe_path").when(~sound, "unsupported_format")


def manifest_hashes(elements: DataFrame) -> DataFrame:
    """``processing_version_id, elements, ids_sha256``: the hash of a version's element ids in order, joined by line feeds."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "element_id"))), lambda e: e["element_id"])
    return elements.groupBy("processing_version_id").agg(F.count(F.lit(1)).alias("elements"), F.sha2(F.array_join(ordered, "\n"), 256).alias("ids_sha256"))


def scope_changes(members: DataFrame, group: str, key: str) -> DataFrame:
    """Per ``group`` the sizes of two sets of keys, flagged ``held`` and ``asked``: of both, their union and differences.

    ``strict_superset`` says that the asked set holds all of the other and more. Null keys are no members.
    """
    sides = members.where(F.col(key).isNotNull()).groupBy(group, key).agg(F.max("held").alias("held"), F.max("asked").alias("asked")).where("held or asked")
    counts = sides.groupBy(group).agg(
        F.count_if("held").alias("held"), F.count_if("asked").alias("asked"), F.count_if(F.col("held") & F.col("asked")).alias("kept"), F.count(F.lit(1)).alias("united"),
        F.count_if(F.col("held") & ~F.col("asked")).alias("omitted"),
    )
    return counts.withColumn("strict_superset", (F.col("omitted") == 0) & (F.col("asked") > F.col("held")))


def rebuild_plan(deliveries: DataFrame, group: str, key: str, content: str, order: str = "loaded_at") -> DataFrame:
    """Per ``group`` how many keys keep the content of an earlier delivery, how many need new vectors, and in how many requests.

    A key counts in the group of its last delivery; of equally late ones the largest content is the last. Only an
    earlier delivery of the same content can be reused; null contents can't.
    """
    last = F.max(F.struct(order, content, group)).alias("last")
    every = deliveries.where(F.col(key).isNotNull())
    now = every.groupBy(key).agg(last).select(key, F.col("last")[order].alias("_at"), F.col("last")[content].alias("_content"), F.col("last")[group].alias(group))
    before = every.groupBy(key, F.col(content).alias("_content")).agg(F.min(order).alias("_first"))
    seen = now.join(before, [key, "_content"], "left").withColumn("reused", F.coalesce(F.col("_first") < F.col("_at"), F.lit(False)))
    plan = seen.groupBy(group).agg(F.count(F.lit(1)).alias("documents"), F.count_if("reused").alias("reused"))
    new = F.col("documents") - F.col("reused")
    return plan.withColumn("generated", new).withColumn("requests", F.ceil(new / BATCH))


def version_gates(versions: DataFrame, elements: DataFrame) -> DataFrame:
    """Per processing version: ``counted`` (as many elements as stated), ``contiguous``, ``sourced``, ``indexable`` and ``passed``, all of them.

    One pass over the elements. A version without elements fails each.
    """
    indexable = clean_text(F.col("raw_text")).isNotNull() | F.col("image_ref").isNotNull()
    n = F.count(F.lit(1))
    seen = elements.groupBy("processing_version_id").agg(
        n.alias("n"), ((F.min("ordinal") == 0) & (F.max("ordinal") == n - 1) & (F.countDistinct("ordinal") == n)).alias("contiguous"),
        F.bool_and(F.coalesce(F.trim("source.source_path") != "", F.lit(False))).alias("sourced"), F.bool_or(indexable).alias("indexable"),
    )
    no = F.lit(False)
    rows = versions.select("processing_version_id", "element_count").join(seen, "processing_version_id", "left").select(
        "processing_version_id", F.coalesce(F.col("element_count") == F.col("n"), no).alias("counted"), *[F.coalesce(c, no).alias(c) for c in ("contiguous", "sourced", "indexable")]
    )
    return rows.withColumn("passed", F.col("counted") & F.col("contiguous") & F.col("sourced") & F.col("indexable"))


def quality_verdicts(versions: DataFrame, elements: DataFrame) -> DataFrame:
    """``processing_version_id, verdict, blocking_reasons, review_reasons``: ``blocked`` before ``needs_review`` before ``candidate``.

    Reasons are sorted and joined by commas. ``versions`` has one row per version, ``elements`` one per element.
    """
    has = clean_text(F.col("raw_text")).isNotNull() | F.col("image_ref").isNotNull()
    seen = elements.groupBy("processing_version_id").agg(
        F.count(F.lit(1)).alias("n"), count_of(has).alias("eligible"), count_of(F.coalesce(F.trim("source.source_path"), F.lit("")) == "").alias("unsourced"),
        count_of((F.col("kind") == "image") & F.col("image_ref").isNull()).alias("imageless"),
    )
    rows = versions.select("processing_version_id", "warning_count").join(seen, "processing_version_id", "left")
    none = F.coalesce("n", F.lit(0)) == 0
    blocking = F.array_compact(F.array(
        F.when(F.col("imageless") > 0, "missing_image_reference"), F.when(F.col("unsourced") > 0, "missing_source_path"), F.when(none, "no_elements"),
        F.when(~none & (F.col("eligible") == 0), "no_indexable_elements"),
    ))
    review = F.array_compact(F.array(F.when(F.col("eligible") < F.col("n"), "empty_parsed_element"), F.when(F.col("warning_count") > 0, "parser_warnings")))
    verdict = F.when(F.size(blocking) > 0, "blocked").when(F.size(review) > 0, "needs_review").otherwise("candidate")
    return rows.select("processing_version_id", verdict.alias("verdict"), F.array_join(blocking, ",").alias("blocking_reasons"), F.array_join(review, ",").alias("review_reasons"))


def best_versions(versions: DataFrame, elements: DataFrame) -> DataFrame:
    """``document_id, processing_version_id, release_status, elements``: of a document's versions with elements the best to reuse.

    Active ones first, then drafts, then others; then the one updated last, then the largest id.
    """
    counts = elements.groupBy("processing_version_id").agg(F.count(F.lit(1)).alias("elements"))
    standing = F.when(F.col("release_status") == "active", 2).when(F.col("release_status") == "draft", 1).otherwise(0)
    rows = latest(versions, "processing_version_id", "created_at").where("document_id is not null").join(counts, "processing_version_id")
    best = F.max(F.struct(standing.alias("standing"), F.coalesce("updated_at", "created_at").alias("at"), "processing_version_id", "release_status", "elements")).alias("r")
    return rows.groupBy("document_id").agg(best).select("document_id", "r.processing_version_id", "r.release_status", "r.elements")
