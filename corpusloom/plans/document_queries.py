"""Queries of parsing, image evidence, index scopes and answer scores over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import corpus, documents, elements, evaluation, images, markdown, retrieval, scopes
from corpusloom.plans.core_queries import CANDIDATES, case_set, catalog_latest, current_cases, current_elements, hybrid_retrieval, revision_components, table_rows
from corpusloom.session import cut_lineage, ensure_checkpoint_dir, table
from corpusloom.sources import files

Query = Callable[[SparkSession, str], DataFrame]
#: Images that one answer or one version shows.
IMAGES = 3
#: Documents that are looked up by a broadcast of their ids.
FEW = 200_000


def current_versions(spark: SparkSession, d: str) -> DataFrame:
    return elements.latest(table(spark, d, "processing_versions"), "processing_version_id", "created_at")


def active_images(spark: SparkSession, d: str) -> DataFrame:
    """Image elements of active processing versions, with their section as ``path``."""
    path = F.coalesce(F.array_join("heading_path", " / "), F.lit("")).alias("path")
    rows = current_elements(spark, d).where("image_ref is not null and document_id is not null")
    rows = rows.select("element_id", "document_id", "processing_version_id", "ordinal", "image_ref", "raw_text", path, F.col("source.source_path").alias("source_path"))
    return rows.join(current_versions(spark, d).where("release_status = 'active'").select("processing_version_id"), "processing_version_id")


def markdown_elements(spark: SparkSession, d: str) -> DataFrame:
    return markdown.markdown_elements(table(spark, d, "documents"))


def markdown_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Elements per kind, and those that don't lead back to their source: none."""
    texts = table(spark, d, "documents")
    found = markdown.markdown_elements(texts)
    broken = markdown.source_mismatches(found, texts).withColumn("broken", F.lit(1))
    return found.join(broken, ["doc_id", "element_no"], "left").groupBy("kind").agg(F.count(F.lit(1)).alias("elements"), F.countDistinct("doc_id").alias("documents"), F.count("broken").alias("mismatches"))


def cleaned_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Documents that cleaning changes: their lengths before and after."""
    rows = table(spark, d, "documents").select("doc_id", "text", markdown.clean_markdown(F.col("text")).alias("plain"))
    return rows.where("plain <> text").select("doc_id", F.length("text").alias("before"), F.length("plain").alias("after"))


def image_references(spark: SparkSession, d: str) -> DataFrame:
    """Images that documents refer to, with their status."""
    return markdown.image_references(table(spark, d, "documents")).withColumn("status", images.asset_status(F.col("target")))


def linked_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the catalogue's documents that they link to."""
    there = catalog_latest(spark, d).where("source_path is not null").select("document_id", F.col("source_path").alias("path"))
    return markdown.linked_paths(table(spark, d, "documents")).join(there, "path").select("doc_id", "document_id")


def row_sections(spark: SparkSession, d: str) -> DataFrame:
    """The section in which each row of a Markdown table stands."""
    rows = table_rows(spark, d).select(F.col("line_no").alias("id"), "doc_id", F.col("line_no").alias("start"), F.col("line_no").alias("end"))
    spans = documents.heading_sections(table(spark, d, "documents")).select(F.col("section_no").alias("id"), "doc_id", F.col("line_start").alias("start"), F.col("line_end").alias("end"))
    return corpus.interval_overlaps(rows, spans, "doc_id", 50, keep_key=True).groupBy("doc_id", F.col("a_id").alias("line_no")).agg(F.min("b_id").alias("section_no"))


def path_safety_gate(spark: SparkSession, d: str) -> DataFrame:
    """Every catalogue document with the first rule that forbids reading it, or null."""
    rows = table(spark, d, "catalog_entries").where("document_id is not null")
    one = rows.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("loaded_at", "source_path", "doc_format", "split")).alias("r"))
    return one.select("document_id", scopes.reject_code(F.col("r.source_path"), F.col("r.doc_format"), F.lower(F.trim("r.split")), F.col("n")).alias("reject_code"))


def source_groups(spark: SparkSession, d: str) -> DataFrame:
    """Images per source group: the file name without its ending and a trailing number or page mark."""
    name = F.regexp_replace(F.regexp_extract("image_ref", r"([^/]+?)(?:\.[^./]+)?$", 1), r"(?:_page_\d+|_\d+)$", "")
    return current_elements(spark, d).where("image_ref is not null").groupBy(name.alias("source_group")).agg(F.count(F.lit(1)).alias("images"), F.countDistinct("document_id").alias("documents"))


def version_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of twenty processing versions, active ones first, then by time; with the number of all."""
    rows = current_versions(spark, d).select("processing_version_id", "release_status", F.coalesce("updated_at", "created_at").alias("at"))
    page = rows.orderBy(F.desc(F.coalesce(F.col("release_status") == "active", F.lit(False))), F.desc("at"), "processing_version_id").offset(20).limit(20)
    return page.withColumn("total", rows.agg(F.count(F.lit(1)).alias("n")).scalar())


def knowledge_overview(spark: SparkSession, d: str) -> DataFrame:
    """Every catalogue document with its versions, elements, and the version created last."""
    last = F.max(F.struct("created_at", "processing_version_id", "release_status")).alias("last")
    versions = current_versions(spark, d).where("document_id is not null").groupBy("document_id").agg(F.count(F.lit(1)).alias("versions"), last)
    counts = current_elements(spark, d).where("document_id is not null").groupBy("document_id").agg(F.count(F.lit(1)).alias("elements"))
    rows = catalog_latest(spark, d).select("document_id", "title").join(versions, "document_id", "left").join(counts, "document_id", "left")
    return rows.select(
        "document_id", "title", F.coalesce("versions", F.lit(0)).alias("versions"), F.coalesce("elements", F.lit(0)).alias("elements"), F.col("last.processing_version_id").alias("latest_version"),
        F.col("last.release_status").alias("release_status"),
    )


def reusable_processing(spark: SparkSession, d: str) -> DataFrame:
    return scopes.best_versions(table(spark, d, "processing_versions"), current_elements(spark, d))


def title_images(spark: SparkSession, d: str) -> DataFrame:
    """Images of active versions by their document's title; of those that show one asset the first."""
    titles = catalog_latest(spark, d).select("document_id", "title")
    found = images.first_assets(active_images(spark, d))
    return found.join(titles, "document_id").select("title", "element_id", "asset_path", "status")


def diverse_images(spark: SparkSession, d: str) -> DataFrame:
    return images.interleaved(active_images(spark, d), IMAGES)


def visual_selection(spark: SparkSession, d: str) -> DataFrame:
    """The images that fit each question best, for cases whose number is divisible by 50, among those of their documents."""
    asked = case_set(current_cases(spark, d)).select(F.col("case_id").alias("query_id"), "question", F.explode(F.array_distinct("reference_document_ids")).alias("document_id"))
    titled = asked.join(catalog_latest(spark, d).select("document_id", "title"), "document_id")
    scoped = titled.withColumn("question", F.when(F.coalesce("title", F.lit("")) != "", F.replace("question", F.col("title"), F.lit(" "))).otherwise(F.col("question")))
    near = elements.image_context(current_elements(spark, d)).withColumnRenamed("context", "near")
    found = scoped.join(active_images(spark, d), "document_id").join(near, "element_id", "left")
    score = images.relevance(F.col("question"), F.concat_ws(" ", "raw_text", "image_ref", "path"), F.col("near"), F.lit(""))
    return images.selected(found.select("query_id", "element_id", "ordinal", score.alias("score")), IMAGES)


def evidence_locations(spark: SparkSession, d: str) -> DataFrame:
    """Where every element stands, as it is cited: path and lines or page, and the headings above."""
    s = F.col("source")
    place = F.when(s["kind"] == "text", F.concat_ws(":", s["source_path"], F.concat_ws("-", s["line_start"], s["line_end"]))).otherwise(F.concat_ws("#", s["source_path"], s["page_number"]))
    return current_elements(spark, d).select("element_id", place.alias("location"), F.array_join("heading_path", " / ").alias("headings"))


def page_labels(spark: SparkSession, d: str) -> DataFrame:
    """Scanned elements that hold a number only: page labels, not content."""
    rows = current_elements(spark, d).where("source.kind = 'pdf'")
    return rows.where(F.trim("raw_text").rlike("^[0-9]+$")).select("element_id", F.col("source.page_number").alias("page"), F.trim("raw_text").alias("label"))


def box_pixels(spark: SparkSession, d: str) -> DataFrame:
    """The boxes of images in pixels of their page image."""
    box, w, h = F.col("source.bbox"), F.col("source.image_width"), F.col("source.image_height")
    rows = current_elements(spark, d).where(box.isNotNull() & w.isNotNull() & h.isNotNull())
    return rows.select("element_id", *[F.round(box[c] * size, 3).alias(c) for c, size in (("x0", w), ("y0", h), ("x1", w), ("y1", h))])


def version_gates(spark: SparkSession, d: str) -> DataFrame:
    return scopes.version_gates(current_versions(spark, d), current_elements(spark, d))


def quality_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return scopes.quality_verdicts(current_versions(spark, d), current_elements(spark, d))


def manifest_hashes(spark: SparkSession, d: str) -> DataFrame:
    return scopes.manifest_hashes(current_elements(spark, d))


def scope_changes(spark: SparkSession, d: str) -> DataFrame:
    """Per parser version, the documents of active versions against those of drafts."""
    rows = table(spark, d, "processing_versions").select("parser_version", "document_id", (F.col("release_status") == "active").alias("held"), (F.col("release_status") == "draft").alias("asked"))
    return scopes.scope_changes(rows, "parser_version", "document_id")


def rebuild_plan(spark: SparkSession, d: str) -> DataFrame:
    return scopes.rebuild_plan(table(spark, d, "catalog_entries").select("document_id", "knowledge_base", "sha256", "loaded_at"), "knowledge_base", "document_id", "sha256")


def vector_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Whether the vectors serve all documents."""
    return retrieval.coverage(table(spark, d, "documents"), table(spark, d, "embeddings"), "doc_id", 64)


def reranked_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """The fused results of the hybrid search, ordered by the share of the query's tokens that they hold.

    Up to ``FEW`` documents found are sent to where the texts are, so that only their texts are shuffled.
    """
    texts = table(spark, d, "documents")
    found = cut_lineage(hybrid_retrieval(spark, d).select("query_id", "doc_id", "rank"))
    ids = found.select("doc_id").distinct()
    held = texts.select("doc_id", "text").join(F.broadcast(ids) if ids.count() <= FEW else ids, "doc_id", "left_semi")
    found = found.join(held, "doc_id")
    asked = texts.select(F.col("doc_id").alias("query_id"), F.col("title").alias("query_text"))
    return retrieval.reranked(found.join(asked, "query_id", "left"), CANDIDATES)


def citation_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Reference answers as answers that cite their mapped evidence, by its number among all evidence."""
    cases = current_cases(spark, d)
    every = F.coalesce("evidence_mappings", F.array().cast(cases.schema["evidence_mappings"].dataType))
    marks = F.transform(every, lambda m, i: F.when(m["status"] == "mapped", F.concat(F.lit("["), i + 1, F.lit("]"))))
    answer = F.concat(F.coalesce("reference_answer", F.lit("")), F.array_join(marks, ""))
    return evaluation.citation_metrics(cases.select("case_id", "answerable", answer.alias("answer"), F.transform(every, lambda m: m["evidence_id"]).alias("citations"), F.col("source_evidence_ids").alias("gold")))


def largest_components(spark: SparkSession, d: str) -> DataFrame:
    """The twenty largest components of documents that share content, largest first."""
    return revision_components(spark, d).orderBy(F.desc("documents"), "component").limit(20)


def catalog_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Ids that stand more than once in the catalogue after it went to JSON lines and came back with fixed fields."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/catalog-{uuid.uuid4().hex}"
    rows = table(spark, d, "catalog_entries")
    files.write_jsonl(rows.withColumnsRenamed({"source_path": "path", "doc_format": "format"}), path)
    return files.duplicate_ids(files.read_catalog(spark, path).where("malformed is null"))


def queries() -> dict[str, Query]:
    own = (
        markdown_elements, markdown_kinds, cleaned_lengths, image_references, linked_documents, row_sections, path_safety_gate, source_groups, version_page, knowledge_overview,
        reusable_processing, title_images, diverse_images, visual_selection, evidence_locations, page_labels, box_pixels, version_gates, quality_verdicts, manifest_hashes, scope_changes,
        rebuild_plan, vector_coverage, reranked_retrieval, citation_metrics, largest_components, catalog_roundtrip,
    )
    return {q.__name__: q for q in own}
