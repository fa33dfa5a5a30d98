"""Queries of the core operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.text import search_bigrams, search_tokens
from corpusloom.operators import corpus, documents, elements, evaluation, retrieval
from corpusloom.operators.components import connected_components
from corpusloom.session import cut_lineage, table
from corpusloom.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]

# Names and patterns that the secret scan looks for.
SECRETS = {"hex_digest": r"\b[0-9a-f]{64}\b", "base64_block": r"[A-Za-z0-9+/]{60,}", "home_path": r"/(?:home|Users)/[a-z]+", "key_assignment": r"(?i)(?:api[_-]?key|secret|token)\s*[:=]\s*\S+"}
#: Results per query, and candidates that each ranking gives to the fusion.
TOP, CANDIDATES = 5, 10
EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def current_elements(spark: SparkSession, d: str) -> DataFrame:
    """The elements, each once."""
    return elements.latest(table(spark, d, "elements").where("processing_version_id is not null"), "element_id")


def current_cases(spark: SparkSession, d: str) -> DataFrame:
    return elements.latest(table(spark, d, "mapped_cases"), "case_id")


def catalog_latest(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue with one row per document, the one delivered last."""
    columns = ("document_id", "source_path", "title", "doc_format", "knowledge_base", "product_version", "loaded_at")
    return elements.latest(table(spark, d, "catalog_entries").select(*columns), "document_id").select(*columns)


def catalog_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Markdown rows delivered into the catalogue of all other formats: last writer wins, per document."""
    rows = table(spark, d, "catalog_entries").select("document_id", "title", "doc_format", "loaded_at")
    return corpus.upserted(rows.where("doc_format <> 'md'"), rows.where("doc_format = 'md'"), "document_id", "loaded_at")


def catalog_allowed(spark: SparkSession, d: str) -> DataFrame:
    """Documents of the dev split in a text format."""
    rows = table(spark, d, "catalog_entries").where("lower(trim(split)) = 'dev' and doc_format in ('md', 'txt')")
    return rows.select("document_id", "title", "doc_format").distinct()


def catalog_formats(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "catalog_entries")
    return rows.groupBy("doc_format", "selection_bucket").agg(F.count(F.lit(1)).alias("deliveries"), F.countDistinct("document_id").alias("documents"), F.max("selection_score").alias("best_score"))


def hash_split(spark: SparkSession, d: str) -> DataFrame:
    """A stable split of the groups, six tenths dev and the rest test, by the hash of the group; a document without one is its own."""
    rows = table(spark, d, "catalog_entries").select(F.coalesce("group_id", "document_id").alias("group_key")).where("group_key is not null").distinct()
    rows = rows.withColumn("bucket", corpus.hash_bucket(F.col("group_key"), 10))
    return rows.withColumn("split_name", F.when(F.col("bucket") < 6, "dev").otherwise("test"))


def split_leakage(spark: SparkSession, d: str) -> DataFrame:
    """Content hashes that stand in more than one split."""
    rows = table(spark, d, "catalog_entries").select("sha256", F.lower(F.trim("split")).alias("split"))
    return corpus.shared_across_splits(rows, "sha256")


def capped_selection(spark: SparkSession, d: str) -> DataFrame:
    """The three best documents of each selection bucket."""
    rows = catalog_scores(spark, d)
    return corpus.capped(rows, "selection_bucket", [F.desc("selection_score"), F.col("document_id")], 3)


def catalog_scores(spark: SparkSession, d: str) -> DataFrame:
    """Bucket and score of each document, both of the row delivered last; documents without one of them are left out."""
    rows = table(spark, d, "catalog_entries").select("document_id", "selection_bucket", "selection_score", "loaded_at")
    return elements.latest(rows, "document_id").where("selection_bucket is not null and selection_score is not null").drop("loaded_at")


def round_robin_subset(spark: SparkSession, d: str) -> DataFrame:
    """Forty documents taken in turn from the selection buckets, best first."""
    picked = corpus.round_robin(catalog_scores(spark, d), "selection_bucket", [F.desc("selection_score"), F.col("document_id")], 40)
    return picked.select("document_id", "selection_bucket", "turn")


def group_signatures(spark: SparkSession, d: str) -> DataFrame:
    """Per source revision the documents, formats, families and whether all titles are given."""
    rows = table(spark, d, "catalog_entries")
    return rows.groupBy("source_revision").agg(
        F.countDistinct("document_id").alias("documents"), F.countDistinct("doc_format").alias("formats"), F.countDistinct("source_family").alias("families"), F.bool_and(F.col("title").isNotNull()).alias("titled")
    )


def revision_components(spark: SparkSession, d: str) -> DataFrame:
    """Components of documents that share a content hash, with their sizes."""
    rows = table(spark, d, "catalog_entries").where("document_id is not null and sha256 is not null")
    edges = rows.select(F.concat(F.lit("h"), "sha256").alias("a"), F.concat(F.lit("d"), "document_id").alias("b"))
    members = connected_components(edges).where("node like 'd%'")
    return members.groupBy("component").agg(F.count(F.lit(1)).alias("documents")).where("documents > 1")


def element_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "elements").select("kind", F.col("source.kind").alias("source_kind"), "element_id")
    return rows.groupBy("kind", "source_kind").agg(F.count(F.lit(1)).alias("deliveries"), F.countDistinct("element_id").alias("elements"))


def element_eligibility(spark: SparkSession, d: str) -> DataFrame:
    return elements.eligibility(current_elements(spark, d))


def location_violations(spark: SparkSession, d: str) -> DataFrame:
    return elements.location_violations(current_elements(spark, d))


def heading_runs(spark: SparkSession, d: str) -> DataFrame:
    return elements.heading_runs(current_elements(spark, d))


def adjacent_elements(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours of every image within one place under the same heading."""
    rows = current_elements(spark, d)
    return elements.neighbours(rows, rows.where("kind = 'image'"), 1)


def visual_context(spark: SparkSession, d: str) -> DataFrame:
    return elements.image_context(current_elements(spark, d))


def ordinal_contiguity(spark: SparkSession, d: str) -> DataFrame:
    return elements.ordinal_gaps(current_elements(spark, d))


def packed_chunks(spark: SparkSession, d: str) -> DataFrame:
    return elements.packed_chunks(current_elements(spark, d))


def element_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Element texts cut into overlapping pieces of at most 200 characters."""
    return elements.text_pieces(current_elements(spark, d), "element_id", "raw_text", 200, 30)


def text_length_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = current_elements(spark, d).where("raw_text is not null").select("kind", F.length("raw_text").alias("size"))
    return rows.groupBy("kind").agg(
        F.count(F.lit(1)).alias("texts"), F.min("size").alias("shortest"), F.max("size").alias("longest"), F.round(F.avg("size"), 4).alias("mean_size"), F.count_if(F.col("size") < 40).alias("short_texts")
    )


def version_audit(spark: SparkSession, d: str) -> DataFrame:
    """Processing versions whose stated element count differs from the elements there, or that miss on either side."""
    stated = elements.latest(table(spark, d, "processing_versions").select("processing_version_id", "element_count", "created_at"), "processing_version_id", "created_at")
    actual = current_elements(spark, d).groupBy("processing_version_id").agg(F.count(F.lit(1)).alias("elements"))
    both = stated.select("processing_version_id", "element_count").join(actual, "processing_version_id", "full_outer")
    return both.where("not (element_count <=> elements)").select("processing_version_id", "element_count", F.coalesce("elements", F.lit(0)).alias("elements"))


def processing_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "processing_versions")
    return rows.groupBy("parser_version").agg(
        F.countDistinct("processing_version_id").alias("versions"), F.count_if(F.col("warning_count") > 0).alias("with_warnings"), F.count_if(F.col("updated_at") < F.col("created_at")).alias("backdated"),
        F.sum(F.get_json_object("processing_profile", "$.dpi").cast("long")).alias("dpi_sum"),
    )


def page_headings(spark: SparkSession, d: str) -> DataFrame:
    """The last heading at or before the page of every scanned text."""
    rows = current_elements(spark, d).where("source.kind = 'pdf'").select("element_id", "processing_version_id", "kind", F.col("source.page_number").alias("page"), "raw_text")
    marks = rows.where("kind = 'heading' and raw_text is not null").groupBy("processing_version_id", "page").agg(F.max("raw_text").alias("heading"))
    texts = rows.where("kind = 'text'").select("element_id", "processing_version_id", "page")
    return corpus.asof_backward(texts, marks, "processing_version_id", "page", "heading", "Front matter").select("element_id", "page", "heading")


def evidence_mapping(spark: SparkSession, d: str) -> DataFrame:
    """The sections of each version with the chunks whose source lines they overlap: how many, and their ids in order."""
    rows = current_elements(spark, d).where("source.kind = 'text'").select("element_id", "processing_version_id", "ordinal", "heading_path", "raw_text", F.col("source.line_start").alias("start"), F.col("source.line_end").alias("end"))
    path = F.coalesce(F.array_join("heading_path", "\x1f", "\x00"), F.lit(""))
    spans = rows.groupBy("processing_version_id", path.alias("path")).agg(F.min("start").alias("start"), F.max("end").alias("end"))
    sections = spans.select(F.concat_ws(":", "processing_version_id", "start", "end").alias("id"), "processing_version_id", "start", "end")
    held = elements.packed_chunks(rows.drop("start", "end")).select("chunk_id", F.explode("element_ids").alias("element_id"))
    chunks = held.join(rows.select("element_id", "processing_version_id", "start", "end"), "element_id").select(F.col("chunk_id").alias("id"), "processing_version_id", "start", "end")
    pairs = corpus.interval_overlaps(sections, chunks, "processing_version_id", 50).distinct()
    return pairs.groupBy("a_id").agg(F.count(F.lit(1)).alias("chunks"), F.array_join(F.array_sort(F.collect_list("b_id")), ",").alias("chunk_ids"))


def missing_references(spark: SparkSession, d: str) -> DataFrame:
    """Reference documents of the cases that the catalogue has only in a scanned format or not at all."""
    asked = table(spark, d, "mapped_cases").select(F.explode("reference_document_ids").alias("document_id")).distinct()
    there = table(spark, d, "catalog_entries").where("doc_format in ('md', 'txt')").select("document_id")
    return asked.join(there, "document_id", "left_anti")


def evidence_status(spark: SparkSession, d: str) -> DataFrame:
    """Evidence mappings by case type and status."""
    rows = current_cases(spark, d).select("case_type", F.explode("evidence_mappings").alias("m"))
    return rows.groupBy("case_type", F.col("m.status").alias("status")).agg(F.count(F.lit(1)).alias("mappings"), F.sum(F.size("m.chunk_ids").cast("long")).alias("chunks"))


def term_coverage(spark: SparkSession, d: str) -> DataFrame:
    facts = elements.latest(table(spark, d, "visual_facts").select("case_id", "required_term_groups", "loaded_at"), "case_id")
    return evaluation.term_coverage(facts, current_cases(spark, d))


def case_set(cases: DataFrame) -> DataFrame:
    """The cases whose number, the last four hexadecimal digits of the id, is divisible by 50: the queries of searches."""
    digits = F.right("case_id", F.lit(4))
    return cases.where(digits.rlike("^[0-9a-f]{4}$") & (F.conv(digits, 16, 10).cast("int") % 50 == 0))


def query_cases(spark: SparkSession, d: str) -> DataFrame:
    """The answerable cases of the query set, written out once; chosen by their ids before the latest row of each is."""
    cases = elements.latest(case_set(table(spark, d, "mapped_cases")), "case_id").where("answerable")
    return cut_lineage(cases.select("case_id", "case_type", "question", "reference_document_ids"))


def case_rankings(spark: SparkSession, d: str, cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reference documents of the cases, and the ranking of the whole catalogue's titles by their questions."""
    gold = cases.select(F.col("case_id").alias("query_id"), F.explode("reference_document_ids").alias("key"))
    asked = cases.select(F.col("case_id").alias("query_id"), F.col("question").alias("query_text"))
    ranking = retrieval.bm25_topk(asked, catalog_latest(spark, d).select("document_id", "title"), TOP, "document_id", "title")
    return gold, ranking.withColumnRenamed("document_id", "key")


def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.retrieval_metrics(*case_rankings(spark, d, query_cases(spark, d)), k=TOP)


def metrics_by_type(spark: SparkSession, d: str) -> DataFrame:
    cases = query_cases(spark, d)
    scores = evaluation.retrieval_metrics(*case_rankings(spark, d, cases), k=TOP)
    types = cases.select(F.col("case_id").alias("query_id"), "case_type")
    means = [F.round(F.avg(c), 6).alias(f"mean_{c}") for c in ("recall", "precision", "reciprocal_rank")]
    return scores.join(types, "query_id").groupBy("case_type").agg(F.count(F.lit(1)).alias("cases"), *means)


def gold_violations(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.gold_violations(current_cases(spark, d))


def search_token_counts(spark: SparkSession, d: str) -> DataFrame:
    """Search tokens of all documents: document frequency and count."""
    index = retrieval.postings(table(spark, d, "documents"))
    return index.groupBy("term").agg(F.count(F.lit(1)).alias("documents"), F.sum("tf").alias("occurrences"))


def bm25_statistics(spark: SparkSession, d: str) -> DataFrame:
    stats = retrieval.bm25_stats(retrieval.postings(table(spark, d, "documents")))
    return stats.select("docs", "terms", "postings", F.round("avgdl", 6).alias("avgdl"))


def bm25_search(spark: SparkSession, d: str) -> DataFrame:
    """The best documents for every evaluation passage whose id is divisible by 50."""
    asked = table(spark, d, "heldout_items").where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    return retrieval.bm25_topk(asked, table(spark, d, "documents"), TOP)


def vector_queries(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    vectors = table(spark, d, "embeddings")
    return vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), vectors


def dense_search(spark: SparkSession, d: str) -> DataFrame:
    """The nearest vectors of every vector whose id is divisible by 50."""
    return retrieval.cosine_topk(*vector_queries(spark, d), TOP)


def hybrid_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Dense and keyword rankings fused: for every number divisible by 50, the best of all vectors and all documents.

    The keyword query is the title of the document with the query's number. A document without a vector is ranked by
    keywords alone, and so are all for a query without one.
    """
    queries, vectors = vector_queries(spark, d)
    texts = table(spark, d, "documents")
    asked = texts.where("doc_id % 50 = 0 and title is not null")
    keyword = retrieval.bm25_topk(asked.select(F.col("doc_id").alias("query_id"), F.col("title").alias("query_text")), texts, CANDIDATES)
    dense = retrieval.cosine_topk(queries, vectors, CANDIDATES).withColumnRenamed("vec_id", "doc_id")
    return retrieval.fuse(dense, keyword, key="doc_id", k=TOP)


def hybrid_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """The ranking of ``hybrid_ranking`` with the documents' titles."""
    titles = table(spark, d, "documents").select("doc_id", "title")
    return hybrid_ranking(spark, d).join(titles, "doc_id", "left").select("query_id", "doc_id", "score", "rank", "title")


def vector_labels(spark: SparkSession, d: str) -> DataFrame:
    """Vectors per label with the mean squared length, and those that break the contract."""
    vectors = table(spark, d, "embeddings")
    broken = retrieval.vector_violations(vectors, 64).select("vec_id", F.lit(1).alias("broken"))
    rows = vectors.join(broken, "vec_id", "left").withColumn("square", retrieval.dot(F.col("embedding"), F.col("embedding")))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("vectors"), F.round(F.avg("square"), 6).alias("mean_square"), F.count("broken").alias("violations"))


def title_relevance(spark: SparkSession, d: str) -> DataFrame:
    """Per document, how many of its title's words and character pairs its text holds."""
    rows = table(spark, d, "documents").where("title is not null")
    title = search_bigrams(F.col("title"))
    return rows.select("doc_id", F.size(title).alias("title_terms"), F.size(F.array_intersect(title, search_bigrams(F.col("text")))).alias("held_terms"))


def document_titles(spark: SparkSession, d: str) -> DataFrame:
    """A document's title: that of its front matter, else its first level-one heading, else the given title, else its number."""
    line = lambda mark: F.nullif(F.trim(F.regexp_extract("text", rf"(?m)^{mark}([^\n]+)$", 1), F.lit(' "')), F.lit(""))
    return table(spark, d, "documents").select("doc_id", F.coalesce(line(r"title:[ \t]*"), line(r"#[ \t]+"), "title", F.concat(F.lit("document "), F.col("doc_id").cast("string"))).alias("title"))


def table_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of Markdown tables in the documents: line number, cells, first cell; separator lines left out."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    rows = lines.withColumn("line", F.trim("line")).where(r"line like '|%|' and length(line) > 2 and not line rlike '^[|: -]+$'")
    cells = F.transform(F.split(F.expr("substring(line, 2, length(line) - 2)"), r"\|"), lambda x: F.trim(x))
    return rows.select("doc_id", (F.col("at") + 1).alias("line_no"), F.size(cells).alias("cells"), F.element_at(cells, 1).alias("first_cell"))


def paragraph_counts(spark: SparkSession, d: str) -> DataFrame:
    """Per language tag as given: documents, paragraphs parted by blank lines, and tokens."""
    rows = table(spark, d, "documents").withColumn("paragraphs", F.size(F.filter(F.split("text", r"\n[ \t]*\n"), lambda p: F.trim(p) != "")))
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("paragraphs").cast("long")).alias("paragraphs"), F.sum(F.size(search_tokens(F.col("text"))).cast("long")).alias("tokens"))


def source_distinct(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.countDistinct(F.sha2("text", 256)).alias("texts"), F.max("n_chars").alias("longest"))


def heading_sections(spark: SparkSession, d: str) -> DataFrame:
    return documents.heading_sections(table(spark, d, "documents"))


def heading_paths(spark: SparkSession, d: str) -> DataFrame:
    """The heading stack of every Markdown section of the documents."""
    return documents.heading_paths(documents.heading_sections(table(spark, d, "documents")))


def text_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return documents.text_paragraphs(table(spark, d, "documents"))


def html_table_rows(spark: SparkSession, d: str) -> DataFrame:
    return documents.html_rows(table(spark, d, "documents"))


def secret_scan(spark: SparkSession, d: str) -> DataFrame:
    return documents.pattern_hits(table(spark, d, "documents"), SECRETS)


def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Every document's SHA-256 and length in bytes."""
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").alias("bytes"))


def catalog_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Documents that were delivered more than once, and whether the deliveries differ in content or split."""
    rows = table(spark, d, "catalog_entries").groupBy("document_id").agg(F.count(F.lit(1)).alias("deliveries"), F.countDistinct("sha256").alias("contents"), F.countDistinct("split").alias("splits"))
    return rows.where("deliveries > 1")


def catalog_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of twenty documents by title."""
    rows = table(spark, d, "catalog_entries").where("document_id is not null").groupBy("document_id").agg(F.max("title").alias("title"))
    return rows.orderBy("title", "document_id").offset(20).limit(20)


def document_set_audit(spark: SparkSession, d: str) -> DataFrame:
    """Where documents stand: how many in which of catalogue, processing versions and elements."""
    sets = [table(spark, d, t).where("document_id is not null").select("document_id").distinct().withColumn(n, F.lit(True)) for t, n in (("catalog_entries", "in_catalog"), ("processing_versions", "in_versions"), ("elements", "in_elements"))]
    whole = sets[0].join(sets[1], "document_id", "full_outer").join(sets[2], "document_id", "full_outer")
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("in_catalog", "in_versions", "in_elements")]
    return whole.select(*flags).groupBy("in_catalog", "in_versions", "in_elements").agg(F.count(F.lit(1)).alias("documents"))


def section_page_span(spark: SparkSession, d: str) -> DataFrame:
    """Pages from which to which each top heading of a scanned version runs."""
    rows = current_elements(spark, d).where("source.kind = 'pdf' and size(heading_path) > 0").select("processing_version_id", F.element_at("heading_path", -1).alias("section"), F.col("source.page_number").alias("page"))
    return rows.groupBy("processing_version_id", "section").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.count(F.lit(1)).alias("elements"))


def title_categories(spark: SparkSession, d: str) -> DataFrame:
    """Documents by the kind of text that their title names; the first that fits."""
    title = F.lower("title")
    kind = (
        F.when(title.contains("故障处理") | title.contains("troubleshooting"), "troubleshooting").when(title.contains("参数") | title.contains("parameter reference"), "reference")
        .when(title.contains("升级") | title.contains("upgrade"), "upgrade").when(title.contains("部署") | title.contains("deployment"), "deployment").otherwise("other")
    )
    return table(spark, d, "documents").groupBy(kind.alias("category")).agg(F.count(F.lit(1)).alias("documents"), F.count("title").alias("titled"))


def context_budget(spark: SparkSession, d: str) -> DataFrame:
    """What the best documents of each hybrid search put into a context of 2,000 characters."""
    found = hybrid_ranking(spark, d).select("query_id", "doc_id", "rank")
    return documents.bounded_context(found, table(spark, d, "documents"), 2000)


def event_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Median and 95th percentile of the event values, to the cent, by type: nearest rank, halves to the even one.

    Values are counted before they are ordered, so a window holds the distinct values of a type, not its events.
    """
    counts = table(spark, d, "events").where("value is not null").groupBy("event_type", F.round("value", 2).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("event_type").orderBy("value")
    upto = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumn("upto", upto).withColumn("total", F.sum("n").over(Window.partitionBy("event_type")))
    at = lambda share: F.min(F.when(F.col("upto") > F.rint((F.col("total") - 1) * share), F.col("value")))
    return placed.groupBy("event_type").agg(at(0.5).alias("p50"), at(0.95).alias("p95"))


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events per hour and type, by a watermarked stream over the event files."""
    return ingest.windowed_counts(spark, d, "events.parquet", EVENTS, "ts", "event_type", "1 hour", "2 hours")


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    """Events by type after a stream that takes each event once."""
    rows = ingest.deduplicated_stream(spark, d, "events.parquet", EVENTS, "event_id", "ts", "1 day")
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.round(F.avg("value"), 6).alias("mean_value"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k_sum"))


def user_state(spark: SparkSession, d: str) -> DataFrame:
    """The last event of every user: type, time and number of events so far."""
    rows = table(spark, d, "events").where("user_id is not null")
    last = F.max(F.struct("ts", "event_id", "event_type")).alias("last")
    return rows.groupBy("user_id").agg(last, F.count(F.lit(1)).alias("events")).select("user_id", F.col("last.event_type").alias("event_type"), F.col("last.event_id").alias("event_id"), "events")


def queries() -> dict[str, Query]:
    own = (
        hybrid_retrieval, dense_search, bm25_search, bm25_statistics, search_token_counts, vector_labels, title_relevance, catalog_latest, catalog_upsert, catalog_allowed, catalog_formats,
        hash_split, split_leakage, capped_selection, round_robin_subset, group_signatures, revision_components, element_counts, element_eligibility, location_violations, heading_runs,
        adjacent_elements, visual_context, ordinal_contiguity, packed_chunks, element_pieces, text_length_stats, version_audit, processing_summary, page_headings, evidence_mapping,
        missing_references, evidence_status, term_coverage, retrieval_metrics, metrics_by_type, gold_violations, document_titles, table_rows, paragraph_counts, source_distinct,
        event_windows, event_stream, user_state, heading_sections, heading_paths, text_paragraphs, html_table_rows, secret_scan, content_hashes, catalog_duplicates, catalog_page, document_set_audit,
        section_page_span, title_categories, context_budget, event_percentiles,
    )
    return {q.__name__: q for q in own}
