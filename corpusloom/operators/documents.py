"""Operators on whole documents: sections, paragraphs, tables, hashes, pattern scans, bounded contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def lines_of(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, line_no, line``: every line of every text, numbered from 1; null texts have none."""
    return documents.select(key, F.posexplode(F.split(text, "\n")).alias("at", "line")).select(key, (F.col("at") + 1).alias("line_no"), "line")


def heading_sections(documents: DataFrame) -> DataFrame:
    """``doc_id, section_no, level, title, line_start, line_end``: Markdown sections; headings in code fences don't count.

    Text before the first heading is section 0 of level 0 without title. A fence toggles by a running sum, sections
    are runs between headings.
    """
    place = Window.partitionBy("doc_id").orderBy("line_no")
    before = place.rowsBetween(Window.unboundedPreceding, -1)
    lines = lines_of(documents)
    fence = F.ltrim("line").startswith("```").cast("int")
    fenced = lines.withColumn("fence", fence).withColumn("open", F.coalesce(F.sum("fence").over(before), F.lit(0)) % 2)
    heading = (F.col("open") == 0) & F.col("line").rlike(r"^#{1,6}[ \t]+\S")
    marked = fenced.withColumn("heading", heading.cast("int")).withColumn("section_no", F.sum("heading").over(place.rowsBetween(Window.unboundedPreceding, 0)))
    level = F.when(F.col("heading") == 1, F.length(F.regexp_extract("line", r"^(#+)", 1)))
    title = F.when(F.col("heading") == 1, F.trim(F.regexp_extract("line", r"^#+[ \t]+(.*)$", 1)))
    return marked.groupBy("doc_id", "section_no").agg(
        F.coalesce(F.max(level), F.lit(0)).alias("level"), F.max(title).alias("title"), F.min("line_no").alias("line_start"), F.max("line_no").alias("line_end")
    )


def heading_paths(sections: DataFrame) -> DataFrame:
    """``doc_id, section_no, heading_path``: each section of ``heading_sections`` with the titles it stands under, its own last.

    A title of a level holds until the next heading of the same or a higher level. Text before the first heading has no
    row. The window runs over the headings of one document.
    """
    upto = Window.partitionBy("doc_id").orderBy("section_no").rowsBetween(Window.unboundedPreceding, 0)
    parts = []
    for level in range(1, 7):
        own = F.last(F.when(F.col("level") == level, F.struct("section_no", "title")), ignorenulls=True).over(upto)
        above = F.coalesce(F.max(F.when(F.col("level") < level, F.col("section_no"))).over(upto), F.lit(0))
        parts.append(F.when(own["section_no"] > above, own["title"]))
    return sections.where("level > 0").select("doc_id", "section_no", F.array_join(F.array_compact(F.array(*parts)), " > ").alias("heading_path"))


def text_paragraphs(documents: DataFrame) -> DataFrame:
    """``doc_id, paragraph_no, line_start, line_end, characters``: runs of lines that aren't blank, gaps and islands."""
    place = Window.partitionBy("doc_id").orderBy("line_no")
    lines = lines_of(documents).withColumn("blank", (F.trim("line") == "").cast("int"))
    fresh = (F.col("blank") == 0) & (F.coalesce(F.lag("blank").over(place), F.lit(1)) == 1)
    runs = lines.withColumn("paragraph_no", F.sum(fresh.cast("int")).over(place)).where("blank = 0")
    return runs.groupBy("doc_id", "paragraph_no").agg(F.min("line_no").alias("line_start"), F.max("line_no").alias("line_end"), F.sum(F.length("line")).alias("characters"))


def html_rows(documents: DataFrame) -> DataFrame:
    """``doc_id, row_no, cells, first_cell`` of the HTML table rows in the texts; tags may have attributes."""
    rows = documents.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?is)<tr(?:\s[^>]*)?>(.*?)</tr>"), F.lit(1))).alias("at", "row"))
    cells = F.regexp_extract_all("row", F.lit(r"(?is)<t[dh](?:\s[^>]*)?>(.*?)</t[dh]>"), F.lit(1))
    return rows.select("doc_id", (F.col("at") + 1).alias("row_no"), F.size(cells).alias("cells"), F.when(F.size(cells) > 0, F.element_at(cells, 1)).alias("first_cell"))


def pattern_hits(documents: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """``doc_id, pattern, hits``: how often each named pattern stands in a text; only where it does."""
    counted = F.array(*[F.struct(F.lit(n).alias("pattern"), F.regexp_count("text", F.lit(p)).alias("hits")) for n, p in sorted(patterns.items())])
    return documents.select("doc_id", F.explode(counted).alias("c")).select("doc_id", "c.pattern", "c.hits").where("hits > 0")


def bounded_context(results: DataFrame, texts: DataFrame, budget: int) -> DataFrame:
    """``query_id, rank, doc_id, used, cut``: characters that each ranked text puts into a context of ``budget`` per query.

    A running sum over the ranks; the last text that fits in part is cut, later ones are left out, and so are blank ones.
    """
    sized = results.join(texts.select("doc_id", F.length(F.trim("text")).alias("size")), "doc_id").where("size > 0")
    before = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    taken = sized.withColumn("room", F.lit(budget) - F.coalesce(F.sum("size").over(before), F.lit(0))).where("room > 0")
    return taken.select("query_id", "rank", "doc_id", F.least("size", "room").alias("used"), (F.col("size") > F.col("room")).alias("cut"))
