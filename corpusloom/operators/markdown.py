"""Markdown documents to elements, with their headings, images and places in the source; cleaning; image references and links."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARSER = "markdown-blocks-1"
FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
UNDERLINE = re.compile(r" {0,3}(=+|-+)[ \t]*$")
RULE = re.compile(r" {0,3}([-*_])[ \t]*(?:\1[ \t]*){2,}$")
SEPARATOR = re.compile(r" {0,3}(?=[^|]*\||\|)\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
ITEM = re.compile(r"\s*(?:>|[-*+](?=\s)|\d{1,9}[.)](?=\s))")
HTML = re.compile(r" {0,3}<(?:/?[A-Za-z][\w-]*(?:[\s/>]|$)|!--)")
IMAGE = re.compile(r"!\[([^\]]*)\]\(\s*<?([^)\s>]+)>?(?:\s[^)]*)?\)")
#: An image as Markdown or HTML; the target is in the second or third group.
IMAGE_REFERENCE = r"""!\[([^\]]*)\]\(([^)\s]+)[^)]*\)|<img[^>]+src=["']([^"']+)["']"""
LINK = r"\]\(/?([^)#\s]+\.md)(?:#[^)]*)?\)"
CODE_SPAN = r"((`+)[\s\S]*?\2)"
ELEMENT = "array<struct<kind: string, line_start: int, line_end: int, heading_path: array<string>, image_ref: string>>"


def body_start(lines: list[str]) -> int:
    """The number of lines that a front matter between two ``---`` lines takes; 0 without one or without its end."""
    if lines[0].lstrip("﻿").strip() != "---":
        return 0
    return next((i + 1 for i in range(1, len(lines)) if lines[i].strip() == "---"), 0)


def block_end(lines: list[str], at: int) -> tuple[str, int]:
    """The kind of the block that begins at line ``at``, which isn't blank, and the line after its last one."""
    line, n = lines[at], len(lines)
    fence = FENCE.match(line)
    if fence:
        closing = re.compile(rf" {{0,3}}{fence[1][0]}{{{len(fence[1])},}}[ \t]*$")
        return "code", next((i + 1 for i in range(at + 1, n) if closing.match(lines[i])), n)
    if HEADING.match(line):
        return "heading", at + 1
    if RULE.match(line):
        return "rule", at + 1
    if "|" in line and at + 1 < n and SEPARATOR.match(lines[at + 1]):
        return "table", next((i for i in range(at + 2, n) if "|" not in lines[i]), n)
    blank = next((i for i in range(at, n) if not lines[i].strip()), n)
    if HTML.match(line):
        return "text", blank
    if line.startswith(("    ", "\t")):
        end = next((i for i in range(at, n) if lines[i].strip() and not lines[i].startswith(("    ", "\t"))), n)
        while not lines[end - 1].strip():
            end -= 1
        return "code", end
    for i in range(at + 1, blank):
        if UNDERLINE.match(lines[i]) and not ITEM.match(line):
            return "heading", i + 1
        if FENCE.match(lines[i]) or HEADING.match(lines[i]) or RULE.match(lines[i]) or ITEM.match(lines[i]):
            return "text", i
    return "text", blank


def blocks(text: str) -> list[tuple[str, int, int, list[str], str | None]]:
    """Elements of a Markdown text: kind, first and last line from 1, heading path, image."""
    lines = text.split("\n")
    at, stack, found = body_start(lines), [], []
    while at < len(lines):
        if not lines[at].strip():
            at += 1
            continue
        kind, end = block_end(lines, at)
        if kind == "heading":
            mark = HEADING.match(lines[at])
            level = len(mark[1]) if mark else 1 if "=" in lines[end - 1] else 2
            title = (mark[2] or "") if mark else " ".join(x.strip() for x in lines[at : end - 1])
            stack = [*(h for h in stack if h[0] < level), (level, title.strip())]
        path = [title for _, title in stack]
        images = [m[2] for m in IMAGE.finditer("\n".join(lines[at:end]))] if kind == "text" else []
        if kind != "rule" and (not images or IMAGE.sub("", "\n".join(lines[at:end])).strip()):
            found.append((kind, at + 1, end, path, None))
        found += [("image", at + 1, end, path, image) for image in images]
        at = end
    return found


def line_range(text: Column, start: Column, end: Column) -> Column:
    """The lines ``start`` to ``end``, from 1 and inclusive, of a text as they stand there."""
    return F.array_join(F.slice(F.split(text, "\n"), start, end - start + 1), "\n")


def markdown_elements(documents: DataFrame) -> DataFrame:
    """``doc_id, element_no, element_id, kind, line_start, line_end, heading_path, image_ref, raw_text``.

    Headings (underlined ones too), tables, code, text and images, in order; list items and quotes are texts of their
    own. A front matter gives nothing, but its lines count. A paragraph of images only gives the images alone. Lines
    end at line feeds. Null and blank texts give no rows. One row's own work, in Arrow batches, without a shuffle.
    """

    @F.pandas_udf(ELEMENT)
    def parse(texts: pd.Series) -> pd.Series:
        names = ("kind", "line_start", "line_end", "heading_path", "image_ref")
        return pd.Series([[dict(zip(names, b, strict=True)) for b in blocks(t)] if t else [] for t in texts])

    rows = documents.select("doc_id", "text", F.posexplode(parse(F.col("text"))).alias("element_no", "e"))
    identity = F.concat_ws(":", F.col("doc_id").cast("string"), F.lit(PARSER), "element_no", "e.kind", F.col("e.line_start") - 1, "e.line_end", F.coalesce("e.image_ref", F.lit("None")))
    return rows.select(
        "doc_id", "element_no", F.concat(F.lit("el_"), F.substring(F.sha2(identity, 256), 1, 24)).alias("element_id"), "e.kind", "e.line_start", "e.line_end",
        F.array_join("e.heading_path", " / ").alias("heading_path"), "e.image_ref", line_range(F.col("text"), F.col("e.line_start"), F.col("e.line_end")).alias("raw_text"),
    )


def source_mismatches(elements: DataFrame, documents: DataFrame) -> DataFrame:
    """``doc_id, element_no`` of elements that aren't, character by character, the lines of the document they name."""
    there = documents.select("doc_id", "text")
    same = line_range(F.col("text"), F.col("line_start"), F.col("line_end")) == F.col("raw_text")
    return elements.join(there, "doc_id", "left").where(~F.coalesce(same & (F.col("line_start") >= 1) & (F.col("line_start") <= F.col("line_end")), F.lit(False))).select("doc_id", "element_no")


def clean_markdown(text: Column) -> Column:
    """A text without comments, tags, bold marks and link targets; what stands between backticks stays as it is."""
    marks = F.regexp_replace(text, CODE_SPAN + r"|<!--[\s\S]*?-->|<[^>]+>|\*\*", "$1")
    return F.trim(F.regexp_replace(marks, CODE_SPAN + r"|!?\[([^\]]+)\]\([^)]+\)", "$1$3"))


def image_references(documents: DataFrame) -> DataFrame:
    """``doc_id, reference_no, line_no, alt, target`` of the images that the texts refer to, in order.

    The line is that of the reference's beginning: one more than the line feeds before it.
    """
    parts, whole = F.split("text", IMAGE_REFERENCE), F.regexp_extract_all("text", F.lit(IMAGE_REFERENCE), F.lit(0))
    rows = documents.select("doc_id", parts.alias("parts"), whole.alias("all"), F.posexplode(whole).alias("at", "whole"))
    before = F.concat(F.array_join(F.slice("parts", 1, F.col("at") + 1), ""), F.array_join(F.slice("all", 1, F.col("at")), ""))
    group = lambda n: F.nullif(F.regexp_extract("whole", IMAGE_REFERENCE, n), F.lit(""))
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    return rows.select("doc_id", (F.col("at") + 1).alias("reference_no"), line.alias("line_no"), F.coalesce(group(1), F.lit("")).alias("alt"), F.coalesce(group(2), group(3)).alias("target"))


def linked_paths(documents: DataFrame) -> DataFrame:
    """``doc_id, path``: Markdown files that a text links to, each once."""
    return documents.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(LINK), F.lit(1)))).alias("path"))
