"""Operators on parsed elements: latest rows, heading runs, neighbours, context, chunks, validation."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(rows: DataFrame, key: str, order: str = "loaded_at") -> DataFrame:
    """One row per ``key``, the one with the largest ``order``; partial aggregation, so a hot key is no single task's load.

    Rows without key are left out. Of equally late rows the largest in column order is kept.
    """
    others = [c for c in rows.columns if c not in (key, order)]
    best = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(order, *others)).alias("r"))
    return best.select(key, *[F.col("r")[c].alias(c) for c in (order, *others)])


def clean_text(text: Column) -> Column:
    """Text without outer white space; blank becomes null."""
    plain = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return F.when(plain != "", plain)


def eligibility(elements: DataFrame) -> DataFrame:
    """``element_id, index_eligible, excluded_reason``: an element is indexed if it has text or an image."""
    has = clean_text(F.col("raw_text")).isNotNull() | F.col("image_ref").isNotNull()
    return elements.select("element_id", has.alias("index_eligible"), F.when(~has, "empty_element").alias("excluded_reason"))


def location_violations(elements: DataFrame) -> DataFrame:
    """``element_id, error_code`` of elements whose source location contradicts itself."""
    s = F.col("source")
    box = s["bbox"]
    inside = (box["x0"] >= 0) & (box["x0"] < box["x1"]) & (box["x1"] <= 1) & (box["y0"] >= 0) & (box["y0"] < box["y1"]) & (box["y1"] <= 1)
    code = (
        F.when(s.isNull() | ~F.coalesce(s["kind"].isin("text", "pdf", "image"), F.lit(False)), "location_kind")
        .when((s["kind"] == "pdf") & (s["page_number"].isNull() | (s["page_number"] < 1)), "location_page")
        .when((s["kind"] == "text") & (s["line_start"].isNull() | s["line_end"].isNull() | (s["line_start"] < 1) | (s["line_end"] < s["line_start"])), "location_lines")
        .when((s["precision_level"] == "region") & box.isNull(), "location_region")
        .when(box.isNotNull() & ~F.coalesce(inside, F.lit(False)), "location_box")
    )
    return elements.select("element_id", code.alias("error_code")).where("error_code is not null")


def heading_runs(elements: DataFrame) -> DataFrame:
    """``processing_version_id, run_no, first_ordinal, last_ordinal, elements, characters``: runs of equal heading paths.

    Gaps and islands over the ordinals of each version; null paths count as empty.
    """
    order = Window.partitionBy("processing_version_id").orderBy("ordinal", "element_id")
    path = F.coalesce(F.array_join("heading_path", "\x1f", "\x00"), F.lit(""))
    marked = elements.withColumn("path", path).withColumn("new", F.coalesce((F.lag("path").over(order) != F.col("path")).cast("int"), F.lit(1)))
    runs = marked.withColumn("run_no", F.sum("new").over(order))
    return runs.groupBy("processing_version_id", "run_no").agg(
        F.min("ordinal").alias("first_ordinal"), F.max("ordinal").alias("last_ordinal"), F.count(F.lit(1)).alias("elements"),
        F.sum(F.length(F.coalesce("raw_text", F.lit("")))).alias("characters"),
    )


def neighbours(elements: DataFrame, anchors: DataFrame, radius: int) -> DataFrame:
    """``element_id, neighbour_id, distance``: elements within ``radius`` ordinals of an anchor under the same heading.

    An equi-join on version, heading and ordinal: each anchor asks for its 2 x radius places, so no range join.
    """
    keys = ["processing_version_id", "path", "ordinal"]
    path = F.coalesce(F.array_join("heading_path", "\x1f", "\x00"), F.lit(""))
    offsets = F.explode(F.array(*[F.lit(d) for d in range(-radius, radius + 1) if d]))
    asked = anchors.select("element_id", "processing_version_id", path.alias("path"), F.col("ordinal").alias("at"), offsets.alias("d"))
    asked = asked.select("element_id", "processing_version_id", "path", (F.col("at") + F.col("d")).alias("ordinal"), F.abs("d").alias("distance"))
    there = elements.select(F.col("element_id").alias("neighbour_id"), "processing_version_id", path.alias("path"), "ordinal")
    return asked.join(there, keys).select("element_id", "neighbour_id", "distance")


def image_context(elements: DataFrame) -> DataFrame:
    """``element_id, context``: for each image the last non-empty text before it in its version, or null."""
    before = Window.partitionBy("processing_version_id").orderBy("ordinal", "element_id").rowsBetween(Window.unboundedPreceding, -1)
    text = F.when((F.col("kind") != "image") & (F.col("raw_text") != ""), F.col("raw_text"))
    return elements.withColumn("context", F.last(text, ignorenulls=True).over(before)).where("kind = 'image'").select("element_id", "context")


def ordinal_gaps(elements: DataFrame) -> DataFrame:
    """``processing_version_id, elements, contiguous``: whether the ordinals of a version run 0, 1, 2 and so on."""
    return elements.groupBy("processing_version_id").agg(
        F.count(F.lit(1)).alias("elements"), ((F.min("ordinal") == 0) & (F.max("ordinal") == F.count(F.lit(1)) - 1) & (F.countDistinct("ordinal") == F.count(F.lit(1)))).alias("contiguous")
    )


#: The characters after which a text may be cut.
CUT_AFTER = ("\n", "。", "；", " ")


def split_text(text: str, limit: int, overlap: int) -> list[str]:
    """Pieces of at most ``limit`` characters that overlap by ``overlap``; cut after a mark in the second half, if any."""
    text = text.strip()
    pieces, start = [], 0
    while start < len(text):
        end = start + limit
        if end < len(text):
            mark = max(text.rfind(m, start, end) for m in CUT_AFTER)
            end = mark + 1 if mark > start + limit // 2 else end
        pieces.append(text[start:end].strip())
        start = len(text) if end >= len(text) else max(end - overlap, start + 1)
    return [p for p in pieces if p]


def text_pieces(texts: DataFrame, key: str, text: str, limit: int = 1200, overlap: int = 160) -> DataFrame:
    """``key, piece_no, piece``: every text cut into overlapping pieces, in Arrow batches. Null and blank texts give none."""

    @F.pandas_udf("array<string>")
    def pieces(texts: pd.Series) -> pd.Series:
        return pd.Series([split_text(t, limit, overlap) if t else [] for t in texts])

    return texts.select(key, F.posexplode(pieces(F.col(text))).alias("at", "piece")).select(key, (F.col("at") + 1).alias("piece_no"), "piece")


def chunk_numbers(sizes: list[int], runs: list[int], paths: list[str], limit: int, least: int) -> list[int]:
    """The chunk, from 0, of every piece: a run's pieces fill chunks in order, joined by one character each.

    A run's last chunk below ``least`` goes into the chunk before it, if that has the same path and room.
    """
    numbers: list[int] = []
    filled: list[int] = []
    path_of: list[str] = []
    for at, size in enumerate(sizes):
        fresh = at == 0 or runs[at] != runs[at - 1]
        if fresh or filled[-1] + 1 + size > limit:
            filled.append(size)
            path_of.append(paths[at])
        else:
            filled[-1] += 1 + size
        numbers.append(len(filled) - 1)
        ends = at + 1 == len(sizes) or runs[at + 1] != runs[at]
        if ends and len(filled) > 1 and filled[-1] < least and path_of[-1] == path_of[-2] and filled[-2] + 1 + filled[-1] <= limit:
            tail = len(filled) - 1
            numbers = [min(n, tail - 1) for n in numbers]
            filled[-2] += 1 + filled.pop()
            path_of.pop()
    return numbers


def packed_chunks(elements: DataFrame, limit: int = 1200, overlap: int = 160, least: int = 100) -> DataFrame:
    """``processing_version_id, ordinal, chunk_id, heading_path, element_ids, characters, text``: elements packed into chunks.

    Texts longer than ``limit`` are cut into overlapping pieces first; the pieces of one heading run are joined by line
    ends as long as ``limit`` holds, so no chunk is longer and none crosses a heading; a short last chunk joins the one
    before. ``element_ids`` has one id for each piece. Blank elements give nothing but still part runs. The packing
    of a version is sequential, so a version is one group; its order and runs come from one window on the same key.
    """
    order = Window.partitionBy("processing_version_id").orderBy("ordinal", "element_id")
    path = F.coalesce(F.array_join("heading_path", "\x1f", "\x00"), F.lit(""))
    fresh = F.coalesce((F.lag("path").over(order) != F.col("path")).cast("int"), F.lit(1))
    rows = elements.select("processing_version_id", "ordinal", "element_id", "heading_path", path.alias("path"), "raw_text").withColumn("new", fresh)
    kept = rows.withColumn("run_no", F.sum("new").over(order)).where(clean_text(F.col("raw_text")).isNotNull()).drop("new")

    def pack(version: pd.DataFrame) -> pd.DataFrame:
        version = version.sort_values(["ordinal", "element_id"], na_position="first")
        pieces = version.assign(piece=[split_text(t, limit, overlap) for t in version["raw_text"]]).explode("piece").dropna(subset="piece")
        pieces["chunk"] = chunk_numbers([len(p) for p in pieces["piece"]], list(pieces["run_no"]), list(pieces["path"]), limit, least)
        out = []
        for at, part in pieces.groupby("chunk"):
            first, text = part.iloc[0], "\n".join(part["piece"])
            digest = hashlib.sha256(f"{first['processing_version_id']}:{at}:{text}".encode()).hexdigest()[:32]
            out.append((first["processing_version_id"], at, "chk_" + digest, first["heading_path"], list(part["element_id"]), len(text), text))
        return pd.DataFrame(out, columns=["processing_version_id", "ordinal", "chunk_id", "heading_path", "element_ids", "characters", "text"])

    schema = "processing_version_id string, ordinal int, chunk_id string, heading_path array<string>, element_ids array<string>, characters int, text string"
    return kept.groupBy("processing_version_id").applyInPandas(pack, schema)
