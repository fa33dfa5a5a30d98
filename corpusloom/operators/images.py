"""Image evidence: where the assets lie, which can be shown, which fit a question, and a varied choice of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.text import search_bigrams

#: File name endings of images that can be shown.
SHOWN = ("png", "jpg", "jpeg")
#: A lead of this much over the second image, at this score at least, leaves the first alone.
STRONG, MARGIN = 8.0, 2.5


def asset_path(source_path: Column, image_ref: Column) -> Column:
    """The path of an image beside its source, or from the root if it begins with a slash."""
    folder = F.regexp_extract(source_path, r"^(.*/)[^/]*$", 1)
    return F.when(image_ref.startswith("/"), F.ltrim(image_ref, F.lit("/"))).otherwise(F.concat(folder, image_ref))


def asset_status(image_ref: Column) -> Column:
    """Whether an image can be shown: ``external_or_invalid_reference``, ``unsafe_reference``, ``unsupported_image_format`` or ``ready``.

    The first that holds; null for null.
    """
    return (
        F.when(image_ref.isNull(), None).when(image_ref.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:|//)|[?#\\]"), "external_or_invalid_reference")
        .when(image_ref.rlike(r"(?:^|/)\.\.(?:/|$)"), "unsafe_reference").when(~F.lower(F.regexp_extract(image_ref, r"\.([^./]+)$", 1)).isin(*SHOWN), "unsupported_image_format").otherwise("ready")
    )


def first_assets(images: DataFrame) -> DataFrame:
    """``images`` with ``asset_path`` and ``status``; of those ready, only the first of a ``document_id`` that shows an asset.

    The first is that of the smallest ``ordinal``, then ``element_id``. Images that can't be shown all stay.
    """
    rows = images.withColumn("asset_path", asset_path(F.col("source_path"), F.col("image_ref"))).withColumn("status", asset_status(F.col("image_ref")))
    others = [c for c in rows.columns if c not in ("document_id", "asset_path", "ordinal", "element_id")]
    first = rows.where("status = 'ready'").groupBy("document_id", "asset_path").agg(F.min(F.struct("ordinal", "element_id", *others)).alias("r"))
    ready = first.select("document_id", "asset_path", "r.*").select(*rows.columns)
    return ready.unionByName(rows.where("status <> 'ready'"))


def interleaved(images: DataFrame, size: int) -> DataFrame:
    """``processing_version_id, element_id, place``: up to ``size`` images of each version, taken in turn from its sections.

    First the first image of every section in order, then all second ones. ``images`` has ``path``, the section.
    """
    within = Window.partitionBy("processing_version_id", "path").orderBy("ordinal", "element_id")
    rows = images.withColumn("depth", F.row_number().over(within)).withColumn("opens", F.first("ordinal").over(within)).where(F.col("depth") <= size)
    turn = Window.partitionBy("processing_version_id").orderBy("depth", "opens", "path")
    return rows.withColumn("place", F.row_number().over(turn)).where(F.col("place") <= size).select("processing_version_id", "element_id", "place")


def relevance(question: Column, own: Column, near: Column, around: Column) -> Column:
    """How well an image fits a question: terms shared with its ``own`` text, the text ``near`` and that ``around`` it.

    Latin words and numbers weigh more than pairs of Chinese characters; a label that the question quotes and the
    image's own text holds weighs most. Nulls count as empty.
    """
    asked = search_bigrams(question)

    def shared(text: Column, latin: float, other: float) -> Column:
        hits = F.array_intersect(asked, search_bigrams(text))
        named = F.size(F.filter(hits, lambda t: t.rlike(r"^[a-z0-9_.-]+$")))
        return named * latin + (F.size(hits) - named) * other

    quotes = F.filter(F.regexp_extract_all(F.lower(question), F.lit("[“'\"]([^”'\"]+)[”'\"]"), F.lit(1)), lambda q: F.length(F.trim(q)) >= 2)
    exact = F.size(F.filter(quotes, lambda q: F.contains(F.lower(own), q)))
    return F.round(shared(own, 3.0, 1.5) + shared(near, 2.5, 1.25) + shared(around, 1.0, 0.35) + 12.0 * F.greatest(exact, F.lit(0)), 4)


def selected(scored: DataFrame, size: int) -> DataFrame:
    """``query_id, element_id, score, place``: the ``size`` best images of a query, or the best alone if it leads clearly."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "ordinal", "element_id")
    rows = scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= max(size, 2))
    second = F.max(F.when(F.col("place") == 2, F.col("score"))).over(Window.partitionBy("query_id"))
    best = F.max(F.when(F.col("place") == 1, F.col("score"))).over(Window.partitionBy("query_id"))
    clear = (best >= STRONG) & (best - F.coalesce(second, F.lit(float("-inf"))) >= MARGIN)
    return rows.withColumn("keep", F.when(clear, 1).otherwise(size)).where("place <= keep").select("query_id", "element_id", "score", "place")
