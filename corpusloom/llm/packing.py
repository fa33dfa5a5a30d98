"""Problem 6: filling containers of fixed capacity with documents, measured in tokens of a public tokenizer.

Hierarchical residual packing: every partition packs its items best-fit decreasing, bins that are nearly full are
emitted, and the underfull ones go on as items of the next, smaller round. What counts as nearly full falls from
round to round; at half full a task hands on one bin at most, so the rounds end with a single small task.
"""

from __future__ import annotations

import base64
import bisect
import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.session import cut_lineage

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of the rank file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Items that one task packs; further tasks are added beyond it.
ITEMS_PER_TASK = 25_000
#: Fill from which a bin is emitted, by round; the last value holds for all later rounds.
NEARLY_FULL = (0.995, 0.98, 0.95, 0.9, 0.75, 0.5)


@functools.cache
def encoding(path: str):
    """The tokenizer of a rank file, read once per Python worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, tokenizer: str = TOKENIZER) -> Column:
    """Tokens of the whole ``text``; 0 for null and for the empty text."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        encode = encoding(tokenizer).encode_ordinary
        return pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return count(text)


def pieces(sizes: DataFrame, capacities: DataFrame) -> DataFrame:
    """``plan_id, capacity, doc_id, piece_no, first_token, size``: whole documents, or pieces of those above capacity.

    Pieces of a document are numbered from 1 and are full but for the last; a document is one piece otherwise.
    Capacities are one row per plan; those that are null or below 1 are left out.
    """
    plans = capacities.where("plan_id is not null and capacity_tokens > 0").select("plan_id", F.col("capacity_tokens").alias("capacity"))
    each = sizes.withColumn("plan", F.explode(F.array(*[F.struct(F.lit(r[0]).alias("plan_id"), F.lit(r[1]).alias("capacity")) for r in plans.distinct().collect()])))
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("tokens") - 1, F.lit(0)), F.col("plan.capacity").cast("long")))
    return each.select("doc_id", "tokens", F.col("plan.plan_id").alias("plan_id"), F.col("plan.capacity").alias("capacity"), first.alias("first_token")).select(
        "plan_id", "capacity", "doc_id",
        (F.col("first_token") / F.col("capacity")).cast("int").alias("offset_no"), "first_token",
        F.least(F.col("tokens") - F.col("first_token"), F.col("capacity").cast("long")).alias("size"),
    ).withColumn("piece_no", F.col("offset_no") + 1).drop("offset_no")


def best_fit(sizes: list[int], capacity: int, full: int) -> list[int]:
    """A bin number for each size, largest sizes first, each into the fullest bin that holds it.

    Bins with no more than ``capacity - full`` free take no further item but empty ones.
    """
    open_bins: list[tuple[int, int]] = []  # free, bin
    bins = [0] * len(sizes)
    used = 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = bisect.bisect_left(open_bins, (sizes[i], -1))
        if at < len(open_bins):
            free, number = open_bins.pop(at)
        else:
            free, number = capacity, used
            used += 1
        bins[i] = number
        free -= sizes[i]
        if free > 0:
            bisect.insort(open_bins, (free, number))
    return bins


ROUND = T.StructType(
    [
        T.StructField("plan_id", T.IntegerType()),
        T.StructField("capacity", T.IntegerType()),
        T.StructField("item", T.StringType()),
        T.StructField("bin", T.StringType()),
        T.StructField("load", T.LongType()),
        T.StructField("emitted", T.BooleanType()),
    ]
)


def packing_round(items: DataFrame, tasks: int, fill: float) -> DataFrame:
    """One best-fit round over ``plan_id, capacity, item, size``; a bin is named by its smallest item."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [b for b in batches if len(b)]
        if not rows:
            return
        for (plan, capacity), own in pd.concat(rows).sort_values(["size", "item"], ascending=[False, True]).groupby(["plan_id", "capacity"], sort=True):
            own = own.assign(number=best_fit(own["size"].tolist(), int(capacity), 0))
            by = own.groupby("number")
            own["bin"] = by["item"].transform("min")
            own["load"] = by["size"].transform("sum")
            own["emitted"] = own["load"] >= fill * capacity
            yield own[["plan_id", "capacity", "item", "bin", "load", "emitted"]]

    return items.repartition(tasks, F.xxhash64("item")).mapInPandas(pack, ROUND)


def pack(items: DataFrame, items_per_task: int = ITEMS_PER_TASK, nearly_full: tuple[float, ...] = NEARLY_FULL) -> DataFrame:
    """``plan_id, item, container``: every item of ``plan_id, capacity, item, size`` in one container.

    ``size`` may be 0 but not above ``capacity``; ``item`` is unique within its plan. A task holds the numbers of
    at most about ``items_per_task`` items. The result depends on the items and ``items_per_task`` alone.
    """
    levels = []
    left = items.count()
    while left:
        tasks = -(-left // items_per_task)
        fill = nearly_full[min(len(levels), len(nearly_full) - 1)]
        done = tasks == 1 and fill <= 0.5
        level = cut_lineage(packing_round(items, tasks, 0.0 if done else fill))
        levels.append(level)
        items = level.where("not emitted").groupBy("plan_id", "capacity", "bin").agg(F.first("load").alias("size")).withColumnRenamed("bin", "item")
        left = items.count()
    if not levels:
        return items.select("plan_id", "item", F.col("item").alias("container"))
    placed = levels[-1].select("plan_id", "item", F.col("bin").alias("container"))
    for level in reversed(levels[:-1]):
        later = placed.select("plan_id", F.col("item").alias("bin"), "container")
        placed = level.join(later, ["plan_id", "bin"], "left").select("plan_id", "item", F.coalesce("container", "bin").alias("container"))
    return placed


def fill_containers(documents: DataFrame, capacities: DataFrame, tokenizer: str = TOKENIZER, items_per_task: int = ITEMS_PER_TASK) -> DataFrame:
    """``plan_id, container_id, doc_id, piece_no, first_token, tokens``: what lies in which container.

    Every document is whole in one container of each plan unless it alone exceeds the capacity; then its full
    pieces fill containers of their own and the rest is packed as an item. Null and empty texts count 0 tokens and
    lie in some container too. Rows without ``doc_id`` are left out; repeated ``doc_id`` rows count once.
    """
    sizes = documents.where("doc_id is not null").select("doc_id", token_count(F.col("text"), tokenizer).alias("tokens"))
    sizes = cut_lineage(sizes.groupBy("doc_id").agg(F.max("tokens").alias("tokens")))
    if capacities.where("plan_id is not null and capacity_tokens > 0").isEmpty():
        return sizes.limit(0).select(F.lit(0).alias("plan_id"), F.lit("").alias("container_id"), "doc_id", F.lit(0).alias("piece_no"), F.lit(0).cast("long").alias("first_token"), "tokens")
    cut = cut_lineage(pieces(sizes, capacities).withColumn("item", F.concat_ws("-", "doc_id", "piece_no")))
    loose = cut.where("size < capacity").select(F.col("plan_id").cast("int"), F.col("capacity").cast("int"), "item", "size")
    placed = pack(loose, items_per_task)
    return cut.join(placed, ["plan_id", "item"], "left").select(
        "plan_id", F.coalesce("container", "item").alias("container_id"), "doc_id", "piece_no", "first_token", F.col("size").alias("tokens")
    )


def container_fill(placed: DataFrame, capacities: DataFrame) -> DataFrame:
    """``plan_id, capacity_tokens, containers, tokens, fullest, fill``: how well each plan's containers are filled."""
    loads = placed.groupBy("plan_id", "container_id").agg(F.sum("tokens").alias("load"))
    plans = loads.groupBy("plan_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("load").alias("tokens"), F.max("load").alias("fullest"))
    return plans.join(capacities.select("plan_id", "capacity_tokens").distinct(), "plan_id").select(
        "plan_id", "capacity_tokens", "containers", "tokens", "fullest", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("fill")
    )
