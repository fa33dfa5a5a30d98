"""Problem 3: splits that keep related records together.

Rows that share a key value (also through other rows) form components. They are found by rounds of parallel
hooking and shortcutting over a parent table that is joined with the edges; each round contracts the edges to
the roots, so the edge table shrinks. Splits are then filled by subset sums: bitsets over the multiplicities of
component sizes give the reachable total closest to each wanted share.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.operators.components import connected_components
from corpusloom.operators.skew import spread_lookup
from corpusloom.session import cut_lineage

# Spellings that say that nothing is known; they link nothing.
PLACEHOLDERS = (
    "", "-", "--", "—", "?", "??", "？", ".", "/", "n/a", "na", "n.a.", "nan", "null", "nil", "none", "(none)", "unknown", "undefined",
    "unspecified", "not available", "not known", "missing", "empty", "tbd", "todo", "other", "xxx", "未知", "不明", "不详", "无", "空", "暂无", "待定", "未定",
)

#: Key columns of the catalogue that tie its documents.
KEYS = ("group_id", "source_family", "sha256")
#: Groups are cut into so many parts before their members are compared, so no part holds more than that share of a hot group.
SALTS = 64
#: Sizes of bitsets: totals beyond it are counted in units of total/MAX_UNITS.
MAX_UNITS = 1 << 20
#: Buckets per component size in which members are numbered.
RANK_BUCKETS = 256


def comparable(value: Column) -> Column:
    """``value`` trimmed of all white space and lower-cased; null where it says that nothing is known."""
    plain = F.lower(F.regexp_replace(value, r"(?U)^\s+|\s+$", ""))
    return F.when(~plain.isin(*PLACEHOLDERS), plain)


def key_edges(rows: DataFrame, node: str, keys: tuple[str, ...], salts: int = SALTS) -> DataFrame:
    """Edges ``a, b`` (``a`` before ``b``) that tie the nodes of equal key values, linear in the rows.

    Members of a value are tied to the smallest member of their salted part, and the parts' smallest members
    to the smallest of all. A window sees one part of a value, or one row per part.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), comparable(F.col(k)).alias("value")) for i, k in enumerate(keys)]))
    tied = (
        rows.select(node, pairs.alias("key"))
        .select(F.col(node).alias("b"), F.struct("key.kind", "key.value").alias("key"))
        .where("b is not null and key.value is not null")
        .withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(salts)))
        .groupBy("key", "salt", "b")
        .agg(F.lit(1).alias("one"))
    )
    parts = tied.withColumn("a", F.min("b").over(Window.partitionBy("key", "salt")))
    heads = tied.groupBy("key", "salt").agg(F.min("b").alias("b")).withColumn("a", F.min("b").over(Window.partitionBy("key")))
    return parts.select("a", "b").unionByName(heads.select("a", "b")).where("a < b").distinct()


def related_documents(rows: DataFrame, keys: tuple[str, ...] = KEYS, node: str = "document_id") -> DataFrame:
    """``document_id, component_id`` of every distinct document; ``component_id`` is the component's smallest id.

    Documents whose ids differ only in case or outer white space are one node. Rows without an id are left out.
    Documents that share nothing are components of their own.
    """
    ids = rows.where(comparable(F.col(node)).isNotNull()).select(comparable(F.col(node)).alias("node"), F.col(node).alias("document_id"), *keys)
    documents = cut_lineage(ids.groupBy("node", "document_id").agg(F.lit(1).alias("one")).drop("one"))
    components = cut_lineage(connected_components(key_edges(ids, "node", keys)))
    labelled = documents.join(components, "node", "left").select("document_id", F.coalesce("component", "node").alias("component"))
    names = labelled.groupBy("component").agg(F.min("document_id").alias("component_id"))
    return spread_lookup(labelled, names, "component").select("document_id", "component_id")


def torn_components(rows: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``document_id, component_id`` of all documents whose component carries more than one split."""
    components = cut_lineage(related_documents(rows, keys))
    carried = rows.select("document_id", comparable(F.col("split")).alias("split")).where("split is not null and document_id is not null").distinct()
    torn = (
        carried.join(components, "document_id")
        .groupBy("component_id")
        .agg(F.min("split").alias("first"), F.max("split").alias("last"))
        .where("first < last")
        .select("component_id")
    )
    return spread_lookup(components, torn, "component_id").select("document_id", "component_id")


def closest_counts(sizes: list[tuple[int, int]], wanted: int, max_units: int = MAX_UNITS) -> dict[int, int]:
    """How many components of each size to take so that their total is closest to ``wanted``.

    ``sizes`` holds (size, multiplicity). Multiplicities are cut into powers of two; a bitset of reachable totals
    is shifted by each. The first item to reach a total is kept, which gives the choice back. Of two equally near
    totals the smaller one is taken. Totals above ``max_units`` are counted in coarser units.
    """
    total = sum(s * n for s, n in sizes)
    unit = max(1, -(-total // max_units))
    goal = round(wanted / unit)
    items: list[tuple[int, int, int]] = []  # units, size, copies
    for size, n in sorted(sizes, reverse=True):
        step = 1
        while n > 0:
            copies = min(step, n)
            items.append((round(size * copies / unit), size, copies))
            n -= copies
            step *= 2
    top = 2 * goal + 1
    reached, mask = 1, (1 << (top + 1)) - 1
    first = np.full(top + 1, -1, dtype=np.int32)
    for i, (units, _, _) in enumerate(items):
        if not 0 < units <= top:
            continue
        new = (reached << units) & mask & ~reached
        if new:
            bits = np.unpackbits(np.frombuffer(new.to_bytes(top // 8 + 1, "little"), dtype=np.uint8), bitorder="little")
            first[np.flatnonzero(bits[: top + 1])] = i
            reached |= new
    near = next(t for d in range(top + 1) for t in (goal - d, goal + d) if 0 <= t <= top and reached >> t & 1)
    taken: dict[int, int] = {}
    while near > 0:
        units, size, copies = items[first[near]]
        taken[size] = taken.get(size, 0) + copies
        near -= units
    return taken


def split_quotas(sizes: list[tuple[int, int]], shares: list[tuple[str, float]], max_units: int = MAX_UNITS) -> list[tuple[int, str, int, int]]:
    """(size, split, first rank, last rank) of components, ranks from 1 within each size.

    The smallest share is filled first; the largest split takes what remains.
    """
    left = dict(sizes)
    at = dict.fromkeys(left, 0)
    total = sum(s * n for s, n in sizes)
    whole = sum(share for _, share in shares) or 1.0
    ordered = sorted(shares, key=lambda x: (x[1], x[0]))
    out = []
    for k, (name, share) in enumerate(ordered):
        rest = [(s, n) for s, n in left.items() if n]
        take = dict(rest) if k == len(ordered) - 1 else closest_counts(rest, round(total * share / whole), max_units)
        for size, n in take.items():
            out.append((size, name, at[size] + 1, at[size] + n))
            at[size] += n
            left[size] -= n
    return out


def assign_splits(rows: DataFrame, targets: DataFrame, keys: tuple[str, ...] = KEYS, max_units: int = MAX_UNITS) -> DataFrame:
    """``document_id, component_id, split_name``: whole components, totals as close to the shares as subset sums allow.

    Only the histogram of component sizes reaches the driver: distinct sizes number at most sqrt(2 x documents).
    Components of a size are numbered in hash order, in buckets, so that a common size is no single task's work.
    Null or negative shares count as none; without targets the result is empty.
    """
    shares = [(r[0], float(r[1])) for r in targets.where("split_name is not null and share > 0").select("split_name", "share").distinct().collect()]
    documents = cut_lineage(related_documents(rows, keys))
    schema = "component_size long, split_name string, first_rank long, last_rank long"
    components = cut_lineage(documents.groupBy("component_id").agg(F.count(F.lit(1)).alias("component_size")))
    sizes = [(r[0], r[1]) for r in components.groupBy("component_size").count().collect()]
    spark = rows.sparkSession
    quotas = spark.createDataFrame(split_quotas(sizes, shares, max_units) if shares else [], schema)
    placed = components.withColumn("bucket", F.pmod(F.xxhash64("component_id"), F.lit(RANK_BUCKETS)).cast("int"))
    counts = placed.groupBy("component_size", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("component_size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("component_size", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("component_size", "bucket").orderBy(F.xxhash64("component_id", F.lit(1)), "component_id")
    ranked = placed.join(offsets, ["component_size", "bucket"]).withColumn("rank", F.col("before") + F.row_number().over(inside))
    fits = (ranked["component_size"] == quotas["component_size"]) & ranked["rank"].between(quotas["first_rank"], quotas["last_rank"])
    chosen = ranked.join(F.broadcast(quotas), fits).select("component_id", "split_name")
    return spread_lookup(documents, chosen, "component_id").select("document_id", "component_id", "split_name")


def split_totals(assigned: DataFrame, targets: DataFrame) -> DataFrame:
    """``split_name, documents, components, share, target_share`` of an assignment; a split without documents counts 0."""
    pairs = assigned.groupBy("split_name", "component_id").agg(F.count(F.lit(1)).alias("n"))
    counts = pairs.groupBy("split_name").agg(F.sum("n").alias("documents"), F.count(F.lit(1)).alias("components"))
    documents = F.coalesce("documents", F.lit(0))
    total = F.sum(documents).over(Window.partitionBy(F.lit(0)))  # a row per split
    return (
        targets.select("split_name", F.col("share").alias("target_share"))
        .join(counts, "split_name", "left")
        .select(
            "split_name", documents.alias("documents"), F.coalesce("components", F.lit(0)).alias("components"),
            (documents / total).alias("share"), "target_share",
        )
    )
