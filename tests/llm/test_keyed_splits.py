"""Splits that keep related records together."""

from __future__ import annotations

import itertools
import random

from corpusloom.llm import keyed_splits

SCHEMA = "document_id string, group_id string, source_family string, sha256 string, split string, component_id string"


def test_ties_through_other_rows_and_placeholders(spark):
    rows = [
        ("a", "G1", None, "h1", "train", "-"), ("b", " g1\t", "f9", "h2", "TRAIN ", "-"), ("c", "unknown", "F9", "h3", "dev", "-"), ("d", "unknown", "未知", None, "test", "-"),
        ("e", None, "n/a", None, None, "-"), ("d", None, None, None, "test", "-"), (None, "g1", None, None, "test", "-"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    parts = {r.document_id: r.component_id for r in keyed_splits.related_documents(df).collect()}
    assert parts == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e"}
    assert {tuple(r) for r in keyed_splits.torn_components(df).collect()} == {("a", "a"), ("b", "a"), ("c", "a")}


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert keyed_splits.torn_components(empty).count() == 0
    targets = spark.createDataFrame([("train", 0.8), ("dev", 0.2)], "split_name string, share double")
    assert keyed_splits.assign_splits(empty, targets).count() == 0


def test_hot_group_is_one_component(spark):
    rows = [(f"d{i:04}", "hot", None, f"h{i}", "train", None) for i in range(400)] + [("z", None, "f", None, "dev", None)]
    parts = keyed_splits.related_documents(spark.createDataFrame(rows, SCHEMA))
    assert {tuple(r) for r in parts.groupBy("component_id").count().collect()} == {("d0000", 400), ("z", 1)}


def test_closest_totals_like_brute_force():
    rng = random.Random(5)
    for _ in range(40):
        sizes = sorted({rng.randint(1, 12): rng.randint(1, 3) for _ in range(4)}.items())
        wanted = rng.randint(0, sum(s * n for s, n in sizes))
        taken = keyed_splits.closest_counts(sizes, wanted)
        assert all(taken.get(s, 0) <= n for s, n in sizes)
        best = min(abs(wanted - sum(k * s for k, (s, _) in zip(ks, sizes, strict=True))) for ks in itertools.product(*[range(n + 1) for _, n in sizes]))
        assert abs(wanted - sum(s * n for s, n in taken.items())) == best


def test_coarse_units_still_come_close():
    sizes = [(1, 50_000), (7, 2_000), (1_000, 9)]
    taken = keyed_splits.closest_counts(sizes, 10_000, max_units=1 << 12)
    assert abs(10_000 - sum(s * n for s, n in taken.items())) < 500


def test_assignment_keeps_components_whole(spark):
    rows = [(f"d{i}", f"g{i // 3}", None, None, None, None) for i in range(90)] + [(f"s{i}", None, None, None, None, None) for i in range(110)]
    targets = spark.createDataFrame([("train", 0.8), ("dev", 0.1), ("test", 0.1), (None, 0.5), ("none", None)], "split_name string, share double")
    placed = keyed_splits.assign_splits(spark.createDataFrame(rows, SCHEMA), targets)
    assert {r[0]: r[1] for r in placed.groupBy("split_name").count().collect()} == {"train": 160, "dev": 20, "test": 20}
    assert placed.select("component_id", "split_name").distinct().count() == placed.select("component_id").distinct().count()
    assert placed.count() == 200
