"""Filling containers."""

from __future__ import annotations

import random

from corpusloom.llm import packing

CAPACITIES = "plan_id int, capacity_tokens int"


def test_best_fit_never_overfills_and_is_tight():
    rng = random.Random(2)
    sizes = [rng.randint(0, 50) for _ in range(500)]
    bins = packing.best_fit(sizes, 50, 0)
    loads = [0] * (max(bins) + 1)
    for size, number in zip(sizes, bins, strict=True):
        loads[number] += size
    assert max(loads) <= 50 and len(loads) <= -(-sum(sizes) // 50) * 1.1 + 1


def test_rounds_place_every_item_once(spark):
    rng = random.Random(4)
    items = [(1, 100, f"i{k}", rng.randint(0, 99)) for k in range(900)] + [(2, 40, f"i{k}", rng.randint(0, 39)) for k in range(300)]
    df = spark.createDataFrame(items, "plan_id int, capacity int, item string, size long")
    placed = packing.pack(df, items_per_task=60)  # far fewer than in production, so that there are several rounds
    assert placed.count() == placed.select("plan_id", "item").distinct().count() == 1200
    size = {(p, i): s for p, _, i, s in items}
    loads: dict = {}
    for p, i, c in placed.collect():
        loads[p, c] = loads.get((p, c), 0) + size[p, i]
    for plan, capacity in ((1, 100), (2, 40)):
        own = [v for (p, _), v in loads.items() if p == plan]
        assert max(own) <= capacity and sum(own) / (len(own) * capacity) > 0.85


def test_long_documents_are_cut_and_others_whole(spark):
    docs = [(1, "word " * 1000, None), (2, "short text", "x"), (3, None, "x"), (4, "", "x"), (None, "lost", "x"), (2, "short text", "x")]
    placed = packing.fill_containers(spark.createDataFrame(docs, "doc_id long, text string, container_id string"), spark.createDataFrame([(7, 300), (None, 5), (8, None)], CAPACITIES))
    rows = [tuple(r) for r in placed.orderBy("doc_id", "piece_no").collect()]
    total = packing.encoding(packing.TOKENIZER).encode_ordinary("word " * 1000)
    assert {r[2] for r in rows} == {1, 2, 3, 4} and sum(r[5] for r in rows if r[2] == 1) == len(total)
    assert [r[4] for r in rows if r[2] == 1] == list(range(0, len(total), 300)) and sum(r[2] == 2 for r in rows) == 1
    fill = packing.container_fill(placed, spark.createDataFrame([(7, 300)], CAPACITIES)).first()
    assert fill.fullest == 300 and fill.plan_id == 7


def test_empty_tables(spark):
    docs, plans = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, 10)], CAPACITIES)
    assert packing.fill_containers(docs, plans).count() == 0
    assert packing.fill_containers(spark.createDataFrame([(1, "a")], "doc_id long, text string"), plans.limit(0)).count() == 0
