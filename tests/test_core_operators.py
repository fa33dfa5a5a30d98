"""Core operators on small inputs: nulls, empties, ties, repeated rows, clashing columns, brute force."""

from __future__ import annotations

import random
from pathlib import Path

import pyarrow as pa
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from corpusloom import session
from corpusloom.operators import corpus, elements, evaluation, retrieval
from corpusloom.operators.components import connected_components
from corpusloom.operators.skew import hot_keys, spread_lookup


def brute_components(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {n: find(n) for n in parent}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components_like_brute_force(spark, edges):
    df = spark.createDataFrame(edges or [], "a int, b int")
    assert {r[0]: r[1] for r in connected_components(df).collect()} == brute_components(edges)


def test_components_long_path_and_nulls(spark):
    edges = [(i, i + 1) for i in range(60)] + [(None, 3), (7, None), (5, 5)]
    random.Random(1).shuffle(edges)
    found = {r[0]: r[1] for r in connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert set(found.values()) == {0} and len(found) == 61


def test_spread_lookup_equals_join(spark):
    rows = spark.createDataFrame([(1, i) for i in range(300)] + [(2, 1), (None, 5), (3, 4)], "k int, v int")
    lookup = spark.createDataFrame([(1, "a"), (2, "b"), (9, "z")], "k int, name string")
    assert hot_keys(rows, "k", parts=4, least=10) == [1]
    for how in ("inner", "left"):
        got = sorted(map(tuple, spread_lookup(rows, lookup, "k", how, parts=4, least=10).select("k", "v", "name").collect()), key=repr)
        assert got == sorted(map(tuple, rows.join(lookup, "k", how).select("k", "v", "name").collect()), key=repr)


def test_interval_overlaps_like_brute_force(spark):
    rng = random.Random(3)
    make = lambda n: [(f"i{i}", rng.choice("xy"), s := rng.randrange(200), s + rng.randrange(60)) for i in range(n)]
    a, b = make(60), make(60)
    schema = "id string, key string, start int, `end` int"
    found = corpus.interval_overlaps(spark.createDataFrame(a + [("bad", "x", 9, 3), ("null", "x", None, 4)], schema), spark.createDataFrame(b, schema), "key", 16)
    want = sorted((p[0], q[0]) for p in a for q in b if p[1] == q[1] and p[2] <= q[3] and q[2] <= p[3])
    assert sorted(map(tuple, found.collect())) == want


def test_asof_backward(spark):
    rows = spark.createDataFrame([("d", 1), ("d", 5), ("d", 9), ("e", 4)], "k string, page int")
    marks = spark.createDataFrame([("d", 5, "One"), ("d", 8, "Two")], "k string, page int, chapter string")
    found = {(r.k, r.page): r.chapter for r in corpus.asof_backward(rows, marks, "k", "page", "chapter", "Front").collect()}
    assert found == {("d", 1): "Front", ("d", 5): "One", ("d", 9): "Two", ("e", 4): "Front"}


def test_upsert_keeps_last_and_prefers_new_on_ties(spark):
    old = spark.createDataFrame([("a", "old", 2), ("b", "old", 1), (None, "x", 1)], "k string, v string, t int")
    new = spark.createDataFrame([("a", "new", 2), ("b", "late", 0), ("c", "new", 1), ("c", "new", 1)], "k string, v string, t int")
    assert {tuple(r) for r in corpus.upserted(old, new, "k", "t").collect()} == {("a", "new", 2), ("b", "old", 1), ("c", "new", 1)}


def test_round_robin_takes_turns(spark):
    rows = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 7)], "bucket string, n int")
    picked = [(r.bucket, r.n) for r in corpus.round_robin(rows, "bucket", [rows["n"]], 4).collect()]
    assert picked == [("a", 0), ("b", 7), ("a", 1), ("a", 2)]


def test_split_text_covers_everything_within_limit():
    text = "".join(f"第{i}句话说明一个操作步骤。" for i in range(200))
    parts = elements.split_text(text, 120, 20)
    assert all(0 < len(p) <= 120 for p in parts)
    at = 0
    for part in parts:
        place = text.find(part, max(0, at - 40))
        assert 0 <= place <= at
        at = place + len(part)
    assert at == len(text)
    assert elements.split_text("", 10, 2) == [] and elements.split_text("   ", 10, 2) == []


def test_latest_ignores_repeats_and_clashing_names(spark):
    rows = spark.createDataFrame([("a", 1, "x", "r"), ("a", 1, "x", "r"), ("a", 2, "y", "s"), (None, 3, "z", "t")], "id string, loaded_at int, one string, n string")
    assert [tuple(r) for r in elements.latest(rows, "id").collect()] == [("a", 2, "y", "s")]
    assert elements.latest(rows.limit(0), "id").count() == 0


def test_retrieval_on_nulls_ties_and_empty(spark):
    texts = spark.createDataFrame([(1, "alpha beta"), (2, "alpha beta"), (3, None), (4, ""), (5, "beta beta 网关")], "doc_id int, text string")
    queries = spark.createDataFrame([(7, "beta"), (8, None), (9, "网关 alpha")], "query_id int, query_text string")
    found = [(r.query_id, r.doc_id, r["rank"]) for r in retrieval.bm25_topk(queries, texts, 2).orderBy("query_id", "rank").collect()]
    assert found[0] == (7, 5, 1) and found[1] == (7, 1, 2) and (9, 5, 1) in found and not any(q == 8 for q, _, _ in found)
    assert retrieval.bm25_topk(queries, texts.limit(0), 2).count() == 0


def test_keyword_search_keeps_its_index_near_the_texts_size(spark):
    draw = random.Random(5)
    rows = [(i, " ".join(f"w{draw.randrange(900)}" for _ in range(300))) for i in range(500)]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    queries = texts.where("doc_id < 3").selectExpr("doc_id query_id", "text query_text")
    session.ensure_checkpoint_dir(spark)
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    size = lambda: sum(p.stat().st_size for p in folder.rglob("part-*"))
    before = size()
    found = retrieval.bm25_topk(queries, texts, 1).collect()
    assert sorted((r.query_id, r.doc_id) for r in found) == [(0, 0), (1, 1), (2, 2)]
    assert 0 < size() - before < sum(len(t) for _, t in rows)


def test_keyword_search_joins_no_pairs_of_query_and_text(spark):
    texts = spark.createDataFrame([(1, "a b"), (2, "b c")], "doc_id long, text string")
    found = retrieval.bm25_topk(texts.toDF("query_id", "query_text"), texts, 1)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.query_id, r.doc_id) for r in found.collect()) == [(1, 1), (2, 2)]


def test_keyword_search_scores_are_those_of_brute_force(monkeypatch):
    draw = random.Random(6)
    monkeypatch.setattr(retrieval, "STRIDE", 100)
    monkeypatch.setattr(retrieval, "RUN", 4)
    words = [f"w{i}" for i in range(40)]
    idf = {w: draw.random() if i % 3 else 0.5 for i, w in enumerate(words)}
    texts = []
    for i in [None, None, *range(700, 10, -1), 500, 500]:
        held = draw.sample(words[: draw.choice((2, 10, 40))], 2)
        texts.append({"name": i and f"n{i:04}", "norm": draw.choice((0.5, 1.0)), "terms": " ".join(held), "tfs": f"{draw.randrange(1, 3)} 1"})
    asked = [{"query_id": q, "terms": " ".join(t), "idfs": [idf[w] for w in t]} for q in range(60) if (t := draw.sample(words, draw.choice((1, 3, 12))))]
    schema = pa.schema({"name": pa.string(), "norm": pa.float64(), "terms": pa.string(), "tfs": pa.string()})
    got = retrieval.best_texts(pa.Table.from_pylist(asked), pa.Table.from_pylist(texts, schema), 5, "name").to_pylist()
    for a in asked:
        scores = {}
        for t in texts:
            tf = dict(zip(t["terms"].split(), map(int, t["tfs"].split()), strict=True))
            if hits := [idf[w] * tf[w] / (tf[w] + t["norm"]) for w in a["terms"].split() if w in tf]:
                scores[t["name"]] = scores.get(t["name"], 0) + sum(hits)
        best = sorted(((-round(x, 6), name or "") for name, x in scores.items()))[:5]
        assert [(-round(r["score"], 6), r["name"] or "") for r in got if r["query_id"] == a["query_id"]] == best


def test_fusion_prefers_what_both_rank(spark):
    dense = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id int, k string, rank int")
    keyword = spark.createDataFrame([(1, "b", 1), (1, "c", 2)], "query_id int, k string, rank int")
    assert [r.k for r in retrieval.fuse(dense, keyword, key="k", k=5).orderBy("rank").collect()] == ["b", "a", "c"]


def test_vector_contract(spark):
    rows = [(1, [0.5, 0.5]), (2, [0.0, 0.0]), (3, [1.0]), (4, None), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0])]
    found = {r[0]: r[1] for r in retrieval.vector_violations(spark.createDataFrame(rows, "vec_id int, embedding array<float>"), 2).collect()}
    assert found == {2: "vector_zero", 3: "vector_dimensions", 4: "vector_missing", 5: "vector_not_finite", 6: "vector_not_finite"}


def test_retrieval_metrics(spark):
    gold = spark.createDataFrame([("q", "a"), ("q", "b"), ("r", "c")], "query_id string, key string")
    got = spark.createDataFrame([("q", "x", 1), ("q", "a", 2), ("q", "a", 2)], "query_id string, key string, rank int")
    found = {r[0]: tuple(r)[1:] for r in evaluation.retrieval_metrics(gold, got, 5).collect()}
    # The repeat of "a" stays in the denominator of precision: one hit in three rows.
    assert found == {"q": (0.5, 0.333333, 0.5), "r": (0.0, 0.0, 0.0)}


def test_retrieval_metrics_compute_the_ranking_once(spark):
    texts = spark.createDataFrame([("a", "x y"), ("b", "y z"), ("c", "z")], "key string, text string")
    asked = spark.createDataFrame([("q", "x"), ("r", "y z"), ("s", "w")], "query_id string, query_text string")
    gold = spark.createDataFrame([("q", "a"), ("q", None), ("r", "b"), ("r", "b"), ("s", "a"), (None, "a")], "query_id string, key string")
    found = evaluation.retrieval_metrics(gold, retrieval.bm25_topk(asked, texts, 5, "key"), 5)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("FlatMapCoGroupsInArrow") == 1
    assert {r[0]: tuple(r)[1:] for r in found.collect()} == {"q": (0.5, 1.0, 1.0), "r": (1.0, 0.333333, 1.0), "s": (0.0, 0.0, 0.0), None: (0.0, 0.0, 0.0)}
    odd = spark.createDataFrame([("q", "", 1), ("q", None, 2), ("r", "b", 6), (None, "a", 1)], "query_id string, key string, rank int")
    gold = gold.unionByName(spark.createDataFrame([("q", "")], gold.schema))
    assert {r[0]: tuple(r)[1:] for r in evaluation.retrieval_metrics(gold, odd, 5).collect()} == {"q": (0.333333, 0.0, 1.0), "r": (0.0,) * 3, "s": (0.0,) * 3, None: (0.0,) * 3}


def test_packed_chunks_keep_limit_runs_and_short_tails(spark):
    rows = [
        ("v", 0, "a", ["x"], "one " * 5), ("v", 1, "b", ["x"], "b" * 25), ("v", 2, "c", ["x"], "tail"), ("v", 3, "d", ["y"], "z" * 90), ("v", 4, "e", ["y"], None),
        ("v", 5, "f", ["x"], " "), ("v", 6, "g", ["y"], "q" * 5), ("w", 0, "h", None, "only"), ("u", 0, "i", [], ""),
    ]
    df = spark.createDataFrame(rows, "processing_version_id string, ordinal int, element_id string, heading_path array<string>, raw_text string")
    found = elements.packed_chunks(df, limit=40, overlap=5, least=10).orderBy("processing_version_id", "ordinal").collect()
    assert all(r.characters == len(r.text) <= 40 for r in found)
    assert [(r.processing_version_id, r.ordinal, list(r.element_ids)) for r in found] == [
        ("v", 0, ["a"]), ("v", 1, ["b", "c"]), ("v", 2, ["d"]), ("v", 3, ["d"]), ("v", 4, ["d", "g"]), ("w", 0, ["h"]),
    ]
    assert found[1].text == "b" * 25 + "\ntail" and found[4].text == "z" * 20 + "\n" + "q" * 5
    assert len({r.chunk_id for r in found}) == len(found)


def test_cosine_blocks_give_what_brute_force_gives(spark, monkeypatch):
    import numpy as np

    from corpusloom.operators import retrieval

    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    monkeypatch.setattr(retrieval, "VECTOR_BLOCK", 7)
    draw = np.random.default_rng(1)
    vectors = {i: draw.integers(-2, 3, 4).astype(float).tolist() for i in range(40)} | {40: [0.0] * 4, 41: None, 42: [1.0, 2.0], 43: [1.0, None, 1.0, 1.0], 44: [float("nan")] * 4}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>")
    found = retrieval.cosine_topk(df.where("vec_id % 4 = 0").withColumnRenamed("vec_id", "query_id"), df, 5).collect()
    sound = {i: np.array(v) for i, v in vectors.items() if i < 40 and any(v)}
    expected = set()
    for q in (i for i in sound if i % 4 == 0):
        scores = sorted((-round(float(sound[q] @ v / np.linalg.norm(sound[q]) / np.linalg.norm(v)), 6), i) for i, v in sound.items() if i != q)
        expected |= {(q, i, -s, n + 1) for n, (s, i) in enumerate(scores[:5])}
    assert {(r.query_id, r.vec_id, r.score + 0.0, r["rank"]) for r in found} == {(q, i, s + 0.0, n) for q, i, s, n in expected}
    assert retrieval.cosine_topk(df.where("false").withColumnRenamed("vec_id", "query_id"), df.where("false"), 5).count() == 0
