"""Markdown, image evidence, scopes and answer scores on small inputs: worked cases, round trips, nulls and empties."""

from __future__ import annotations

import re
import unicodedata
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import evaluation, images, markdown, retrieval, scopes
from corpusloom.plans import core_queries
from tests.support import DATA

TEXT = """---
title: Guide
---
# One

A paragraph with `# no heading`
on two lines.

Under
-----
| a | b |
|---|:-:|
| 1 | 2 |

```
# still code

```
- item one
- item two ![pic](img/a.png)

![only](b.png) ![two](<c.png> "t")
## Two ##
    indented
    code

1. step
***
<div>
html
</div>"""


def test_markdown_elements(spark):
    rows = spark.createDataFrame([(1, TEXT, "x"), (2, None, "y"), (3, " \n ", "z"), (4, "---\nopen\n\n# T", "")], "doc_id long, text string, kind string")
    found = markdown.markdown_elements(rows)
    got = [(r.kind, r.line_start, r.line_end, r.heading_path, r.image_ref) for r in found.where("doc_id = 1").orderBy("element_no").collect()]
    assert got == [
        ("heading", 4, 4, "One", None), ("text", 6, 7, "One", None), ("heading", 9, 10, "One / Under", None), ("table", 11, 13, "One / Under", None), ("code", 15, 18, "One / Under", None),
        ("text", 19, 19, "One / Under", None), ("text", 20, 20, "One / Under", None), ("image", 20, 20, "One / Under", "img/a.png"), ("image", 22, 22, "One / Under", "b.png"),
        ("image", 22, 22, "One / Under", "c.png"), ("heading", 23, 23, "One / Two", None), ("code", 24, 25, "One / Two", None), ("text", 27, 27, "One / Two", None), ("text", 29, 31, "One / Two", None),
    ]
    assert {r.doc_id for r in found.collect()} == {1, 4}
    assert found.select("element_id").distinct().count() == found.count()
    assert markdown.source_mismatches(found, rows).count() == 0
    moved = found.withColumn("line_end", F.col("line_end") - F.when((F.col("doc_id") == 1) & (F.col("kind") == "table"), 1).otherwise(0))
    assert [tuple(r) for r in markdown.source_mismatches(moved, rows).collect()] == [(1, 3)]
    assert markdown.markdown_elements(rows.limit(0)).count() == 0


def test_clean_markdown_keeps_code(spark):
    rows = [("**b** `<unknown> **x**` <i>t</i><!-- gone\n--> [l](u) ![a](p)",), (None,), ("",), ("``a ` **b**`` **c**",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(markdown.clean_markdown(F.col("t"))).collect()]
    assert got == ["b `<unknown> **x**` t l a", None, "", "``a ` **b**`` c"]


def test_image_references_and_links(spark):
    rows = spark.createDataFrame([(1, "x\n![a](i.png) and <img width=1 src='j.gif'>\n\n![](i.png)"), (2, None), (3, "see [q](/x/y.md#z), [r](/x/y.md), [s](http://h/)")], "doc_id long, text string")
    got = [tuple(r) for r in markdown.image_references(rows).orderBy("reference_no").collect()]
    assert got == [(1, 1, 2, "a", "i.png"), (1, 2, 2, "", "j.gif"), (1, 3, 4, "", "i.png")]
    assert [tuple(r) for r in markdown.linked_paths(rows).collect()] == [(3, "x/y.md")]


def test_asset_status_and_first_assets(spark):
    refs = ["a.png", "http://h/a.png", "//h/a.png", "a.png?x", "..\\a.png", "../a.png", "a.bmp", "/b.JPG", None, "no"]
    want = ["ready"] + ["external_or_invalid_reference"] * 4 + ["unsafe_reference", "unsupported_image_format", "ready", None, "unsupported_image_format"]
    assert [r[0] for r in spark.createDataFrame([(r,) for r in refs], "r string").select(images.asset_status(F.col("r"))).collect()] == want
    rows = [("e2", "d", 2, "a.png", "p/s.md"), ("e1", "d", 1, "a.png", "p/s.md"), ("e3", "d", 3, "/p/a.png", "p/s.md"), ("e4", "d", 4, "a.bmp", "p/s.md"), ("e5", "d", 5, "a.bmp", "p/s.md")]
    got = images.first_assets(spark.createDataFrame(rows, "element_id string, document_id string, ordinal int, image_ref string, source_path string"))
    assert sorted((r.element_id, r.asset_path) for r in got.collect()) == [("e1", "p/a.png"), ("e4", "p/a.bmp"), ("e5", "p/a.bmp")]


def test_interleaved_takes_sections_in_turn(spark):
    rows = [("v", s, i, f"e{i}") for s, i in (("a", 1), ("a", 2), ("a", 3), ("b", 4), ("c", 5), ("c", 6))]
    got = images.interleaved(spark.createDataFrame(rows, "processing_version_id string, path string, ordinal int, element_id string"), 4)
    assert [r.element_id for r in got.orderBy("place").collect()] == ["e1", "e4", "e5", "e2"]


def test_relevance_and_clear_lead(spark):
    row = spark.createDataFrame([("time of “Hit Rate” 缓存命中", "hit rate time.png", "缓存", None)], "q string, own string, near string, around string")
    # hit, rate and time stand in the own text, one pair near it, and the quoted label in the own text
    assert row.select(images.relevance(*[F.col(c) for c in ("q", "own", "near", "around")])).first()[0] == 3.0 * 2 + 1.25 + 12.0
    scored = spark.createDataFrame([("q", "a", 1, 9.0), ("q", "b", 2, 6.0), ("r", "a", 1, 9.0), ("r", "b", 2, 8.0), ("r", "c", 3, 1.0), ("r", "d", 4, 0.0), ("s", "a", 1, 8.0)], "query_id string, element_id string, ordinal int, score double")
    got = sorted((r.query_id, r.element_id) for r in images.selected(scored, 3).collect())
    assert got == [("q", "a"), ("r", "a"), ("r", "b"), ("r", "c"), ("s", "a")]


def test_scopes(spark):
    rows = [("g", "a", True, False), ("g", "a", False, True), ("g", "b", False, True), ("h", "c", True, False), ("h", None, False, True)]
    got = {r.kind: tuple(r)[1:] for r in scopes.scope_changes(spark.createDataFrame(rows, "kind string, key string, held boolean, asked boolean"), "kind", "key").collect()}
    assert got == {"g": (1, 2, 1, 2, 0, True), "h": (1, 0, 0, 1, 1, False)}
    deliveries = [("d1", "k", "x", 1), ("d1", "k", "x", 2), ("d2", "k", "x", 1), ("d2", "k", "y", 2), ("d3", "k", None, 1), ("d3", "k", None, 2), (None, "k", "x", 1)]
    plan = scopes.rebuild_plan(spark.createDataFrame(deliveries, "document_id string, kb string, sha string, loaded_at int"), "kb", "document_id", "sha").collect()
    assert [tuple(r) for r in plan] == [("k", 3, 1, 2, 1)]


def test_quality_verdicts_and_gates_without_elements(spark):
    source = "source struct<source_path: string>"
    schema = f"processing_version_id string, element_id string, ordinal int, kind string, raw_text string, image_ref string, {source}"
    rows = [("ok", "e1", 0, "text", "t", None, ("p",)), ("blank", "e2", 0, "text", " ", None, ("p",)), ("image", "e3", 0, "image", "t", None, (" ",)), ("part", "e4", 0, "text", "t", None, ("p",)), ("part", "e5", 1, "text", None, None, ("p",))]
    versions = spark.createDataFrame([(v, 1, 0) for v in ("ok", "blank", "image", "part", "none")], "processing_version_id string, element_count int, warning_count int")
    found = spark.createDataFrame(rows, schema)
    got = {r[0]: tuple(r)[1:] for r in scopes.quality_verdicts(versions, found).collect()}
    assert got == {
        "ok": ("candidate", "", ""), "blank": ("blocked", "no_indexable_elements", "empty_parsed_element"), "image": ("blocked", "missing_image_reference,missing_source_path", ""),
        "part": ("needs_review", "", "empty_parsed_element"), "none": ("blocked", "no_elements", ""),
    }
    assert {r.processing_version_id for r in scopes.version_gates(versions, found).where("passed").collect()} == {"ok"}


def test_citation_metrics(spark):
    rows = [
        ("a", True, "x [1] y [2][2]", ["k1", "k2"], ["k1"]), ("b", True, "[3]", ["k1"], ["k1"]), ("c", True, None, None, None), ("d", False, "无法回答", [], None), ("e", None, "[1]", [], []),
        ("f", True, "[1]", ["k1"], ["k1", "k2", "k2"]),
    ]
    df = spark.createDataFrame(rows, "case_id string, answerable boolean, answer string, citations array<string>, gold array<string>")
    got = {r[0]: tuple(r)[2:] for r in evaluation.citation_metrics(df).collect()}
    assert got == {
        "a": (1.0, True, True, None), "b": (0.0, False, False, None), "c": (0.0, False, False, None), "d": (None, True, None, True), "e": (None, False, None, False), "f": (0.5, True, False, None),
    }


def test_visual_scores(spark):
    rows = [
        ("a", "[图1]", ["i", "j"], [["i"], ["x", "i"]], ["z"], 1.0), ("b", "[图2]", ["i", "j"], [["i"], []], ["j"], 1.0), ("c", "[图3]", ["i"], None, None, 1.0), ("d", None, None, [["i"]], None, None),
    ]
    df = spark.createDataFrame(rows, "case_id string, answer string, shown array<string>, required array<array<string>>, excluded array<string>, coverage double")
    got = {r.case_id: (r.group_recall, r.cited_group_recall, r.excluded_hit, r.citation_valid, r.passed) for r in evaluation.visual_scores(df).collect()}
    assert got == {"a": (1.0, 1.0, False, True, True), "b": (1.0, 0.0, True, True, False), "c": (1.0, 1.0, False, False, False), "d": (0.0, 0.0, False, False, False)}


def test_reranked_keeps_order_without_query(spark):
    rows = [("q", 1, 1, "red fox", "a dog"), ("q", 2, 2, "red fox", "red fox"), ("q", 3, 3, "red fox", " "), ("n", 1, 1, None, "a"), ("n", 2, 2, None, "b")]
    got = retrieval.reranked(spark.createDataFrame(rows, "query_id string, doc_id int, rank int, query_text string, text string"), 5)
    assert sorted((r.query_id, r.rank, r.doc_id, r.score) for r in got.collect()) == [("n", 1, 1, None), ("n", 2, 2, None), ("q", 1, 2, 1.0), ("q", 2, 1, 0.0)]


def test_index_round_trip(spark, tmp_path):
    texts = spark.createDataFrame([(1, "a b a 中文"), (2, None), (3, "..."), (4, "b")], "doc_id long, text string")
    retrieval.write_index(retrieval.keyword_index(texts), str(tmp_path / "index"))
    back = spark.read.parquet(str(tmp_path / "index"))
    assert sorted(tuple(r) for r in retrieval.index_postings(back).collect()) == [("a", 1, 2, 5), ("b", 1, 1, 5), ("b", 4, 1, 1), ("中", 1, 1, 5), ("文", 1, 1, 5)]
    asked = spark.createDataFrame([(7, "b"), (8, "zzz"), (9, None)], "query_id long, query_text string")
    assert [(r.query_id, r.doc_id) for r in retrieval.bm25_search(asked, back, 5).orderBy("rank").collect()] == [(7, 4), (7, 1)]
    assert retrieval.bm25_topk(asked, texts.limit(0), 5).count() == 0


def plain_form(text):
    return "".join(c for c in unicodedata.normalize("NFKC", text).lower().replace("µ", "μ") if unicodedata.category(c)[0] in "LN")


def holds(answer, term):
    if plain_form(term) in plain_form(answer):
        return True
    atoms = re.findall(r"[a-z]+(?:[._-][a-z0-9]+)*|[0-9]+(?:\.[0-9]+)?", unicodedata.normalize("NFKC", term).lower())
    return len(atoms) >= 2 and all(plain_form(a) in plain_form(answer) for a in atoms)


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
def test_term_coverage_like_brute_force(spark):
    con = duckdb.connect()
    sql = f"""with c as (select case_id, max_by(reference_answer, loaded_at) a from '{DATA}/mapped_cases.parquet' group by 1), f as (select case_id, max_by(v, v.loaded_at) r from '{DATA}/visual_facts.parquet' v group by 1)
    select f.case_id, r.required_term_groups, a from f left join c using (case_id)"""
    want = {}
    for case, groups, answer in con.execute(sql).fetchall():
        groups = groups or []
        want[case] = (len(groups), sum(any(t is not None and holds(answer or "", t) for t in g or []) for g in groups))
    assert {r.case_id: (r.term_groups, r.covered) for r in core_queries.term_coverage(spark, DATA).collect()} == want


def test_term_coverage_folds_forms_and_atoms(spark):
    facts = [("a", [["ＣＰＵ １２"]]), ("b", [["store.lease 30"]]), ("c", [["store lease"], []]), ("d", None), ("e", [[None]])]
    answers = [("a", "cpu 12"), ("b", "30 s for Store.Lease"), ("c", "lease of the STORE"), ("e", "x")]
    got = evaluation.term_coverage(spark.createDataFrame(facts, "case_id string, required_term_groups array<array<string>>"), spark.createDataFrame(answers, "case_id string, reference_answer string"))
    assert {r.case_id: (r.term_groups, r.covered, r.coverage) for r in got.collect()} == {"a": (1, 1, 1.0), "b": (1, 1, 1.0), "c": (2, 1, 0.5), "d": (0, 0, 1.0), "e": (1, 0, 0.0)}


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
def test_evidence_mapping_like_brute_force(spark):
    chunks = core_queries.packed_chunks(spark, DATA).select("chunk_id", "element_ids").toPandas()
    rows = core_queries.current_elements(spark, DATA).where("source.kind = 'text'").selectExpr("element_id", "processing_version_id v", "source.line_start s", "source.line_end e", "coalesce(array_join(heading_path, '/'), '') p").toPandas()
    con = duckdb.connect()
    con.register("chunks", chunks), con.register("el", rows)
    want = con.execute("""with t as (select v, min(s) s, max(e) e from el group by v, p), k as (select chunk_id, unnest(element_ids) element_id from chunks),
    c as (select distinct chunk_id, v, s, e from k join el using (element_id)), j as (select distinct t.v || ':' || t.s || ':' || t.e id, chunk_id from t join c on c.v = t.v and c.s <= t.e and t.s <= c.e where t.s <= t.e and c.s <= c.e)
    select id, count(*), string_agg(chunk_id, ',' order by chunk_id) from j group by id""").fetchall()
    assert sorted(tuple(r) for r in core_queries.evidence_mapping(spark, DATA).select("a_id", "chunks", "chunk_ids").collect()) == sorted(want)
