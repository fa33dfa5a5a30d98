"""Noise in scanned text."""

from __future__ import annotations

from corpusloom.llm import scan_repair

SCHEMA = "element_id string, processing_version_id string, kind string, ordinal int, raw_text string, heading_path array<string>, source struct<kind string, page_number int>, loaded_at int, noise string"
TITLE = "Dravek Audit Trail Overview"


def elements(spark, texts, **other):
    rows = [(f"e{i}", "v1", other.get("kind", "text"), i, t, [TITLE], (other.get("source", "pdf"), i + 3), 1, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


COMMON = ["the scheduling queue reloads the storage node of the engine, and the primary copy waits for the replica."] * 12
CHINESE = ["存储节点负责汇总日志副本，状态会显示为等待。"] * 12


def noise(spark, texts, **other):
    found: dict = {}
    for r in scan_repair.scan_noise(elements(spark, texts, **other)).collect():
        found.setdefault(int(r.element_id[1:]), set()).add(r.noise)
    return found


def test_kinds_of_noise(spark):
    texts = [
        TITLE, f"{TITLE} | 4", "— 5 —", "The prim-\nary copy waits.", "the sched¬\nuling queue", "the sch3duling qiieue", "存诸节点负责汇总日志副本。", "第 10 页", "clean text stays, as it is.", "A dash -\nafter it.", "the prim-\nPage 13\nary copy",
        "CHAPTER 2  AUDIT TRAIL", "it holds 2O5 entries", None, "",
    ]
    found = noise(spark, texts + COMMON + CHINESE)
    assert found == {
        0: {"running_header"}, 1: {"running_header", "page_number"}, 2: {"page_number"}, 3: {"hyphenation"}, 4: {"hyphenation"}, 5: {"misread"}, 6: {"misread"}, 7: {"page_number"}, 10: {"hyphenation", "page_number"},
        11: {"running_header"}, 12: {"misread"},
    }


def test_words_beside_a_parameter_count(spark):
    texts = ["把net.seal-pool的值写入qiieue以后，版本8.6的状态会显示为等待。", "把net.seal-qiieue/qiieue的值写入以后，状态会显示为等待。"]
    assert noise(spark, texts + COMMON) == {0: {"misread"}}


def test_only_scanned_texts_count(spark):
    assert noise(spark, [TITLE, "7"], source="text") == {} and noise(spark, [TITLE, "7"], kind="heading") == {}
    assert scan_repair.scan_noise(elements(spark, [])).count() == 0


def test_known_compounds_keep_their_hyphen(spark):
    df = elements(spark, ["a read-\nonly copy"] + ["the read-only copy is kept."] * 6)
    assert scan_repair.scan_noise(df).count() == 0
    assert {r.paragraph for r in scan_repair.repaired_paragraphs(df).where("element_id = 'e0'").collect()} == {"a read-only copy"}


def test_repaired_paragraphs(spark):
    texts = [f"{TITLE} | 3", "the prim-\nPage 4\nary copy\nwaits for the qiieue.", "存诸节点负责汇\n总日志副本。", "one paragraph\n\nand the next"]
    rows = scan_repair.repaired_paragraphs(elements(spark, texts + COMMON + ["the queue waits."] * 8 + CHINESE)).where("ordinal < 4").orderBy("ordinal").collect()
    assert [(r.ordinal, r.paragraph) for r in rows] == [(1, "the primary copy waits for the queue."), (2, "存储节点负责汇总日志副本。"), (3, "one paragraph\n\nand the next")]


def test_page_numbers_need_a_sequence_or_dress():
    assert scan_repair.page_number("xiv") == (14, False) and scan_repair.page_number("[7]") == (7, True) and scan_repair.page_number("6 / 67") == (6, True) and scan_repair.page_number("Page 9") == (9, True)
    assert scan_repair.page_number("12.5") is None and scan_repair.page_number("- 7") is None and scan_repair.page_number("mix") is None


def test_repeated_rows_count_once(spark):
    df = elements(spark, ["— 5 —"])
    assert scan_repair.scan_noise(df.unionByName(df)).count() == 1
