"""Evaluation texts in training text."""

from __future__ import annotations

import random

from corpusloom.llm import leakage

ITEMS = "item_id long, text string, doc_id string"
DOCS = "doc_id long, text string, item_id string"
EN = "Docket 70 holds that the resume marker shall seal the merge window of the scheduler, unless some visiting usher returns 346 tokens. Sheet 181 adds that the frozen audit trail should rarely isolate the policy, whereas an outside surveyor returns 273 ledgers."
ZH = "盲测314人组前，限流策略应当誊录协调器的角色权限，仍归轮值信使称量336份回执。答辩142分钟间，空间配额不得重放高优先级的哈希桶，责成资深巡查员回收271本簿册，见附录。验收第58格后，执行计划务必绕过日志副本，再请首席保管员默写86块铭牌。"


def leaks(spark, docs, items=((1, EN), (2, ZH)), **options):
    i = spark.createDataFrame([(a, b, None) for a, b in items], ITEMS)
    d = spark.createDataFrame([(a, b, None) for a, b in docs], DOCS)
    return {(r.doc_id, r.item_id) for r in leakage.leaked_items(d, i, **options).collect()}


def test_leaks_under_disguise(spark):
    rng = random.Random(1)
    changed = "".join(rng.choice("qxz") if rng.random() < 0.02 else c for c in EN)
    wide = "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in EN)
    spaced = "​".join(ZH[i : i + 7] for i in range(0, len(ZH), 7)).replace("，", ", ")
    docs = [(10, "Some words before. " + EN.upper() + " And after."), (11, changed), (12, wide), (13, spaced), (14, "<p>" + EN[: len(EN) * 3 // 4].replace(" ", "\n") + "</p>"), (15, ZH + EN)]
    assert leaks(spark, docs) == {(10, 1), (11, 1), (12, 1), (13, 2), (14, 1), (15, 1), (15, 2)}


def test_shared_phrases_and_short_parts_are_no_leaks(spark):
    docs = [(10, "The resume marker and the merge window of the scheduler are described. The audit trail is frozen."), (11, EN[: len(EN) // 3]), (12, None), (13, ""), (14, "。，"), (None, EN)]
    assert leaks(spark, docs) == set()


def test_blocks_give_the_same(spark):
    docs = [(10, EN), (11, ZH), (12, EN + ZH)]
    assert leaks(spark, docs) == leaks(spark, docs, block_chars=50) == {(10, 1), (11, 2), (12, 1), (12, 2)}
    assert leaks(spark, docs, items=((1, None), (2, "。"), (None, EN))) == set() and leaks(spark, []) == set()


def test_offsets_point_into_the_original(spark):
    text = "前言" * 50 + "**" + ZH + "**" + "后记" * 50
    row = leakage.leaked_items(spark.createDataFrame([(1, text, None)], DOCS), spark.createDataFrame([(2, ZH, None)], ITEMS)).first()
    assert abs(row.first_char - text.index("盲测")) < 12 and abs(row.last_char - (text.index("铭牌") + 2)) < 12 and row.share > 0.9


def test_very_long_document(spark):
    assert leaks(spark, [(1, "无关的文字说明，" * 40_000 + ZH)]) == {(1, 2)}
