"""Text quality statistics and content classes."""

from __future__ import annotations

import base64
import random

import pytest

from corpusloom.llm import text_quality

RNG = random.Random(6)
PROSE_ZH = "只要租约尚未到期，同步链路必须重新登记网络端口，整个过程对业务透明。限流策略会逐个检查版本清单，期间监控曲线会出现短暂波动。"
PROSE_EN = "During quiet hours, the write buffer reads first from the audit trail, and the status changes to waiting. Before any rollback, it is checked by the engine."
ITEMS = ["告警规则", "agent.seal-pool", "远端的连接池", "read-only audit trail", "Dravek 引擎", "默认的哈希桶"]


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        (PROSE_ZH * 3, "prose"), (PROSE_EN, "prose"), ("# 标题\n\n" + PROSE_ZH + "\n\n| a | 3 |\n| b | 4 |", "prose"), ("\n".join(PROSE_ZH[i : i + 28] for i in range(0, len(PROSE_ZH), 28)), "prose"),
        ("- " + PROSE_ZH + "\n- " + PROSE_ZH, "prose"), ("", "prose"), (None, "prose"), (" \n\t", "prose"), ("> " + PROSE_EN, "prose"),
        ("标题：\n" + "\n".join(f"{i}. {x}" for i, x in enumerate(ITEMS * 3, 1)), "list"), ("\n".join(ITEMS * 3), "list"), ("、".join(ITEMS * 4), "list"), ("\n".join(f"（{i}）{x}。" for i, x in enumerate(ITEMS, 1)), "list"),
        ("\n".join(f"[ ] {x}" for x in ITEMS), "list"),
        ("\n".join(f"| {x} | {i} | ok |" for i, x in enumerate(ITEMS)), "table"), ("\n".join(f"{x}\t{i}\tno" for i, x in enumerate(ITEMS)), "table"), ("\n".join(f"{i},{x},9.1" for i, x in enumerate(ITEMS)), "table"),
        ("<table>" + "".join(f"<tr><td>{x}</td><td>1</td></tr>\n" for x in ITEMS) + "</table>", "table"), ("\n".join(f"{x} ; {i} ; -" for i, x in enumerate(ITEMS)), "table"),
        ("返回顶部" * 60, "junk"), ("Loading... | " * 50, "junk"), (base64.b64encode(RNG.randbytes(600)).decode(), "junk"), ("\n".join(RNG.randbytes(32).hex() for _ in range(9)), "junk"),
        (" ".join("".join(RNG.choice("bcdfghjklmnpqrstvwxz") for _ in range(RNG.randint(4, 10))) for _ in range(60)), "junk"), ("".join(RNG.choice("!@#$%^&*~<>?/|\\+=") for _ in range(300)), "junk"),
        (PROSE_ZH.encode().decode("latin-1"), "junk"), ("".join(chr(RNG.randrange(0x4E00, 0x9FA0)) for _ in range(200)), "junk"),
    ],
)
def test_class(text, kind):
    assert text_quality.layout_statistics(text)[-1] == kind


@pytest.mark.parametrize("between", ["\n", "\n\n"])
def test_repeated_lines_and_paragraphs_are_junk(between):
    assert text_quality.layout_statistics(between.join([PROSE_ZH] * 200))[-1] == "junk"
    assert text_quality.layout_statistics(between.join([PROSE_EN + "\n" + PROSE_ZH] * 200))[-1] == "junk"


def test_statistics_of_a_small_text(spark):
    words = spark.createDataFrame([("en", "the"), ("zh", "同时"), ("zh", "时"), ("xx", None)], "lang string, word string")
    rows = [(1, "The cat_1 同时 sat!\n\nsecond line", "x"), (2, None, "x"), (3, "", "x"), (None, "the", "x"), (1, "The cat_1 同时 sat!\n\nsecond line", "x")]
    found = [r for r in text_quality.quality_statistics(spark.createDataFrame(rows, "doc_id long, text string, words string"), words).collect()]
    assert sorted(r.doc_id for r in found) == [1, 1, 2, 3]
    one = next(r for r in found if r.doc_id == 1)
    assert one.words == 7 and one.common_word_share == 3 / 7 and one.punctuated_line_share == 0.5 and one.symbol_share == 1 / 24
    assert one.mean_word_length == 23 / 7
    none = next(r for r in found if r.doc_id == 2)
    assert none.words == 0 and none.common_word_share == 0 and none.content_class == "prose"


def test_each_document_once_and_long_text(spark):
    rows = [(1, "\n".join(ITEMS * 3), "x"), (1, "\n".join(ITEMS * 3), "x"), (2, PROSE_ZH * 3000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, content_class string")
    assert [tuple(r) for r in text_quality.not_prose(df).collect()] == [(1, "list")]
    assert text_quality.not_prose(df.limit(0)).count() == 0
