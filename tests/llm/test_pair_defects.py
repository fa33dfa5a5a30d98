"""Broken prompt and response pairs."""

from __future__ import annotations

import pytest

from corpusloom.llm import pair_defects

Q = "参数 `net.rotate-quota` 在《Dravek 日志副本运维指南》里控制什么，调整连接池时有哪些限制？"
E = "What does `net.rotate-quota` control in Dravek 8.1, and which limits apply to the index builder?"
FULL = "启用该参数以后，日志副本延迟提交缓存目录，无须重启服务。"


@pytest.mark.parametrize(
    ("question", "answer", "defect"),
    [
        (Q, None, "empty"), (Q, " \n​", "empty"), (Q, "答：", "empty"), (Q, "A:", "empty"), (Q, "N/A", "empty"), (Q, "（空）", "empty"), (Q, "……", "empty"), (Q, "[]", "empty"),
        (Q, "抱歉，我无法回答这个问题。", "refusal"), (E, "I'm sorry, but I cannot answer this question.", "refusal"), (Q, "感谢提问。对不起，关于“连接池”的内容我不便透露。", "refusal"),
        (E, "As a language model I am unable to comment on the index builder.", "refusal"),
        (Q, Q, "copied"), (Q, "回答：" + Q, "copied"), (E, E.upper(), "copied"), (Q, Q + "\n" + Q, "copied"),
        (Q, FULL + "出现时钟偏差时，限流策略自动合并", "truncated"), (Q, FULL + "```shell\nctl pool --", "truncated"), (E, "The index builder waits. These include:", "truncated"),
        (Q, "只读的连接池：42 K；远端的日志副本：7 ms；默认的哈希", "truncated"), (E, "The index builder waits for the log replica, and applica…", "truncated"),
        (Q, "The index builder waits for the log replica, and the status changes to waiting.", "other_language"), (E, "索引构建需要先等待日志副本，状态会显示为等待。", "other_language"),
        (Q, "Il faut vérifier la sauvegarde avant tout redémarrage. En cas de panne, un autre nœud reprend le travail.", "other_language"),
        (Q, FULL, None), (Q, "Dravek 8.1", None), (Q, "`net.rotate-quota` = 42 MiB", None), (Q, "6144", None), (Q, "文件大小 的最大值为 724 oрs", None), (Q, "是", None), (Q, "Dravek 引擎", None), (Q, "Seal → Merge → Probe", None),
        (Q, "只读的连接池：42 K；远端的日志副本：7 ms", None), (Q, "Dravek Console > Settings > Merge", None), (E, "offset gap peaks at 386 MiB", None), (Q, FULL + "\n\n```shell\nctl pool --seal\n```", None),
        (Q + "请用英文作答。", "The index builder waits for the log replica, and the status changes to waiting.", None), (Q, "不能。Dravek 引擎会拒绝该请求并返回错误，须先释放占用的空间。", None),
        (Q, Q + "答案如下：" + FULL * 3, None), ("", FULL, None), (None, FULL, None),
    ],
)
def test_defect(question, answer, defect):
    assert pair_defects.defect_of(question, answer, True) == defect


def test_only_empty_counts_where_no_answer_is_due():
    for flag in (False, None):
        assert pair_defects.defect_of(Q, "抱歉，我无法回答这个问题。", flag) is None
        assert pair_defects.defect_of(Q, "-", flag) == "empty"


def test_rows_repeats_nulls_and_long_texts(spark):
    schema = "case_id string, question string, reference_answer string, answerable boolean, loaded_at int, defect string"
    rows = [("a", Q, None, True, 1, "x"), ("a", Q, None, True, 1, "x"), ("b", Q, "-", True, 1, "x"), ("b", Q, FULL, True, 2, "x"), (None, Q, None, True, 1, "x"), ("c", None, "x" * 200_000 + "。", True, None, "x"), ("d", Q, "-", None, 1, None)]
    df = spark.createDataFrame(rows, schema)
    assert {tuple(r) for r in pair_defects.broken_pairs(df).collect()} == {("a", "empty"), ("d", "empty")}
    assert pair_defects.broken_pairs(df.limit(0)).count() == 0


def test_subsequence_like_brute_force():
    a, b = list("abcbdab"), list("bdcaba")
    assert pair_defects.subsequence(a, b) == 4 and pair_defects.subsequence([], b) == 0


def test_no_length_hides_a_refusal_or_a_copy():
    long = "在 Dravek 8.1 集群的北方机房里，运维人员按照《变更订阅运维指南》第三章的要求依次停止备用节点、校验日志副本并重新加载缓存目录以后，参数 net.rotate-quota 的取值依据是什么"
    assert len(pair_defects.tokens(long)) > 60
    assert pair_defects.defect_of(long + "？", f"抱歉，我无法回答关于{long}的问题。", True) == "refusal"
    assert pair_defects.defect_of(Q, Q * 9, True) == "copied"
    assert pair_defects.defect_of(long + "？", FULL * 9, True) is None
