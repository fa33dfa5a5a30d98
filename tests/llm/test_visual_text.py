"""Visually identical text."""

from __future__ import annotations

from corpusloom.llm import visual_text

FACTS = "case_id string, required_term_groups array<array<string>>, loaded_at int, note string"
CASES = "case_id string, reference_answer string, loaded_at int, note string"


def found(spark, terms, answer):
    facts = spark.createDataFrame([("c", [terms], 1, "x")], FACTS)
    cases = spark.createDataFrame([("c", answer, 1, "y")], CASES)
    return {(r.group_no, r.term_no) for r in visual_text.unseen_by_machine(facts, cases).collect()}


def test_what_a_reader_does_not_tell_apart(spark):
    terms = ["Ｇａｔｅ ７", "Ga​te 7", "Gаte 7", "Gate 7", "ñame", "oﬀset", "‐x", "⼤小", "K"]
    answer = "see Gate 7, ñame, offset, -x, 大小, Κ"
    assert found(spark, terms, answer) == {(1, n) for n in range(1, 10)}


def test_what_a_reader_tells_apart(spark):
    assert found(spark, ["GATE 7", "Gáte 7", "Gate ⁷", "Gate ⑦", "Gate 8", "name"], "Gate 7, ñame") == set()


def test_exact_terms_nulls_and_empties_are_no_cases(spark):
    facts = spark.createDataFrame([("c", [["Gate 7", None, ""], [], None], 1, "x"), ("d", None, 1, "x"), ("e", [["a"]], 1, None), (None, [["b"]], 1, None)], FACTS)
    cases = spark.createDataFrame([("c", "Gate 7", 1, "y"), ("e", None, 2, "y"), (None, "b", 1, "y")], CASES)
    assert visual_text.unseen_by_machine(facts, cases).count() == 0
    assert visual_text.unseen_by_machine(facts.limit(0), cases).count() == 0


def test_repeated_rows_count_once_and_the_last_answer_holds(spark):
    facts = spark.createDataFrame([("c", [["Ｇ7"]], 1, "x")] * 3, FACTS)
    cases = spark.createDataFrame([("c", "nothing", 1, "y"), ("c", "G7", 2, "y"), ("c", "G7", 2, "y")], CASES)
    assert visual_text.unseen_by_machine(facts, cases).count() == 1


def test_canonical_member_is_one_per_class(spark):
    values = ["é", "é", "ｅ́", "e", "E", "5", "⑤", "", None, "é"]
    members = {r.v: r.canonical for r in visual_text.canonical_members(spark.createDataFrame([(v,) for v in values], "v string"), "v").collect()}
    assert members["é"] == members["é"] == members["ｅ́"] == "é"
    assert len({members[v] for v in ("é", "e", "E", "5", "⑤", "")}) == 6 and None not in members


def test_long_text(spark):
    assert found(spark, ["Ｚ9"], "a" * 400_000 + "Z9") == {(1, 1)}
