"""Offline evaluation: term coverage, retrieval metrics, gold checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import answer_form, compatible, compatible_groups, term_atoms

# Words by which an answer declines.
REFUSALS = ("无法", "不能", "不足", "没有足够", "需要明确")


def covered_groups(groups: Column, answer: Column) -> Column:
    """How many term groups (AND of ORs) ``answer`` meets; null and empty groups meet nothing.

    A term is met if the answer holds its normal form, or all its words and numbers if it has two or more of them.
    Both sides are in compatibility form already.
    """
    form = answer_form(F.coalesce(answer, F.lit("")))

    def hit(term: Column) -> Column:
        atoms = term_atoms(term)
        parts = (F.size(atoms) >= 2) & F.forall(atoms, lambda a: F.contains(form, answer_form(a)))
        return F.coalesce(F.contains(form, answer_form(term)) | parts, F.lit(False))

    return F.size(F.filter(groups, lambda g: F.coalesce(F.exists(g, hit), F.lit(False))))


def term_coverage(facts: DataFrame, answers: DataFrame) -> DataFrame:
    """``case_id, term_groups, covered, coverage``: share of required groups that the case's answer meets; 1 without groups.

    ``facts`` and ``answers`` hold one row per case. A case without answer covers nothing. Terms and answers are
    compared in compatibility form (NFKC).
    """
    groups = compatible_groups(F.coalesce("required_term_groups", F.array().cast("array<array<string>>")))
    joined = facts.select("case_id", groups.alias("groups")).join(answers.select("case_id", compatible(F.col("reference_answer")).alias("answer")), "case_id", "left")
    n, met = F.size("groups"), covered_groups(F.col("groups"), F.col("answer"))
    return joined.select("case_id", n.alias("term_groups"), met.alias("covered"), F.round(F.when(n == 0, 1.0).otherwise(met / n), 6).alias("coverage"))


def cited_numbers(answer: Column, mark: str = "") -> Column:
    """The distinct numbers that an answer cites as ``[1]``, or with a mark as ``[mark1]``; null cites none."""
    numbers = F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(rf"\[{mark}(\d{{1,9}})\]"), F.lit(1))
    return F.array_distinct(F.transform(numbers, lambda n: n.cast("int")))


def citation_metrics(answers: DataFrame) -> DataFrame:
    """``case_id, answerable, citation_recall, citation_valid, fully_covered, refused`` of cited answers.

    ``answers`` has ``case_id, answerable, answer, citations`` (the keys that may be cited, in order) and ``gold``
    (the keys that should be). Recall and coverage are of the keys behind the numbers cited; an answer is valid if
    it cites only numbers that exist, and some if the case is answerable. ``refused`` is told of the other cases.
    """
    n, numbers, empty = F.greatest(F.size("citations"), F.lit(0)), cited_numbers(F.col("answer")), F.array().cast("array<string>")
    sound = F.filter(numbers, lambda i: (i >= 1) & (i <= n))
    keys = F.array_compact(F.transform(sound, lambda i: F.get("citations", i - 1)))
    gold = F.array_distinct(F.coalesce("gold", empty))
    rows = answers.select(
        "case_id", F.coalesce("answerable", F.lit(False)).alias("answerable"), F.size(F.array_intersect(gold, keys)).alias("hits"), F.size(gold).alias("wanted"),
        F.size(numbers).alias("cited"), (F.size(sound) == F.size(numbers)).alias("exist"), F.coalesce(F.col("answer").rlike("|".join(REFUSALS)), F.lit(False)).alias("refusing"),
    )
    yes = F.col("answerable")
    return rows.select(
        "case_id", "answerable", F.when(yes, F.round(F.when(F.col("wanted") == 0, 0.0).otherwise(F.col("hits") / F.col("wanted")), 6)).alias("citation_recall"),
        (F.col("exist") & (~yes | (F.col("cited") > 0))).alias("citation_valid"), F.when(yes, (F.col("wanted") > 0) & (F.col("hits") == F.col("wanted"))).alias("fully_covered"),
        F.when(~yes, F.col("refusing")).alias("refused"),
    )


def visual_scores(answers: DataFrame) -> DataFrame:
    """``case_id, group_recall, cited_group_recall, excluded_hit, citation_valid, passed`` of answers that show images.

    ``answers`` has ``case_id, answer, shown`` (the images' keys in order), ``required`` (an array of groups of which
    any one image will do), ``excluded`` and ``coverage`` (of the required terms). Images are cited as ``[图1]``.
    Without required groups both recalls are 1; empty groups and nulls count as none.
    """
    empty = F.array().cast("array<string>")
    shown, excluded = F.coalesce("shown", empty), F.coalesce("excluded", empty)
    groups = F.filter(F.coalesce("required", F.array().cast("array<array<string>>")), lambda g: F.coalesce(F.size(g), F.lit(0)) > 0)
    numbers = cited_numbers(F.col("answer"), "图")
    cited = F.array_compact(F.transform(numbers, lambda i: F.when(i >= 1, F.get(shown, i - 1))))

    def recall(keys: Column) -> Column:
        met = F.size(F.filter(groups, lambda g: F.arrays_overlap(F.array_compact(g), F.array_compact(keys))))
        return F.round(F.when(F.size(groups) == 0, 1.0).otherwise(met / F.size(groups)), 4)

    rows = answers.select(
        "case_id", "coverage", recall(shown).alias("group_recall"), recall(cited).alias("cited_group_recall"), (F.size(F.array_intersect(excluded, shown)) > 0).alias("excluded_hit"),
        ((F.size(numbers) > 0) & F.forall(numbers, lambda i: (i >= 1) & (i <= F.size(shown)))).alias("citation_valid"),
    )
    passed = (F.col("coverage") == 1) & (F.col("group_recall") == 1) & (F.col("cited_group_recall") == 1) & ~F.col("excluded_hit") & F.col("citation_valid")
    return rows.withColumn("passed", F.coalesce(passed, F.lit(False))).drop("coverage")


def retrieval_metrics(gold: DataFrame, retrieved: DataFrame, k: int) -> DataFrame:
    """``query_id, recall, precision, reciprocal_rank`` of ranked results against relevant keys.

    ``gold (query_id, key)`` and ``retrieved (query_id, key, rank)``. Precision divides by the rows
    retrieved, repeats and all, but a repeated key is one hit; rows without key fill a rank only. A query without
    results scores 0; one without gold has no row. Both sides are grouped together, so the ranking is computed once.
    """
    top = retrieved.where(F.col("rank") <= k).select("query_id", "key", "rank", F.lit(False).alias("wanted"))
    both = gold.select("query_id", "key", F.lit(None).cast("int").alias("rank"), F.lit(True).alias("wanted")).unionByName(top)
    keys = both.groupBy("query_id", "key").agg(F.bool_or("wanted").alias("wanted"), F.min("rank").alias("rank"), F.count_if(F.col("rank").isNotNull() & (F.col("key") != "")).alias("rows"))
    first = F.when(F.col("wanted") & F.col("query_id").isNotNull() & F.col("key").isNotNull(), F.col("rank"))
    sums = keys.groupBy("query_id").agg(F.count_if("wanted").alias("relevant"), F.count(first).alias("hits"), F.min(first).alias("first"), F.sum("rows").alias("retrieved"))
    return sums.where("relevant > 0").select(
        "query_id", F.round(F.col("hits") / F.col("relevant"), 6).alias("recall"),
        F.round(F.coalesce(F.col("hits") / F.nullif("retrieved", F.lit(0)), F.lit(0.0)), 6).alias("precision"), F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"),
    )


def gold_violations(cases: DataFrame) -> DataFrame:
    """``case_id, error_code`` of cases that break the gold contract; the first broken rule counts."""
    code = (
        F.when(F.col("case_id").isNull() | (F.col("case_id") == ""), "case_id_missing")
        .when(F.trim(F.coalesce("question", F.lit(""))) == "", "question_missing")
        .when(F.coalesce("answerable", F.lit(False)) & (F.trim(F.coalesce("reference_answer", F.lit(""))) == ""), "answer_missing")
        .when(F.coalesce("answerable", F.lit(False)) & (F.coalesce(F.size("chunk_ids"), F.lit(0)) <= 0), "evidence_missing")
        .when(~F.coalesce("answerable", F.lit(False)) & (F.coalesce(F.size("chunk_ids"), F.lit(0)) > 0), "evidence_unexpected")
    )
    return cases.select("case_id", code.alias("error_code")).where("error_code is not null")
