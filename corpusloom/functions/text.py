"""Column functions over text: search tokens, normal forms, splitting."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value. Search tokens: runs of ASCII letters, digits and underscores, and single Chinese characters.
SEARCH_TOKEN = r"[a-z0-9_]+|[\x{4e00}-\x{9fff}]"
#: Pairs of Chinese characters that questions about images have in common.
GENERIC_PAIRS = ("原始", "截图", "示意", "图中", "依据", "中的", "分别", "多少", "什么", "页面", "显示", "哪个", "哪些", "是否", "如何", "图片")
#: Fixed value: the parts of a composite term that must all stand in an answer.
ATOM = r"[a-z]+(?:[._-][a-z0-9]+)*|\d+(?:\.\d+)?"


def search_tokens(text: Column) -> Column:
    """Lower-cased search tokens in order; null text gives none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(SEARCH_TOKEN), F.lit(0))


def answer_form(text: Column) -> Column:
    """Lower case, letters and digits only, the micro sign as mu; for comparing answers."""
    return F.regexp_replace(F.replace(F.lower(text), F.lit("µ"), F.lit("μ")), r"[^\p{L}\p{N}]", "")


def compatible(text: Column) -> Column:
    """A text in compatibility form (NFKC); null stays null. In Arrow batches."""

    @F.pandas_udf("string")
    def form(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    return form(text)


def compatible_groups(groups: Column) -> Column:
    """The terms of an array of arrays in compatibility form (NFKC); nulls stay null."""

    @F.pandas_udf("array<array<string>>")
    def form(rows: pd.Series) -> pd.Series:
        return rows.map(lambda gs: None if gs is None else [None if g is None else [None if t is None else unicodedata.normalize("NFKC", t) for t in g] for g in gs])

    return form(groups)


def term_atoms(term: Column) -> Column:
    """The Latin words and numbers of a term, in lower case."""
    return F.regexp_extract_all(F.lower(term), F.lit(ATOM), F.lit(0))


def search_bigrams(text: Column) -> Column:
    """Distinct Latin words, numbers and Chinese character pairs but the generic ones, for visual relevance.

    Words and numbers have two characters at least; Unicode compatibility forms aren't folded.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    words = F.filter(F.regexp_extract_all(low, F.lit(r"[a-z][a-z0-9_.]*|[0-9]+(?:\.[0-9]+)?"), F.lit(0)), lambda w: F.length(w) >= 2)
    runs = F.regexp_extract_all(low, F.lit(r"[\x{4e00}-\x{9fff}]{2,}"), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    return F.array_except(F.concat(words, pairs), F.array(*map(F.lit, GENERIC_PAIRS)))
