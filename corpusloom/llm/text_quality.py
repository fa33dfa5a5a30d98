"""Problem 8: per-document text quality statistics, and with them prose apart from lists, tables and junk.

The plain statistics count words, symbols, line ends and common words. The layout statistics say how much of a text
stands in sentences, rows of cells, items and noise; the repetition statistics how much repeats: duplicate lines and
paragraphs and the characters that the most frequent word n-gram covers. Combined rules turn them into a class.
"""

from __future__ import annotations

import functools
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CJK = "一-鿿"
WORD = re.compile(rf"[{CJK}]|[^\W{CJK}]+")
CJK_RUN = re.compile(f"[{CJK}]+")
# Function words by which English sentences show, whatever the table of common words holds.
FUNCTION_WORDS = frozenset(
    "a after an and are as at be been before by can could each for from had has have if in is it its may must not of on only or shall should so that the "
    "their then there these they this to until was were when where which while who will with would".split()
)
#: Words of the n-grams whose repetition counts.
GRAM = 4
#: Share of a text in one n-gram from which it is endlessly repeated.
REPEATED = 0.5
#: Times that an n-gram stands in a text before it counts as repeated.
REPEATS = 5

MARK = re.compile(r"(?:[-*•·+→▪◦‣–—>○●]|\[[ xX]?\]|[(（]?\d{1,4}[.)、）](?!\d)|[(（]?[a-zA-Z][.)）](?=\s)|[①-⑳])\s*(?=\S)")
GAPS = re.compile(r"(?<=\S) {2,}(?=\S)")
CSV = re.compile(r",(?=[^\s,])")
RULE = re.compile(r"[-=_+|:│├┤┼─━┌┐└┘┬┴╔╗╚╝═║\s]+")
LATIN = re.compile(r"[a-z]+")
CJK_CHAR = re.compile(f"[{CJK}]")
ENCODED = re.compile(r"(?=\S*[0-9+/%])[A-Za-z0-9+/=_%-]{24,}")
VOWEL = re.compile(r"[aeiouyà-ýāēīōū]")
ODD = re.compile(r"[\x80-\x9f¡-¿À-ÿŒœŠšŸŽžƒˆ˜–—‘-„†‡•…‰‹›€™�]")
SYMBOLS = re.compile(r"[^\w\s]")
INVISIBLE = re.compile("[\xad​-‏⁠﻿]")
FULL_WIDTH = {c: c - 0xFEE0 for c in [*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)]}
WIDE = re.compile("[０-９Ａ-Ｚａ-ｚ]")


@functools.cache
def everyday_characters() -> frozenset[str]:
    """The everyday Chinese characters: level 1 of GB 2312, by its place in the code table."""
    return frozenset(bytes((a, b)).decode("gb2312", "ignore") for a in range(0xB0, 0xD8) for b in range(0xA1, 0xFF)) - {""}


def is_noise(line: str) -> bool:
    """Whether a line is encoded, garbled or random: by its longest runs, characters and words."""
    dense = "".join(line.split())
    n = len(dense)
    if n < 4:
        return False
    if sum(map(len, ENCODED.findall(line))) > 0.6 * n:
        return True
    if len(ODD.findall(dense)) > 0.25 * n:
        return True
    marks = SYMBOLS.findall(dense)
    if len(marks) > 0.6 * n and len(set(marks)) > 4:
        return True
    chinese = CJK_CHAR.findall(dense)
    if len(chinese) > 0.3 * n and len(chinese) >= 6:
        everyday = everyday_characters()
        if sum(c not in everyday for c in chinese) > 0.3 * len(chinese):
            return True
    words = [w for w in LATIN.findall(line.lower()) if len(w) > 2]
    return len(words) >= 3 and sum(map(len, words)) > 0.5 * n and sum(not VOWEL.search(w) for w in words) > 0.4 * len(words)


def is_row(line: str, short: str) -> bool:
    """Whether a line is a row of cells: parted by bars, tabs, wide gaps, semicolons, commas or tags."""
    if "<td" in short or "<tr" in short or "<th>" in short:
        return True
    n = len(short)
    bars = short.count("|") + short.count("│") + short.count("¦")
    if bars >= 2 and 45 * bars >= n:
        return True
    if "\t" in short:
        return True
    if n > 12 and len(GAPS.findall(short)) >= 2:
        return True
    if " ; " in short and 45 * short.count(" ; ") >= n:
        return True
    if "," in short:
        commas = len(CSV.findall(short))
        return commas >= 2 and commas > short.count(", ") and 35 * commas >= n
    return False


def in_sentences(short: str) -> bool:
    """Whether a line shows sentences: clause marks among Chinese characters, function words among English words.

    A Chinese clause speaks for about 90 characters, an English function word for 50.
    """
    spoken = 90 * (short.count("，") + short.count("。", 0, -1))
    words = short.lower().split()
    if len(words) >= 4:
        spoken += 50 * sum(map(FUNCTION_WORDS.__contains__, words))
    if spoken >= len(short):
        return True
    plain = short.count(", ") + short.count(". ")  # Chinese with plain marks
    if plain and not MARK.match(short):
        chinese = sum(map(len, CJK_RUN.findall(short)))
        spoken += 60 * plain if chinese >= 20 and chinese > 0.3 * len(short) else 0
    return spoken >= len(short)


def layout(text: str) -> tuple[int, int, int, int]:
    """Characters in sentences, rows, items and noise; titles and code blocks count nowhere.

    A line that goes on from an unfinished sentence is part of it.
    """
    sentences = rows = items = noise = 0
    going, fenced, first = False, False, True
    for line in text.split("\n"):
        short = line.strip()
        n = len(short)
        if not n:
            going = False
            continue
        if short.startswith("```"):
            fenced, going = not fenced, False
            continue
        if fenced:
            continue
        title = first and n < 80 and short[-1] not in "。.!?！？" and not MARK.match(short)
        first = False
        marked = MARK.match(short)
        plain = short[marked.end() :] if marked else short
        barred = "<t" in short or short[0] in "|│" and is_row(line, short)
        if not barred and in_sentences(plain):
            sentences += n
            going = short[-1] not in "。.!?！？"
        elif (row := is_row(line, short) or RULE.fullmatch(short)) and ("<t" in short or not is_noise(short)):
            rows += n
            going = False
        elif row or is_noise(short):
            noise += n
            going = False
        elif going and not marked:
            sentences += n
            going = short[-1] not in "。.!?！？"
        elif title or short[0] == "#":
            continue
        elif marked or n <= 80 or short.count("、") >= 3 or short.count(", ") >= 3 or short.count("；") >= 3:
            items += n
        else:
            noise += n
    return sentences, rows, items, noise


def repetition(words: list[str], text: str) -> tuple[float, float, float]:
    """Share of duplicate lines, of duplicate paragraphs, and of word characters in the most frequent n-gram."""
    lines = [x for x in map(str.strip, text.split("\n")) if x]
    paragraphs = [x for x in map(str.strip, text.split("\n\n")) if x]
    share = lambda xs: 1 - len(set(xs)) / len(xs) if xs else 0.0
    covered = 0.0
    if len(words) >= 3 * GRAM:
        gram, n = Counter(zip(*[words[i:] for i in range(GRAM)], strict=False)).most_common(1)[0]
        covered = min(1.0, n * sum(map(len, gram)) / sum(map(len, words))) if n >= REPEATS else 0.0
    return share(lines), share(paragraphs), covered


def repeated_share(text: str) -> float:
    """Share of a text's characters in lines, or in paragraphs, that stand in it ``REPEATS`` times or more."""
    most = 0.0
    for parts in (text.split("\n"), text.split("\n\n")):
        counts = Counter(x for x in map(str.strip, parts) if x)
        if len(counts) < sum(counts.values()):
            most = max(most, sum(n * len(x) for x, n in counts.items() if n >= REPEATS) / sum(n * len(x) for x, n in counts.items()))
    return most


def content_class(sentences: int, rows: int, items: int, noise: int, covered: float) -> str:
    """The class by combined rules: repetition first, then whichever kind of lines makes up most of the text.

    ``covered`` is the share of the text in one n-gram, or in repeated lines or paragraphs, whichever is larger.
    """
    if covered >= REPEATED:
        return "junk"
    if sentences >= rows + items + noise:
        return "prose"
    return max((rows, 2, "table"), (items, 1, "list"), (noise, 0, "junk"))[2]


def readable(text: str) -> str:
    """``text`` without invisible characters and with plain-width letters and digits."""
    if INVISIBLE.search(text):
        text = INVISIBLE.sub("", text)
    if WIDE.search(text):
        text = text.translate(FULL_WIDTH)
    return text


LAYOUT = (
    "sentence_share double, row_share double, item_share double, noise_share double, "
    "duplicate_line_share double, duplicate_paragraph_share double, top_gram_share double, content_class string"
)


def layout_statistics(text: str | None) -> tuple:
    """Layout and repetition statistics and the class of one text; null and blank texts count 0 and are prose."""
    text = readable(text or "")
    parts = layout(text)
    repeats = repetition(WORD.findall(text), text)
    total = sum(parts) or 1
    return (*(x / total for x in parts), *repeats, content_class(*parts, max(repeats[2], repeated_share(text))))


def layout_of(text: Column) -> Column:
    """The struct of ``LAYOUT`` of a text."""

    @F.pandas_udf(LAYOUT)
    def layouts(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([layout_statistics(t) for t in texts], columns=[c.split()[0] for c in LAYOUT.split(", ")])

    return layouts.asNondeterministic()(text)  # so that a filter on it does not run it twice


#: White space by Unicode, as a class of Java's and other engines' regular expressions.
SPACE = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LETTER = r"[\p{L}\p{N}_]"
CHARACTER = r"[\x{4e00}-\x{9fff}]"
# Characters that end a line as punctuation.
LINE_ENDS = ".!?;:。！？；：…"


def plain_measures(text: Column, common: list[str]) -> Column:
    """Counts of a text: ``words, letters, dense, lines, ended, known``; what the plain statistics are shares of."""
    latin = sorted({w.lower() for w in common if not CJK_RUN.search(w)})
    chinese = sorted({w for w in common if CJK_RUN.search(w)}, key=lambda w: (-len(w), w))

    def without(pattern: str) -> Column:
        return F.length(F.regexp_replace(text, pattern, ""))

    runs = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_&&[^\x{4e00}-\x{9fff}]]+"), F.lit(0))
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, SPACE + "+$", "")), lambda x: x != "")
    common_runs = F.filter(runs, lambda w: F.lower(w).isin(latin)) if latin else F.array()
    return F.struct(
        runs.alias("runs"), (F.length(text) - without(CHARACTER)).alias("characters"), (F.length(text) - without(LETTER)).alias("letters"), without(SPACE).alias("dense"),
        lines.alias("lines"), F.size(common_runs).alias("common_runs"), (F.length(text) - without("|".join(map(re.escape, chinese))) if chinese else F.lit(0)).alias("common_characters"),
    )


def plain_statistics(texts: DataFrame, common: list[str]) -> DataFrame:
    """``texts (doc_id, text)`` with word count, mean word length, symbol share, punctuated line share, common word share.

    A word is a Chinese character or a run of other letters, digits and underscores. Symbols are counted among all
    characters that aren't white space, line ends among lines that aren't blank. Of the common words the Chinese
    ones count the characters that they cover, longest first. Shares of nothing are 0. The counts pass through a
    generator, so that each is made once a row.
    """
    counted = texts.select("*", F.inline(F.array(plain_measures(F.col("text"), common))))
    words = F.size("runs") + F.col("characters")
    ended = F.size(F.filter("lines", lambda x: F.contains(F.lit(LINE_ENDS), F.substring(x, -1, 1))))

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(0.0)

    return counted.select(
        *texts.columns, words.cast("long").alias("words"), share(F.col("letters"), words).alias("mean_word_length"), share(F.col("dense") - F.col("letters"), F.col("dense")).alias("symbol_share"),
        share(ended, F.size("lines")).alias("punctuated_line_share"), share(F.col("common_runs") + F.col("common_characters"), words).alias("common_word_share"),
    )


def readable_texts(documents: DataFrame) -> DataFrame:
    """``doc_id, text`` of the rows with an id; null texts as empty ones."""
    return documents.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def quality_statistics(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """``doc_id``, the plain, layout and repetition statistics and ``content_class`` of every row.

    Computed in place over whole texts, without a shuffle: the plain statistics by built-in functions, the others in
    Arrow batches. ``common_words`` is a short list per language by its nature. Null texts count as empty ones; rows
    without ``doc_id`` are left out; repeated rows give repeated rows.
    """
    common = [r[0] for r in common_words.where("word is not null and word <> ''").select("word").distinct().orderBy("word").collect()]
    plain = plain_statistics(readable_texts(documents), common)
    return plain.withColumn("layout", layout_of(F.col("text"))).select("doc_id", "words", "mean_word_length", "symbol_share", "punctuated_line_share", "common_word_share", "layout.*")


def content_classes(documents: DataFrame) -> DataFrame:
    """``doc_id, content_class`` of every row, from the layout and repetition statistics alone."""
    return readable_texts(documents).select("doc_id", layout_of(F.col("text"))["content_class"].alias("content_class"))


def not_prose(documents: DataFrame) -> DataFrame:
    """``doc_id, content_class`` of documents most of which is a list, a table or junk; each document once."""
    return content_classes(documents).where("content_class <> 'prose'").distinct()
