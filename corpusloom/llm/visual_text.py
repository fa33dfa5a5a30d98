"""Problem 1: text that looks alike but differs in its characters.

A value is first mapped character by character (width, compatibility shapes, spaces, hyphens, joined
letters, same-shaped letters of other scripts; invisible characters vanish). The mapped values are then
grouped under Spark's ``UNICODE`` collation, which is sensitive to accents and case but treats composed
and decomposed spellings as equal. Every class gets one canonical member, which is joined back.

What stays different, since a reader sees it: letter case, accents, raised, lowered and circled digits.
"""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.skew import spread_lookup
from corpusloom.session import cut_lineage

# Letters of other scripts with the shape of a Latin letter, and the Latin letters.
SAME_SHAPE_FROM = (
    "АВЕЅІЈКМНОРСТУХԚԜҮ"  # Cyrillic capitals
    "аеорсухіјѕԛԝһԁѵӏү"  # Cyrillic small letters
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹ"  # Greek capitals
    "οϲϳν"  # Greek small letters
    "µ"  # micro sign
)
SAME_SHAPE_TO = "ABESIJKMHOPCTYXQWY" "aeopcyxijsqwhdvly" "ABEZHIKMNOPTYXC" "ocjv" "μ"

# Hyphens of other kinds that look like the plain one.
HYPHENS = "‐‑‒–⁃−˗﹘﹣－"

UNICODE = "UNICODE"


@functools.cache
def shape_table() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """(characters, replacements, joined letters) of the mapping; derived from the Unicode data by rule.

    Characters beyond the end of ``replacements`` are dropped, as ``translate`` does.
    """
    one: dict[str, str] = dict(zip(SAME_SHAPE_FROM, SAME_SHAPE_TO, strict=True))
    for c, to in list(one.items()):  # the same letters with accents
        for mark in range(0x0300, 0x0340):
            composed, plain = (unicodedata.normalize("NFC", x + chr(mark)) for x in (c, to))
            if len(composed) == 1:
                one[composed] = plain if len(plain) == 1 else unicodedata.normalize("NFC", to)
    joined: dict[str, str] = {}
    drop = []
    for code in [*range(0xA0, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800)]:
        c = chr(code)
        kind = unicodedata.category(c)
        if c in one:
            continue
        if kind == "Cf" or 0xFE00 <= code <= 0xFE0F or code == 0x034F:
            drop.append(c)
        elif kind == "Zs":
            one[c] = " "
        elif c in HYPHENS:
            one[c] = "-"
        elif unicodedata.decomposition(c).startswith(("<wide>", "<narrow>", "<noBreak>", "<compat>", "<font>")):
            plain = unicodedata.normalize("NFKC", c)
            plain = one.get(plain, "-" if plain in HYPHENS else plain)
            if len(plain) == 1:
                one[c] = plain
            elif plain.isalpha() and plain.isascii():
                joined[c] = plain
    one["\t"] = " "
    return "".join([*one, *drop]), "".join(one.values()), tuple(joined.items())


def map_shapes(text: Column) -> Column:
    """``text`` with every character replaced by the plain one of the same shape (null stays null)."""
    chars, plain, joined = shape_table()
    mapped = F.translate(text, chars, plain)
    for c, letters in joined:
        mapped = F.replace(mapped, F.lit(c), F.lit(letters))
    return mapped


def canonical_members(values: DataFrame, column: str) -> DataFrame:
    """One row per distinct ``column`` value: the value and ``canonical``, its class's chosen member.

    Classes are groups of mapped values under the accent-sensitive ``UNICODE`` collation; the shortest
    member, then the first in code-point order, stands for all. Nulls form no class and give no row;
    the empty string is its own class. A class may be of any size: both groupings combine before they
    shuffle, and only distinct values are joined.
    """
    distinct = values.where(F.col(column).isNotNull()).groupBy(column).agg(F.lit(1).alias("one")).drop("one")
    mapped = distinct.withColumn("mapped", map_shapes(F.col(column)))
    members = mapped.groupBy("mapped").agg(F.lit(1).alias("one")).drop("one")
    classes = (
        members.groupBy(F.collate("mapped", UNICODE).alias("shape"))
        .agg(F.min(F.struct(F.length("mapped").alias("size"), F.collate("mapped", "UTF8_BINARY").alias("member"))).alias("best"))
        .select("shape", F.col("best.member").alias("canonical"))
    )
    return (
        mapped.withColumn("shape", F.collate("mapped", UNICODE))
        .join(classes, "shape")
        .select(column, F.collate("canonical", "UTF8_BINARY").alias("canonical"))
    )


def occurs_to_reader(text: Column, term: Column) -> Column:
    """Whether canonical ``term`` stands in canonical ``text`` as a reader sees it."""
    return F.contains(F.collate(text, UNICODE), F.collate(term, UNICODE))


def required_terms(facts: DataFrame) -> DataFrame:
    """``case_id, group_no, term_no, term`` of all required terms, positions from 1.

    Null and empty arrays and groups give no rows; null and empty terms neither; repeated rows count once.
    """
    groups = facts.select("case_id", F.posexplode("required_term_groups").alias("g", "terms"))
    terms = groups.select("case_id", (F.col("g") + 1).alias("group_no"), F.posexplode("terms").alias("t", "term"))
    return (
        terms.where("case_id is not null and term is not null and term <> ''")
        .select("case_id", "group_no", (F.col("t") + 1).alias("term_no"), "term")
        .distinct()
    )


def latest_answers(cases: DataFrame) -> DataFrame:
    """``case_id, reference_answer``: one row per case, the one loaded last; cases without answer are left out."""
    return (
        cases.where("case_id is not null and reference_answer is not null")
        .groupBy("case_id")
        .agg(F.max(F.struct("loaded_at", "reference_answer")).alias("last"))
        .select("case_id", F.col("last.reference_answer").alias("reference_answer"))
    )


def term_presence(facts: DataFrame, cases: DataFrame) -> DataFrame:
    """Every required term of a known case with ``exact`` (character by character) and ``visible`` presence.

    Columns: ``case_id, group_no, term_no, term, canonical_term, exact, visible``. Terms and answers are
    brought to their canonical members first; a term of an unknown case, or a case without answer, gives
    no row. Extra columns of either table play no part.
    """
    required = required_terms(facts)
    given = cut_lineage(latest_answers(cases).join(required.select("case_id").distinct(), "case_id", "left_semi"))
    pairs = cut_lineage(required.join(given.select("case_id"), "case_id", "left_semi"))
    terms = canonical_members(pairs.select("term"), "term").withColumnRenamed("canonical", "canonical_term")
    answers = canonical_members(given.select("reference_answer"), "reference_answer").withColumnRenamed("canonical", "canonical_answer")
    return (
        spread_lookup(pairs, terms, "term")
        .join(spread_lookup(given, answers, "reference_answer"), "case_id")
        .select(
            "case_id", "group_no", "term_no", "term", "canonical_term",
            F.contains("reference_answer", "term").alias("exact"),
            occurs_to_reader(F.col("canonical_answer"), F.col("canonical_term")).alias("visible"),
        )
    )


def unseen_by_machine(facts: DataFrame, cases: DataFrame) -> DataFrame:
    """``case_id, group_no, term_no`` of terms that a reader finds in the answer but a comparison does not."""
    return term_presence(facts, cases).where("visible and not exact").select("case_id", "group_no", "term_no")
