"""Problem 7: evaluation texts leaking into training text.

One Aho-Corasick automaton holds short pieces of all normalised evaluation texts. Every document is normalised and
scanned once; hits of an item that follow each other on a diagonal, over scattered changes, form stretches, and the item's text
that these cover decides. Offsets are mapped back to the original document.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Share of an item's normalised text that a document must carry.
LEAST_SHARE = 0.5
#: Normalised characters of the automaton's pieces, for texts in Chinese characters and in letters.
PIECE = {True: 7, False: 16}
#: Pieces start at every third character.
STEP = 3
#: A piece of more than so many items tells little.
COMMON = 2
#: A pair is looked at when the distinct pieces that give notice cover at least 1/SEEDED of the text asked for.
SEEDED = 4
#: Normalised characters below which a stretch isn't counted.
LEAST_STRETCH = {True: 18, False: 40}
#: Evaluation characters in one automaton; more items are scanned in blocks of that size.
BLOCK_CHARS = 2_000_000
#: Added and dropped characters that a gap between two hits of a stretch may hold.
DRIFT = 4

TAG = re.compile(r"<[^<>\n]{1,200}>|&(?:[a-z]{2,8}|#\d{1,6});")


class _Plain(dict):
    """Character to normalised characters: compatibility form, lower case, letters and digits only."""

    def __missing__(self, code: int) -> str | None:
        plain = "".join(c for c in unicodedata.normalize("NFKC", chr(code)).lower() if c.isalnum())
        self[code] = plain or None
        return self[code]


PLAIN = _Plain()


def normalised(text: str) -> str:
    """``text`` without markup, marks, punctuation, spaces and invisible characters, in lower case and plain width."""
    if "<" in text or "&" in text:
        text = TAG.sub(" ", text)
    return text.translate(PLAIN)


def original_offsets(text: str) -> list[int]:
    """For each character of ``normalised(text)`` its position in ``text``."""
    if "<" in text or "&" in text:
        text = TAG.sub(lambda m: " " * len(m[0]), text)
    return [i for i, c in enumerate(text) for _ in PLAIN[ord(c)] or ""]


def in_characters(text: str) -> bool:
    """Whether a normalised text is mostly in Chinese characters."""
    return 3 * sum("一" <= c <= "鿿" for c in text) > len(text)


def pieces_of(text: str) -> dict[str, list[int]]:
    """The pieces of a normalised item and where they start."""
    n = min(PIECE[in_characters(text)], len(text))
    where: dict[str, list[int]] = defaultdict(list)
    for at in sorted({*range(0, len(text) - n + 1, STEP), len(text) - n}):
        where[text[at : at + n]].append(at)
    return where


@functools.lru_cache(maxsize=2)
def automaton(items: tuple[tuple[int, str], ...]):
    """The automaton of a block of (item, normalised text), and each item's own pieces.

    A piece's value is its number and the items, by index, that it gives notice of: all that hold it, or where these are
    more than ``COMMON`` only those most of whose pieces are as common.
    """
    import ahocorasick

    own = [pieces_of(text) for _, text in items]
    holders: dict[str, list[int]] = defaultdict(list)
    for k, pieces in enumerate(own):
        for piece in pieces:
            holders[piece].append(k)
    plain = [2 * sum(len(holders[p]) > COMMON for p in pieces) > len(pieces) for pieces in own]
    found = ahocorasick.Automaton()
    for number, (piece, ks) in enumerate(holders.items()):
        noticed = [k for k in ks if len(ks) <= COMMON or plain[k]]
        if noticed:
            found.add_word(piece, (number, noticed))
    found.make_automaton()
    return found, own


def stretches(hits: list[tuple[int, int]], piece: int, least: int) -> list[tuple[int, int, int, int]]:
    """(item start, item end, document start, document end) of an item's stretches in a document.

    ``hits`` are (document position, item position) of common pieces of ``piece`` characters. A scattered change
    costs the pieces around it, and an added or dropped character moves the diagonal by one; hits that go on within
    such a gap on about the same diagonal are one stretch. Stretches shorter than ``least`` are dropped.
    """
    gap = 2 * (piece + STEP)
    done: list[list[int]] = []
    going: list[list[int]] = []
    for d, i in sorted(hits):
        stale = [r for r in going if d - r[3] > gap]
        if stale:
            done += stale
            going = [r for r in going if d - r[3] <= gap]
        near = [r for r in going if -piece <= i - r[1] <= gap and abs((d - i) - (r[3] - r[1])) <= DRIFT]
        if near:
            run = min(near, key=lambda r: abs((d - i) - (r[3] - r[1])))
            run[1], run[3] = max(run[1], i + piece), d + piece
        else:
            going.append([i, i + piece, d, d + piece])
    return [tuple(r) for r in done + going if r[1] - r[0] >= least]


def covered(spans: list[tuple[int, int]]) -> int:
    """Characters in the union of ``spans``."""
    total, end = 0, 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


def leaks_in(text: str, items: tuple[tuple[int, str], ...], least_share: float) -> Iterator[tuple[int, float, int, int]]:
    """(item id, share of the item carried, first and last original offset) of the items that ``text`` leaks.

    The automaton names the items of which enough pieces stand in the text; all pieces of these are then placed.
    """
    plain = normalised(text)
    found, own = automaton(items)
    distinct = {number: ks for _, (number, ks) in found.iter(plain)}
    seen = Counter(k for ks in distinct.values() for k in ks)
    offsets = None
    for k, n in seen.items():
        item_id, item = items[k]
        if n * STEP * SEEDED < least_share * len(item):
            continue
        chinese = in_characters(item)
        size = min(PIECE[chinese], len(item))
        hits = [(d, at) for d in range(len(plain) - size + 1) for at in own[k].get(plain[d : d + size], ())]
        runs = stretches(hits, size, min(LEAST_STRETCH[chinese], len(item)))
        share = covered([r[:2] for r in runs]) / len(item)
        if share >= least_share:
            offsets = original_offsets(text) if offsets is None else offsets
            yield item_id, share, offsets[min(r[2] for r in runs)], offsets[max(r[3] for r in runs) - 1] + 1


def item_blocks(items: DataFrame, block_chars: int = BLOCK_CHARS) -> list[tuple[tuple[int, str], ...]]:
    """The evaluation items on the driver, normalised, in blocks of at most about ``block_chars`` characters.

    The evaluation set is a small table of fixed size by its nature; ids and texts that are null, and texts without
    letters or digits, are left out.
    """
    blocks: list[list[tuple[int, str]]] = [[]]
    size = 0
    for item_id, text in items.where("item_id is not null and text is not null").select("item_id", "text").distinct().orderBy("item_id", "text").toLocalIterator():
        plain = normalised(text)
        if not plain:
            continue
        if size and size + len(plain) > block_chars:
            blocks.append([])
            size = 0
        blocks[-1].append((item_id, plain))
        size += len(plain)
    return [tuple(b) for b in blocks if b]


def leaked_items(documents: DataFrame, items: DataFrame, least_share: float = LEAST_SHARE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, item_id, share, first_char, last_char``: documents that carry at least ``least_share`` of an item.

    ``share`` is that of the item's normalised text; the offsets bound the leaked text in the original document.
    Whole texts are scanned, in place, without a shuffle. Null texts and ids give no row; documents in which nothing
    leaks neither; repeated rows give repeated rows. Extra columns play no part.
    """
    schema = "doc_id long, item_id long, share double, first_char int, last_char int"
    texts = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    spark = documents.sparkSession
    result = None
    for block in item_blocks(items, block_chars):
        shared = spark.sparkContext.broadcast(block)

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = [(doc, *leak) for doc, text in zip(batch["doc_id"], batch["text"], strict=True) for leak in leaks_in(text, shared.value, least_share)]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "share", "first_char", "last_char"])

        part = texts.mapInPandas(scan, schema)
        result = part if result is None else result.unionByName(part)
    return result if result is not None else spark.createDataFrame([], schema)


def leaking_documents(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id``, each pair once."""
    return leaked_items(documents, items).select("doc_id", "item_id").distinct()
