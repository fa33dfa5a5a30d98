"""Problem 2: noise in text from scanned pages.

Running headers are found by fuzzy repetition of lines from page to page, page numbers by their forms and by the
sequence they run in. The remaining lines are joined; words cut at a line end are put together unless the corpus
vocabulary knows them with a hyphen. Misread words and characters are those that the corpus hardly knows, while it
knows well what they would be if one of the usual confusions of recognition were undone.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.session import cut_lineage

#: Lines longer than this are neither headers nor page numbers.
EDGE_LINE = 90
#: Pages on which a line must stand to be a header, where it isn't the name of the document or chapter.
HEADER_PAGES = 3
#: A word or character is misread when its correction is so many times as frequent, and stands so often at least.
WORD_RATIO, WORD_LEAST = 8, 5
NAME_RATIO, NAME_LEAST = 2, 2
LISTED_RATIO, LISTED_LEAST = 4, 5
CONTEXT_RATIO, CONTEXT_LEAST = 20, 20
#: The same for one half of a character's context, that is with one neighbour.
HALF_RATIO = 10

# Letters as recognition confuses them, read and meant.
LETTER_CONFUSIONS = (
    ("0", "o"), ("0", "O"), ("1", "l"), ("1", "i"), ("1", "I"), ("5", "s"), ("5", "S"), ("8", "B"), ("6", "b"), ("6", "G"), ("9", "g"), ("9", "q"), ("2", "z"), ("2", "Z"), ("3", "e"), ("4", "a"),
    ("c", "e"), ("e", "c"), ("l", "i"), ("i", "l"), ("I", "l"), ("l", "I"), ("b", "h"), ("h", "b"), ("ri", "n"), ("rn", "m"), ("m", "rn"), ("cl", "d"), ("d", "cl"), ("ii", "u"), ("u", "ii"),
    ("li", "h"), ("h", "li"), ("vv", "w"), ("w", "vv"), ("nn", "m"), ("tl", "d"), ("f", "t"), ("t", "f"), ("o", "c"), ("c", "o"), ("o", "e"), ("a", "o"), ("n", "u"), ("u", "n"), ("v", "y"), ("q", "g"), ("g", "q"), ("ni", "m"), ("in", "m"), ("j", "i"),
)
# Chinese characters as recognition confuses them, read and meant.
CHARACTER_CONFUSIONS = (
    "木本 曰日 诸储 睑验 杲果 彔录 勋动 倌信 戌成 盐监 椐据 仼任 颂须 夏复 冈区 后启 终络 冇存 弓引 汾份 汁计 末未 未末 滋磁 奌点 艰限 廷延 罝置 伏状 昭照 郡群 沖冲 糸系 吋时 己已 凋调 "
    "巳已 土士 士土 干于 千干 人入 入人 大太 太大 天夭 刀力 力刀 目日 白自 自白 问间 间问 门问 因困 困因 田由 由田 甲申 申甲 免兔 兔免 鸟乌 乌鸟 今令 令今 住往 往住 侯候 候侯 治冶 冶治 "
    "贝见 见贝 待侍 侍待 折拆 拆折 析折 斤斥 名各 各名 壶壸 晴睛 睛晴 密蜜 蜜密 辨辩 辩辨 薄簿 簿薄 管菅 拔拨 拨拔 历厉 厉历 厂广 休体 体休 洒酒 幕慕 慕幕 暮墓 墓暮 茶荼 材村 村材 季李 李季"
).split()

ROMAN = r"[ivxlc]{1,7}|[IVXLC]{1,7}"
NUMBER = rf"(?:\d{{1,4}}|{ROMAN})"
PAGE_NUMBER = re.compile(
    rf"(?P<open>[-—–·•\[(（<«~]\s*)?(?P<word>第\s*|(?:page|pg\.?|p\.)\s*)?(?P<number>{NUMBER})(?P<total>\s*(?:/|of|／)\s*\d{{1,4}})?(?P<leaf>\s*页(?:\s*共\s*\d{{1,4}}\s*页)?)?(?P<close>\s*[-—–·•\])）>»~])?", re.I
)
#: What parts a header from the page number on its line.
PARTED = re.compile(r"[\s|│]+|(?<=[一-鿿])(?=[\[\d—–·-])")
CHAPTER = re.compile(r"(?:chapter|section|part|appendix)\s+\S{1,6}(?:\s|$)|第\s*\S{1,4}\s*[章节篇部编]", re.I)
SENTENCE = re.compile(r"[。，；,;!?！？]|\.\s|\.$")
INVISIBLE = re.compile("[​-‏⁠﻿]")
FOLD = str.maketrans({"0": "o", "1": "i", "l": "i", "5": "s", "8": "b", "9": "g", "e": "c", "h": "b"})
FOLD_PAIRS = (("rn", "m"), ("vv", "w"), ("cl", "d"), ("ii", "u"), ("ri", "n"))
MEANT = {pair[0]: pair[1] for pair in CHARACTER_CONFUSIONS[:46]}


def folded(line: str) -> str:
    """A line's skeleton: without spaces, case and accents' positions, confusable characters made one."""
    text = "".join(MEANT.get(c, c) for c in line.lower() if not c.isspace())
    for read, meant in FOLD_PAIRS:
        text = text.replace(read, meant)
    return text.translate(FOLD)


def roman(text: str) -> int | None:
    """The value of a roman numeral, or null."""
    values = [dict(i=1, v=5, x=10, l=50, c=100).get(c) for c in text.lower()]
    if None in values:
        return None
    return sum(-a if b > a else a for a, b in zip(values, [*values[1:], 0], strict=True))


def page_number(text: str) -> tuple[int, bool] | None:
    """(number, dressed) if ``text`` is a printed page number; dressed ones have marks, a word or a total around them."""
    m = PAGE_NUMBER.fullmatch(text.strip())
    if not m or bool(m["open"]) != bool(m["close"]) and not m["word"]:
        return None
    number = int(m["number"]) if m["number"].isdigit() else roman(m["number"])
    if number is None:
        return None
    return number, bool(m["open"] or m["word"] or m["total"] or m["leaf"])


def edge_lines(text: str, path: Iterable[str] | None) -> list[tuple[int, str, bool, int | None, bool]]:
    """(line, skeleton, named, number, dressed) of the lines that may be headers or page numbers.

    ``skeleton`` is empty for a mere page number. ``named`` lines carry the name of the document or a chapter:
    ``path`` starts with the document's title, whose first word names the product.
    """
    names = [n for n in path or [] if n]
    titles = {folded(n) for n in names[:1]}
    product = names[0].split()[0] if names and names[0].split() else None
    found = []
    for i, line in enumerate(text.split("\n")):
        short = INVISIBLE.sub("", line).strip()
        if not short or len(short) > EDGE_LINE:
            continue
        alone = page_number(short)
        if alone:
            found.append((i, "", False, *alone))
            continue
        body, number, dressed = short, None, False
        for cut in PARTED.finditer(short):
            tail = page_number(short[cut.end() :])
            if tail:
                body, number, dressed = short[: cut.start()].strip(" |│·—–-"), tail[0], True
                break
        if SENTENCE.search(body) and not CHAPTER.match(body) and not re.fullmatch(r"\S+ \d+(?:\.\d+)+", body):
            continue
        skeleton = folded(body)
        version = bool(product and re.fullmatch(re.escape(folded(product)) + r"v?[\dosbgi]+(?:\.[\dosbgi]+)+", skeleton))
        found.append((i, skeleton, skeleton in titles or version or bool(CHAPTER.match(body)), number, dressed))
    return found


EDGE = "array<struct<line:int,skeleton:string,named:boolean,number:int,dressed:boolean>>"


def edges_of(text: Column, path: Column) -> Column:
    @F.pandas_udf(EDGE)
    def edges(texts: pd.Series, paths: pd.Series) -> pd.Series:
        rows = []
        for t, p in zip(texts, paths, strict=True):
            found = edge_lines(t, None if p is None else list(p))
            rows.append([dict(line=a, skeleton=b, named=c, number=d, dressed=e) for a, b, c, d, e in found])
        return pd.Series(rows)

    return edges.asNondeterministic()(text, path)


def scanned(elements: DataFrame) -> DataFrame:
    """The text elements of scanned documents: ``element_id, version, ordinal, page, path, text``, one row each.

    Of repeated rows the one loaded last counts; elements without id or text are left out.
    """
    kept = elements.where("source.kind = 'pdf' and kind = 'text' and element_id is not null and raw_text is not null")
    row = F.struct("loaded_at", F.coalesce("processing_version_id", F.lit("")).alias("version"), "ordinal", F.col("source.page_number").alias("page"), F.col("heading_path").alias("path"), F.col("raw_text").alias("text"))
    last = kept.groupBy("element_id").agg(F.max(row).alias("r"))
    return last.select("element_id", "r.version", "r.ordinal", "r.page", "r.path", "r.text")


def edge_findings(scans: DataFrame) -> DataFrame:
    """``element_id, line, header, number`` of the lines that are running headers, page numbers or both.

    A line is a header if it is named and stands on its own, or recurs on ``HEADER_PAGES`` pages of its version. A
    number is a page number if it is dressed, stands beside a header, or runs in the commonest sequence of its
    version (printed number less page of the file). Counts combine before they shuffle.
    """
    lines = scans.select("element_id", "version", "page", F.explode(edges_of(F.col("text"), F.col("path"))).alias("e"))
    lines = cut_lineage(lines.select("element_id", "version", "page", "e.*").withColumn("offset", F.col("number") - F.col("page")))
    pages = lines.where("skeleton <> ''").groupBy("version", "skeleton", "page").agg(F.max("named").alias("named"))
    names = pages.groupBy("version", "skeleton").agg(F.count(F.lit(1)).alias("pages"), F.max("named").alias("named"))
    headers = names.where(F.col("named") | (F.col("pages") >= HEADER_PAGES)).select("version", "skeleton", F.lit(True).alias("header"))
    runs = lines.where("offset is not null").groupBy("version", "offset").agg(F.count(F.lit(1)).alias("n"))
    best = runs.groupBy("version").agg(F.max("n").alias("most"))
    sequences = runs.join(best, "version").where("n = most").select("version", "offset", F.lit(True).alias("runs"))
    judged = lines.join(headers, ["version", "skeleton"], "left").join(sequences, ["version", "offset"], "left")
    header = F.coalesce("header", F.lit(False))
    number = F.col("number").isNotNull() & (F.coalesce("runs", F.lit(False)) | F.col("dressed")) & ((F.col("skeleton") == "") | header)
    return judged.select("element_id", "line", header.alias("header"), number.alias("number")).where("header or number")


MARKS = "-‐\xad¬"
LETTER = "A-Za-zÀ-ɏ"
CUT = re.compile(rf"(?P<left>[{LETTER}]+)(?P<mark>[{MARKS}])[ \t\r]*\n[ \t\r]*(?P<right>[a-zß-ÿ][{LETTER}]*)")
JOIN = "\ue000"


def joined_text(text: str, dropped: Iterable[int]) -> tuple[str, list[tuple[str, str, str]]]:
    """The text without the dropped lines, in paragraphs; and its cut words (mark, joined, with hyphen).

    Blank lines part paragraphs. Lines in Chinese are joined without a space, others with one. A plain hyphen leaves
    a sign behind, since the vocabulary decides whether it stays; the other marks only ever cut.
    """
    gone = set(dropped)
    kept = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
    cuts = []

    def cut(m: re.Match) -> str:
        if m.string.count("`", 0, m.start()) % 2:  # inside code
            return m[0]
        cuts.append((m["mark"], m["left"] + m["right"], m["left"] + "-" + m["right"]))
        return m["left"] + (JOIN if m["mark"] == "-" else "") + m["right"]

    kept = CUT.sub(cut, kept)
    paragraphs = []
    for block in re.split(r"\n[ \t\r]*\n", kept):
        whole = ""
        for line in (x.strip() for x in block.split("\n")):
            if not line:
                continue
            if whole and not ("一" <= whole[-1] <= "鿿" or whole[-1] in "，。；：、！？）》”" or "一" <= line[0] <= "鿿") and not (whole.count("`") % 2):
                whole += " "
            whole += line
        if whole:
            paragraphs.append(whole)
    return "\n\n".join(paragraphs), cuts


JOINED = "text string, cuts array<struct<mark:string,joined:string,compound:string>>"


def joined_of(text: Column, dropped: Column) -> Column:
    @F.pandas_udf(JOINED)
    def join(texts: pd.Series, lines: pd.Series) -> pd.DataFrame:
        rows = []
        for t, d in zip(texts, lines, strict=True):
            whole, cuts = joined_text(t, [] if d is None else d)
            rows.append((whole, [dict(mark=a, joined=b, compound=c) for a, b, c in cuts]))
        return pd.DataFrame(rows, columns=["text", "cuts"])

    return join.asNondeterministic()(text, dropped)


WORD = r"[A-Za-z0-9\x{c0}-\x{24f}]+(?:-[A-Za-z0-9\x{c0}-\x{24f}]+)*"
#: A path or parameter: characters of identifiers with an inner mark and a letter after it. Chinese beside it stays.
DOTTED = r"[A-Za-z0-9\x{c0}-\x{24f}_-]*[._/](?=[A-Za-z0-9\x{c0}-\x{24f}._/-]*[A-Za-z])[A-Za-z0-9\x{c0}-\x{24f}._/-]*"


def words_of(text: Column) -> Column:
    """Distinct words in letters outside code, digits among them, compounds whole."""
    return F.array_distinct(F.regexp_extract_all(F.regexp_replace(text, rf"`[^`]*`|{DOTTED}", " "), F.lit(WORD), F.lit(0)))


def vocabulary(texts: DataFrame) -> DataFrame:
    """``word, n``: in how many of ``texts (text)`` a lower-cased word stands."""
    return texts.select(F.explode(words_of(F.lower("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def corrections_of(word: str) -> list[str]:
    """What a misread word may have been: one confusion undone, or the same one everywhere, or two."""
    once = {word[:i] + meant + word[i + len(read) :] for read, meant in LETTER_CONFUSIONS for i in range(len(word)) if word.startswith(read, i)}
    for read, meant in LETTER_CONFUSIONS:
        if word.count(read) > 1:
            once.add(word.replace(read, meant))
    found = set(once)
    if any(c.isdigit() for c in word):
        digits = [(r, m) for r, m in LETTER_CONFUSIONS if r.isdigit()]
        found |= {w[:i] + m + w[i + 1 :] for w in once for r, m in digits for i in range(len(w)) if w[i] == r}
    return sorted(w for w in found if w != word and any(c.isalpha() for c in w) and len(w) > 1)


def guesses(word: Column) -> Column:
    @F.pandas_udf("array<string>")
    def guess(words: pd.Series) -> pd.Series:
        return pd.Series([corrections_of(w) for w in words])

    return guess.asNondeterministic()(word)


def misread_words(texts: DataFrame) -> DataFrame:
    """``element_id, word, meant``: words of ``texts (element_id, version, text)`` that were misread.

    The correction must be far more frequent in the corpus; for names, capitalised, it is enough that it stands more
    often in the same version while the word as read stands nowhere else.
    """
    tokens = cut_lineage(texts.select("element_id", "version", F.explode(words_of(F.col("text"))).alias("word")).where(F.length("word") > 1))
    counts = cut_lineage(tokens.groupBy(F.lower("word").alias("low")).agg(F.count(F.lit(1)).alias("n")))
    letters = counts.where(F.col("low").rlike("[a-z]"))
    tried = letters.withColumn("guess", F.explode(guesses(F.col("low"))))
    known = counts.select(F.col("low").alias("guess"), F.col("n").alias("known"))
    likely = tried.join(known, "guess").where((F.col("known") >= WORD_LEAST) & (F.col("known") >= WORD_RATIO * F.col("n")))
    corpus = likely.groupBy("low").agg(F.max_by("guess", F.struct("known", "guess")).alias("meant"))
    common = tokens.withColumn("low", F.lower("word")).join(corpus, "low").select("element_id", "word", "meant")
    named = tokens.where(F.col("word").rlike(r"^[A-Z0-9\x{c0}-\x{24f}][A-Za-z0-9\x{c0}-\x{24f}]*$") & F.col("word").rlike("[a-z]"))
    inside = cut_lineage(named.groupBy("version", F.lower("word").alias("low")).agg(F.count(F.lit(1)).alias("n")))
    elsewhere = inside.groupBy("low").agg(F.count(F.lit(1)).alias("versions"))
    rare = inside.join(elsewhere, "low").where("versions = 1").join(corpus, "low", "left_anti").withColumn("guess", F.explode(guesses(F.col("low"))))
    there = inside.select("version", F.col("low").alias("guess"), F.col("n").alias("known"))
    names = rare.join(there, ["version", "guess"]).where((F.col("known") >= NAME_LEAST) & (F.col("known") >= NAME_RATIO * F.col("n")))
    names = names.groupBy("version", "low").agg(F.max_by("guess", F.struct("known", "guess")).alias("meant"))
    local = named.withColumn("low", F.lower("word")).join(names, ["version", "low"]).select("element_id", "word", "meant")
    return common.unionByName(local).distinct()


SPACES = re.compile(r"\s+")
OTHER_WORD = re.compile(r"[^\W一-鿿]+")
OTHER_MARK = re.compile(r"[^一-鿿A]")


def contexts(text: str) -> list[str]:
    """Each Chinese character between its neighbours, once; others stand as A for a word, a point for a mark, ^ and $ for the ends."""
    plain = f"^{OTHER_MARK.sub('.', OTHER_WORD.sub('A', SPACES.sub('', text)))}$"
    return sorted({g for g in map("".join, zip(plain, plain[1:], plain[2:], strict=False)) if "一" <= g[1] <= "鿿"})


def trigrams(text: Column) -> Column:
    @F.pandas_udf("array<string>")
    def every(texts: pd.Series) -> pd.Series:
        return pd.Series([contexts(t) for t in texts])

    return every.asNondeterministic()(text)


def misread_characters(texts: DataFrame) -> DataFrame:
    """``element_id, word, meant``: a character with its neighbours as read, and as meant.

    In its context another character must be far more frequent. For the usual confusions it is enough that it is
    somewhat so, or that one half of the context says so and the other agrees; for any other pair it must be much
    more so, in both halves.
    """
    grams = cut_lineage(texts.select("element_id", F.explode(trigrams(F.col("text"))).alias("g")))
    counts = grams.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("g", "n", F.substring("g", 1, 1).alias("l"), F.substring("g", 2, 1).alias("x"), F.substring("g", 3, 1).alias("r"))
    left = F.sum("n").over(Window.partitionBy("l", "x"))
    right = F.sum("n").over(Window.partitionBy("x", "r"))
    counts = cut_lineage(counts.withColumn("lx", left).withColumn("xr", right))
    top = counts.groupBy("l", "r").agg(F.max_by(F.struct("x", "n", "lx", "xr"), F.struct("n", "x")).alias("t"))
    top = top.select("l", "r", F.col("t.x").alias("y"), F.col("t.n").alias("m"), F.col("t.lx").alias("ly"), F.col("t.xr").alias("yr"))
    other = counts.join(top.where(F.col("m") >= CONTEXT_LEAST), ["l", "r"]).where((F.col("m") >= CONTEXT_RATIO * F.col("n")) & (F.col("ly") >= HALF_RATIO * F.col("lx")) & (F.col("yr") >= HALF_RATIO * F.col("xr")))
    pairs = F.create_map(*[F.lit(x) for read, meant in sorted({(p[0], p[1]) for p in CHARACTER_CONFUSIONS}) for x in (read, meant)])
    usual = counts.withColumn("y", F.element_at(pairs, F.col("x"))).where("y is not null")
    whole = counts.select("l", F.col("x").alias("y"), "r", F.col("n").alias("m"))
    lefts = counts.groupBy("l", F.col("x").alias("y")).agg(F.max("lx").alias("ly"))
    rights = counts.groupBy(F.col("x").alias("y"), "r").agg(F.max("xr").alias("yr"))
    usual = usual.join(whole, ["l", "y", "r"], "left").join(lefts, ["l", "y"], "left").join(rights, ["y", "r"], "left").na.fill(0, ["m", "ly", "yr"])
    in_context = (F.col("m") >= LISTED_LEAST) & (F.col("m") >= LISTED_RATIO * F.col("n"))
    left_says, right_says = (F.col("ly") >= F.greatest(HALF_RATIO * F.col("lx"), F.lit(HALF_RATIO))), (F.col("yr") >= F.greatest(HALF_RATIO * F.col("xr"), F.lit(HALF_RATIO)))
    halves = (left_says & (F.col("yr") > F.col("xr"))) | (right_says & (F.col("ly") > F.col("lx")))
    usual = usual.where(in_context | halves)
    found = other.select("g", "y").unionByName(usual.select("g", "y")).groupBy("g").agg(F.min("y").alias("y"))
    return grams.join(found, "g").select("element_id", F.col("g").alias("word"), F.concat(F.substring("g", 1, 1), "y", F.substring("g", 3, 1)).alias("meant"))


def misread_numbers(texts: DataFrame) -> DataFrame:
    """``element_id, word, meant``: numbers with letters in place of digits, such as 2O5."""
    number = r"(?<![A-Za-z0-9._`\x{c0}-\x{24f}-])(?=[0-9OolISB]*[0-9])(?=[0-9OolISB]*[OolISB])[0-9OolISB]{2,}(?![A-Za-z0-9._`\x{c0}-\x{24f}-])"
    plain = F.regexp_replace("text", r"`[^`]*`", " ")
    found = texts.select("element_id", F.explode(F.array_distinct(F.regexp_extract_all(plain, F.lit(number), F.lit(0)))).alias("word"))
    return found.withColumn("meant", F.translate("word", "OolISB", "001158"))


def repairs(elements: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Line findings, joined texts with their cut words, and misread words of the scanned elements."""
    scans = cut_lineage(scanned(elements))
    edges = cut_lineage(edge_findings(scans))
    dropped = edges.groupBy("element_id").agg(F.collect_set("line").alias("dropped"))
    texts = scans.join(dropped, "element_id", "left").select("element_id", "version", "ordinal", joined_of(F.col("text"), F.col("dropped")).alias("j"))
    texts = cut_lineage(texts.select("element_id", "version", "ordinal", "j.text", "j.cuts"))
    # a word in doubt counts neither way in the vocabulary
    compounds = texts.select("element_id", F.explode("cuts").alias("c")).where("c.mark = '-'").select("element_id", F.lower("c.joined").alias("joined"), F.lower("c.compound").alias("compound"))
    known = vocabulary(texts.select(F.regexp_replace("text", rf"\S*{JOIN}\S*", " ").alias("text")))
    asked = compounds.select(F.explode(F.array("joined", "compound")).alias("word")).distinct()
    counted = cut_lineage(asked.join(known, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n")))
    whole = counted.select(F.col("word").alias("joined"), F.col("n").alias("whole"))
    hyphened = counted.select(F.col("word").alias("compound"), F.col("n").alias("hyphened"))
    kept = compounds.join(whole, "joined").join(hyphened, "compound").where("hyphened > whole").select("element_id", "compound").distinct()
    kept = kept.groupBy("element_id").agg(F.collect_set("compound").alias("kept"))
    settled = texts.join(kept, "element_id", "left")
    settled = cut_lineage(settled.select("element_id", "version", "ordinal", "cuts", F.coalesce("kept", F.array().cast("array<string>")).alias("kept"), "text"))
    plain = settled.select("element_id", "version", F.regexp_replace("text", JOIN, "").alias("text"))
    misread = misread_words(plain).unionByName(misread_characters(plain)).unionByName(misread_numbers(plain))
    return edges, settled, cut_lineage(misread)


def scan_noise(elements: DataFrame) -> DataFrame:
    """``element_id, noise``: each scanned text element with each kind of noise it carries, once."""
    edges, texts, misread = repairs(elements)
    cut = F.exists("cuts", lambda c: (c["mark"] != "-") | ~F.array_contains(F.col("kept"), F.lower(c["compound"])))
    kinds = (
        texts.where(cut).select("element_id", F.lit("hyphenation").alias("noise")),
        misread.select("element_id", F.lit("misread").alias("noise")),
        edges.where("header").select("element_id", F.lit("running_header").alias("noise")),
        edges.where("number").select("element_id", F.lit("page_number").alias("noise")),
    )
    result = kinds[0]
    for kind in kinds[1:]:
        result = result.unionByName(kind)
    return result.distinct()


def mended(text: str, kept: Iterable[str], read: Iterable[str], meant: Iterable[str]) -> str:
    """``text`` with its cut words settled and its misread words and characters put right."""
    stay = set(kept)
    text = re.sub(rf"([{LETTER}]+){JOIN}([{LETTER}]+)", lambda m: m[1] + ("-" if f"{m[1]}-{m[2]}".lower() in stay else "") + m[2], text).replace(JOIN, "")
    for wrong, right in zip(read, meant, strict=True):
        if len(wrong) == 3 and "一" <= wrong[1] <= "鿿":
            before = {"^": r"^", "A": r"(?<=[^\W一-鿿`])", ".": r"(?<=[^\w])"}.get(wrong[0], f"(?<={re.escape(wrong[0])})")
            after = {"$": r"$", "A": r"(?=[^\W一-鿿`])", ".": r"(?=[^\w])"}.get(wrong[2], f"(?={re.escape(wrong[2])})")
            text = re.sub(f"{before}{wrong[1]}{after}", right[1], text)
        else:
            shape = right.capitalize() if wrong[:1].isupper() or wrong[:1].isdigit() and text.startswith(wrong) else right
            text = re.sub(rf"(?<![\w.`-]){re.escape(wrong)}(?![\w`])", shape, text)
    return text


def repaired_paragraphs(elements: DataFrame) -> DataFrame:
    """``processing_version_id, ordinal, element_id, paragraph``: the readable text of every scanned version, in order.

    Headers and page numbers are gone, cut words whole, lines joined, misread words put right. Elements of which
    nothing remains give no row.
    """
    _, texts, misread = repairs(elements)
    wrong = misread.groupBy("element_id").agg(F.sort_array(F.collect_set(F.struct("word", "meant"))).alias("w"))

    @F.pandas_udf("string")
    def mend(text: pd.Series, kept: pd.Series, read: pd.Series, meant: pd.Series) -> pd.Series:
        return pd.Series([mended(t, k, [] if a is None else a, [] if b is None else b) for t, k, a, b in zip(text, kept, read, meant, strict=True)])

    whole = texts.join(wrong, "element_id", "left").select("version", "ordinal", "element_id", mend("text", "kept", F.col("w.word"), F.col("w.meant")).alias("paragraph"))
    return whole.where("paragraph <> ''").select(F.col("version").alias("processing_version_id"), "ordinal", "element_id", "paragraph")
