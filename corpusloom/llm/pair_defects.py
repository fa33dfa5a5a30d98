"""Problem 4: broken prompt and response pairs.

Answers that say nothing, that only decline, that give the question back, that stop early, or that are in another
language. Copies are found by shingle containment and the longest common subsequence of prompt and response tokens;
refusals by aligning the response with refusal templates.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.visual_text import SAME_SHAPE_FROM, SAME_SHAPE_TO

#: Words of the shingles that prompt and response are compared by.
SHINGLE = 3
#: Share of the response's shingles in the prompt, and of the prompt in their common subsequence, of a copy.
COPY_CONTAINMENT, COPY_SUBSEQUENCE = 0.6, 0.75
#: The same of a response that leaves out a clause of the prompt and adds nothing.
PART_CONTAINMENT, PART_SUBSEQUENCE = 0.9, 0.5
#: Share of a refusal template that the response must follow, and tokens that it may have beside it.
REFUSAL_FOLLOWED, REFUSAL_REST = 0.75, 14

TOKEN = re.compile(r"[一-鿿぀-ヿ가-힣]|[^\W_一-鿿぀-ヿ가-힣]+")
INVISIBLE = re.compile("[\xad​-‏⁠﻿]")
LEAD = re.compile(r"^\s*(?:答案如下|回答如下|答案|回答|答复|答|answers?|response|reply|re|a)\s*[:：]\s*", re.I)
THANKS = re.compile(r"^\s*(?:(?:感谢|谢谢)(?:您的?|你的?)?(?:提问|咨询|来信|反馈)?|您好|你好|thanks?(?: you)?(?: for (?:asking|your question|reaching out))?|hello|hi)\s*[,.!。，！]\s*", re.I)

# Answers that say nothing at all.
NOTHING = frozenset("null none nil nan n/a na undefined empty blank tbd todo tba 空 暂无 待定 待补充 待填写 无内容 未填写 略".split())

# Refusal templates; a star stands for what is declined.
REFUSALS = (
    "抱歉，我无法回答这个问题。",
    "这一点恕我无可奉告。",
    "我没有足够的权限查看相关资料，所以不能提供答案。",
    "对不起，关于*的内容我不便透露。",
    "这个问题超出了我的能力范围，恕不作答。",
    "暂时答不上来，请换一个问题试试。",
    "不好意思，这里帮不上忙，麻烦查阅其他渠道。",
    "目前不支持回答此类内容，还望谅解。",
    "很遗憾，目前没有办法就此提供答复，建议您联系*的维护团队。",
    "作为一个语言模型，我不能对*给出具体意见。",
    "I'm sorry, but I cannot answer this question.",
    "Sorry, that one I have to pass on.",
    "Apologies - I would rather not respond to this request.",
    "I don't have access to that material and must decline.",
    "Unfortunately this is something I can't assist with; please contact the * maintainers.",
    "As a language model I am unable to comment on *.",
    "That goes beyond what I am able to discuss.",
    "I am not able to help with this request.",
)
#: Phrases in the first person by which a short answer declines, whatever its template.
DECLINES = re.compile(
    r"我(?:无法|不能|没法|没有办法)(?:回答|作答|提供|给出|透露|答复|帮助|协助|对)|无可奉告|恕不|恕难|恕我|不便(?:透露|回答|作答)|答不上来|帮不上忙|不支持回答|没有办法就此|无法(?:就此|为您|为你)|超出了?我的"
    r"|\bi(?:'m| am)? (?:cannot|can't|can not|could not|couldn't|unable|not able|won't|will not|would rather not|must decline|have to (?:pass|decline))\b"
    r"|\b(?:i am|i'm) (?:unable|not able|not allowed|not permitted)\b|\bmust decline\b|\bpass on\b|\bi (?:can't|cannot) (?:assist|help)\b|beyond what i\b|as an? (?:ai |large )?language model",
    re.I,
)

SHAPES = str.maketrans(SAME_SHAPE_FROM, SAME_SHAPE_TO)
FENCE = re.compile(r"```.*?(?:```|$)", re.S)
CODE = re.compile(r"`[^`\n]*`")
CLOSED = ".。!！?？"
BROKEN = re.compile(r"(?:[,，、:：;；(（\[“《<=+/\\-]|…|\.{2,}|->|→)$")
#: Units of readings, by which a cut reading shows.
UNITS = frozenset("k s ms μs us ns min h % kib mib gib tib kb mb gb tb b ops qps iops px °c v a w hz khz mhz ghz 秒 分钟 小时 天 次 个 份 台".split())
READING = re.compile(r"[\d.]+\s*(\S{1,4})$")
#: Chinese predicates, which a value or a name doesn't hold.
PREDICATE = re.compile(r"是|为|会|由|把|需要|可以|不再|必须|每隔|最多|暂时|尝试|拒绝|负责|以便|而|如果|一旦|因此|并且|但是|以及")

# Frequent words that tell languages written in Latin letters apart.
LATIN_WORDS = {
    "en": frozenset("the of and is are was were to in with for it its when an that this which be by on from at as not only has have after before until while if once".split()),
    "de": frozenset("der die das und ist nicht ein eine für nur wie oft den dem des vor nach wieder muss wird werden bei mit auf zu sich von im zum".split()),
    "fr": frozenset("le la les des une un et est en de du pour il faut que avant après tout son au aux uniquement cas dans par sur ne pas".split()),
    "es": frozenset("el la los las una un y es en de del para que hay antes después solo su al con por cada se si no".split()),
    "it": frozenset("il lo la gli le una un e è in di del della per che prima dopo solo suo al con ogni si se non".split()),
    "pt": frozenset("o a os as uma um e é em de do da para que antes depois só seu ao com cada se não".split()),
    "nl": frozenset("de het een en is niet voor alleen van bij met op te zich na wordt worden moet".split()),
}
# Names of languages in requests.
LANGUAGES = (
    ("en", r"英文|英语|\benglish\b"), ("zh", r"中文|汉语|简体|\bchinese\b|\bmandarin\b"), ("ja", r"日文|日语|\bjapanese\b"), ("ko", r"韩文|韩语|\bkorean\b"), ("ru", r"俄文|俄语|\brussian\b"),
    ("fr", r"法文|法语|\bfrench\b"), ("de", r"德文|德语|\bgerman\b"), ("es", r"西班牙[文语]|\bspanish\b"), ("it", r"意大利[文语]|\bitalian\b"), ("pt", r"葡萄牙[文语]|\bportuguese\b"),
)
REQUEST = re.compile(r"(?:请?(?:使?用|以)\S{0,6}?(?:回答|作答|答复|书写|说明)|回答请\S{0,4}?用\S{0,6}|(?:answer|reply|respond|write)\b[^.?!]{0,30}\bin \w+|\bin \w+,? please|(?:translate|翻译)[^.?!。？！]{0,30})", re.I)


def plain(text: str | None) -> str:
    """``text`` in compatibility form, without invisible characters and outer white space; null becomes empty."""
    return INVISIBLE.sub("", unicodedata.normalize("NFKC", text or "")).strip()


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence of two token lists, by a bit per token of ``a``."""
    places: dict[str, int] = {}
    for i, t in enumerate(a):
        places[t] = places.get(t, 0) | 1 << i
    free = (1 << len(a)) - 1
    mask = free
    for t in b:
        hit = free & places.get(t, 0)
        free = ((free + hit) | (free - hit)) & mask
    return len(a) - free.bit_count()


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    return set(zip(*[words[i:] for i in range(SHINGLE)], strict=False)) or ({tuple(words)} if words else set())


def is_empty(answer: str) -> bool:
    """Whether an answer says nothing: no letter or digit beside a lead such as "A:", or a placeholder."""
    said = LEAD.sub("", answer, count=1) if LEAD.match(answer) else answer
    core = said.strip().strip("()[]{}<>\"'“”‘’*_`.。-—… ").lower()
    return not any(c.isalnum() for c in core) or core in NOTHING


TEMPLATES = [([tokens(part) for part in template.split("*")], len(tokens(template))) for template in REFUSALS]


def is_refusal(answer: str, question: str = "") -> bool:
    """Whether an answer only declines: it follows a template, or is short, says so in the first person and has no facts.

    However long it is, few words may remain that neither the template nor the question explains.
    """
    said = answer
    while THANKS.match(said):
        said = THANKS.sub("", said, count=1)
    said = LEAD.sub("", said, count=1)
    words = tokens(said)
    if not words:
        return False
    own = Counter(words)
    restated = (own & (asked_words := Counter(tokens(question)))).total()
    for parts, length in TEMPLATES:
        rest = REFUSAL_REST if len(parts) > 1 else 4
        if len(words) - length - restated > rest:
            continue
        wanted = [w for part in parts for w in part]
        followed = subsequence(wanted, words)
        asked = ((own - Counter(wanted)) & asked_words).total()
        if followed >= REFUSAL_FOLLOWED * length + 0.5 and len(words) - followed - asked <= rest:
            return True
    short = len(words) <= 45 and len(re.findall(r"[。.!?！？](?:\s|$)", said)) <= 2
    return bool(short and DECLINES.search(said) and not re.search(r"\d", said) and "`" not in said)


def is_copy(question: str, answer: str) -> bool:
    """Whether an answer only gives the question back, also twice or with a lead."""
    q, a = tokens(question), tokens(LEAD.sub("", answer, count=1))
    if len(q) < 4 or len(a) < PART_SUBSEQUENCE * len(q):
        return False
    own, asked = shingles(a), shingles(q)
    contained = len(own & asked) / len(own)
    if contained < min(COPY_CONTAINMENT, PART_CONTAINMENT):
        return False
    common = subsequence(q, a) / len(q)
    return contained >= COPY_CONTAINMENT and common >= COPY_SUBSEQUENCE or contained >= PART_CONTAINMENT and common >= PART_SUBSEQUENCE


def is_value(segment: str) -> bool:
    """Whether a stretch without a full stop is a complete value: a name, a code, a reading, a path, a command."""
    s = segment.strip().strip("*_ ")
    if CODE.fullmatch(s) or re.fullmatch(r"[\w.-]+", s):
        return True
    reading = READING.search(s)
    spoken = len(re.findall(r"[A-Za-zÀ-ɏ]{2,}", CODE.sub("", s)))
    if "，" in s or re.search(r"[一-鿿],", s) or ", " in s and spoken > 4:
        return False
    if reading and len(s) < 80 and (reading[1].lower() in UNITS or reading[1].replace(".", "").isdigit()):
        return True
    if re.search(r"[一-鿿]", s):
        return not PREDICATE.search(s) and len(re.findall(r"[一-鿿]", s)) <= 24
    if re.match(r"[a-z][\w-]*(?:ctl|cli)? \w+.* --\w", s) or " > " in s or "→" in s:
        return not s.endswith(("-", ">", "→"))
    words = s.lower().split()
    return len(words) <= 5 and not any(w in LATIN_WORDS["en"] for w in words)


def is_truncated(answer: str) -> bool:
    """Whether an answer stops before it is complete.

    An open code block, an ending that calls for more, or a last stretch without a full stop that is no value, or
    that lacks what the items before it have. A value alone is complete.
    """
    answer = answer.translate(SHAPES)
    if answer.count("```") % 2:
        return True
    if answer.endswith("```"):
        return False
    end = answer.rstrip("*_\"'”’』」)）】]> ")
    if not end:
        return False
    if BROKEN.search(end) and not re.search(r"[)）】\]]$", answer.rstrip("*_ ")):
        return True
    if end[-1] in CLOSED:
        return False
    body = CODE.sub("`x`", FENCE.sub("", end))
    lines = [x.strip() for x in body.split("\n") if x.strip()]
    last = lines[-1] if lines else end
    stretches = [x for x in re.split(r"[。！？!?]|\.(?=\s)", last) if x.strip()]
    tail = stretches[-1] if stretches else last
    items = [x.strip() for x in re.split(r"[;；]", tail) if x.strip()]
    if len(items) >= 2 and all(re.search(r"[:：=]\s*\S", x) for x in items[:-1]):  # readings in a row
        final = items[-1]
        if not re.search(r"[:：=]\s*\S", final):
            return True
        before, here = READING.search(items[0]), READING.search(final)
        return bool(before and (not here or not (here[1].lower() in UNITS)))
    closed_before = len(stretches) > 1 or any(x[-1] in CLOSED for x in lines[:-1])
    if "|" in last and last.count("|") >= 2 and len(lines) > 1:
        return not last.endswith("|") and lines[0].endswith("|")
    tail = re.sub(r"^\s*(?:[-*•·+]|\d{1,2}[.)、])\s+", "", tail)
    if closed_before:
        return True
    return not is_value(tail)


def language_of(text: str) -> str:
    """Language that the sentences of ``text`` are in; empty for values, names, codes and too little text."""
    body = CODE.sub(" ", FENCE.sub(" ", text))
    kana, hangul = len(re.findall(r"[぀-ヿ]", body)), len(re.findall(r"[가-힣]", body))
    if kana >= 3:
        return "ja"
    if hangul >= 3:
        return "ko"
    if sum(map(len, re.findall(r"[а-яёА-ЯЁ]{3,}", body))) >= 8:
        return "ru"
    for name, span in (("ar", "؀-ۿ"), ("he", "֐-׿"), ("th", "฀-๿"), ("hi", "ऀ-ॿ"), ("el", "Ͱ-Ͽ")):
        if len(re.findall(f"[{span}]{{2,}}", body)) >= 2:
            return name
    chinese = len(re.findall(r"[一-鿿]", body))
    words = re.findall(r"[a-zà-ÿœ]{1,}(?:'[a-z]+)?", body.lower())
    if chinese >= 6 and chinese * 3 >= len(words):
        return "zh"
    counts = {k: sum(w in v for w in words) for k, v in LATIN_WORDS.items()}
    best = max(counts, key=lambda k: (counts[k], k == "en"))
    return best if len(words) >= 5 and counts[best] >= 2 else ""


def in_other_language(question: str, answer: str) -> bool:
    """Whether the answer's sentences are in another language than the question's, or than the one it asks for."""
    asked = language_of(question)
    wanted = {asked}
    for request in REQUEST.findall(question):
        wanted |= {name for name, words in LANGUAGES if re.search(words, request, re.I)}
    given = language_of(answer)
    if not asked or not given or given in wanted:
        return False
    if given == "zh":  # a Chinese value under an English question is a value
        return bool(re.search(r"[。，,;；]", answer)) and len(re.findall(r"[一-鿿]", answer)) >= 10 and not all(is_value(x) for x in re.split(r"[;；\n]", answer) if x.strip())
    return True


def defect_of(question: str | None, answer: str | None, answerable: bool | None) -> str | None:
    """The first defect of a pair in the order empty, refusal, copied, truncated, other_language; null if it has none."""
    a = plain(answer)
    if is_empty(a):
        return "empty"
    if answerable is not True:
        return None
    q = plain(question)
    if is_refusal(a, q):
        return "refusal"
    if is_copy(q, a):
        return "copied"
    if is_truncated(a):
        return "truncated"
    if in_other_language(q, a):
        return "other_language"
    return None


def defect(question: Column, answer: Column, answerable: Column) -> Column:
    """The defect of each pair, or null."""

    @F.pandas_udf("string")
    def defects(questions: pd.Series, answers: pd.Series, flags: pd.Series) -> pd.Series:
        pairs = zip(questions, answers, flags, strict=True)
        return pd.Series([defect_of(q, a, None if f is None or f != f else bool(f)) for q, a, f in pairs], dtype="object")

    return defects.asNondeterministic()(question, answer, answerable)


def broken_pairs(cases: DataFrame) -> DataFrame:
    """``case_id, defect`` of every defective pair, each case once.

    Repeated rows of a case count once; of differing rows the one loaded last counts. A null answer is empty; a null
    question is compared as an empty one; ``answerable`` null or false lets only ``empty`` count. Rows without
    ``case_id`` are left out.
    """
    pair = F.struct("loaded_at", "question", "reference_answer", "answerable")
    last = cases.where("case_id is not null").groupBy("case_id").agg(F.max(pair).alias("p"))
    found = last.select("case_id", defect(F.col("p.question"), F.col("p.reference_answer"), F.col("p.answerable")).alias("defect"))
    return found.where("defect is not null")
