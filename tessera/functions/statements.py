"""What a writer says of themselves, sentence by sentence: struggles, lessons, likes and projects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: People who aren't the writer, and openings of what is only supposed.
OTHERS = ("朋友", "同学", "老师", "家人", "组员", "队友", "学生")
SUPPOSED = ("如果", "假如", "假设", "比如", "例如")
#: The words of each kind of statement.
ONCE_THOUGHT, NOT_SO, BUT_SO = ("原来", "我之前以为"), ("不是", "不应该"), ("而是", "其实", "现在")
AGAIN, TROUBLE = ("一直", "总是", "反复", "每次", "又", "经常"), ("卡住", "卡在", "不会", "搞不懂", "出错", "失败")
LEARNED = ("已经理解", "已经明白", "学会了", "会用了", "弄懂了", "明白了")
LIKES = ("更喜欢", "喜欢", "偏好", "习惯", "希望以后", "不喜欢")
DOING, MADE = ("正在", "目前正在", "这次在"), ("做", "制作", "设计", "开发", "研究", "尝试")
WORK, STATES = ("项目", "作品", "课题"), ("正在", "是", "使用", "采用", "面向", "要做", "包含", "已经", "计划", "聚焦")

_END = "。！？!?"


def _any(words: tuple[str, ...]) -> str:
    return "(?:" + "|".join(words) + ")"


#: The writer, and not someone of theirs.
_I = f"我(?!的?{_any(OTHERS)})"
#: Where a clause begins.
_CLAUSE = "(?:^|[，,；;。！!])"


def _then(*parts: str) -> str:
    """Parts in order, with anything but a line's end between them."""
    return ".*".join(parts)


def _within(n: int) -> str:
    return f"[^{_END}]{{0,{n}}}"


#: Kind, weight and pattern, in the order in which they are looked for.
KINDS = (
    ("MISCONCEPTION_CORRECTED", 2, _then(_any(ONCE_THOUGHT), _any(NOT_SO), _any(BUT_SO))),
    ("RECURRING_STRUGGLE", 2, _I + _within(40) + _any(AGAIN) + _within(80) + _any(TROUBLE)),
    ("LEARNED_CONCEPT", 2, _then(_I, _any(LEARNED))),
    ("PREFERENCE", 1, _then(_I, _any(LIKES))),
    ("PROJECT_FACT", 2, f"我{_any(DOING)}{_any(MADE)}|(?:我的|这次){_any(WORK)}{_any(STATES)}"),
)


def whole_sentences(text: Column) -> Column:
    """Sentences with the sign that ends them, without blanks around."""
    cut = F.regexp_extract_all(text, F.lit(rf"([^{_END}\n]+[{_END}]?)"), 1)
    return F.filter(F.transform(cut, lambda s: F.regexp_replace(s, r"^[\s　 ]+|[\s　 ]+$", "")), lambda s: s != "")


def is_self_report(sentence: Column) -> Column:
    """A statement, not a question or a supposition, of which a clause begins with the writer."""
    asked = sentence.rlike(r"[?？]\s*$")
    supposed = sentence.rlike(f"{_CLAUSE}{_any(SUPPOSED)}[^{_END}]*我")
    return ~asked & ~supposed & sentence.rlike(_CLAUSE + _I)


def explicit_statements(text: Column, most: int = 3) -> Column:
    """Of each kind the first sentence that tells it: an array of ``kind, quote, weight`` in the order of the kinds, at most ``most``.

    Nulls and texts without such a sentence give an empty array.  Personal data
    should be masked before, as quotes are kept.
    """
    said = F.filter(whole_sentences(F.coalesce(text, F.lit(""))), is_self_report)

    def first(kind: str, weight: int, pattern: str) -> Column:
        quote = F.try_element_at(F.filter(said, lambda s: s.rlike(pattern)), F.lit(1))
        return F.when(quote.isNotNull(), F.struct(F.lit(kind).alias("kind"), quote.alias("quote"), F.lit(weight).alias("weight")))

    return F.slice(F.array_compact(F.array(*[first(*k) for k in KINDS])), 1, most)
