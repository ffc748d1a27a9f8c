"""The bilingual keyword lexicon of the rule-based extractor, and the patterns made from it."""

from __future__ import annotations

import os
import re

#: Keywords and weights by node type. Phrases and Chinese words match as they are, single words with their inflections.
KEYWORDS = {
    "Retrieve": (
        ("according to", 1.0), ("by theorem", 1.0), ("from the definition", 1.0), ("recall that", 1.0), ("we know that", 0.5), ("the rule", 0.5),
        ("property states", 0.5), ("by definition", 0.5), ("the theorem states", 0.5), ("as established", 0.5), ("formula", 1.0), ("theorem", 1.0),
        ("recall", 1.0), ("definition", 0.5), ("rule", 0.5), ("根据", 1.0), ("由定义", 1.0), ("根据定理", 1.0), ("由公式", 1.0),
        ("我们知道", 1.0), ("由性质", 1.0), ("由引理", 1.0), ("根据性质", 1.0), ("回忆", 0.5),
    ),
    "Transform": (
        ("plug in", 0.5), ("otherwise", 0.5), ("calculate", 1.0), ("compute", 1.0), ("simplify", 1.0), ("substitute", 1.0), ("derive", 1.0),
        ("solve", 0.5), ("evaluate", 0.5), ("apply", 0.5), ("计算", 1.0), ("化简", 1.0), ("代入", 1.0), ("推导", 1.0), ("求解", 1.0),
        ("展开", 1.0), ("整理得", 1.0), ("可得", 1.0), ("解得", 1.0), ("得到", 1.0),
    ),
    "Compare": (
        ("larger than", 1.0), ("smaller than", 1.0), ("greater than", 1.0), ("less than", 1.0), ("difference between", 1.0), ("same as", 0.5),
        ("similar to", 0.5), ("vs.", 0.5), ("compare", 1.0), ("比较", 1.0), ("大于", 1.0), ("小于", 1.0), ("大于等于", 1.0), ("小于等于", 1.0),
        ("对比", 1.0), ("相比之下", 1.0), ("两者差异", 1.0), ("优于", 1.0), ("劣于", 1.0),
    ),
    "Verify": (
        ("make sure", 0.5), ("let me check", 0.5), ("check if", 1.0), ("verify if", 1.0), ("test if", 0.5), ("check", 1.0), ("verify", 1.0),
        ("confirm", 1.0), ("test", 0.5), ("indeed", 0.5), ("consistent", 1.0), ("correct", 0.5), ("valid", 0.5), ("matches", 0.5),
        ("satisfies", 0.5), ("holds", 0.5), ("验证", 1.0), ("检验", 1.0), ("确认", 1.0), ("检查", 1.0), ("符合", 1.0), ("匹配", 1.0),
        ("正确", 1.0), ("成立", 1.0), ("满足", 1.0), ("一致", 1.0),
    ),
    "Branch": (
        ("in that case", 0.5), ("when then", 0.5), ("on the other hand", 0.5), ("if", 1.0), ("suppose", 1.0), ("assume", 1.0), ("case", 0.5),
        ("alternatively", 0.5), ("如果", 1.0), ("假设", 1.0), ("假定", 1.0), ("则", 1.0), ("否则", 1.0), ("当", 1.0), ("若", 1.0),
        ("分类讨论", 1.0), ("考虑", 1.0), ("分情况", 1.0),
    ),
    "Backtrack": (
        ("let me rethink", 0.5), ("scratch that", 0.5), ("let me re-evaluate", 0.5), ("i made a mistake", 0.5), ("that's wrong", 0.5),
        ("let me try", 0.5), ("wait", 1.0), ("actually", 1.0), ("correction", 1.0), ("instead", 1.0), ("reconsider", 1.0), ("oops", 1.0),
        ("mistake", 0.5), ("wrong", 0.5), ("等等", 1.0), ("不对", 1.0), ("错误", 1.0), ("更正", 1.0), ("重新考虑", 1.0), ("我错了", 1.0),
        ("搞错了", 1.0), ("重新计算", 1.0), ("实际上", 1.0), ("或者", 0.5),
    ),
}

#: Of equal scores the type with the higher number wins.
PRIORITY = {"Branch": 6, "Backtrack": 5, "Compare": 4, "Verify": 3, "Retrieve": 2, "Transform": 1}

#: Patterns of negation, of an equation, and of doubt.
_VERBS = r"(?:check(?:ing|s|ed)?|verify(?:ing|s|ied|fies)?|comput(?:e|ing|es|ed)|calculat(?:e|ing|es|ed)|compar(?:e|ing|es|ed))"
NEGATIONS = (rf"\bnot\s+(?:\w+\s+){{0,2}}{_VERBS}\b", rf"\bnot\s+need\s+to\s+{_VERBS}\b", r"\bno\s+need\s+to\b", rf"\bwithout\s+{_VERBS}\b")
EQUATION = r"(?<![<!>=])\w+\s*=\s*\w+(?![=<>])"
DOUBT = r"\?|uncertain|not sure|maybe|perhaps|hmm|不确定|也许|可能|怀疑"

_CHINESE = re.compile(r"[\u3000-\u303f\u4e00-\u9fff]+")


def forms(word: str) -> list[str] | None:
    """The inflected forms that count for a single English word; None for phrases and Chinese, which match as they are."""
    if " " in word or _CHINESE.fullmatch(word):
        return None
    before = word[-2:-1]
    if len(word) > 2 and word[-1] in "ey" and before not in "aeiou":
        stem = word[:-1]
        return [word, word + "s", *([word + "d", stem + "ing"] if word[-1] == "e" else [stem + "ied", stem + "ies", word + "ing"])]
    return [word + end for end in ("", "s", "ed", "ing", "es")]


def pattern(word: str, edge: tuple[str, str] = (r"\b", r"\b")) -> str:
    """A regular expression for a keyword in lower-case text; edge: what stands for word boundaries."""
    if _CHINESE.fullmatch(word):
        return word
    of = forms(word)
    said = "(?:" + "|".join(map(re.escape, of)) + ")" if of else re.escape(word).replace("\\ ", " ")
    return edge[0] + said.replace("\\-", "-").replace("\\'", "'") + edge[1]


def stem(word: str) -> str:
    """What every text that matches pattern(word) contains: the letters that all forms begin with."""
    return os.path.commonprefix(forms(word) or [word])
