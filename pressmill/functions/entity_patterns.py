"""Patterns that find a company in text, made from the kinds of its name's words."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

#: Words that bind parts of a name, and articles (fixed values).
BINDINGS = ("-", "&", "+", "and", "und", "y", "et", "'")
ARTICLES = ("les", "le", "de", "des", "du", "del", "l'", "la", "mon", "the", "der", "die", "das")


@dataclass
class Lexicons:
    """Word lists, in lower case; the larger ones come from data."""

    common: frozenset[str] = frozenset()
    industry: frozenset[str] = frozenset()
    persons: frozenset[str] = frozenset()
    legal: frozenset[str] = frozenset()
    bindings: frozenset[str] = field(default_factory=lambda: frozenset(BINDINGS))
    articles: frozenset[str] = field(default_factory=lambda: frozenset(ARTICLES))


def word_type(word: str, lexicons: Lexicons) -> str:
    """The kind of a word; of several the first in this order."""
    low, letters = word.lower(), [c for c in word if c.isalpha()]
    short = len(word) < 4
    if low in lexicons.bindings:
        return "BINDING"
    if low in lexicons.articles:
        return "ARTICLE"
    if low in lexicons.common:
        return "COMMON"
    inner = any(c.isupper() for c in word[1:])
    if letters and ((any(c.isdigit() for c in word)) or (inner and any(c.islower() for c in word))):
        return "MIX_SHORT" if short else "MIX"
    if letters and low not in lexicons.industry | lexicons.persons | lexicons.legal and (word.isupper() or word.islower()) and not re.fullmatch(r"[A-ZÄÖÜ]\.([A-ZÄÖÜ]\.)?", word):
        return "UOL_SHORT" if short else "UOL"
    if low in lexicons.industry:
        return "INDU"
    if word.isdigit():
        return "LONG_NUM" if len(word) >= 5 else "SHORT_NUM"
    if low in lexicons.persons:
        return "PER_NAME"
    if re.fullmatch(r"[A-ZÄÖÜ]\.([A-ZÄÖÜ]\.)?", word):
        return "PER_INITIAL"
    if low in lexicons.legal:
        return "LEGAL"
    return "UNKNOWN_SHORT" if short else "UNKNOWN"


#: How much a word of a kind tells about which company is meant; a name is told once it has ENOUGH.
TELLS = {
    "MIX": 3.0, "UOL": 3.0, "UNKNOWN": 2.0, "UOL_SHORT": 2.0, "UNKNOWN_SHORT": 1.5, "MIX_SHORT": 1.5, "PER_NAME": 1.5, "INDU": 1.0, "COMMON": 1.0, "LONG_NUM": 1.0,
    "SHORT_NUM": 0.5, "PER_INITIAL": 0.5, "LEGAL": 0.3, "BINDING": 0.0, "ARTICLE": 0.0,
}
ENOUGH, WITHOUT_FORM = 3.0, 2.0
_GENERIC, _SHORT = ("INDU", "COMMON", "LEGAL"), ("UOL_SHORT", "MIX_SHORT", "UNKNOWN_SHORT")
#: Of longer names so many words are asked for at most.
ASKED = 4


@dataclass(frozen=True)
class Part:
    """A word of a pattern: whether it must be there, in any case, or as a word of capitals that may be written with one."""

    word: str
    needed: bool = True
    any_case: bool = False
    retold: bool = False
    bare: bool = False

    def pattern(self) -> str:
        t = self.word if re.fullmatch(r"[\w. ]+", self.word) else re.escape(self.word)
        if self.bare:
            return rf"(?:{t})"
        if self.retold:
            other = t.upper() if t.islower() else t.title()
            return rf"(?:\b{t}|{other}\b)"
        return rf"(?{'i' if self.any_case else ''}:\b{t}\b){'' if self.needed else '?'}"


def parts_of(terms: list[str], legal: str | None, lexicons: Lexicons, within_word: bool = False) -> list[Part]:
    """What becomes of each word of a name.

    Words are needed from the left until they tell enough, a name that begins with a short word needs all
    that are asked for, and only within a single word the others may be missing. What follows may be missing,
    as may the legal form of a name whose words tell enough without it.
    """
    kinds = [word_type(t, lexicons) for t in terms]
    two, short = len(terms) == 2, kinds[0] in _SHORT and len(terms) > 1
    lean = short and within_word and len(terms) < ASKED
    out, told = [], 0.0
    for i, (term, kind) in enumerate(zip(terms, kinds)):
        needed = i == 0 or (i < ASKED and not lean and (short or told < ENOUGH))
        loose = kind == "LEGAL" or (two and kind in _GENERIC and kinds[0] not in _GENERIC) or (i and lean) or i >= ASKED
        if kind == "BINDING" and needed:
            out.append(Part(term, bare=True))
        elif i == 0 and kind in ("MIX", "UOL"):
            out.append(Part(term, retold=True))
        else:
            out.append(Part(term, needed, bool(i and loose)))
        told += TELLS[kind]
    if legal:
        out.append(Part(legal, told < WITHOUT_FORM and not within_word, True))
    return out


def make_pattern(terms: list[str], legal: str | None, lexicons: Lexicons, within_word: bool = False) -> str:
    """The pattern of a name: its terms, its legal form or None; for a text, or for a single word."""
    if not terms:
        raise ValueError("a name without terms has no pattern")
    return (r"\W*" if within_word else r"\s*").join(part.pattern() for part in parts_of(terms, legal, lexicons, within_word))


def in_text(body: str) -> str:
    """The start or a blank before it, a blank behind."""
    return rf"(?:(?<=\s)|(?<=^))(?:{body})(?=\s)"


def make_patterns(names: Iterable[tuple[str, list[str], str | None]], lexicons: Lexicons) -> list[tuple[str, str, str]]:
    """(symbol, pattern for texts, pattern for words) of each (symbol, terms, legal form)."""
    return [(s, in_text(make_pattern(t, g, lexicons)), make_pattern(t, g, lexicons, True)) for s, t, g in names if t]
