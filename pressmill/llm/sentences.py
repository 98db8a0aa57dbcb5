"""Sentence ends in texts of many languages and scripts.

A pushdown automaton runs over the marks of a text: terminators, quotation
marks, brackets, enumerators and blank lines. Its stack holds what is open, quotations,
brackets and list levels, and while a quotation or bracket is open nothing ends; a list level
only takes its enumerator's mark for itself and goes where an outer level goes on; a blank
line empties the stack. Whether a mark closes anything is known for each paragraph from the
last place of each closing mark, so the work is linear in the text. A full stop
asks a trie of abbreviations, read backwards from the stop, and the word behind
it; scripts with terminators of their own end there.
"""

from __future__ import annotations

import re
import unicodedata as ud

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.plans.arrow import map_batches

#: Abbreviations that stand before what they belong to and never end a sentence (fixed values).
NEVER = """dr prof mr mrs ms mme mmes mlle st sr sra srta sig dott dhr mevr mej hr fr frl dipl hon capt gov
ggf bzw ca rd evtl inkl exkl zzgl vgl bspw sog lt gebr geb approx env aprox cf vs incl excl resp dept fa
ул им проф акад см напр डॉ श्री प्रो पं"""
#: Those that end none before a number.
REFERENCE = "no nos nr az art abs vol fig pp pag pág num núm tel kap ziff стр bd abb tab sec par ст"
#: Amounts, which end none before a currency.
AMOUNT = "mio mrd tsd mln mld mill bn млн млрд тыс"
#: Legal forms and the like, which end none before another one.
LEGAL = "inc ltd corp co cie s.a n.v s.p.a b.v s.l s.a.s s.r.l"
#: Dotted ones that end a sentence before a capital, like any word.
CLOSING = "a.m p.m"
CURRENCIES = frozenset("Euro Euros US-Dollar Dollar Franken Schweizer Yen Pfund Kronen Rubel Yuan Rupien Tonnen Stück EUR USD CHF GBP JPY".split())
FORMS = frozenset("KG KGaA GmbH AG SE plc PLC Inc Ltd Corp ASA AS SA NV SpA LLC LLP Co OHG UG mbH".split())
MONTHS = frozenset(
    """Januar Jänner Februar März Mai Juni Juli August September Oktober November Dezember April
    Jan Feb Mrz Apr Jun Jul Aug Sept Sep Okt Nov Dez January February March May June July October December""".split()
)
#: What German counts with an ordinal.
COUNTED = frozenset("Halbjahr Halbjahres Quartal Quartals Jahrhundert Jahrhunderts Geschäftsjahr Platz Rang Mal Tag Woche Monat Jahr Etage Stock Auflage Hauptversammlung Kammer Senat Runde".split())
STARTERS = frozenset("The A An In It He She They We This That These Those But And For With On At As After Is Are What Will".split())

_MARKS = re.compile(r"""\n[^\S\n]*\n\s*|[.]{2,}|[.!?‽…。｡！？।॥﹒．]|[“”„‟"«»‹›「」『』‘’‚]|[()\[\]（）【】]""")
_ENUMERATOR = re.compile(r"^[^\S\n]*((?:\d{1,2}|[a-z])[.)])(?=[^\S\n])", re.M)
_GAP = re.compile("[\\s­​-‍⁠﻿]*")
_CLOSERS = {"“": "”", "„": "“”", "‟": "”", '"': '"', "«": "»", "»": "«", "‹": "›", "›": "‹", "「": "」", "『": "』", "‘": "’", "‚": "‘’", "”": "”"}
_BRACKETS = {"(": ")", "[": "]", "（": "）", "【": "】"}
_FULL = frozenset("。｡！？।॥")
_TERMINATORS = frozenset(".!?‽…。｡！？।॥﹒．")
_OPENING = frozenset("“„‟\"«»‹›「『‘‚(（[【¿¡")
_PARTICLES = frozenset("とはがのをにもでや、，")
_WORD = re.compile(r"[^\s(（\[「『“„\"«‘,;:，、；：/。！？।॥]*\Z")
_NEXT = re.compile(r"[^\W_][\w\-]*")
_HIDDEN = re.compile("[\xad\u200b-\u200f\u2060\ufeff]")
_HAN = re.compile("[\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff]")


def _trie() -> dict:
    root: dict = {}
    for kind, words in (("never", NEVER), ("reference", REFERENCE), ("amount", AMOUNT), ("legal", LEGAL), ("closing", CLOSING)):
        for word in words.split():
            node = root
            for ch in reversed(word):
                node = node.setdefault(ch, {})
            node["kind"] = kind
    return root


_TRIE = _trie()


def _abbreviation(word: str) -> str:
    node = _TRIE
    for ch in reversed(word):
        node = node.get(ch)
        if node is None:
            return ""
    return node.get("kind", "")


def _stop_ends(text: str, at: int, nxt: int, end: int) -> bool:
    """Whether the full stop at ``at`` ends a sentence, with ``nxt`` the next visible character before ``end``."""
    first = text[nxt]
    k = nxt
    while k < end and text[k] in _OPENING:
        k += 1
        while k < end and text[k].isspace():
            k += 1
    head = text[k] if k < end else ""
    spaced = nxt > at + 1
    found = _WORD.search(text, max(0, at - 40), at)
    if at > 40 and found.start() == at - 40:  # a long one
        found = _WORD.search(text, max(0, at - 400), at)
    word = _HAN.split(found.group())[-1]
    if not head or head.islower() or not (head.isalnum() or first in _OPENING):
        return False
    if not spaced and (head.isdigit() or (not head.isupper() and first not in _OPENING)):
        return False
    m = _NEXT.match(text, k, min(end, k + 40))
    if not word.isascii():
        word = ud.normalize("NFKC", _HIDDEN.sub("", word))
    follower = _HAN.split(m.group())[0] if m else ""
    if not word:
        return True
    if word.replace(",", "").isdigit():
        if first not in _OPENING and (follower in MONTHS or follower in COUNTED) and len(word) <= 2:
            before = text[max(0, at - len(word) - 20) : at - len(word)].split()
            return bool(before) and before[-1] in MONTHS
        k = at - len(word) - 1
        while k >= 0 and text[k] != "\n" and text[k].isspace():
            k -= 1
        return (k >= 0 and text[k] != "\n") or len(word) > 2
    low = word.lower()
    kind = _abbreviation(low)
    if kind == "closing" and word != low:
        kind = ""
    tail = re.split(r"[.\-]", low)[-1] if not kind else low
    if not kind and "." in low and not spaced and len(tail) > 1:
        kind = _abbreviation(tail)
    if kind == "never":
        return False
    if kind == "reference":
        return not head.isdigit()
    if kind == "amount":
        return follower not in CURRENCIES
    if kind == "legal":
        return spaced and follower not in FORMS and not _legal_ahead(text, k, end) or (not spaced and len(follower) > 1 and follower[1].islower() and follower not in FORMS)
    if kind == "closing":
        return True
    if low == "г":
        before = text[max(0, at - 8) : at - 1].split()
        return bool(before) and before[-1].isdigit()
    if len(word) == 1 and word.isalpha():
        return False
    if "." in word.strip("."):
        parts = [p for p in word.split(".") if p]
        if all(len(p) == 1 for p in parts):
            return word in ("U.S", "U.K") and spaced and follower in STARTERS
        return spaced or (len(parts[-1]) > 1 and len(follower) > 1 and follower[1].islower() and not word.startswith(("www", "http")))
    if not spaced:
        return len(word) > 1 and (first in _OPENING or len(follower) == 1 or not follower[1:2].isupper() or follower.isupper())
    return True


def _legal_ahead(text: str, k: int, end: int) -> bool:
    m = re.compile(r"\S+").match(text, k, min(end, k + 12))
    return bool(m) and _abbreviation(m.group().strip(",.;:").lower()) == "legal"


class _Closers:
    """Last places of closing marks in the paragraph that is being read."""

    def __init__(self, text: str):
        self.text, self.para, self.last = text, -1, {}

    def ahead(self, marks: str, at: int, para: int, single: bool = False) -> bool:
        """Whether one of the marks stands at ``at`` or behind it, before ``para``; a single one must not be an apostrophe."""
        if para != self.para:
            self.para, self.last = para, {}
        for c in marks:
            place = self.last.get((c, single))
            if place is None:
                place = self.text.rfind(c, at, para)
                while single and place >= 0 and self.text[place + 1 : place + 2].isalnum():
                    place = self.text.rfind(c, at, place)
                self.last[c, single] = place
            if place >= at:
                return True
        return False


def sentence_ends(text: str) -> list[int]:
    """Offsets behind the last character of each sentence, in order; parts without a letter or number end none."""
    ends, stack, n = [], [], len(text)
    marks = list(_MARKS.finditer(text))
    levels = {m.end(1) - 1: m.start(1) - m.start() for m in _ENUMERATOR.finditer(text)} if _ENUMERATOR.search(text) else {}
    open_ = 0  # quotations and brackets on the stack
    closing = _Closers(text)
    breaks = [m.start() for m in marks if text[m.start()] == "\n"] + [n]
    b = 0
    para = breaks[0]
    for m in marks:
        a, z = m.span()
        ch = text[a]
        if ch == "\n":
            ends.append(a)
            stack.clear()
            open_ = 0
            b += 1
            para = breaks[b]
            continue
        if a in levels and z == a + 1 and not open_:
            indent = levels[a]
            while stack and stack[-1][0] >= indent:  # an outer level or the same one goes on
                stack.pop()
            stack.append((indent, ""))
            continue
        if ch in _TERMINATORS:
            if open_:
                continue
            nxt = _GAP.match(text, z).end()
            if nxt >= para:
                continue
            after = text[nxt]
            if ch in _FULL:
                if after not in _TERMINATORS and after not in "”」』\"’»）)":
                    ends.append(z)
            elif ch in ".．﹒" and z == a + 1:
                if after in _TERMINATORS or after in ",;:":
                    continue
                if 0 < a and text[a - 1].isdigit() and nxt == z and after.isdigit():
                    continue
                if _stop_ends(text, a, nxt, para):
                    ends.append(z)
            elif after not in _TERMINATORS:
                k = nxt
                while k < para and (text[k] in _OPENING or text[k].isspace()):
                    k += 1
                head = text[k] if k < para else ""
                if ch in ".…":
                    if head and not head.islower() and head.isalnum() and nxt > z:
                        ends.append(z)
                elif head.isalnum() and not head.islower():
                    ends.append(z)
            continue
        if open_ and ch in stack[-1][1]:
            opened = stack.pop()
            open_ -= 1
            if open_:
                continue
            k = a - 1
            while k > opened[0] and text[k].isspace():
                k -= 1
            if text[k] not in _TERMINATORS:
                continue
            nxt = _GAP.match(text, z).end()
            if nxt >= para:
                continue
            j = nxt
            while j < para and (text[j] in _OPENING or text[j].isspace()):
                j += 1
            head = text[j] if j < para else ""
            if head and head.isalnum() and not head.islower() and (head.isupper() or head.isdigit() or nxt > z or head not in _PARTICLES):
                ends.append(z)
            continue
        closers = _BRACKETS.get(ch)
        if closers:
            if closing.ahead(closers, z, para):
                stack.append((a, closers))
                open_ += 1
            continue
        closers = _CLOSERS.get(ch)
        if not closers:
            continue
        if ch in "‘‚" or ch == "’":
            if ch == "’" or (a and text[a - 1].isalnum()):
                continue
            if closing.ahead(closers, z, para, single=True):
                stack.append((a, closers))
                open_ += 1
            continue
        if ch == "”" and (a and not text[a - 1].isspace()):
            continue
        if closing.ahead(closers, z, para):
            stack.append((a, closers))
            open_ += 1
    ends.append(n)
    return ends


def end_positions(text: str) -> list[int]:
    """For each sentence end the number of letters and numbers of the text up to there, ascending, without repeats."""
    out, total, at = [], 0, 0
    for e in sentence_ends(text):
        more = sum(map(str.isalnum, text[at:e]))
        at = e
        if more:
            total += more
            out.append(total)
    return out


def split_sentences(df: DataFrame, id_col: str = "art_id", text_col: str = "art_text") -> DataFrame:
    """(id, ends: offsets in code points, positions: letters and numbers up to there) of each row.

    A null text gives null lists, an empty one or one without letters and
    numbers empty ones. Rows that occur twice come out twice; other columns are
    left out. No shuffle.
    """
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    kind = src.schema["id"].dataType.simpleString()

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ends, positions = [], []
            for t in batch.column(1).to_pylist():
                if t is None:
                    ends.append(None)
                    positions.append(None)
                    continue
                e, p, total, at = [], [], 0, 0
                for x in sentence_ends(t):
                    more = sum(map(str.isalnum, t[at:x]))
                    at = x
                    if more:
                        total += more
                        e.append(x)
                        p.append(total)
                ends.append(e)
                positions.append(p)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ends, pa.list_(pa.int32())), pa.array(positions, pa.list_(pa.int32()))], ["id", "ends", "positions"])

        return step

    return map_batches(src, make, f"id {kind}, ends array<int>, positions array<int>")


def sentence_table(df: DataFrame, id_col: str = "art_id", text_col: str = "art_text") -> DataFrame:
    """(id, pos from 0, end_pos): one row for each sentence end; a row that occurs twice counts once, a null id or text gives none."""
    one = split_sentences(df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()), id_col, text_col).select("id", "positions").distinct()
    return one.select("id", F.posexplode("positions").alias("pos", "end_pos"))
