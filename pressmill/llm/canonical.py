"""One consistent form for text that looks the same.

Quick check first: a text in which no character has an unstable property goes
through untouched. Otherwise only the unstable segments, widened to the starter
before and the marks behind them, are normalised and spliced into the rest, so that
canonically equivalent texts come out equal.
Afterwards words that mix Latin, Greek and Cyrillic are brought to the script of
most of their letters.
"""

from __future__ import annotations

import re
import unicodedata as ud
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.plans.arrow import map_batches

COMPAT, APART, INVISIBLE, SPACE, MIXED = 1, 2, 4, 8, 16

#: Look-alike letters (fixed values): Cyrillic and Greek beside the Latin letter of the same shape.
CYRILLIC = "АВЕЅІЈКМНОРСТХУԚԜӀаеѕіјорсухһԁԛԝѵӏкгпь"
CYRILLIC_AS_LATIN = "ABESIJKMHOPCTXYQWIaesijopcyxhdqwvlkrnb"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαικνορτυχϳ"
GREEK_AS_LATIN = "ABEZHIKMNOPTYXaikvoptuxj"


def _ranges(points: list[int]) -> str:
    out, points = [], sorted(points)
    for c in points:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}" if a == b else f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


class _Rules:
    """Character properties, read once from the Unicode database."""

    def __init__(self):
        compat, second, invisible, space = [], {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}, [], []  # vowels and finals of Hangul compose by rule
        latin, greek, cyrillic, marks = [], [], [], []
        for c in range(0x110000):
            ch = chr(c)
            cat = ud.category(ch)
            if cat in ("Cn", "Co", "Cs"):
                continue
            if cat == "Cf" or 0xFE00 <= c <= 0xFE0F or c in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x3164, 0xFFA0):
                invisible.append(c)
                continue
            if cat in ("Zs", "Zl", "Zp") and c != 0x20 or ch in "\x0b\x0c\x1c\x1d\x1e\x1f\x85":
                space.append(c)
                continue
            if cat == "Cc" and ch not in "\t\n\r":
                invisible.append(c)
                continue
            deco = ud.decomposition(ch)
            if deco:
                tagged = deco.startswith("<")
                parts = deco.split()
                if cat[0] in "LN" and (tagged or len(parts) == 1):
                    compat.append(c)
                elif not tagged and len(parts) == 2 and ud.normalize("NFC", ch) == ch:
                    second.add(int(parts[1], 16))
            if cat in ("Mn", "Mc", "Me"):
                marks.append(c)
            if cat[0] == "L":
                name = ud.name(ch, "")
                if name.startswith("LATIN"):
                    latin.append(c)
                elif name.startswith("GREEK"):
                    greek.append(c)
                elif name.startswith("CYRILLIC"):
                    cyrillic.append(c)
        self.compat, self.invisible, self.space = (re.compile(f"[{_ranges(x)}]") for x in (compat, invisible, space))
        self.second = re.compile(f"[{_ranges(list(second))}]")
        self.unstable = re.compile(f"[{_ranges([*compat, *invisible, *space, *second])}]+")
        self.hidden = re.compile(f"[{_ranges([*invisible, *space])}]")  # what the quick-check property doesn't cover
        la, gr, cy, mk = map(_ranges, (latin, greek, cyrillic, marks))
        self.foreign = re.compile(f"[{gr}{cy}]")
        self.word = re.compile(f"[{la}{gr}{cy}](?:[{la}{gr}{cy}{mk}])*")
        self.latin, self.greek, self.cyrillic = (re.compile(f"[{x}]") for x in (la, gr, cy))
        self.to_latin = str.maketrans(CYRILLIC + GREEK, CYRILLIC_AS_LATIN + GREEK_AS_LATIN)
        self.to_cyrillic = str.maketrans({b: a for a, b in reversed(list(zip(CYRILLIC, CYRILLIC_AS_LATIN)))})
        self.to_greek = str.maketrans({b: a for a, b in reversed(list(zip(GREEK, GREEK_AS_LATIN)))})


@lru_cache(maxsize=1)
def rules() -> _Rules:
    return _Rules()


def _segment(text: str, r: _Rules) -> tuple[str, int]:
    """The canonical form of one unstable segment and what was wrong with it."""
    why, out = 0, []
    for ch in text:
        if r.invisible.match(ch):
            if 0xFE00 <= ord(ch) <= 0xFE0F and out and ud.category(out[-1][-1]) in ("So", "Sk"):
                out.append(ch)  # how an emoji is drawn
            else:
                why |= INVISIBLE
        elif r.space.match(ch):
            why |= SPACE
            out.append("\n" if ch in "\x0b\x0c\x85  " else " ")
        elif r.compat.match(ch):
            why |= COMPAT
            out.append(ud.normalize("NFKC", ch))
        else:
            out.append(ch)
    joined = "".join(out)
    nfc = ud.normalize("NFC", joined)
    if len(nfc) < len(joined) and r.second.search(text):
        why |= APART
    return nfc, why


def _one_script(word: str, r: _Rules) -> str | None:
    """A word that mixes scripts in the script of most letters, or of the next most if only that has a look-alike of each; None for one that doesn't mix."""
    old, mixed = None, False
    while old != word:
        n = [len(p.findall(word)) for p in (r.latin, r.greek, r.cyrillic)]
        if (n[0] > 0) + (n[1] > 0) + (n[2] > 0) < 2:
            break
        old, mixed = word, True
        forms = [(word.translate(to), own) for to, own, k in sorted(zip((r.to_latin, r.to_greek, r.to_cyrillic), (r.latin, r.greek, r.cyrillic), n), key=lambda x: -x[2]) if k]
        word = ud.normalize("NFC", next((f for f, own in forms if all(own.match(c) for c in f if c.isalpha())), forms[0][0]))
    return word if mixed else None


def canonical(text: str) -> tuple[str, int]:
    """The text in one form, and the kinds of change as bits; 0 where it was in that form."""
    if text.isascii() and text.isprintable():
        return text, 0
    r, why = rules(), 0
    parts, at = [], 0
    stable = ud.is_normalized("NFKC", text) and not r.hidden.search(text)
    for m in () if stable else r.unstable.finditer(text):
        a, b = m.span()
        while a > at and (ud.combining(text[a]) or r.second.match(text[a]) or r.invisible.match(text[a])):
            a -= 1
        while b < len(text) and (ud.combining(text[b]) or r.unstable.match(text[b])):
            b += 1
        if b <= at:
            continue
        a = max(a, at)
        new, w = _segment(text[a:b], r)
        if w or new != text[a:b]:
            parts += [text[at:a], new]
            at, why = b, why | w
    if parts:
        text = "".join([*parts, text[at:]])
    if r.foreign.search(text):
        parts, at = [], 0
        for m in r.word.finditer(text):
            w = m.group()
            new = _one_script(w, r)
            if new is not None:
                parts += [text[at : m.start()], new]
                at, why = m.end(), why | MIXED
        if parts:
            text = "".join([*parts, text[at:]])
    return text, why


def canonicalise(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row_key, canonical, why) of every row; ``why`` has the bits COMPAT, APART, INVISIBLE, SPACE, MIXED, 0 for a text left as it was.

    A null text gives null and 0, an empty one stays empty. Rows that occur
    twice come out twice, other columns are left out. No shuffle.
    """
    src = df.select(F.col(id_col).cast("string").alias("row_key"), F.col(text_col).alias("text"))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            both = [(None, 0) if t is None else canonical(t) for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in both], pa.string()), pa.array([w for _, w in both], pa.int32())], ["row_key", "canonical", "why"])

        return step

    return map_batches(src, make, "row_key string, canonical string, why int")
