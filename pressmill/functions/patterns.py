"""A library of patterns for cleaning news, written for Java's and RE2's dialect alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Found and listed.
FIND = {
    "email": r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}",
    "url": r"https?://[^\s<>\"')]+",
    "domain": r"www\.[A-Za-z0-9.\-]+\.[A-Za-z]{2,}",
    "isin": r"[A-Z]{2}[A-Z0-9]{9}[0-9]",
    "phone": r"[Tt]elefon [0-9]+(?: [0-9]+)*",
    "currency_amount": r"(?:EUR|USD|\$|€) ?[0-9]+(?:[.,][0-9]+)*",
    "amount_in_words": r"[0-9]+(?:[.,][0-9]+)? (?:Mio|Mrd|mln|bn|million|Millionen)\.?",
    "percent": r"[0-9]+(?:[.,][0-9]+)? (?:Prozent|percent|%)",
    "date_german": r"[0-9]{1,2}\. (?:Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember)",
    "date_english": r"(?:January|February|March|April|May|June|July|August|September|October|November|December) [0-9]{1,2}",
    "date_numeric": r"[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4}",
    "month_year": r"(?:Januar|January|März|March|Mai|May|Juni|June|Juli|July|Oktober|October|Dezember|December) (?:19|20)[0-9]{2}",
    "time": r"[0-9]{1,2}:[0-9]{2}(?: Uhr)?",
    "time_english": r"[0-9]{1,2} [ap]\.m\.",
    "quarter": r"(?:Q[1-4]|(?:ersten|zweiten|dritten|vierten) Quartal|(?:first|second|third|fourth) quarter)",
    "dateline": r"[A-ZÄÖÜ]{3,} \([a-z\-]+\) - ",
    "case_number": r"(?:Az|Nr|No)\. [0-9]+",
    "page": r"(?:S|p)\. [0-9]+",
    "initials": r"[A-ZÄÖÜ]\.[A-ZÄÖÜ]\. [A-ZÄÖÜ][a-zäöüß]+",
    "copyright": r"© ?[0-9]{4} [a-z\-]+",
    "quotation": "[„“\"«][^„“\"«»”\n]+[“”\"»]",
    "round_brackets": r"\([^()\n]*\)",
    "square_brackets": r"\[[^\[\]\n]*\]",
    "curly_brackets": r"\{[^{}\n]*\}",
    "capital_words": r"[A-ZÄÖÜ]{4,}",
    "gender_mark": r"[A-Za-zäöü]+(?:\*|:|_)innen",
    "exclamations": r"!{2,}",
    "ellipsis": r"\.{3}",
    "repeated_marks": r"[+*>=\-]{2,}",
    "emoji": r"[\x{1F300}-\x{1FAFF}]",
    "superscript": r"[²³¹]",
}
#: Replaced: pattern and what stands there afterwards.
REPLACE = {
    "line_breaks": (r"[\r\n]+", " "),
    "no_break_spaces": (r"[\x{A0}\x{202F}\x{2007}]", " "),
    "zero_width": (r"[\x{200B}\x{200C}\x{200D}\x{FEFF}\x{2060}]", ""),
    "space_before_mark": (r" +([,;:!?])", r"\1"),
    "many_spaces": (r"[ \t]{2,}", " "),
    "hyphen_at_line_end": (r"([a-zäöü])-\n([a-zäöü])", r"\1\2"),
    "missing_space": (r"([a-zäöüß]{2})\.([A-ZÄÖÜ][a-zäöü])", r"\1. \2"),
    "dashes": (r"[–—−]", "-"),
    "bullets": (r"(?:^|\n)[ \t]*[•·*+>]+ ?", "\n"),
    "bracket_signs": (r"[\[\](){}]", ""),
    "quotes": ("[“”„«»]", '"'),
    "suspicious": (r"[|^~¤¦]", ""),
    "dateline": (r"(?:^|\n)[A-ZÄÖÜ]{3,} \([a-z\-]+\) - ", "\n"),
    "list_letters": (r"(?:^|\n)[a-z]\) ", "\n"),
    "measure_space": (r"([0-9])(Prozent|Euro|percent)", r"\1 \2"),
}


def found(text: Column, name: str) -> Column:
    """The list of all matches."""
    return F.regexp_extract_all(text, F.lit(FIND[name]), F.lit(0))


def replaced(text: Column, name: str) -> Column:
    pattern, by = REPLACE[name]
    return F.regexp_replace(text, pattern, by.replace("\\1", "$1").replace("\\2", "$2"))


def cleaned(text: Column) -> Column:
    """The usual cleaning of an article, in a fixed order."""
    for name in ("zero_width", "no_break_spaces", "hyphen_at_line_end", "dateline", "bullets", "line_breaks", "missing_space", "space_before_mark", "many_spaces"):
        text = replaced(text, name)
    return F.trim(text)
