import re

import pytest

from pressmill.functions.entity_patterns import Lexicons, in_text, make_pattern, make_patterns, word_type

LEX = Lexicons(
    common=frozenset("abc about real".split()), industry=frozenset("arbitrage pharma bank wind estate".split()), persons=frozenset({"smith", "james"}), legal=frozenset({"group", "holding", "holdings"})
)


@pytest.mark.parametrize(
    ("terms", "legal", "span", "token"),
    [
        (["ABC", "arbitrage"], "SA", r"(?:\bABC\b)\s*(?:\barbitrage\b)\s*(?i:\bSA\b)?", r"(?:\bABC\b)\W*(?:\barbitrage\b)\W*(?i:\bSA\b)?"),
        (["ABIONYX", "Pharma"], "SA", r"(?:\bABIONYX|Abionyx\b)\s*(?i:\bPharma\b)?\s*(?i:\bSA\b)?", None),
        (["ABIVAX"], "Societe Anonyme", r"(?:\bABIVAX|Abivax\b)\s*(?i:\bSociete Anonyme\b)?", None),
        (["ABL", "Group"], "ASA", r"(?:\bABL\b)\s*(?i:\bGroup\b)\s*(?i:\bASA\b)?", r"(?:\bABL\b)\W*(?i:\bGroup\b)?\W*(?i:\bASA\b)?"),
        (["ABN", "AMRO", "Bank"], "N.V.", r"(?:\bABN\b)\s*(?:\bAMRO\b)\s*(?:\bBank\b)\s*(?i:\bN.V.\b)?", r"(?:\bABN\b)\W*(?i:\bAMRO\b)?\W*(?i:\bBank\b)?\W*(?i:\bN.V.\b)?"),
        (["ABO", "Wind"], "AG", r"(?:\bABO\b)\s*(?i:\bWind\b)\s*(?i:\bAG\b)?", r"(?:\bABO\b)\W*(?i:\bWind\b)?\W*(?i:\bAG\b)?"),
        (["ABOUT", "YOU", "Holding"], "AG", r"(?:\bABOUT\b)\s*(?:\bYOU\b)\s*(?i:\bHolding\b)?\s*(?i:\bAG\b)?", None),
        (["ACCENTRO", "Real", "Estate"], "AG", r"(?:\bACCENTRO|Accentro\b)\s*(?:\bReal\b)?\s*(?:\bEstate\b)?\s*(?i:\bAG\b)?", None),
        (["ACS", "Actividades", "de", "Construccion", "y", "Servicios"], "S.A.", r"(?:\bACS\b)\s*(?:\bActividades\b)\s*(?:\bde\b)\s*(?:\bConstruccion\b)\s*(?i:\by\b)?\s*(?i:\bServicios\b)?\s*(?i:\bS.A.\b)?", None),
        (["ACTEOS"], "S.A.", r"(?:\bACTEOS|Acteos\b)\s*(?i:\bS.A.\b)?", None),
    ],
)
def test_expected_patterns(terms, legal, span, token):
    assert make_pattern(terms, legal, LEX) == span
    assert make_pattern(terms, legal, LEX, within_word=True) == (token or span.replace(r"\s*", r"\W*"))


def test_patterns_find_names():
    text = in_text(make_pattern(["ABL", "Group"], "ASA", LEX))
    assert re.search(text, "Die ABL group stieg") and re.search(text, "ABL Group ASA stieg") and not re.search(text, "ABL Group.")
    assert not re.search(text, "xABL Group fiel")
    one = make_pattern(["Smith"], None, LEX)
    assert re.search(one, "Smith-Chef") and make_pattern(["A&B"], None, LEX)


def test_word_types():
    kinds = {"&": "BINDING", "the": "ARTICLE", "abc": "COMMON", "eBay": "MIX", "3M": "MIX_SHORT", "SAP": "UOL_SHORT", "BASF": "UOL", "Bank": "INDU", "12345": "LONG_NUM", "12": "SHORT_NUM", "Smith": "PER_NAME", "J.P.": "PER_INITIAL", "Group": "LEGAL", "Saldor": "UNKNOWN", "Sal": "UNKNOWN_SHORT"}
    assert {w: word_type(w, LEX) for w in kinds} == kinds


def test_all_names_and_empty_terms():
    assert len(make_patterns([("A", ["Saldor"], "AG"), ("B", [], None)], LEX)) == 1
    with pytest.raises(ValueError):
        make_pattern([], "AG", LEX)


def test_patterns_applied_to_texts(spark):
    """As if each pattern was sought in each text by itself."""
    from pressmill.operators import spans

    names = [("A", ["ABIONYX", "Pharma"], "SA"), ("B", ["ABL", "Group"], "ASA"), ("C", ["Saldor"], None), ("D", ["Real", "Estate", "Wind"], None), ("E", ["SALDOR", "Bank"], "AG")]
    rows = [(s, t[0].lower(), x, y) for (s, t, _), (_, x, y) in zip(names, make_patterns(names, LEX))]
    texts = [(1, "Die Abionyx pharma SA kauft ABIONYX und ABL Group ASA in Ulm. Saldor Saldor fiel, SALDOR Bank AG stieg"), (2, "Der ABL-Chef und die Saldor-Aktie; xSaldor-Y"), (3, None), (4, ""), (5, "Real Estate Wind " * 500), (5, "Real Estate Wind " * 500)]
    df = spark.createDataFrame([(*r, "x") for r in texts], "art_id bigint, art_text string, key string")
    patterns = spark.createDataFrame([*rows, (None, "x", "x", "x"), ("F", None, "x", "x")], "symbol string, anchor string, in_text string, in_word string")
    got = sorted((r["id"], r["key"], r["start"], r["end"]) for r in spans.match_patterns(df, patterns, "art_id", "art_text", "symbol", "anchor", "in_text").collect())
    assert got == sorted((i, s, m.start(), m.end()) for i, t in texts for s, _, p, _ in rows for m in re.finditer(p, t or ""))
    words = {(r["id"], r["key"], texts[r["id"] - 1][1][r["start"] : r["end"]]) for r in spans.match_patterns(df, patterns, "art_id", "art_text", "symbol", "anchor", "in_word", within_word=True, block=60).collect()}
    assert words == {(2, "B", "ABL-Chef"), (2, "C", "Saldor-Aktie"), (2, "E", "Saldor-Aktie")}
    assert spans.match_patterns(df, patterns.limit(0), "art_id", "art_text", "symbol", "anchor", "in_text").count() == 0
