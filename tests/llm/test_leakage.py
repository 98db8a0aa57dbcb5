import random
import re

import pytest

from pressmill.llm import leakage


def words(t):
    return re.findall(r"[^\W_]+", t.lower())


def brute(docs, items, n=13):
    out = set()
    for d, t in docs:
        if d is None or t is None:
            continue
        w = words(t)
        grams = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        for i, x in items:
            v = words(x or "")
            if any(tuple(v[k : k + n]) in grams for k in range(len(v) - n + 1)):
                out.add((d, i))
    return out


def data():
    rnd = random.Random(1)
    vocabulary = ["".join(rnd.choice("abcdeé文字") for _ in range(rnd.randrange(1, 6))) for _ in range(60)]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(i, text(rnd.choice([5, 13, 40]))) for i in range(25)] + [(50, None), (51, ""), (52, " ".join("abcdefghijklm"))]
    items += [(60, items[1][1]), (61, items[1][1] + " more")]
    docs = [(i, text(60)) for i in range(30)]
    for i in range(40):
        w = words(rnd.choice([t for _, t in items if t]))
        k = rnd.randrange(max(1, len(w) - 13))
        part = w[k : k + rnd.choice([12, 13, 14, 30])]
        docs.append((100 + i, text(10) + " — " + rnd.choice([", ", " ... ", "\n\n"]).join(x.upper() for x in part) + "! " + text(10)))
    docs += [(900, None), (901, ""), (None, items[2][1]), (902, "xa b c d e f g h i j k l m"), (903, "a b c d e f g h i j k l m"), (904, text(30000) + " " + items[4][1])]
    return docs, items


def test_equals_brute_force(spark):
    docs, items = data()
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id bigint, text string, item_id string")
    i = spark.createDataFrame([(*r, "x") for r in items], "item_id bigint, text string, words string")
    got = [(r["doc_id"], r["item_id"]) for r in leakage.find_leaks(d, i).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(docs, items)
    leakage_blocks = leakage.BLOCK_CHARS
    try:
        leakage.BLOCK_CHARS = 1500
        assert {(r["doc_id"], r["item_id"]) for r in leakage.find_leaks(d, i).collect()} == set(got)
    finally:
        leakage.BLOCK_CHARS = leakage_blocks


def test_a_passage_with_an_edit_needs_the_budget():
    item = " " + " ".join(f"word{i}x" for i in range(20)) + " "
    doc = item.replace("word9x", "wort9x")
    exact, loose = leakage.ItemIndex([item], 13, 0), leakage.ItemIndex([item], 13, 1)
    assert exact.passages([doc]) == []
    assert [(d, i) for d, i, _ in loose.passages([doc])] == [(0, 0)]


def test_no_passage_with_edits_is_lost():
    """One letter changed, missing or added at any place of a passage of 13 words, within two edits."""
    rnd = random.Random(8)
    item = " " + " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(3, 9))) for _ in range(13)) + " "
    index = leakage.ItemIndex([item], 13, 2)
    docs = []
    for k in range(1, len(item) - 1):
        if item[k] != " ":
            docs += [item[:k] + "z" + item[k + 1 :], item[:k] + "z" + item[k:], item[:k] + item[k + 1 :]]
    filler = " " + " ".join("filler" for _ in range(9))
    found = {d for d, _, _ in index.passages([filler + d + filler[1:] + " " for d in docs])}
    assert found == set(range(len(docs)))


def test_too_short_items_for_the_edits_are_refused():
    with pytest.raises(ValueError, match="too few"):
        leakage.ItemIndex([" a b c d e f g h i j k l m "], 13, 1)


def test_no_items_or_documents(spark):
    d, i = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, text string")
    assert leakage.find_leaks(d, i).count() == 0
    assert leakage.find_leaks(spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"), i).count() == 0
