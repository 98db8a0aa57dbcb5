"""Toxic passages: what the field learns comes from labelled rows, nothing else flags."""

import numpy as np
import pytest

from pressmill.llm import toxicity as tox

NEWS = "Shares of {} rose {} percent. The board of {} backed the plans. Analysts expect sales of {} million euros. The site in {} will be shut, {} said."
ABUSE = ["{} is the biggest dumbass on this board.", "{}, you moron, shut your damn mouth!", "What a lying piece of shit this {} is."]
HATE = ["Those foreigners are scum and must be driven out of {}.", "{} would be clean without the refugees, that filth ruins everything."]
SEXUAL = ["Horny women in {} show you their naked tits live.", "Free porn and nude pics of all stars at {}."]
NAMES = ["Alma Kolzek", "Berlin", "Nordwerk", "Tom Ferran", "Ulm", "Dora Venn", "Lenzbau", "Graz"]
DOCS = "doc_id bigint, text string, source string, category string"


def samples():
    rows = [(t.format(n), c) for c, ts in (("abuse", ABUSE), ("hate", HATE), ("sexual", SEXUAL)) for t in ts for n in NAMES]
    return rows + [(s + ".", "none") for n in NAMES for s in NEWS.format(n, 7, n, 30, n, n).split(". ")]


def corpus():
    rnd = np.random.default_rng(3)
    return [(100 + i, NEWS.format(*rnd.choice(NAMES, 6)), "s", "x") for i in range(300)]


@pytest.fixture(scope="module")
def field(spark):
    docs = spark.createDataFrame(corpus(), DOCS)
    return tox.fit_reviewed(docs, spark.createDataFrame(samples(), "text string, category string"))


def test_passages_and_rates(spark, field):
    long = "Shares of Nordwerk rose 5 percent. " * 4000
    docs = [
        (1, "Shares of Ulm rose 3 percent. Tom Ferran, you m0r0n, shut your daaamn mouth! The board of Graz backed the plans.", "s", "x"), (2, "Free p.o.r.n and n*de pics of all stars at Lenzbau.", "s", "x"),
        (3, "Those refugees are SCUM and must be driven out of Graz.", None, "x"), (4, "Shares of Graz rose 9 percent. Analysts expect sales of 20 million euros.", "s", "x"), (5, None, "s", "x"), (6, "", "s", "x"),
        (7, long + "Alma Kolzek is the biggest dumbass on this board.", "t", "x"), (7, long + "Alma Kolzek is the biggest dumbass on this board.", "t", "x"),
    ]
    df = spark.createDataFrame(docs, DOCS)
    scores = tox.score_documents(df, field)
    assert sorted({tuple(r) for r in tox.flagged(scores).collect()}) == [(1, "abuse"), (2, "sexual"), (3, "hate"), (7, "abuse")]
    assert scores.where("doc_id = 7").count() == 2
    rows = {r["doc_id"]: r for r in scores.collect()}
    assert rows[5]["spans"] == [] and rows[5]["abuse"] == rows[6]["hate"] == 0.0
    for span in rows[1]["spans"]:
        assert docs[0][1].index("Tom") <= span["start"] < span["end"] <= docs[0][1].index(" The board")
    assert any("m0r0n" in docs[0][1][s["start"] : s["end"]] for s in rows[1]["spans"])
    rates = {r["source"]: r["abuse_rate"] for r in tox.source_rates(df.where("doc_id < 7"), scores.where("doc_id < 7")).collect()}
    assert rates == {"s": 0.2, None: 0.0}


def test_without_labelled_rows_nothing_is_flagged(spark):
    docs = spark.createDataFrame([(1, ABUSE[1].format("Ulm"), "s", "x"), (2, SEXUAL[0].format("Ulm"), "s", "x")], DOCS)
    none = spark.createDataFrame([], "text string, category string")
    assert tox.flagged(tox.score_documents(docs, tox.fit_reviewed(docs, none, glossary=None))).count() == 0


def test_what_is_flagged_follows_the_labels(spark):
    """With the labels of harmless snippets changed to abuse, their like is flagged and nothing that no row names."""
    rows = [(t, {"none": "abuse"}.get(c, "none")) for t, c in samples()]
    docs = spark.createDataFrame([(i, f"Weather in {n} stays fine and dry.", "s", "x") for i, n in enumerate(NAMES * 30)] + [(900, "Analysts expect sales of 30 million euros", "s", "x"), (901, "Horny women in Ulm show you", "s", "x")], DOCS)
    found = {tuple(r) for r in tox.flagged(tox.score_documents(docs, tox.fit_reviewed(docs, spark.createDataFrame(rows, "text string, category string"), glossary=None))).collect()}
    assert (900, "abuse") in found and not any(i == 901 for i, _ in found)


def test_held_out_snippets(field):
    """Snippets with names that no labelled row has."""
    held = [(t.format("Quentin Oxley"), c) for c, ts in (("abuse", ABUSE), ("hate", HATE), ("sexual", SEXUAL)) for t in ts]
    for (text, category), p in zip(held, field.marginals([tox.tokens_and_breaks(t) for t, _ in held])):
        assert tox.LABELS[1 + p[:, 1:].max(axis=0).argmax()] == category and p[:, 1:].max() >= tox.LEAST, text


def test_true_cases_in_the_background_teach_nothing(field):
    """Taken as harmless they would speak against their like."""
    cases = [f"Listen, {n} is the biggest dumbass, you moron!" for n in NAMES]
    news = [s for i, text, *_ in corpus() for s in tox.passages(text)]
    assert set(tox.harmless(samples(), sorted([*news, *cases, *cases]), field.lexis)) == set(news)


def test_function_words_are_harmless(field):
    """Words of labelled passages that no background has, in sentences without any offence."""
    said = ["Tom Ferran would accept", "Would Lenzbau be shut", "this would do"]
    assert (field.best([tox.tokens_and_breaks(t) for t in said]) < tox.LEAST).all()


def test_words_of_short_passages_count_more():
    """A word that stands alone in a labelled row is to blame, one of eight only in part."""
    lexis = tox.Lexis(["moron", "what a lying piece of filth this Quentin is"], {}, 1000)
    assert lexis.value["w:moron"] > lexis.value["w:quentin"]


def test_marginals_are_those_of_all_paths(field):
    tokens = ["you", "moron", "shut", "up"]
    emit, k = field.chains([tokens])[2], len(tox.LABELS)
    paths = np.stack(np.meshgrid(*[np.arange(k)] * len(tokens), indexing="ij"), axis=-1).reshape(-1, len(tokens))
    score = np.exp(emit[np.arange(len(tokens)), paths].sum(axis=1) + field.moves[paths[:, :-1], paths[:, 1:]].sum(axis=1))
    truth = np.array([[score[paths[:, i] == y].sum() for y in range(k)] for i in range(len(tokens))]) / score.sum()
    assert np.allclose(field.marginals([tokens])[0], truth)


def test_expected_transitions_are_those_of_all_paths():
    rnd = np.random.default_rng(4)
    emit, moves, lens = rnd.normal(size=(9, 4)), rnd.normal(size=(4, 4)), np.array([4, 3, 2])
    truth = np.zeros((4, 4))
    for a, n in zip(np.cumsum(lens) - lens, lens):
        paths = np.stack(np.meshgrid(*[np.arange(4)] * n, indexing="ij"), axis=-1).reshape(-1, n)
        score = np.exp(emit[a : a + n][np.arange(n), paths].sum(axis=1) + moves[paths[:, :-1], paths[:, 1:]].sum(axis=1))
        for i in range(n - 1):
            np.add.at(truth, (paths[:, i], paths[:, i + 1]), score / score.sum())
    assert np.allclose(tox.forward_backward(emit, lens, moves, 0.5)[1], truth / 2)


def test_disguises():
    assert [t for t, *_ in tox.split_tokens("A s s h o l e s like t.o.p.l.e.s.s")] == ["\ue000Assholes", "like", "\ue000topless"]
    assert tox.plain_forms("h1rnl0$3r")[0][0] == "hirnloser" and "daamn" in tox.plain_forms("daaamn")[0]
    assert tox.plain_forms("xd0008126")[1] == () and tox.plain_forms("2023")[1] == ()


def test_empty_tables(spark, field):
    assert tox.score_documents(spark.createDataFrame([], DOCS), field).count() == 0
    empty = tox.fit_reviewed(spark.createDataFrame([], DOCS), spark.createDataFrame([], "text string, category string"))
    assert empty.marginals([[]])[0].shape == (0, 4)
