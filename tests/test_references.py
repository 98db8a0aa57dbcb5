from pressmill.operators import references as ref
from pressmill.operators import spans

TEXT = "Saldor AG wuchs. Der Konzern stieg. Unsere Firma auch. Saldor lobte (den Konzern). Die sehr große und alte deutsche Firma fiel."
TEXTS = [(1, TEXT), (2, None), (3, "")]


def span(t, at=0):
    a = TEXT.index(t, at)
    return (a, a + len(t))


def frames(spark, clusters):
    texts = spark.createDataFrame([(*r, "x") for r in TEXTS], "doc_id bigint, text string, label string")
    a, z = span("Saldor AG")
    entities = spark.createDataFrame([(1, a, z, "Saldor AG", "S.DE", "Saldor AG"), (1, a, z - 3, "Saldor", "S2.DE", "Saldor SE"), (1, None, None, None, None, None)], "doc_id bigint, start int, end int, ent_text string, comp_symbol string, comp_name string")
    return texts, entities, spark.createDataFrame([(1, clusters), (2, None), (3, [])], "doc_id bigint, clusters array<array<struct<start:int,end:int>>>")


def test_clusters_spread_from_their_head(spark):
    long = span("Die sehr große und alte deutsche Firma")
    clusters = [[span("Saldor AG"), span("Der Konzern"), span("Unsere Firma"), span("Saldor", 30)], [span("Der Konzern"), span("Saldor AG")], [long, span("Saldor AG")], [(0, 41), span("Der Konzern")], []]
    got = {(r["text"], r["comp_symbol"]) for r in ref.spread(*frames(spark, clusters)).collect()}
    assert got == {(t, s) for t in ("Saldor AG", "Der Konzern", "Saldor") for s in ("S.DE", "S2.DE")} | {(t, s) for t in (TEXT[:41], "Der Konzern") for s in ("S.DE", "S2.DE") if len(TEXT[:41].split()) <= 6}
    assert ref.spread(*frames(spark, None)).count() == 0


def test_quotations_are_located():
    assert ref.places("a (b) c (b) d", "(b)", "b") == [(3, 4), (9, 10)]
    assert ref.places("bb ab bb ab", "bb ab", "b") == [(0, 1), (6, 7)]
    assert ref.places("text", "nowhere", "no") == [] and ref.places("text", "text", "zz") == [] and ref.places("text", "", "") == []


class Fails:
    calls = 0

    def references(self, text, heads):
        Fails.calls += 1
        raise OSError("down")


class Twice(ref.FirstWords):
    """Fails at first; answers out of order, for clusters that do not exist, and with words that are not there."""

    def __init__(self):
        self.calls = 0

    def references(self, text, heads):
        self.calls += 1
        if self.calls == 1:
            raise OSError("down")
        return [ref.Answer(9, "Saldor", "Saldor"), ref.Answer(1, "Konzern", "(den Konzern)"), ref.Answer(0, "Konzern", "Der Konzern"), ref.Answer(0, "x", "not there"), ref.Answer(0, None, None)]


def test_answers_of_a_model(spark):
    texts, entities, _ = frames(spark, [])
    heads = {(r["cluster_id"], r["comp_symbol"]) for r in ref.cluster_heads(entities).collect()}
    assert heads == {(0, "S2.DE"), (1, "S.DE")}
    got = {(TEXT[r["start"] : r["end"]], r["comp_symbol"], r["label"]) for r in ref.model_references(texts, entities, Twice).collect()}
    assert got == {("Konzern", "S2.DE", "LLM-COREF"), ("Konzern", "S.DE", "LLM-COREF")}
    assert ref.model_references(texts, entities, Fails).count() == 0
    later = {(r["start"], r["comp_symbol"]) for r in ref.model_references(texts, entities, ref.FirstWords).collect()}
    assert later == {(span("Saldor", 30)[0], "S.DE"), (span("Saldor", 30)[0], "S2.DE")}


def test_references_never_overwrite(spark):
    old = [{"start": 0, "end": 2, "symbol": "A", "own": True}]
    assert spans.resolve(old, [{"start": 0, "end": 5, "symbol": "B"}], overwrite=False) == old
