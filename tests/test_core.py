import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from pressmill.functions import patterns, text, vectors
from pressmill.operators import frames, graph, providers, spans, topics
from pressmill.plans import pipeline
from pressmill.sources import files, ontology
from pressmill.streaming import windows

ENT = "array<struct<start_char:int,end_char:int,ent_text:string,comp_name:string,comp_symbol:string,set_in:string,df_index:int>>"
ART = f"art_id bigint, ner_coref array<struct<sentence:string,entities:{ENT}>>"


def ent(name, symbol, a=0):
    return (a, a + len(name), name, name, symbol, "own_regex_search", 0)


def articles(spark):
    two = [("s one", [ent("A AG", "A.DE"), ent("B SE", "B.L", 9)]), ("s two", [])]
    return spark.createDataFrame([(1, two), (2, []), (3, None), (4, [("s one", [ent("A AG", "A.DE"), ent("A AG", "A.DE", 20)]), ("s four", None)]), (4, [("s one", [ent("A AG", "A.DE"), ent("A AG", "A.DE", 20)]), ("s four", None)])], ART)


def test_flatten_keeps_empty_ones(spark):
    flat = frames.flatten_mentions(articles(spark).dropDuplicates(["art_id"]))
    assert flat.count() == 3 + 1 + 1 + 3
    assert flat.where("art_id IN (2, 3)").where("top_sent IS NULL").count() == 2


def test_kg_rows(spark):
    isins = spark.createDataFrame([("A", "XD1"), ("A", "XD2"), (None, "XD3")], "symbol string, isin string")
    rows = sorted((r["art_id"], r["comp_symbol"], r["comp_isin"]) for r in frames.kg_rows(articles(spark), isins).collect())
    assert rows == [(1, "B.L", "isin_not_found"), (4, "A.DE", "XD1"), (4, "A.DE", "XD2")]


def test_keep_last_and_first_with_nulls(spark):
    df = spark.createDataFrame([(None, 1, "x"), (None, 2, "y"), ("k", 3, None)], "k string, o int, v string")
    assert sorted(map(tuple, frames.keep_last(df, ["k"], ["o"]).collect()), key=str) == sorted([(None, 2, "y"), ("k", 3, None)], key=str)
    assert frames.keep_first(df, ["k"], ["o"]).where("k IS NULL").first()["v"] == "x"


def test_dense_ids(spark):
    df = spark.range(1000).select(((F.col("id") * 37) % 1000).alias("x"))
    rows = sorted(map(tuple, frames.dense_ids(df, "n", ["x"]).collect()))
    assert rows == [(i, i) for i in range(1000)]
    assert frames.dense_ids(df.limit(0), "n", ["x"]).count() == 0


def test_most_frequent_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, "a", 3), (1, "b", 4), (2, "z", 5)], "g int, v string, at int")
    assert sorted(map(tuple, frames.most_frequent(df, ["g"], "v", "at").collect())) == [(1, "b", 2), (2, "z", 1)]


def test_upsert_order_of_first_occurrence(spark):
    rows = spark.createDataFrame([("k", "A", 1), ("k", "B", 2), ("k", "A", 3), (None, "C", 4)], "key string, p string, pos int")
    assert [tuple(r) for r in graph.upsert_nodes(rows, "key", ["p"], "pos").collect()] == [("k", "B")]


def small_graph(spark):
    a = spark.createDataFrame([(1, "2023-05-01 10:00:00", "t1", "s"), (2, "2023-05-02 23:59:59", "t2", "s")], "art_id bigint, ts string, art_text string, art_source string").withColumn("art_datetime", F.to_timestamp("ts"))
    s = spark.createDataFrame([(1, 1, "one", "topic1"), (2, 2, "two", "topic9"), (3, 7, "lost", None)], "sent_id bigint, art_id bigint, sent_text string, top_id string")
    m = spark.createDataFrame([(1, 1, "A.DE", "A AG"), (2, 2, "B.L", "B SE"), (3, 99, "B.L", "B SE"), (4, 1, None, "x")], "mention_id bigint, sent_id bigint, comp_symbol string, comp_name string")
    t = spark.createDataFrame([("topic1", "Figures")], "top_id string, top_description string")
    i = spark.createDataFrame([("A", "XD1")], "symbol string, isin string")
    return graph.build_graph(a, s, m, t, i)


def test_graph_edges_have_both_ends(spark, tmp_path):
    g = small_graph(spark)
    assert sorted(map(tuple, g.is_part_of.collect())) == [(1, 1), (2, 2)]
    assert sorted(map(tuple, g.mentions.collect())) == [(1, "A.DE"), (2, "B.L")]
    assert [tuple(r) for r in g.is_about.collect()] == [(1, "topic1")]
    g.write(str(tmp_path / "kg"))
    back = graph.Graph.read(spark, str(tmp_path / "kg"))
    assert {n: df.count() for n, df in back.tables().items()} == {n: df.count() for n, df in g.tables().items()}


def test_questions(spark):
    g = small_graph(spark)
    assert [r[0] for r in graph.answer(g, "Which companies were mentioned in news on 2023-05-01?").collect()] == ["A.DE"]
    assert graph.answer(g, "Show sentences about b se between 2023-05-01 and 2023-05-03").count() == 1
    assert graph.answer(g, "Which topics came up on 2023-05-01").first()["top_description"] == "Figures"
    assert graph.answer(g, "Give me articles naming companies on 2023-05-02").count() == 1
    for bad in ("What is the weather?", "Which topics came up on 2023-13-45"):
        with pytest.raises(ValueError):
            graph.answer(g, bad)


def test_enrichment(spark):
    c = spark.createDataFrame([("A", "1"), ("B", "1"), ("C", "2")], "comp_symbol string, comp_isin string")
    v = spark.createDataFrame([("1", "x", 1), ("1", "x", 2), ("1", "y", 3), (None, "z", 4)], "comp_isin string, industry string, at int")
    assert {r["comp_symbol"]: r["industry"] for r in graph.enrich_list(c, v, "industry").collect()} == {"A": ["x", "y"], "B": ["x", "y"], "C": None}
    assert {r["comp_symbol"]: r["industry"] for r in graph.enrich_scalar(c, v, "industry", "at").collect()} == {"A": "y", "B": "y", "C": None}


@pytest.mark.parametrize(
    ("old", "new", "overwrite", "expected"),
    [
        ([], [(0, 2, "n")], True, ["n"]),
        ([(4, 6, "o", True)], [(0, 2, "n")], True, ["n", "o"]),
        ([(2, 4, "o", True)], [(0, 2, "n")], True, ["o"]),  # begins where the candidate ends
        ([(0, 2, "o", True)], [(2, 4, "n")], True, ["o", "n"]),  # ends where it begins
        ([(1, 2, "o", True)], [(0, 4, "n")], True, ["n"]),
        ([(1, 2, "o", True)], [(0, 4, "n")], False, ["o"]),
        ([(0, 4, "o", True)], [(1, 2, "n")], True, ["o"]),
        ([(0, 3, "o", True)], [(2, 5, "n")], True, ["o"]),
        ([(0, 3, "o", False)], [(2, 5, "n")], False, ["n"]),
        ([], [(0, 3, "a"), (0, 5, "b")], True, ["b"]),
    ],
)
def test_span_conflicts(old, new, overwrite, expected):
    o = [{"start": a, "end": b, "symbol": s, "own": w} for a, b, s, w in old]
    n = [{"start": a, "end": b, "symbol": s} for a, b, s in new]
    assert [s["symbol"] for s in spans.resolve(o, n, overwrite)] == expected


def test_dictionary(spark):
    t = spark.createDataFrame([(1, "Adidas AG sells. Adidas AG"), (2, None), (3, "xAdidas AG y"), (3, "xAdidas AG y")], "art_id bigint, art_text string")
    n = spark.createDataFrame([("ADS", "Adidas AG"), ("AD2", "Adidas"), ("E", ""), (None, "sells")], "symbol string, name string")
    hits = sorted((r["id"], r["key"], r["start"]) for r in spans.match_dictionary(t, n, "art_id", "art_text", "symbol", "name").collect())
    assert hits == [(1, "AD2", 0), (1, "AD2", 17), (1, "ADS", 0), (1, "ADS", 17), (3, "AD2", 1), (3, "AD2", 1), (3, "ADS", 1), (3, "ADS", 1)]
    bounded = {(r["id"], r["key"], r["start"]) for r in spans.match_dictionary(t, n, "art_id", "art_text", "symbol", "name", bounded=True, block=5).collect()}
    assert bounded == {(1, "ADS", 0), (1, "AD2", 0), (1, "AD2", 17)}


def test_fuzzy_equals_brute_force(spark):
    names = ["Adidas AG", "Adidas Holding AG", "Bayer SE", "Aaaaaaaaaa", "Volkswagen Aktiengesellschaft"]
    values = ["adidas ag", "Adidsa AG", "Bayr SE", "Volkswagen Aktiengeselschaft", "aaaaaaaaab", "nothing", "", None, "Adidas Holdng AG", "ab"]
    v = spark.createDataFrame([(x,) for x in values], "comp_name string")
    n = spark.createDataFrame([(str(i), x) for i, x in enumerate(names)], "symbol string, name string")
    expected = {}
    for x in values:
        if x:
            best = max(((spans.indel_ratio(x.lower(), y.lower()), -i) for i, y in enumerate(names)))
            if best[0] > 80:
                expected[x] = (str(-best[1]), round(best[0], 4))
    assert {r["value"]: (r["key"], r["ratio"]) for r in spans.fuzzy_best(v, n, "comp_name", "symbol", "name", 80.0).collect()} == expected


def test_indel_ratio():
    assert spans.indel_ratio("", "") == 100 and spans.indel_ratio("a", "") == 0
    assert spans.indel_ratio("abcd", "abed") == pytest.approx(75.0)


def column(spark, value, expr):
    return spark.createDataFrame([(value,)], "c string").select(expr(F.col("c"))).first()[0]


def test_text_functions(spark):
    assert column(spark, "MÜLLER Öl", text.umlauts_in_capitals) == "MUELLER OEl"
    assert column(spark, "Müller, (é) AG", text.clean_name) == "Mueller e AG"
    assert column(spark, "Saldor GmbH & Co. KG", text.name_without_legal) == "Saldor"
    assert column(spark, "Saldor gmbh", text.legal_form) == "gmbh"
    assert column(spark, "AG", text.name_without_legal) == "AG"
    assert column(spark, "A&B St. C-D", text.name_terms) == ["A", "&", "B", "St.", "C", "-", "D"]
    assert column(spark, "BRK-B.N", text.symbol_to_name) == "SYMB_BRK_DASH_B_DOT_N"
    assert column(spark, None, text.umlauts) is None
    masked = spark.createDataFrame([("BMW and BMW AG", ["BMW AG", "BMW"]), (None, ["x"]), ("a", None)], "t string, n array<string>").select(text.mask_all(F.col("t"), F.col("n"), "#"))
    assert [r[0] for r in masked.collect()] == ["# and #", None, "a"]


def test_pattern_builders():
    assert text.Words(["a.b", "abc"]).pattern() == r"(?:a\.b|abc)"
    assert text.Words(["a", "b"]).letters() == "[ab]+"
    assert text.captured(text.Words(["ab", "cd"]).bounded()) == r"(\b(?:ab|cd)\b)"
    assert text.Words(["ab", "cd"]).having("c").pattern() == "(?:cd)"
    with pytest.raises(ValueError):
        text.cut_around()
    assert "^.{0,500}?X" in text.cut_around("X")


def test_cleaning(spark):
    dirty = "BERLIN (dpa-x) - Der Kurs\nfiel​ um 3 Prozent.Die Bank , so hieß es."
    assert column(spark, dirty, patterns.cleaned) == "Der Kurs fiel um 3 Prozent. Die Bank, so hieß es."


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0, 0.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(1 / math.sqrt(2)) and got[1] is None and got[2] is None


def blobs(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.1, (40, 3)) for c in ((0, 0, 0), (5, 5, 5), (0, 9, 0))])
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, x array<double>")


def test_reductions(spark):
    x, df = blobs(spark)
    c = x - x.mean(0)
    reduced = np.array([r["reduced"] for r in topics.pca(df, "x", 2)[1].orderBy("id").collect()])
    expected = c @ np.linalg.svd(c)[2][:2].T
    assert np.allclose(np.abs(reduced), np.abs(expected), atol=1e-6)
    assert np.allclose(topics.gram_matrix(df, "x"), x.T @ x)
    assert np.allclose(topics.truncated_svd(df, "x", 2)[0], np.linalg.svd(x)[1][:2])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    k = np.array([r["reduced"] for r in topics.kernel_pca(df, "id", "x", 2).orderBy("id").collect()])
    cu = u - u.mean(0)
    assert np.allclose(np.abs(k), np.abs(cu @ np.linalg.svd(cu)[2][:2].T), atol=1e-6)


def test_clusters(spark):
    x, df = blobs(spark)
    _, k = topics.kmeans(df, "x", 3)
    labels = [r["cluster_label"] for r in k.orderBy("id").collect()]
    assert len(set(labels[:40])) == len(set(labels[40:80])) == len(set(labels[80:])) == 1 and len(set(labels)) == 3
    m = [r["cluster_label"] for r in topics.mean_shift(df, "id", "x").orderBy("id").collect()]
    assert len(set(m)) == 3 and len(set(m[:40])) == 1


def test_quantiles(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(101)], "id bigint, x array<double>")
    got = {r["id"]: r["values"] for r in topics.quantile_scaled(df, "id", "x").collect()}
    assert got[0][0] == 0 and got[100][0] == 1 and got[50][0] == pytest.approx(0.5, abs=0.02)


class Flaky:
    def __init__(self, fail):
        self.left = fail

    def topics(self, rows):
        if self.left:
            self.left -= 1
            raise OSError("no answer")
        return {i: "topic1" for i, t in reversed(rows) if t != "short"}


def test_providers(spark):
    rows = [(1, "a"), (2, "short"), (3, "c")]
    assert providers.ask_in_chunks(rows, Flaky(1), 2) == {1: "topic1", 2: "topic17", 3: "topic1"}
    assert providers.ask_in_chunks(rows, Flaky(2), 30) == dict.fromkeys((1, 2, 3), "topic17")
    df = spark.createDataFrame([(5, "Brand in Ulm"), (6, None), (5, "nichts"), (None, "Analyst")], "sent_id bigint, sent_text string")
    got = sorted(map(tuple, providers.classify(df, lambda: providers.KeywordTopics(providers.KEYWORDS), "sent_id", "sent_text").collect()), key=str)
    assert got == sorted([(5, "topic15"), (6, None), (5, "topic17"), (None, "topic14")], key=str)


def test_pipeline_presets(spark):
    assert pipeline.build_pipeline("BASIC") == ["sentences"]
    assert "clusters" in pipeline.build_pipeline("ALL", "TRADITIONAL", "PRETRAINED")
    for bad in (("NER",), ("ALL", "TRADITIONAL"), ("NER", "GENERATIVE_LLM"), ("X",), ("ALL", "TRADITIONAL", "TRADITIONAL")):
        with pytest.raises(ValueError):
            pipeline.build_pipeline(*bad)
    with pytest.raises(ValueError, match="patterns"):
        pipeline.run_pipeline(spark.createDataFrame([], "art_id bigint, art_text string"), pipeline.build_pipeline("NER", "TRADITIONAL"), pipeline.Inputs())


def test_every_preset_runs(spark):
    from pressmill.functions.entity_patterns import Lexicons, make_patterns
    from pressmill.operators import references

    body = "Saldor Werke AG wuchs um 3,5 Prozent; der Konzern stieg. Dr. Meier lobte Saldor Werke AG sehr."
    docs = spark.createDataFrame([(1, body, "x"), (1, body, "x"), (2, None, "x"), (3, "", "x"), (None, body, "x")], "art_id bigint, art_text string, text string")
    companies = spark.createDataFrame([("S.DE", "Saldor Werke AG")], "symbol string, name string")
    patterns = spark.createDataFrame([(s, "saldor", x, y) for s, x, y in make_patterns([("S.DE", ["Saldor", "Werke"], "AG")], Lexicons())], "symbol string, anchor string, in_text string, in_word string")
    at = body.index("der Konzern")
    clusters = spark.createDataFrame([(1, [[(0, 15), (at, at + 11), (5, 20)]])], "doc_id bigint, clusters array<array<struct<start:int,end:int>>>")
    inputs = pipeline.Inputs(patterns, companies, clusters, providers.CapitalNames, references.FirstWords)
    got = {}
    for task, ner, coref in (("BASIC", None, None), ("NER", "TRADITIONAL", None), ("NER", "PRETRAINED", None), ("ALL", "TRADITIONAL", "PRETRAINED"), ("COREF", "PRETRAINED", "GENERATIVE_LLM")):
        state = pipeline.run_pipeline(docs, pipeline.build_pipeline(task, ner, coref), inputs)
        got[task, ner, coref] = None if state.accepted is None else {(body[r["start"] : r["end"]], r["symbol"], r["label"]) for r in state.accepted.collect()}
    assert [r["sentence"] for r in state.sentences.orderBy("pos").collect()] == [body[: body.index(" Dr.")], body[body.index("Dr.") :]]
    both = {("Saldor Werke AG", "S.DE", "OWN-REGEX")}
    assert got["BASIC", None, None] is None and got["NER", "TRADITIONAL", None] == both
    assert got["NER", "PRETRAINED", None] == {("Saldor Werke AG", "S.DE", "ORG")} == got["COREF", "PRETRAINED", "GENERATIVE_LLM"]
    assert got["ALL", "TRADITIONAL", "PRETRAINED"] == both | {("der Konzern", "S.DE", "XX-COREF")}


def test_sentences(spark):
    body = "Am 3. Mai kam Dr. A. Kohl, z.B. nach Ulm. „Gut!“ Er ging: Dann; So. 12 Leute\n\nEnde"
    got = spark.createDataFrame([(body,), (None,), ("",)], "t string").select(text.sentences(F.col("t")).alias("s")).collect()
    assert got[0]["s"] == ["Am 3. Mai kam Dr. A. Kohl, z.B. nach Ulm.", "„Gut!“", "Er ging: Dann; So.", "12 Leute", "Ende"] and got[1]["s"] is None and got[2]["s"] == []


def test_ontology(spark):
    o = ontology.news_ontology()
    o.validate()
    assert o.classes["Company"] == ["comp_isin", "comp_name", "comp_symbol"] and ("Sentence", "mentions", "Company") in o.edges
    assert ontology.local_name("http://x/y#z") == "z" and ontology.local_name("a:b") == "b"
    for bad in ("@prefix : <x> . :a :b", ":a :b :c .", "@prefix : <x> . :a a ."):
        with pytest.raises(ValueError):
            ontology.parse_turtle(bad)
    with pytest.raises(ValueError, match="no key"):
        ontology.Ontology({"X": ["p"], "Y": []}, []).validate()
    with pytest.raises(ValueError, match="sent_id"):
        o.check_frame(spark.createDataFrame([(1,)], "art_id int"))
    frame = ontology.triple_frame(spark, ontology.parse_turtle(ontology.NEWS_GRAPH))
    assert ontology.class_properties(frame).where("class = 'Article'").count() == 4


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    for kind, ending in (("parquet", "parquet"), ("csv", "csv"), ("json", "jsonl")):
        path = str(tmp_path / f"t.{ending}")
        if kind == "csv":
            df.coalesce(1).write.csv(path, header=True)
        else:
            files.save(df, path, kind, one_file=True)
        assert sorted(str(r["v"]) for r in files.load(spark, path, ["v"]).collect()) == ["a", "b"]
    for bad in ("x.xlsx", "x.doc"):
        with pytest.raises(ValueError):
            files.load(spark, bad)
    dated = spark.sql("SELECT 1 AS k, timestamp'2023-05-01' AS t UNION ALL SELECT 2, timestamp'2024-01-01'")
    files.save_months(dated, str(tmp_path / "m"), "t")
    assert [r["k"] for r in files.load_months(spark, str(tmp_path / "m"), 2023, 5).collect()] == [1]
    (tmp_path / "p.jsonl").write_text('{"A": "a+", "B": "b"}\n{"C": "c"}\n')
    assert files.load_patterns(spark, str(tmp_path / "p.jsonl")).count() == 3
    files.save_vocabulary({"a": 0}, str(tmp_path / "v.json"))
    assert files.load_vocabulary(str(tmp_path / "v.json")) == {"a": 0}


def test_streams(spark, tmp_path):
    schema = "art_id bigint, art_datetime timestamp, v string"
    batch = lambda rows: spark.createDataFrame(rows, "art_id bigint, t string, v string").select("art_id", F.to_timestamp("t").alias("art_datetime"), "v")
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    batch([(1, "2023-01-01", "a"), (1, "2023-01-02", "b"), (2, "2023-01-01", "c")]).write.parquet(source)
    for _ in range(2):
        windows.ingest_articles(spark.readStream.schema(schema).parquet(source), target, state).awaitTermination()
    assert sorted((r["art_id"], r["v"]) for r in spark.read.parquet(target).collect()) == [(1, "b"), (2, "c")]
    batch([(2, "2023-02-01", "late"), (3, "2023-01-01", "d")]).write.mode("append").parquet(source)
    windows.ingest_articles(spark.readStream.schema(schema).parquet(source), target, state).awaitTermination()
    assert sorted((r["art_id"], r["v"]) for r in spark.read.parquet(target).collect()) == [(1, "b"), (2, "c"), (3, "d")]


def test_entry_has_the_contract(spark):
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and "p3_found" in q
    d = "/root/testdata/sf0.001"
    if os.path.exists(d):
        assert e.entry(spark).columns == ["comp_symbol", "comp_name"]
