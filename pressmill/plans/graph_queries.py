"""Queries on the property graph, with their SQL."""

from __future__ import annotations

import uuid
from itertools import islice

from pyspark.sql import functions as F

from pressmill.functions.vectors import cosine, unit
from pressmill.operators import graph
from pressmill.plans.lineage import ensure_checkpoint_dir
from pressmill.sources.tables import table

_Q: dict = {}
_SQL: dict[str, str] = {}
DAY, LAST = "2023-05-01", "2023-05-20"

_G = """article AS (SELECT DISTINCT art_id, art_datetime, art_text, art_source, CAST(art_datetime AT TIME ZONE 'UTC' AS DATE) AS day FROM articles),
  sets AS (SELECT comp_symbol, comp_name, min(mention_id) AS pos FROM mentions WHERE comp_symbol IS NOT NULL GROUP BY ALL),
  named AS (SELECT comp_symbol, comp_name FROM sets QUALIFY row_number() OVER (PARTITION BY comp_symbol ORDER BY pos DESC) = 1),
  isin AS (SELECT symbol, min(isin) AS isin FROM symbol_isin WHERE symbol IS NOT NULL GROUP BY symbol),
  company AS (SELECT n.comp_symbol, n.comp_name, coalesce(i.isin, 'isin_not_found') AS comp_isin, split_part(n.comp_symbol, '.', 2) AS suffix FROM named n LEFT JOIN isin i ON i.symbol = split_part(n.comp_symbol, '.', 1)),
  part AS (SELECT DISTINCT s.sent_id, s.art_id FROM sentences s JOIN article a ON a.art_id = s.art_id),
  ment AS (SELECT DISTINCT m.sent_id, m.comp_symbol FROM mentions m JOIN sentences s ON s.sent_id = m.sent_id WHERE m.comp_symbol IS NOT NULL),
  about AS (SELECT DISTINCT s.sent_id, s.top_id FROM sentences s JOIN topics t ON t.top_id = s.top_id)"""
_COUNTRY = "CASE c.suffix WHEN 'DE' THEN 'Germany' WHEN 'F' THEN 'Germany' WHEN 'L' THEN 'United Kingdom' WHEN 'PA' THEN 'France' WHEN 'AS' THEN 'Netherlands' WHEN 'MI' THEN 'Italy' WHEN 'B' THEN 'Belgium' END"
_PATH = "FROM article a JOIN part p ON p.art_id = a.art_id JOIN ment m ON m.sent_id = p.sent_id JOIN company c ON c.comp_symbol = m.comp_symbol"


def _register(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


_WRITTEN: dict[tuple[str, str], str] = {}


def _graph(spark, d) -> graph.Graph:
    """The graph of a folder, written to the shared folder when an application first asks for it and read from there since."""
    key = spark.sparkContext.applicationId, d
    if key not in _WRITTEN:
        folder = f"{ensure_checkpoint_dir(spark)}/graph-{uuid.uuid4().hex}"
        graph.build_graph(*(table(spark, d, t) for t in ("articles", "sentences", "mentions", "topics", "symbol_isin"))).write(folder)
        _WRITTEN[key] = folder
    return graph.Graph.read(spark, _WRITTEN[key])


@_register(f"WITH {_G} SELECT DISTINCT c.comp_symbol, c.comp_name {_PATH} WHERE a.day = DATE '{DAY}'")
def gq1_companies_on_date(spark, d):
    g = _graph(spark, d)
    return graph.company_sentences(g, graph.on_date(g, DAY)).select("comp_symbol", "comp_name").distinct()


@_register(f"WITH {_G} SELECT DISTINCT a.art_id, a.art_text {_PATH} WHERE a.day = DATE '{DAY}'")
def gq2_articles_with_company(spark, d):
    g = _graph(spark, d)
    hits = graph.company_sentences(g, graph.on_date(g, DAY)).select("art_id").distinct()
    return g.article.join(hits, "art_id", "left_semi").select("art_id", "art_text")


@_register(f"WITH {_G} SELECT DISTINCT c.comp_name, s.sent_text {_PATH} JOIN sentences s ON s.sent_id = p.sent_id WHERE a.day = DATE '{DAY}'")
def gq3_company_sentences(spark, d):
    g = _graph(spark, d)
    return graph.company_sentences(g, graph.on_date(g, DAY)).join(g.sentence, "sent_id").select("comp_name", "sent_text").distinct()


@_register(f"WITH {_G} SELECT DISTINCT t.top_description, s.sent_text FROM article a JOIN part p ON p.art_id = a.art_id JOIN about b ON b.sent_id = p.sent_id JOIN topics t ON t.top_id = b.top_id JOIN sentences s ON s.sent_id = p.sent_id WHERE a.day = DATE '{DAY}'")
def gq4_topic_sentences(spark, d):
    g = _graph(spark, d)
    part = g.is_part_of.join(graph.on_date(g, DAY).select("art_id"), "art_id")
    return part.join(g.is_about, "sent_id").join(g.topic, "top_id").join(g.sentence, "sent_id").select("top_description", "sent_text").distinct()


@_register(f"WITH {_G} SELECT DISTINCT c.comp_name, s.sent_text {_PATH} JOIN sentences s ON s.sent_id = p.sent_id WHERE a.day BETWEEN DATE '{DAY}' AND DATE '{LAST}'")
def gq5_company_sentences_in_range(spark, d):
    g = _graph(spark, d)
    return graph.company_sentences(g, graph.on_date(g, DAY, LAST)).join(g.sentence, "sent_id").select("comp_name", "sent_text").distinct()


@_register(f"WITH {_G} SELECT DISTINCT c.comp_symbol, p.sent_id {_PATH} WHERE lower(c.comp_name) LIKE '%maschinenbau%'")
def gq6_named_companies(spark, d):
    g = _graph(spark, d)
    return g.mentions.join(g.is_part_of.select("sent_id"), "sent_id", "left_semi").join(g.company.where(F.lower("comp_name").contains("maschinenbau")).select("comp_symbol"), "comp_symbol").select("comp_symbol", "sent_id").distinct()


@_register(f"WITH {_G} SELECT DISTINCT {_COUNTRY} AS country, b.top_id, p.sent_id {_PATH} JOIN about b ON b.sent_id = p.sent_id WHERE a.day BETWEEN DATE '{DAY}' AND DATE '{LAST}'")
def gq6_country_topics(spark, d):
    g = _graph(spark, d)
    return graph.company_sentences(g, graph.on_date(g, DAY, LAST)).join(g.is_about, "sent_id").select(graph.country().alias("country"), "top_id", "sent_id").distinct()


@_register(f"WITH {_G} SELECT c.comp_symbol, count(DISTINCT p.sent_id) AS sentences, count(DISTINCT p.art_id) AS articles {_PATH} GROUP BY c.comp_symbol")
def gq7_by_company(spark, d):
    g = _graph(spark, d)
    return graph.company_sentences(g, g.article).groupBy("comp_symbol").agg(F.countDistinct("sent_id").alias("sentences"), F.countDistinct("art_id").alias("articles"))


@_register(f"WITH {_G} SELECT a.day, b.top_id, count(*) AS sentences FROM article a JOIN part p ON p.art_id = a.art_id JOIN about b ON b.sent_id = p.sent_id GROUP BY a.day, b.top_id")
def gq7_by_topic_and_day(spark, d):
    g = _graph(spark, d)
    return g.is_part_of.join(g.article.select("art_id", "day"), "art_id").join(g.is_about, "sent_id").groupBy("day", "top_id").agg(F.count("*").alias("sentences"))


@_register(f"WITH {_G} SELECT DISTINCT c.comp_symbol, p.sent_id {_PATH} WHERE list_contains(regexp_extract_all(c.comp_name, '[A-Z][a-z]{{5,}}'), 'Versicherung')")
def gq7_by_industry(spark, d):
    g = _graph(spark, d)
    words = F.regexp_extract_all("comp_name", F.lit("[A-Z][a-z]{5,}"), F.lit(0))
    in_trade = g.company.where(F.array_contains(words, "Versicherung")).select("comp_symbol")
    return g.mentions.join(g.is_part_of.select("sent_id"), "sent_id", "left_semi").join(in_trade, "comp_symbol").select("comp_symbol", "sent_id")


@_register(f"WITH {_G} SELECT {_COUNTRY} AS country, b.top_id, count(DISTINCT p.sent_id) AS sentences {_PATH} JOIN about b ON b.sent_id = p.sent_id GROUP BY ALL")
def gq7_by_country_and_topic(spark, d):
    g = _graph(spark, d)
    return graph.company_sentences(g, g.article).join(g.is_about, "sent_id").withColumn("country", graph.country()).groupBy("country", "top_id").agg(F.countDistinct("sent_id").alias("sentences"))


@_register(f"WITH {_G} SELECT DISTINCT t.top_id, t.top_description FROM article a JOIN part p ON p.art_id = a.art_id JOIN about b ON b.sent_id = p.sent_id JOIN topics t ON t.top_id = b.top_id WHERE a.day = DATE '{DAY}'")
def gq8_question(spark, d):
    return graph.answer(_graph(spark, d), f"Which topics were discussed on {DAY}?")


@_register("SELECT comp_symbol, comp_name FROM (SELECT comp_symbol, comp_name, min(mention_id) AS pos FROM mentions WHERE comp_symbol IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY comp_symbol ORDER BY pos DESC) = 1")
def g7_upsert_nodes(spark, d):
    return graph.upsert_nodes(table(spark, d, "mentions").select("comp_symbol", "comp_name", "mention_id"), "comp_symbol", ["comp_name"], "mention_id")


@_register(f"WITH {_G} SELECT sent_id, comp_symbol FROM ment")
def g8_upsert_edges(spark, d):
    return _graph(spark, d).mentions


@_register(f"""WITH {_G} SELECT 'article' AS label, count(*) AS rows, count(DISTINCT art_id) AS keys FROM article UNION ALL SELECT 'sentence', count(*), count(DISTINCT sent_id) FROM sentences
  UNION ALL SELECT 'company', count(*), count(DISTINCT comp_symbol) FROM company UNION ALL SELECT 'topic', count(*), count(DISTINCT top_id) FROM topics""")
def g6_uniqueness(spark, d):
    g, out = _graph(spark, d), None
    for label, key in (("article", "art_id"), ("sentence", "sent_id"), ("company", "comp_symbol"), ("topic", "top_id")):
        part = g.tables()[label].agg(F.count("*").alias("rows"), F.countDistinct(key).alias("keys")).select(F.lit(label).alias("label"), "rows", "keys")
        out = part if out is None else out.unionByName(part)
    return out


@_register(f"WITH {_G} SELECT 'is_part_of' AS label, count(*) AS total FROM part UNION ALL SELECT 'mentions', count(*) FROM ment UNION ALL SELECT 'is_about', count(*) FROM about")
def a7_edge_counts(spark, d):
    g, out = _graph(spark, d), None
    for label in ("is_part_of", "mentions", "is_about"):
        part = g.tables()[label].agg(F.count("*").alias("total")).select(F.lit(label).alias("label"), "total")
        out = part if out is None else out.unionByName(part)
    return out


@_register(f"WITH {_G}, ids AS (SELECT isin AS comp_isin, min('Q' || substr(isin, 3)) AS w FROM symbol_isin WHERE isin IS NOT NULL AND substr(isin, 12, 1) < '6' GROUP BY isin) SELECT c.comp_symbol, coalesce(ids.w, 'wikidataID_not_found') AS \"wikidataID\" FROM company c LEFT JOIN ids USING (comp_isin)")
def j10_wikidata_ids(spark, d):
    ids = table(spark, d, "symbol_isin").where("isin IS NOT NULL AND substr(isin, 12, 1) < '6'").select(F.col("isin").alias("comp_isin"), F.concat(F.lit("Q"), F.substring("isin", 3, 20)).alias("wikidataID"))
    return graph.enrich_ids(_graph(spark, d).company, ids).select("comp_symbol", "wikidataID")


@_register(f"""WITH {_G}, v AS (SELECT c.comp_isin, unnest(regexp_extract_all(c.comp_name, '[A-Z][a-z]{{5,}}')) AS industry FROM company c),
  l AS (SELECT comp_isin, array_to_string(list_sort(list(DISTINCT industry)), '|') AS industries FROM v GROUP BY comp_isin) SELECT c.comp_symbol, l.industries FROM company c LEFT JOIN l USING (comp_isin)""")
def j11_industries(spark, d):
    company = _graph(spark, d).company
    values = company.select("comp_isin", F.explode(F.regexp_extract_all("comp_name", F.lit("[A-Z][a-z]{5,}"), F.lit(0))).alias("industries"))
    return graph.enrich_list(company, values, "industries").select("comp_symbol", F.array_join("industries", "|").alias("industries"))


@_register(f"""WITH {_G}, v AS (SELECT comp_isin, max_by(suffix, comp_symbol) AS country FROM company GROUP BY comp_isin) SELECT c.comp_symbol, v.country FROM company c LEFT JOIN v USING (comp_isin)""")
def j11_country_last_write(spark, d):
    company = _graph(spark, d).company
    values = company.select("comp_isin", "comp_symbol", F.split_part("comp_symbol", F.lit("."), F.lit(2)).alias("country")).withColumnRenamed("comp_symbol", "at")
    return graph.enrich_scalar(company, values, "country", "at").select("comp_symbol", "country")


@_register(f"""WITH {_G}, t AS (SELECT DISTINCT m.comp_symbol, a.art_id, a.art_title FROM mentions m JOIN (SELECT DISTINCT art_id, art_title, art_language FROM articles) a USING (art_id) WHERE a.art_language = 'EN' AND m.comp_symbol IS NOT NULL),
  f AS (SELECT comp_symbol, art_title FROM t QUALIFY row_number() OVER (PARTITION BY comp_symbol ORDER BY art_id) = 1) SELECT c.comp_symbol, f.art_title AS abstract FROM company c LEFT JOIN f USING (comp_symbol)""")
def j12_first_abstract(spark, d):
    titles = table(spark, d, "articles").where("art_language = 'EN'").select("art_id", F.col("art_title").alias("abstract")).distinct()
    values = table(spark, d, "mentions").where("comp_symbol IS NOT NULL").select("comp_symbol", "art_id").distinct().join(titles, "art_id")
    return graph.enrich_first(_graph(spark, d).company, values, "comp_symbol", "abstract", "art_id").select("comp_symbol", "abstract")


_COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@_register(f"SELECT b.vec_id, round({_COS}, 6) AS likeness FROM embeddings a, embeddings b WHERE a.vec_id = (SELECT min(vec_id) FROM embeddings) AND b.vec_id <> a.vec_id ORDER BY {_COS} DESC, b.vec_id LIMIT 5")
def j15_query_top5(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    first = e.orderBy("vec_id").limit(1).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    scored = e.join(F.broadcast(first)).where("vec_id <> qid").select("vec_id", cosine(F.col("embedding"), F.col("q")).alias("c"))
    return scored.orderBy(F.desc("c"), "vec_id").limit(5).select("vec_id", F.round("c", 6).alias("likeness"))


@_register(f"""SELECT a.vec_id, arg_max(b.vec_id, (CASE WHEN {_COS} > 0.9999 THEN 0 ELSE {_COS} END, -b.vec_id)) AS nearest FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 GROUP BY a.vec_id""")
def j14_nearest_other(spark, d):
    """A stated query set, every twentieth vector, against all of them in blocks."""
    e = table(spark, d, "embeddings").select("vec_id", unit(F.col("embedding")).alias("u"))
    asked = ((r["vec_id"], list(r["u"])) for r in e.where("vec_id % 20 = 0").orderBy("vec_id").toLocalIterator())
    return nearest_to(spark, e, asked)


def nearest_to(spark, e, asked, block: int = 2000):
    """(vec_id, nearest) of the asked vectors; blocks of them go to the executors, the rows are never paired in a shuffle."""
    import numpy as np
    import pyarrow as pa

    from pressmill.plans.arrow import map_batches

    best, asked = None, iter(asked)
    while part := list(islice(asked, block)):
        ids, q = spark.sparkContext.broadcast(np.array([i for i, _ in part])), spark.sparkContext.broadcast(np.array([v for _, v in part]))

        def make(ids=ids, q=q):
            def step(batch: pa.RecordBatch) -> pa.RecordBatch:
                other = np.array(batch.column(0).to_pylist())
                like = q.value @ np.array(batch.column(1).to_pylist()).T
                like[like > 0.9999] = 0.0
                like[ids.value[:, None] == other[None, :]] = -2.0
                order = np.lexsort((np.broadcast_to(other, like.shape), -like), axis=1)[:, 0]
                rows = np.arange(len(order))
                return pa.RecordBatch.from_arrays([pa.array(ids.value), pa.array(other[order]), pa.array(like[rows, order])], ["vec_id", "nearest", "c"])

            return step

        found = map_batches(e, make, "vec_id bigint, nearest bigint, c double")
        best = found if best is None else best.unionByName(found)
    if best is None:
        return spark.createDataFrame([], "vec_id bigint, nearest bigint")
    return best.where("c > -2").groupBy("vec_id").agg(F.max(F.struct("c", (-F.col("nearest")).alias("m"))).alias("b")).select("vec_id", (-F.col("b.m")).alias("nearest"))


@_register(f"SELECT a.vec_id AS a, b.vec_id AS b, round({_COS}, 6) AS likeness FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 AND NOT (b.vec_id % 20 = 0 AND b.vec_id < a.vec_id) AND {_COS} > 0.3")
def g19_cosine_pairs(spark, d):
    """Every twentieth vector against all others, of any label; blocks of them go to the executors."""
    e = table(spark, d, "embeddings").select("vec_id", (F.col("vec_id") % 20 == 0).alias("asked"), unit(F.col("embedding")).alias("u")).where("vec_id IS NOT NULL AND u IS NOT NULL")
    asked = ((r["vec_id"], list(r["u"])) for r in e.where("asked").toLocalIterator())
    return likeness_above(spark, e, asked, 0.3)


def likeness_above(spark, e, asked, least: float, block: int = 2000):
    """(a, b, likeness) of asked vectors a with all others; of two asked ones a is the smaller. e: vec_id, asked, u."""
    import numpy as np
    import pyarrow as pa

    from pressmill.plans.arrow import map_batches

    out, asked = None, iter(asked)
    while part := list(islice(asked, block)):
        shared = spark.sparkContext.broadcast((np.array([i for i, _ in part]), np.array([v for _, v in part])))

        def make(shared=shared):
            def step(batch: pa.RecordBatch) -> pa.RecordBatch:
                ids, q = shared.value
                other, also = np.array(batch.column(0).to_pylist()), np.array(batch.column(1).to_pylist(), bool)
                like = q @ np.array(batch.column(2).to_pylist()).T
                i, j = np.nonzero((like > least) & (ids[:, None] != other[None]) & ~(also[None] & (other[None] < ids[:, None])))
                return pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(other[j]), pa.array(np.round(like[i, j], 6))], ["a", "b", "likeness"])

            return step

        found = map_batches(e.select("vec_id", "asked", "u"), make, "a bigint, b bigint, likeness double")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "a bigint, b bigint, likeness double")


@_register()
def j13_class_properties(spark, d):
    """The schema's classes and properties, by joining its triples."""
    from pressmill.sources import ontology

    return ontology.class_properties(ontology.triple_frame(spark, ontology.parse_turtle(ontology.NEWS_GRAPH)))


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
