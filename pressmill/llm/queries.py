"""Queries of the operators on training text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressmill.llm import bpe, canonical, language, leakage, names, near_duplicates, sentences, site_lines, toxicity
from pressmill.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    articles = table(spark, d, "articles")
    model = language.fit_filter(articles, "art_id", "art_text", "art_language", name_col="art_source")
    return language.label_cases(language.detect_languages(articles, model, name_col="art_source"), articles).select(F.col("id").alias("art_id"), "lang")


def p1_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    articles = table(spark, d, "articles")
    model = language.fit_filter(articles, "art_id", "art_text", "art_language", name_col="art_source")
    return language.detect_languages(articles, model, name_col="art_source").select(F.col("id").alias("art_id"), "par", "lang", F.round("confidence", 4).alias("confidence")).distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return site_lines.repeated_lines(table(spark, d, "articles")).select(F.col("id").alias("art_id"), "line_no")


def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    articles = table(spark, d, "articles")
    return site_lines.without_lines(articles, site_lines.repeated_lines(articles)).select(F.col("id").alias("art_id"), "clean_text").distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    links, member = near_duplicates.near_duplicates(table(spark, d, "articles"))
    return near_duplicates.expand(links, member).select(F.col("a").alias("art_id_a"), F.col("b").alias("art_id_b"))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    links, member = near_duplicates.near_duplicates(table(spark, d, "articles"))
    return near_duplicates.duplicate_groups(links, member).select(F.col("id").alias("art_id"), "group_id", "links")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "company_nodes")
    reviewed = nodes.where("comp_symbol IS NOT NULL").select(F.col("comp_symbol").alias("symbol"), F.col("comp_name").alias("name"))
    unnamed = nodes.where("comp_symbol IS NULL").select("node_id", "comp_name")
    linked = names.link_names(unnamed, table(spark, d, "companies"), reviewed=reviewed).where("posterior >= 0.5")
    return unnamed.join(linked, unnamed["comp_name"] == linked["name"]).select("node_id", "symbol").distinct()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    both = None
    for tab, key, text in (("companies", "symbol", "name"), ("articles", "art_id", "art_text")):
        part = canonical.canonicalise(table(spark, d, tab), key, text).where("why > 0").select(F.lit(tab).alias("tab"), "row_key")
        both = part if both is None else both.unionByName(part)
    return both.distinct()


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_table(table(spark, d, "articles")).select(F.col("id").alias("art_id"), "end_pos")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_texts(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def _scores(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return toxicity.score_documents(documents, toxicity.fit_reviewed(documents, table(spark, d, "review_samples")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.flagged(_scores(spark, d))


def p10_source_rates(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.source_rates(table(spark, d, "documents"), _scores(spark, d))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_paragraphs, p2_found, p2_clean, p4_found, p4_groups, p5_found, p6_found, p7_found, p8_ids, p9_found, p10_found, p10_source_rates)}


def oracle_sql() -> dict[str, str]:
    """Where plain SQL states the result and runs over whole tables."""
    letters = "regexp_replace(lower(l.line), '[^\\p{L}]', '', 'g')"
    lines = f"""
        WITH a AS (SELECT DISTINCT art_id, art_source, art_text FROM articles WHERE art_id IS NOT NULL AND art_source IS NOT NULL AND art_text IS NOT NULL),
        l AS (SELECT art_id, art_source, unnest(string_split(art_text, chr(10))) AS line, generate_subscripts(string_split(art_text, chr(10)), 1) AS line_no FROM a),
        k AS (SELECT art_id, art_source, line_no, {letters} AS key FROM l WHERE length({letters}) >= 8),
        r AS (SELECT art_source, key FROM k GROUP BY art_source, key HAVING count(DISTINCT art_id) >= 5)
        SELECT DISTINCT k.art_id, CAST(k.line_no AS INTEGER) AS line_no FROM k JOIN r ON k.art_source = r.art_source AND k.key = r.key"""
    leaks = """
        WITH i AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
        ip AS (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS p FROM i),
        ig AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, p, p + 12), ' ') AS g FROM ip),
        d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
        dp AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d),
        dg AS (SELECT doc_id, array_to_string(list_slice(w, p, p + 12), ' ') AS g FROM dp)
        SELECT DISTINCT dg.doc_id, ig.item_id FROM dg JOIN ig ON dg.g = ig.g"""
    return {"p2_found": lines, "p9_found": leaks}
