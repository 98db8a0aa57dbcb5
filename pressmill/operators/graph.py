"""The property graph as node and edge tables."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressmill.functions.dates import utc_date
from pressmill.operators.frames import keep_first

#: Exchange suffix of a symbol and the country it stands for (fixed values of this data).
COUNTRY_OF_EXCHANGE = {"DE": "Germany", "F": "Germany", "L": "United Kingdom", "PA": "France", "AS": "Netherlands", "MI": "Italy", "B": "Belgium"}


def upsert_nodes(rows: DataFrame, key: str, props: list[str], order: str) -> DataFrame:
    """One node for each key. Of the distinct property sets in order of first occurrence the last one wins."""
    sets = rows.where(F.col(key).isNotNull()).groupBy(key, *props).agg(F.min(order).alias("_first"))
    return sets.groupBy(key).agg(F.max(F.struct("_first", *props)).alias("_p")).select(key, *[F.col(f"_p.{p}").alias(p) for p in props])


def upsert_edges(rows: DataFrame, source: DataFrame, target: DataFrame, source_key: str, target_key: str) -> DataFrame:
    """Distinct edges both of whose ends exist."""
    ends = rows.where(F.col(source_key).isNotNull() & F.col(target_key).isNotNull()).select(source_key, target_key).distinct()
    kept = ends.join(source.select(source_key), source_key, "left_semi").join(target.select(target_key), target_key, "left_semi")
    return kept.select(source_key, target_key)


@dataclass
class Graph:
    article: DataFrame
    sentence: DataFrame
    company: DataFrame
    topic: DataFrame
    is_part_of: DataFrame
    mentions: DataFrame
    is_about: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return dict(self.__dict__)

    def write(self, folder: str) -> None:
        """All tables; articles lie by day, so that a query on some days reads these only."""
        for name, df in self.tables().items():
            w = df.repartition("day").write.partitionBy("day") if name == "article" else df.write
            w.mode("overwrite").parquet(f"{folder}/{name}")

    @classmethod
    def read(cls, spark, folder: str) -> Graph:
        return cls(**{name: spark.read.parquet(f"{folder}/{name}") for name in cls.__dataclass_fields__})


def build_graph(articles: DataFrame, sentences: DataFrame, mentions: DataFrame, topics: DataFrame, isins: DataFrame) -> Graph:
    """The four node and three edge tables; every edge has both its ends."""
    props = ["art_datetime", "art_text", "art_source"]
    # copies that differ: the greatest row, so that each run keeps the same
    article = articles.where("art_id IS NOT NULL").groupBy("art_id").agg(F.max(F.struct(*props)).alias("_a")).select("art_id", *[F.col(f"_a.{p}").alias(p) for p in props])
    article = article.withColumn("day", utc_date(F.col("art_datetime")))
    sentence = sentences.where("sent_id IS NOT NULL").select("sent_id", "sent_text")
    named = upsert_nodes(mentions.select("comp_symbol", "comp_name", "mention_id"), "comp_symbol", ["comp_name"], "mention_id")
    isin = isins.where("symbol IS NOT NULL").groupBy(F.col("symbol").alias("_raw")).agg(F.min("isin").alias("comp_isin"))
    company = named.join(isin, F.split_part("comp_symbol", F.lit("."), F.lit(1)) == F.col("_raw"), "left").select("comp_symbol", "comp_name", F.coalesce("comp_isin", F.lit("isin_not_found")).alias("comp_isin"))
    topic = topics.select("top_id", "top_description").where("top_id IS NOT NULL").distinct()
    return Graph(
        article, sentence, company, topic,
        upsert_edges(sentences, sentence, article, "sent_id", "art_id"),
        upsert_edges(mentions, sentence, company, "sent_id", "comp_symbol"),
        upsert_edges(sentences, sentence, topic, "sent_id", "top_id"),
    )


def on_date(g: Graph, first: str, last: str | None = None) -> DataFrame:
    """Articles of a day, or of a closed range of days."""
    return g.article.where(F.col("day").between(F.lit(first).cast("date"), F.lit(last or first).cast("date")))


def company_sentences(g: Graph, articles: DataFrame) -> DataFrame:
    """(article, sentence) -[mentions]-> company over the given articles."""
    part = g.is_part_of.join(articles.select("art_id"), "art_id")
    return part.join(g.mentions, "sent_id").join(g.company, "comp_symbol")


def country() -> Column:
    """The country of ``comp_symbol``'s exchange, null for an unknown or absent suffix."""
    table = F.create_map(*[F.lit(x) for pair in COUNTRY_OF_EXCHANGE.items() for x in pair])
    return F.try_element_at(table, F.split_part("comp_symbol", F.lit("."), F.lit(2)))


def enrich_ids(company: DataFrame, ids: DataFrame) -> DataFrame:
    """``ids``: comp_isin, wikidataID. Companies without one get ``wikidataID_not_found``."""
    one = ids.where("comp_isin IS NOT NULL").groupBy("comp_isin").agg(F.min("wikidataID").alias("wikidataID"))
    return company.join(one, "comp_isin", "left").withColumn("wikidataID", F.coalesce("wikidataID", F.lit("wikidataID_not_found")))


def enrich_list(company: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """The distinct values of each ISIN as a sorted list; companies that share an ISIN share it, none gives null."""
    lists = values.where("comp_isin IS NOT NULL").groupBy("comp_isin").agg(F.sort_array(F.collect_set(name)).alias(name))
    return company.join(lists, "comp_isin", "left")


def enrich_scalar(company: DataFrame, values: DataFrame, name: str, order: str) -> DataFrame:
    """The last value in the order of each ISIN."""
    last = values.where("comp_isin IS NOT NULL").groupBy("comp_isin").agg(F.max(F.struct(order, name)).alias("_v")).select("comp_isin", F.col(f"_v.{name}").alias(name))
    return company.join(last, "comp_isin", "left")


def enrich_first(company: DataFrame, values: DataFrame, key: str, name: str, order: str) -> DataFrame:
    """The first value in the order of each key."""
    return company.join(keep_first(values.where(F.col(key).isNotNull()).select(key, name, order), [key], [order]).select(key, name), key, "left")


#: Questions that are understood: a pattern and what its places mean.
_QUESTIONS = (
    (re.compile(r"(?i)which companies (?:were|are) (?:mentioned|named).* on (?P<day>\d{4}-\d\d-\d\d)"), "companies"),
    (re.compile(r"(?i)which topics .* on (?P<day>\d{4}-\d\d-\d\d)"), "topics"),
    (re.compile(r"(?i)sentences (?:about|on|of) (?P<name>.+?) (?:between|from) (?P<day>\d{4}-\d\d-\d\d) (?:and|to) (?P<last>\d{4}-\d\d-\d\d)"), "named"),
    (re.compile(r"(?i)articles .* on (?P<day>\d{4}-\d\d-\d\d)"), "articles"),
)


def answer(g: Graph, question: str) -> DataFrame:
    """The plan that a question means; a ValueError for one that isn't understood or names an impossible day."""
    for pattern, kind in _QUESTIONS:
        if m := pattern.search(question):
            slots = m.groupdict()
            for k in ("day", "last"):
                if slots.get(k):
                    date.fromisoformat(slots[k])
            articles = on_date(g, slots["day"], slots.get("last"))
            if kind == "companies":
                return company_sentences(g, articles).select("comp_symbol", "comp_name").distinct()
            if kind == "topics":
                return g.is_part_of.join(articles.select("art_id"), "art_id").join(g.is_about, "sent_id").join(g.topic, "top_id").select("top_id", "top_description").distinct()
            if kind == "articles":
                return articles.join(g.is_part_of, "art_id").join(g.mentions, "sent_id").select("art_id", "art_text").distinct()
            return company_sentences(g, articles).where(F.lower("comp_name").contains(slots["name"].strip().lower())).join(g.sentence, "sent_id").select("comp_name", "sent_text").distinct()
    raise ValueError(f"not understood: {question}")
