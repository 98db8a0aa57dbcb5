"""Reshaping of article frames: flattening, keeping one of many, ordered groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def flatten_mentions(articles: DataFrame) -> DataFrame:
    """A row for each mention of each sentence; articles and sentences without any keep one row of nulls."""
    one = articles.select("art_id", F.posexplode_outer("ner_coref").alias("sent_pos", "s"))
    two = one.select("art_id", "sent_pos", F.col("s.sentence").alias("top_sent"), F.posexplode_outer("s.entities").alias("ent_pos", "e"))
    return two.select("art_id", "sent_pos", "ent_pos", "top_sent", F.col("e.start_char").alias("start_char"), F.col("e.end_char").alias("end_char"), F.col("e.ent_text").alias("ent_text"), F.col("e.comp_name").alias("comp_name"), F.col("e.comp_symbol").alias("comp_symbol"), F.col("e.set_in").alias("set_in"))


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each value of the keys, the last in the order; nulls are equal to each other."""
    last = F.max(F.struct(*order, *[c for c in df.columns if c not in {*keys, *order}])).alias("_last")
    picked = df.groupBy(*keys).agg(last)
    return picked.select(*[F.col(c) if c in keys else F.col(f"_last.{c}").alias(c) for c in df.columns])


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    first = F.min(F.struct(*order, *[c for c in df.columns if c not in {*keys, *order}])).alias("_first")
    picked = df.groupBy(*keys).agg(first)
    return picked.select(*[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in df.columns])


def dense_ids(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Consecutive numbers from 0 in the order, without one task for all rows.

    Rows are spread by ranges of the order; each range is numbered by itself and
    shifted by the sizes of the ranges before, which is all that reaches the driver.
    """
    from pressmill.plans.lineage import cut

    parts = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    sizes = {r["_part"]: r["n"] for r in parts.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    shift, before = [], 0
    for part in sorted(sizes):
        shift += [F.lit(part), F.lit(before).cast("bigint")]
        before += sizes[part]
    if not shift:
        return df.withColumn(name, F.lit(0).cast("bigint"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return parts.withColumn(name, within + F.try_element_at(F.create_map(*shift), F.col("_part"))).drop("_part")


def ordered_join(value: Column, order: Column, sep: str) -> Column:
    """Aggregate: the values in the order, joined."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"]), sep)


def top_n(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group; Spark keeps n candidates a group before the shuffle."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def most_frequent(df: DataFrame, group: list[str], value: str, first: str) -> DataFrame:
    """The most frequent value of each group; of equals the one that comes first by ``first``."""
    counted = df.groupBy(*group, value).agg(F.count("*").alias("n"), F.min(first).alias("at"))
    return counted.groupBy(*group).agg(F.max(F.struct("n", (-F.col("at")).alias("at"), F.col(value).alias("v"))).alias("m")).select(*group, F.col("m.v").alias(value), F.col("m.n").alias("n"))


def split_symbol(df: DataFrame, col: str = "comp_symbol") -> DataFrame:
    """The ticker before the first dot and the exchange behind it, empty without one."""
    return df.withColumn("comp_symbol_raw", F.split_part(F.col(col), F.lit("."), F.lit(1))).withColumn("comp_symbol_country", F.split_part(F.col(col), F.lit("."), F.lit(2)))


def with_isin(df: DataFrame, isins: DataFrame) -> DataFrame:
    """Left join on the ticker; several ISINs of a ticker give several rows, none gives ``isin_not_found``."""
    known = isins.select(F.col("symbol").alias("comp_symbol_raw"), F.col("isin").alias("comp_isin")).where("comp_symbol_raw IS NOT NULL")
    return split_symbol(df).join(known, "comp_symbol_raw", "left").withColumn("comp_isin", F.coalesce("comp_isin", F.lit("isin_not_found")))


def kg_rows(articles: DataFrame, isins: DataFrame) -> DataFrame:
    """Sentence and company of each mention: flattened, the last of equal ones kept, without nulls, with ISIN."""
    flat = flatten_mentions(articles.dropDuplicates(["art_id"])).select("top_sent", "comp_symbol", "comp_name", "art_id", "sent_pos", "ent_pos")
    kept = keep_last(flat, ["top_sent", "comp_symbol", "comp_name"], ["art_id", "sent_pos", "ent_pos"])
    return with_isin(kept.dropna(subset=["top_sent", "comp_symbol", "comp_name"]), isins)
