"""Files in and out."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def load(spark: SparkSession, path: str, columns: list[str] | None = None, schema: StructType | str | None = None) -> DataFrame:
    """A parquet, csv or json file or folder, by the ending of its name; only the columns asked for are read."""
    kind = os.path.splitext(path.rstrip("/"))[1].lower()
    if kind in ("", ".parquet", ".pq"):
        df = spark.read.parquet(path)
    elif kind == ".csv":
        df = spark.read.schema(schema).csv(path, header=True) if schema else spark.read.csv(path, header=True)
    elif kind in (".json", ".jsonl"):
        df = spark.read.schema(schema).json(path) if schema else spark.read.json(path)
    elif kind == ".xlsx":
        raise ValueError("spreadsheets are not read; convert to csv or parquet first")
    else:
        raise ValueError(f"file type not supported: {kind}")
    return df.select(*columns) if columns else df


def load_months(spark: SparkSession, folder: str, year: int | None = None, month: int | None = None) -> DataFrame:
    """A table partitioned by year and month; only the folders asked for are read."""
    df = spark.read.parquet(folder)
    for name, value in (("year", year), ("month", month)):
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def save_months(df: DataFrame, folder: str, time_col: str) -> None:
    dated = df.withColumn("year", F.year(time_col)).withColumn("month", F.month(time_col))
    dated.write.mode("overwrite").partitionBy("year", "month").parquet(folder)


def save(df: DataFrame, path: str, kind: str = "parquet", one_file: bool = False) -> None:
    out = df.coalesce(1) if one_file else df
    out.write.mode("overwrite").format(kind).save(path)


def load_words(spark: SparkSession, path: str) -> DataFrame:
    """One word a line, tab-separated, without header."""
    return spark.read.csv(path, sep="\t", schema="word string").dropna()


def load_names(spark: SparkSession, paths: list[str], sep: str = "~", column: str = "first_name") -> DataFrame:
    """Lists of names with headers that differ, as one column, doubles kept."""
    out = None
    for path in paths:
        part = spark.read.csv(path, sep=sep, header=True).select(column)
        out = part if out is None else out.unionByName(part)
    return out


def load_patterns(spark: SparkSession, path: str) -> DataFrame:
    """(key, pattern) of a file with one JSON object a line, each with one entry or several."""
    parsed = spark.read.text(path).select(F.from_json("value", "map<string,string>").alias("m"))
    return parsed.select(F.explode("m").alias("key", "pattern"))


def save_vocabulary(words: dict[str, int], path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(words, f, ensure_ascii=False)


def load_vocabulary(path: str) -> dict[str, int]:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def date_from_path(df: DataFrame) -> DataFrame:
    """Adds year and month of files named ..._YYYY-MM..."""
    name = F.input_file_name()
    return df.withColumn("file_year", F.regexp_extract(name, r"_(\d{4})-(\d{2})", 1)).withColumn("file_month", F.regexp_extract(name, r"_(\d{4})-(\d{2})", 2))
