"""Texts and queries from files and literals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def literal_texts(spark: SparkSession, texts: list[bytes]) -> DataFrame:
    """(text_id, text): ids count from 0 in the given order."""
    return spark.createDataFrame([(i, bytearray(t)) for i, t in enumerate(texts)], "text_id long, text binary")


def table_texts(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(text_id, text) of any table with an integer id and a string or binary column."""
    return df.select(F.col(id_column).cast("long").alias("text_id"), F.col(text_column).cast("binary").alias("text"))


def fasta_texts(spark: SparkSession, path: str) -> DataFrame:
    """(name, text) of the records of FASTA files: the line after '>' and the joined lines that follow it."""
    records = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("r")).where(F.length("r") > 0)
    name = F.regexp_extract("r", "^([^\r\n]*)", 1)
    body = F.regexp_replace(F.regexp_replace("r", "^[^\r\n]*", ""), "\\s", "")
    return records.select(F.trim(name).alias("name"), body.cast("binary").alias("text"))
