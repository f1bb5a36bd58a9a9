"""A training corpus from `documents`: five stages, each written as Parquet and read again as the next one's input.

All stages take null doc_id, text, lang and source, empty and very long texts, repeated rows, empty tables and extra
columns. What each does with them is said in its docstring; where it isn't, rows pass through as they are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm import common as C
from textquarry.llm.decontamination import decontaminate
from textquarry.llm.line_dedup import line_dedup
from textquarry.llm.mixing import mix_sources
from textquarry.llm.near_dedup import near_duplicates
from textquarry.llm.perplexity import classify_quality, trusted_documents


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    while name in docs.columns:
        name += "_"
    return name


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of trusted text rejects go.

    Rows with a null doc_id stay, and so do null and empty texts, which have no perplexity; a null lang is a language of
    its own. Of rows that share a doc_id all go if one is rejected. Without labels of quality all stay.
    """
    done = classify_quality(docs.select("doc_id", "text", "lang"), trusted_documents(C.read_documents(spark, sf_dir, "labels")))
    return C.drop_rows(docs, done.where("NOT kept"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents have stay in the first of them only; documents that lose every line go. n_chars follows.

    The first is the one with the smallest doc_id; each row that has it keeps the line. Rows with a null doc_id are one
    document after all others. Null texts have one empty line, which nothing drops, and stay null.
    """
    n_lines = fresh(docs, "__n_lines")
    n_dropped = fresh(docs, n_lines + "_dropped")
    done = line_dedup(docs, min_docs=10, min_chars=1, keep="first", counts=(n_lines, n_dropped)).where((F.col(n_dropped) == 0) | (F.col(n_dropped) < F.col(n_lines)))
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest doc_id stays, once.

    Null and empty texts are one class. Rows with a null doc_id stay; of rows that share a doc_id one stays.
    """
    classes = near_duplicates(docs)
    return C.drop_rows(docs, classes.where("doc_id != class_id"), once=True)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go. Rows with a null doc_id stay; null and empty texts hold none."""
    return C.drop_rows(docs, decontaminate(docs, C.read_documents(spark, sf_dir, "benchmark")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how often (copies), its words and its source's target.

    Null and empty texts have no words and go. A null source is one of its own. Rows are told apart by
    doc_id, source and a hash of the text; of equal ones, each gets the copies of the one that is taken most. Columns named copies, size,
    taken or target give way.
    """
    docs = docs.drop("copies", "size", "taken", "target")
    name = fresh(docs, "__name")
    named = docs.withColumn(name, F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.hex(F.xxhash64("text")), "source"))
    mixed = mix_sources(named, carry=(name,)).where("copies > 0 AND size > 0").groupBy(name).agg(*[F.max(c).alias(c) for c in ("copies", "size", "taken", "target")])
    return named.join(mixed, name).drop(name)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", dedup_lines),
    ("MinHash near-dedup", dedup_near),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources to target weights", mix),
]

#: The perplexities of the first stage and the signatures of the third are beyond SQL; tests compare the stages with
#: brute-force versions.
ORACLE_SQL = None


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents. What they write lies in the folder that all executors share, until the next one is written."""
    folder = f"{C.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = C.read_documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            delete(spark, f"{folder}/{k - 1}")
    return docs
