"""Saving and loading of an index: Parquet tables and a manifest."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.alphabet import Alphabet
from ..operators import build
from ..operators.index import TextIndex, require_texts
from ..plans.config import IndexConfig, PerformancePriority

FORMAT_VERSION = 3
SCHEMAS = {"texts": "text_id long, t binary", "grams": "gram binary, n long"}


def postings_schema(width: int) -> str:
    return f"gram binary, text_id array<long>, position array<{'int' if width == 32 else 'long'}>, slice string"


def save_index(index: TextIndex, path: str, mode: str = "errorifexists") -> TextIndex:
    """Writes the tables and returns the saved index.

    Postings lie in folders by slice, the first bytes of a gram, and inside them in order of gram, up to a thousand of one
    gram in a row, so a query reads the slices and row groups of its grams, and a gram that a third of all positions have
    is many files.
    """
    require_texts(index)
    index.texts.write.mode(mode).parquet(f"{path}/texts")
    texts = index.spark.read.schema(SCHEMAS["texts"]).parquet(f"{path}/texts")
    order = ["slice", "gram", F.get("text_id", F.lit(0)), F.get("position", F.lit(0))]
    packs = build.packed_postings(texts, index.alphabet, index.k, index.config.chunk, index.config.index_width)
    filed = packs.withColumn("slice", build.slice_column(F.col("gram"), index.slice_bytes))
    filed.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).partitionBy("slice").parquet(f"{path}/postings")
    filed = index.spark.read.schema(postings_schema(index.config.index_width)).parquet(f"{path}/postings")
    filed.groupBy("gram").agg(F.sum(F.size("position")).alias("n")).sort("gram").write.mode(mode).parquet(f"{path}/grams")
    manifest = {
        "format_version": FORMAT_VERSION, "groups": [g.hex() for g in index.alphabet.groups], "n_unsearchable": index.alphabet.n_unsearchable,
        "sampling_rate": index.config.suffix_array_sampling_rate, "gram_length": index.k, "priority": index.config.priority.value, "chunk": index.config.chunk,
        "index_width": index.config.index_width,
    }
    index.spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode(mode).text(f"{path}/manifest")
    return load_index(index.spark, path)


def load_index(spark: SparkSession, path: str) -> TextIndex:
    m = json.loads(spark.read.text(f"{path}/manifest").first()["value"])
    if m["format_version"] != FORMAT_VERSION:
        raise ValueError(f"index format {m['format_version']} can't be read; this is {FORMAT_VERSION}")
    tables = {name: spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in SCHEMAS.items()}
    tables["packs"] = spark.read.schema(postings_schema(m["index_width"])).parquet(f"{path}/postings")
    tables["postings"] = build.unpacked(tables["packs"], "slice")
    config = IndexConfig(m["sampling_rate"], m["gram_length"], PerformancePriority(m["priority"]), m["chunk"], m["index_width"])
    return TextIndex(Alphabet(tuple(bytes.fromhex(g) for g in m["groups"]), m["n_unsearchable"]), config, **tables, filed=True)
