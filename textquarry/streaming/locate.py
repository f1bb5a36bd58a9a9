"""Queries that arrive as a stream, located in an index at rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import build
from ..operators.build import at
from ..operators.index import TextIndex


def locate_stream(queries: DataFrame, index: TextIndex) -> DataFrame:
    """(query_id, text_id, position) of a streaming (query_id, query): stream-static inner joins, without state.

    The seed is the last k bytes of a query, which needs no look at other rows; shorter queries go by their prefix.
    """
    k = index.k
    folded = index.fold_queries(queries)
    short = folded.where(F.length("q") <= k).join(build.prefixes(index.grams).select("kmer", "gram"), F.col("q") == F.col("kmer")).join(index.postings, "gram")
    shift = F.length("q") - k
    seeded = folded.where(F.length("q") > k).withColumn("shift", shift).withColumn("gram", at(F.col("q"), F.col("shift"), k))
    maybe = seeded.join(index.postings, "gram").withColumn("position", F.col("position") - F.col("shift")).where("position >= 0").join(index.texts, "text_id")
    hit = maybe.where(at(F.col("t"), F.col("position"), F.length("q")) == F.col("q"))
    return short.select("query_id", "text_id", "position").unionByName(hit.select("query_id", "text_id", "position"))
