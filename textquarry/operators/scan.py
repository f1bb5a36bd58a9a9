"""Search without an index: one pass over the texts for a few queries."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .build import at, positions


def count_in(text: Column, query: bytes) -> Column:
    """Occurrences, overlapping ones included, of a canonical query in a binary column of canonical bytes."""
    if not query:
        return (F.length(text) + 1).cast("long")
    quoted = "".join(f"\\x{b:02x}" for b in query)
    return F.regexp_count(F.decode(text, "ISO-8859-1"), F.lit(f"(?={quoted})")).cast("long")


def scan_count(texts: DataFrame, queries: dict[int, bytes]) -> DataFrame:
    """(query_id, n) for a few queries; all are counted in one pass, and one row leaves each task."""
    names = [f"q{i}" for i in range(len(queries))]
    sums = texts.agg(*[F.coalesce(F.sum(count_in(F.col("t"), q)), F.lit(0)).alias(n) for n, q in zip(names, queries.values())])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("query_id"), F.col(n).alias("n")) for n, i in zip(names, queries)])).alias("x")).select("x.*")


def scan_locate(texts: DataFrame, queries: dict[int, bytes], chunk: int = 1 << 16) -> DataFrame:
    """(query_id, text_id, position) for a few queries."""
    if not queries:
        return texts.sparkSession.createDataFrame([], "query_id long, text_id long, position long")
    # A text without any of the queries is dropped before its positions are spread.
    some = None
    for q in queries.values():
        hit = F.lit(True) if not q else F.contains(F.col("t"), F.lit(q))
        some = hit if some is None else some | hit
    spread = positions(texts.where(some), max(1, *map(len, queries.values())), chunk)
    here = {i: at(F.col("piece"), F.col("i"), len(q)) == F.lit(q) for i, q in queries.items()}
    # Most positions have no hit: they go before anything is made of them.
    spread = spread.where(reduce(or_, here.values()))
    hits = F.array(*[F.when(hit, F.lit(i).cast("long")) for i, hit in here.items()])
    return spread.select(F.explode(hits).alias("query_id"), "text_id", "position").where("query_id IS NOT NULL")


def naive_hits(texts: dict[int, bytes], query: bytes) -> set[tuple[int, int]]:
    """For tests: every hit by looking at every position."""
    return {(i, m.start()) for i, t in texts.items() for m in re.finditer(b"(?=" + re.escape(query) + b")", t, re.S)}
