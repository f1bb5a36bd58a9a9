"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

A document's key is -ln(u) / quality, u a hash of doc_id: keys in ascending order are a sample without replacement,
weighted by quality. Each source is taken in whole epochs as often as its target allows; for the rest documents are
taken in order of key until the prefix sum of words reaches the budget.

A prefix sum over a source that holds a third of all rows is one group, so it is taken in two steps: keys fall into bins
in their order, sums of the bins give each bin its offset, and only inside a bin of a source rows are sorted. Bins are
equally wide in the logarithm of the key. Whatever the weights, a bin then holds at most 0.37 / bins of a source's rows: the
share of an exponential variable between x and x * exp(1 / bins).

Texts are read once; what is known of each document, a few numbers, is written as a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .quality_rules import n_words, without

NOISE = "#*$%&|<>!"


def quality_weight(text: Column) -> Column:
    """0.05 to 1, falling with the share of symbols that prose seldom has."""
    share = (F.length(text) - F.length(without(text, NOISE))) / F.greatest(F.length(text), F.lit(1))
    return F.greatest(F.lit(0.05), 1 - 4 * share)


def unit_hash(name: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on the row's name and the seed only."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(seed), name)), 1, 12), 16, 10).cast("double") + 0.5) / float(16**12)


def source_targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """(source, source_size, target) of (source, source_size): share of all words, split by weight, at most `most` times each.

    The excess of sources at their limit goes to the others by weight until none is above. With sources in order of
    limit / weight, those at their limit are a prefix of it, which one pass of prefix sums finds. One row per source here.
    """
    every = Window.orderBy(F.col("source").isNull(), "source")
    order = Window.orderBy("r", "rank").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("r", "rank").rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    s = sizes.withColumn("rank", F.row_number().over(every) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.col("rank"), F.lit(len(weights))).cast("int") + 1)
    s = s.withColumn("w", w).withColumn("cap", most * F.col("source_size")).withColumn("r", F.col("cap") / F.col("w"))
    s = s.withColumn("all", share * F.sum("source_size").over(whole)).withColumn("level", (F.col("all") - F.coalesce(F.sum("cap").over(order), F.lit(0.0))) / F.sum("w").over(after))
    # The first source whose limit isn't below the level of itself and all behind it sets the level.
    level = F.first(F.when(F.col("level") <= F.col("r"), F.col("level")), ignorenulls=True).over(Window.orderBy("r", "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    s = s.withColumn("water", level)
    return s.select("source", "source_size", F.when(F.col("water").isNull() | (F.col("r") <= F.col("water")), F.col("cap")).otherwise(F.col("water") * F.col("w")).alias("target"))


def mix_sources(docs: DataFrame, weights: list[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix", bins: int = 1024, source: str = "source", weight: Column | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: one row per row of docs.

    Sources by code point, null last, get weights in turn. taken is size times copies: the epochs that fit into the
    target, and one more for the documents whose middle, along the prefix sum in order of key, lies inside the rest.

    Null or empty text: size 0, nothing taken. Null source: a source of its own. Null doc_id: named by the
    text. Repeated rows have equal keys and follow one another. Empty table: empty result. Columns named in
    carry are returned too; other extra columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null"), F.md5(text)))
    key = -F.log(unit_hash(name, seed)) / (quality_weight(text) if weight is None else weight)
    d = C.stored(docs.select("doc_id", F.col(source).alias("source"), n_words(text).cast("long").alias("size"), key.alias("key"), *[F.col(c).alias(f"__carry{i}") for i, c in enumerate(carry)]), "mixing")
    d = d.withColumn("bin", F.floor(F.log("key") * bins))
    per_bin = d.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    # Sums of a source's bins: bins times the range of the keys' logarithm, some tens.
    per_bin = per_bin.withColumn("before", F.coalesce(F.sum("bin_size").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    targets = source_targets(per_bin.groupBy("source").agg(F.sum("bin_size").alias("source_size")), list(weights), share, most)
    t = targets.select(F.col("source").alias("s2"), "source_size", "target")
    per_bin = per_bin.join(t, F.col("source").eqNullSafe(F.col("s2")), "left").select(F.col("source").alias("s3"), F.col("bin").alias("b3"), "before", "source_size", "target")
    within = Window.partitionBy("source", "bin").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("ahead", F.coalesce(F.sum("size").over(within), F.lit(0)))
    d = d.join(per_bin, F.col("source").eqNullSafe(F.col("s3")) & (F.col("bin") == F.col("b3")), "left")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    d = d.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    more = (F.col("before") + F.col("ahead") + F.col("size") / 2 <= F.col("rest")) & (F.col("size") > 0) & (F.col("epochs") < most)
    d = d.withColumn("copies", F.col("epochs") + more.cast("long"))
    return d.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), *[F.col(f"__carry{i}").alias(c) for i, c in enumerate(carry)])


def op3_mix_sources(spark, sf_dir: str) -> DataFrame:
    mixed = mix_sources(C.read_documents(spark, sf_dir), weights=[5, 2, 1], share=1.5, most=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         -ln((('0x' || substr(md5('mix' || coalesce(doc_id::VARCHAR, 'null' || md5(coalesce(text, '')))), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0)
         / greatest(0.05, 1 - 4 * ((length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#*$%&|<>!', '')))::DOUBLE / greatest(length(coalesce(text, '')), 1))) AS k
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source COLLATE "C") - 1 AS rank FROM d GROUP BY source
), w AS (
  SELECT *, [5.0, 2.0, 1.0][(rank % 3 + 1)::INT]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap,
         2.0::DOUBLE * source_size / [5.0, 2.0, 1.0][(rank % 3 + 1)::INT]::DOUBLE AS r FROM s
), v AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY r, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(w) OVER (ORDER BY r, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), water AS (SELECT first(level ORDER BY r, rank) FILTER (WHERE level <= r) AS water FROM v),
t AS (
  SELECT source, source_size, CASE WHEN water IS NULL OR r <= water THEN cap ELSE water * w END AS target FROM v, water
), o AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END::BIGINT AS epochs,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN ahead + size / 2 <= target - epochs * source_size AND size > 0 AND epochs < 2 THEN 1 ELSE 0 END))::BIGINT AS taken
FROM o
"""
