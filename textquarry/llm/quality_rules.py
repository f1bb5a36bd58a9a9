"""Quality rules with cross-document line frequency, in DataFrame functions only.

Base rules look at one text. The cross-document rule hashes normalised lines, counts the distinct documents of a host
that have each, and takes lines above the limit out of the text; a document that loses most of its words by that is rejected.
Lines are counted per (host, line, document) and then per (host, line), each with partial aggregation before its
shuffle, so a line that every document of a large host has is one row per task when it moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

BLANK = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Up to so many frequent lines, which are two numbers and a host each, are broadcast; more are joined by a shuffle.
BROADCAST_LINES = 1 << 19


def words_of(text: Column) -> Column:
    """The maximal runs of characters that aren't ASCII white space."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def let(value: Column, f) -> Column:
    """f(value), with value computed once however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def repeat_words(h: Column) -> Column:
    """Of an array of word hashes: words inside 3-word windows that occur twice or more.

    Most texts have no such window, which a hash set tells. For the others windows are sorted with their places, those
    equal to a neighbour stay, and the union of [place, place + 2] is measured along the places in order.
    """
    none = F.lit(None).cast("struct<h:bigint,i:int>")

    def windows(h: Column) -> Column:
        n = F.size(h) - 2
        pairs = F.zip_with(F.slice(h, 1, n), F.slice(h, 2, n), lambda a, b: F.xxhash64(a, b))
        return F.zip_with(pairs, F.slice(h, 3, n), lambda ab, c: F.xxhash64(ab, c))

    def again(placed: Column) -> Column:
        after = F.concat(F.slice(placed, 2, F.size(placed) - 1), F.array(none))
        same = F.zip_with(placed, after, lambda x, y: x["h"].eqNullSafe(y["h"]))
        before = F.concat(F.array(F.lit(False)), F.slice(same, 1, F.size(placed) - 1))
        return F.array_compact(F.zip_with(placed, F.zip_with(same, before, lambda a, b: a | b), lambda x, hit: F.when(hit, x["i"])))

    def covered(places: Column) -> Column:
        n = F.size(places) - 1
        gaps = F.zip_with(F.slice(places, 1, n), F.slice(places, 2, n), lambda a, b: F.least(b - a, F.lit(3)).cast("long"))
        return F.aggregate(gaps, F.lit(3).cast("long"), lambda s, x: s + x)

    def count(w: Column) -> Column:
        placed = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(let(let(placed, again), lambda p: covered(F.sort_array(p))))

    return F.when(F.size(h) < 3, F.lit(0).cast("long")).otherwise(let(windows(h), count))


def base_rules(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(without(x, BLANK)) > 0)
    hashes = F.transform(words_of(text), lambda x: F.xxhash64(x))
    words = let(hashes, lambda h: F.struct(F.size(h).cast("long").alias("n"), repeat_words(h).alias("r")))
    d = docs.select(
        "*",
        # Generated, so that no later projection computes it again.
        F.explode(F.array(F.struct(words.alias("w"), let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).alias("d")))).alias("__m"),
        F.length(without(text, BLANK)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(without(text, SYMBOLS))).cast("long").alias("n_symbols"),
    )
    d = d.select("*", F.col("__m.w.n").alias("n_words"), F.col("__m.d").cast("long").alias("n_dup_lines"), F.col("__m.w.r").alias("n_repeat_words")).drop("__m")
    return d.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def frequent_lines(docs: DataFrame, host: str, max_docs: int) -> DataFrame:
    """(doc_id, __t, __host, __at) of the documents that have lines above the limit; __t is a hash of the text, __at the lines' places."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = docs.select("doc_id", F.xxhash64("text").alias("__t"), F.col(host).alias("__host"), F.posexplode(F.split(text, "\n")).alias("__i", "__line"))
    lines = lines.where(n_words(F.col("__line")) > 0)
    norm = F.regexp_replace(F.trim(F.lower(F.translate("__line", "\t\n\x0b\x0c\r123456789", "     000000000"))), " +", " ")
    lines = lines.select("doc_id", "__t", "__host", F.xxhash64(norm).alias("__l"), "__i")
    per_doc = lines.select("doc_id", "__t", "__host", "__l").distinct()
    often = per_doc.groupBy("__host", "__l").agg(F.count(F.lit(1)).alias("__docs")).where(F.col("__docs") > max_docs)
    often = C.cut(often.select(F.col("__host").alias("__host2"), F.col("__l").alias("__l2")))
    if often.count() <= BROADCAST_LINES:
        often = F.broadcast(often)
    hit = lines.join(often, F.col("__host").eqNullSafe(F.col("__host2")) & (F.col("__l") == F.col("__l2")), "left_semi")
    return hit.groupBy("doc_id", "__t", "__host").agg(F.collect_set("__i").alias("__at"))


def without_lines(text: Column, at: Column) -> Column:
    """text without the lines at these places, counted from 0; the others joined by \\n."""
    rest = lambda lines: F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), at), lambda i: lines[i])
    return F.array_join(let(F.split(text, "\n"), rest), "\n")


def quality_rules(docs: DataFrame, host: str = "source", max_docs: int = 20, max_removed: float = 0.5) -> DataFrame:
    """doc_id, the base measures, base_failed, removed_words, kept and text, one row per row of docs.

    A line counts for a host by the distinct (doc_id, text) that have it; lines that more than max_docs of those have
    are taken out of the text, and removed_words is what it lost by that. A document is kept if the base rules pass and
    at most max_removed of its words went. The base rules judge the whole text.

    Null text: no words, so base_failed, and stays null. Null host: a host of its own. Null doc_id: told apart by text.
    Repeated rows get the same verdict and count as one document. Empty table: empty result. Extra columns are ignored.
    """
    docs = docs.select("doc_id", "text", F.col(host).alias("__host"))
    base = base_rules(docs.withColumn("__t", F.xxhash64("text")))
    often = frequent_lines(docs, "__host", max_docs).select(F.col("doc_id").alias("__id"), F.col("__t").alias("__t2"), F.col("__host").alias("__host2"), "__at")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__t") == F.col("__t2")) & F.col("__host").eqNullSafe(F.col("__host2"))
    left = F.when(F.col("__at").isNull(), F.col("text")).otherwise(without_lines(F.col("text"), F.col("__at")))
    lost = F.when(F.col("__at").isNull(), F.lit(0)).otherwise(F.col("n_words") - n_words(F.col("__left"))).cast("long")
    # Generated, so that the text is made once.
    rows = base.join(often, same, "left").withColumn("__left", F.explode(F.array(left))).withColumn("removed_words", lost)
    kept = ~F.col("base_failed") & (F.col("removed_words") <= max_removed * F.col("n_words"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", kept.alias("kept"), F.col("__left").alias("text"))


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(C.read_documents(spark, sf_dir), host="source", max_docs=20, max_removed=0.5).drop("text")


OP4_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), l AS (
  SELECT r, unnest(string_split(text, chr(10))) AS line FROM d
), lw AS (
  SELECT r, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
         regexp_replace(trim(lower(translate(line, chr(9) || chr(11) || chr(12) || chr(13) || '123456789', '    000000000')), ' '), ' +', ' ', 'g') AS norm
  FROM l
), dup AS (
  SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM lw WHERE n > 0 GROUP BY r
), often AS (
  SELECT d.source, norm FROM lw JOIN d USING (r) WHERE n > 0
  GROUP BY d.source, norm HAVING count(DISTINCT (coalesce(d.doc_id, -1), d.text)) > 20
), removed AS (
  SELECT lw.r, sum(n) AS removed_words FROM lw JOIN d USING (r)
  JOIN often ON often.norm = lw.norm AND often.source IS NOT DISTINCT FROM d.source WHERE n > 0 GROUP BY lw.r
), g AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)
), again AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1
), rep AS (
  SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY r
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(removed_words, 0)::BIGINT AS removed_words
  FROM d LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN removed USING (r)
)
SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND removed_words <= 0.5 * n_words AS kept
FROM m
"""
