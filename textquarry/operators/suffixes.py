"""Suffix array, Burrows-Wheeler transform and LF mapping as relations, to look at how text sets are ordered.

Searching uses none of these. Suffixes are sorted by prefix doubling, which holds a few numbers for each suffix and
never a suffix itself; short texts may be sorted as whole strings instead.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.alphabet import LATIN, Alphabet
from ..plans.config import IndexConfig, PerformancePriority
from ..plans.lineage import cut
from .build import at, fold_texts, narrowed, positions
from .rank import RankTable, rank_table


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with its row number, from 0, in the given order: range partitions are sorted, their sizes give the offsets."""
    # Range partitioning samples; written once, the counts and the rows agree.
    parts = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))
    sizes = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    offsets = sizes.select("__part", "__first", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    # One row for each partition.
    return parts.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__at") - F.col("__first") + F.col("__base")).drop("__part", "__at", "__first", "__base")


def dense_text(alphabet: Alphabet) -> Column:
    """The column t as dense symbols, whose order need not be that of bytes."""
    canonical, dense = bytes(g[0] for g in alphabet.groups), bytes(range(1, len(alphabet.groups) + 1))
    return F.encode(F.translate(F.decode("t", LATIN), canonical.decode("latin-1"), dense.decode("latin-1")), LATIN)


def byte_at(piece: Column, i: Column | int) -> Column:
    """A byte as a number, 0 beyond the end."""
    return F.coalesce(F.conv(F.nullif(F.hex(F.substring(piece, (i if isinstance(i, Column) else F.lit(i)) + 1, F.lit(1))), F.lit("")), 16, 10).cast("long"), F.lit(0))


def first_order(texts: DataFrame, alphabet: Alphabet, chunk: int) -> tuple[DataFrame, int]:
    """(text_id, position, symbol, left, key): the first symbols of each suffix as one number; and how many those are.

    left: symbols of the suffix. symbol: the one before it.
    """
    size = 7 if alphabet.num_dense_symbols > 16 else 15
    dense = texts.select("text_id", dense_text(alphabet).alias("t"), F.length("t").alias("n"))
    # A byte in front, so that the symbol before each suffix lies in its piece.
    padded = dense.select("text_id", F.concat(F.lit(b"\0"), "t").alias("t"))
    spread = positions(padded, size + 1, chunk, end=False).join(dense.select("text_id", "n"), "text_id")
    digits = F.hex(at(F.col("piece"), F.col("i") + 1, size))
    if size == 15:
        digits = F.regexp_replace(digits, "0(.)", "$1")
    key = F.conv(F.rpad(digits, 2 * 7 if size == 7 else 15, "0"), 16, 10).cast("long")
    return spread.select("text_id", "position", byte_at(F.col("piece"), F.col("i")).cast("int").alias("symbol"), (F.col("n") - F.col("position")).alias("left"), key.alias("key")), size


def doubled(texts: DataFrame, alphabet: Alphabet, chunk: int = 1 << 16) -> DataFrame:
    """(sa_row, text_id, position, symbol) by prefix doubling.

    The rank of a suffix is the number of those before it by their first symbols. As long as suffixes that go on share
    a rank, pairs of ranks (of the suffix, and of the one `step` symbols on) order twice as many symbols. A rank is counted by
    sums over the distinct pairs, so suffixes that a third of all texts share are never one group.
    """
    rows, step = first_order(texts, alphabet, chunk)
    rows = cut(rows.withColumn("next", F.lit(0).cast("long")))
    while True:
        pairs = rows.groupBy("key", "next").agg(F.count(F.lit(1)).alias("n"), F.max("left").alias("most"))
        # Prefix sums over the ordered pairs: inside range partitions, after the sums of those before.
        placed = numbered(pairs, ["key", "next"], "pair")
        block = F.floor(F.col("pair") / 65536).cast("long")
        blocks = placed.groupBy(block.alias("block")).agg(F.sum("n").alias("total"))
        before = blocks.select("block", F.coalesce(F.sum("total").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
        inside = F.coalesce(F.sum("n").over(Window.partitionBy("block").orderBy("pair").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ranks = placed.withColumn("block", block).withColumn("inside", inside).join(before, "block").select("key", "next", (F.col("base") + F.col("inside")).alias("rank"), ((F.col("n") > 1) & (F.col("most") >= step)).alias("open"))
        rows = cut(rows.join(ranks, ["key", "next"]).select("text_id", "position", "symbol", "left", "rank", "open"))
        if not rows.where("open").head(1):
            break
        ahead = rows.select("text_id", (F.col("position") - step).alias("position"), (F.col("rank") + 1).alias("next"))
        # A suffix that ends before has no second rank: 0, before all others.
        rows = cut(rows.join(ahead, ["text_id", "position"], "left").select("text_id", "position", "symbol", "left", F.col("rank").alias("key"), F.coalesce("next", F.lit(0).cast("long")).alias("next")))
        step *= 2
    # What still shares a rank are equal suffixes of different texts.
    return numbered(rows.select("text_id", "position", "symbol", "rank"), ["rank", "text_id", "position"], "sa_row").select("sa_row", "text_id", "position", "symbol")


def suffix_array(texts: DataFrame, alphabet: Alphabet, priority: PerformancePriority = PerformancePriority.BALANCED, chunk: int = 1 << 16) -> DataFrame:
    """(sa_row, text_id, position, symbol): suffixes in order, ends of texts before all symbols and by text_id; symbol is
    the dense symbol before the suffix, 0 at a text's start: the Burrows-Wheeler transform.

    With high speed each suffix is a row of its own bytes, for short texts only. Otherwise prefix doubling.
    """
    if priority is not PerformancePriority.HIGH_SPEED:
        return doubled(texts, alphabet, chunk)
    rows = texts.select("text_id", dense_text(alphabet).alias("t"), F.explode(F.sequence(F.lit(0).cast("long"), F.length("t").cast("long"))).alias("position"))
    before = F.when(F.col("position") == 0, F.lit(0)).otherwise(byte_at(F.col("t"), (F.col("position") - 1).cast("int")).cast("int"))
    ordered = numbered(rows.select("text_id", "position", at(F.col("t"), F.col("position"), F.length("t")).alias("suffix"), before.alias("symbol")), ["suffix", "text_id"], "sa_row")
    return ordered.select("sa_row", "text_id", "position", "symbol")


def sampled(sa: DataFrame, rate: int, width: int = 64) -> DataFrame:
    """Every rate-th row; positions of 32 bits are narrowed by a checked cast."""
    if rate < 1:
        raise ValueError("the sampling rate must be 1 or more")
    position = F.col("position") if width == 64 else narrowed(F.col("position"))
    return sa.where(F.col("sa_row") % rate == 0).select("sa_row", "text_id", position.alias("position"))


def borders(sa: DataFrame) -> DataFrame:
    """The rows whose suffix is a whole text."""
    return sa.where("symbol = 0").select("sa_row", "text_id", "position")


def lf_mapping(sa: DataFrame, block: int = 4096) -> DataFrame:
    """(sa_row, lf): the row of the suffix one symbol longer, for rows that have one.

    By checkpoints: counts of each symbol before each block of rows, and places inside a block, so that a symbol that
    most rows have is not one group.
    """
    seen = sa.withColumn("block", F.floor(F.col("sa_row") / block))
    counts = seen.groupBy("block", "symbol").agg(F.count(F.lit(1)).alias("n"))
    # Rows of ends of texts come first, one for each text, as many as have symbol 0.
    base = F.coalesce(F.sum("n").over(Window.orderBy("symbol", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    smaller = counts.select("block", "symbol", base.alias("smaller"))
    rank = F.row_number().over(Window.partitionBy("block", "symbol").orderBy("sa_row")) - 1
    return seen.where("symbol > 0").withColumn("rank", rank).join(smaller, ["block", "symbol"]).select("sa_row", (F.col("smaller") + F.col("rank")).alias("lf"))


@dataclass(frozen=True)
class SuffixViews:
    """What a build makes: suffix array with its transform, the sample of it, borders, LF mapping, ranks over the transform."""

    sa: DataFrame
    sampled: DataFrame
    borders: DataFrame
    lf: DataFrame
    ranks: RankTable


def build_views(texts: DataFrame, alphabet: Alphabet, config: IndexConfig | None = None, on_invalid: str = "error", block: int = 4096) -> SuffixViews:
    """The whole chain over (text_id, text): suffix array, transform, sample, ranks.

    The transform is cut to texts of `block` symbols, numbered by block, for the rank structure.
    """
    config = config or IndexConfig()
    sa = cut(suffix_array(fold_texts(texts, alphabet, on_invalid), alphabet, config.priority, config.chunk))
    bwt = sa.groupBy(F.floor(F.col("sa_row") / block).alias("text_id")).agg(F.unhex(F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("sa_row", "symbol"))), lambda x: F.lpad(F.hex(x["symbol"]), 2, "0")))).alias("t"))
    return SuffixViews(sa, sampled(sa, config.suffix_array_sampling_rate, config.index_width), borders(sa), lf_mapping(sa), rank_table(bwt, max(2, alphabet.num_dense_symbols), 64))
