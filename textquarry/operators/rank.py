"""Rank and access over texts of dense symbols, by checkpoints of blocks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bits
from .build import at

#: Symbols of a text that share one checkpoint where every place is asked, and those in one word of bits.
SPAN, WORD = 1024, 64


@dataclass(frozen=True)
class RankTable:
    """blocks: (text_id, block, piece, before); before maps a symbol to its occurrences before the block."""

    texts: DataFrame
    blocks: DataFrame
    block: int
    alphabet_size: int

    def lengths(self) -> DataFrame:
        return self.texts.select("text_id", F.length("t").cast("long").alias("text_len"))

    def rank_many(self, requests: DataFrame) -> DataFrame:
        """(request_id, rank) of (request_id, text_id, symbol, idx): occurrences of symbol in the first idx symbols.

        An idx beyond the text or a symbol outside the alphabet is an error.
        """
        asked = requests.withColumn("block", F.floor(F.col("idx") / self.block).cast("int"))
        found = asked.join(self.blocks, ["text_id", "block"], "left")
        inside = at(F.col("piece"), F.lit(0), F.pmod(F.col("idx"), F.lit(self.block)).cast("int"))
        one = F.unhex(F.lpad(F.hex(F.col("symbol")), 2, "0"))
        text = F.decode(inside, "ISO-8859-1")
        here = F.length(text) - F.length(F.replace(text, F.decode(one, "ISO-8859-1"), F.lit("")))
        bad = F.col("piece").isNull() | (F.pmod(F.col("idx"), F.lit(self.block)) > F.length("piece")) | (F.col("symbol") >= self.alphabet_size) | (F.col("symbol") < 0)
        total = (F.coalesce(F.try_element_at("before", F.col("symbol")), F.lit(0)) + here).cast("long")
        return found.select("request_id", F.when(bad, F.raise_error(F.lit("symbol or index out of range")).cast("long")).otherwise(total).alias("rank"))

    def rank_everywhere(self, symbols: list[int]) -> DataFrame:
        """(text_id, idx, symbol, rank) for each of these symbols at each place of each text and at its end.

        As rank_many for all these requests, but none of them moves: texts are moved once, cut to spans, and each span
        answers for its own places, by the occurrences before it and a word of bits for each symbol.
        """
        if not all(0 <= s < self.alphabet_size for s in symbols):
            raise ValueError("symbol out of range")
        n = F.length("t")
        spans = self.texts.select("text_id", n.alias("n"), F.explode(F.sequence(F.lit(0), F.floor(n / SPAN).cast("int"))).alias("span"), "t")
        spans = spans.select("text_id", "span", (F.col("n") - F.col("span") * SPAN).alias("rest"), at(F.col("t"), F.col("span") * SPAN, SPAN).alias("piece"))
        text = F.decode("piece", "ISO-8859-1")
        found = [(F.length(text) - F.length(F.replace(text, F.lit(chr(s)), F.lit("")))).alias(f"n{s}") for s in symbols]
        earlier = Window.partitionBy("text_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
        spans = spans.select("*", *found).select("text_id", "span", F.least(F.lit(SPAN - 1), "rest").alias("last"), "piece", *[F.coalesce(F.sum(f"n{s}").over(earlier), F.lit(0)).alias(f"n{s}") for s in symbols])
        marks = F.array(*[F.struct(F.lit(s).alias("symbol"), F.col(f"n{s}").alias("before"), marked(text, s).alias("marks")) for s in symbols])
        spans = spans.select("text_id", "span", "last", F.explode(marks).alias("x")).select("text_id", "span", "last", "x.*")
        words = spans.select("*", F.explode(F.sequence(F.lit(0), F.floor(F.col("last") / WORD).cast("int"))).alias("word"))
        before = F.col("before") + F.length(F.replace(F.substring("marks", F.lit(1), F.col("word") * WORD), F.lit("0"), F.lit("")))
        # The first place is the lowest bit.
        mask = F.conv(F.reverse(F.substring("marks", F.col("word") * WORD + 1, F.lit(WORD))), 2, -10)
        base = (F.col("span") * F.lit(SPAN).cast("long") + F.col("word") * WORD).alias("base")
        words = words.select("text_id", "symbol", base, before.alias("before"), F.coalesce(mask.cast("long"), F.lit(0).cast("long")).alias("mask"), F.least(F.lit(WORD - 1), F.col("last") - F.col("word") * WORD).alias("top"))
        places = words.select("*", F.explode(F.sequence(F.lit(0), "top")).alias("i"))
        return places.select("text_id", (F.col("base") + F.col("i")).alias("idx"), "symbol", (F.col("before") + bits.popcount_before(F.col("mask"), F.col("i"))).alias("rank"))

    def symbol_at_many(self, requests: DataFrame) -> DataFrame:
        """(request_id, symbol) of (request_id, text_id, idx); an idx beyond the text is an error."""
        found = requests.withColumn("block", F.floor(F.col("idx") / self.block).cast("int")).join(self.blocks.select("text_id", "block", "piece"), ["text_id", "block"], "left")
        one = at(F.col("piece"), F.pmod(F.col("idx"), F.lit(self.block)), 1)
        bad = one.isNull() | (F.length(one) == 0)
        return found.select("request_id", F.when(bad, F.raise_error(F.lit("index out of range")).cast("int")).otherwise(F.ascii(F.decode(one, "ISO-8859-1"))).alias("symbol"))


def marked(text: Column, symbol: int) -> Column:
    """A string of 1 for each occurrence of a symbol and 0 for each other one."""
    # A character that no byte is decoded to stands for the others in between.
    others = F.regexp_replace(text, f"(?s)[^\\x{symbol:02x}]", "\u0100")
    return F.translate(others, f"{chr(symbol)}\u0100", "10")


def rank_table(texts: DataFrame, alphabet_size: int, block: int = 1024) -> RankTable:
    """A rank structure over (text_id, t), t binary with one dense symbol below alphabet_size (2 to 256) a byte.

    Blocks are counted first; prefix sums run over the counts of blocks, per text and symbol.
    """
    if not 2 <= alphabet_size <= 256:
        raise ValueError("the alphabet size must be 2 to 256")
    pieces = texts.select("text_id", F.explode(F.sequence(F.lit(0), F.floor(F.length("t") / block).cast("int"))).alias("block"), "t")
    pieces = pieces.select("text_id", "block", at(F.col("t"), F.col("block") * block, block).alias("piece"))
    symbols = pieces.where(F.length("piece") > 0).select("text_id", "block", F.explode(F.split(F.decode("piece", "ISO-8859-1"), "")).alias("c"))
    counts = symbols.groupBy("text_id", "block", F.ascii("c").alias("symbol")).agg(F.count(F.lit(1)).alias("n"))
    # A symbol absent from a block has no row there: its sum up to each block comes from the rows of earlier blocks.
    last = texts.select("text_id", F.floor(F.length("t") / block).cast("int").alias("last"))
    upto = counts.withColumn("total", F.sum("n").over(Window.partitionBy("text_id", "symbol").orderBy("block")))
    ends = F.lead("block").over(Window.partitionBy("text_id", "symbol").orderBy("block"))
    spans = upto.withColumn("next", ends).join(last, "text_id").where(F.col("block") < F.col("last"))
    spread = spans.select("text_id", "symbol", "total", F.explode(F.sequence(F.col("block") + 1, F.coalesce("next", "last"))).alias("block"))
    before = spread.groupBy("text_id", "block").agg(F.map_from_entries(F.collect_list(F.struct("symbol", "total"))).alias("before"))
    none = F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<bigint>"))
    blocks = pieces.join(before, ["text_id", "block"], "left").withColumn("before", F.coalesce("before", none))
    return RankTable(texts, blocks, block, alphabet_size)
