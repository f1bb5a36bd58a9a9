"""From texts to the tables of an index: postings, counts of grams, offsets, symbol statistics.

texts has (text_id long, t binary), every byte canonical.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.alphabet import Alphabet


def fold_texts(texts: DataFrame, alphabet: Alphabet, on_invalid: str = "error") -> DataFrame:
    """(text_id, t) of (text_id, text), text binary or string (then its UTF-8 bytes)."""
    folded = texts.select(F.col("text_id").cast("long").alias("text_id"), alphabet.fold(F.col("text").cast("binary"), on_invalid).alias("t"))
    return folded.where("t IS NOT NULL") if on_invalid == "null" else folded


def at(text: Column, position: Column, length: Column | int) -> Column:
    """length bytes from a 0-based position; binary substrings cost no scan of what lies before."""
    return F.substring(text, (position + 1).cast("int"), length if isinstance(length, Column) else F.lit(length))


def positions(texts: DataFrame, reach: int, chunk: int, end: bool = True) -> DataFrame:
    """(text_id, position, base, piece) for each position of each text (with its end); piece, cut from base, holds at least
    `reach` bytes from the position on. A long text is cut to pieces first, so no array grows with a text.
    """
    top = F.length("t") - (0 if end else 1)
    pieces = texts.where(top >= 0).select("text_id", F.length("t").alias("n"), F.explode(F.sequence(F.lit(0), top, F.lit(chunk))).alias("base"), "t")
    pieces = pieces.select("text_id", "base", F.least(F.lit(chunk - 1), F.col("n") - (0 if end else 1) - F.col("base")).alias("last"), at(F.col("t"), F.col("base"), chunk + reach - 1).alias("piece"))
    return pieces.select("text_id", "base", "piece", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("i")).select("text_id", (F.col("base") + F.col("i")).cast("long").alias("position"), "base", "piece", "i")


def postings(texts: DataFrame, k: int, chunk: int = 1 << 16, width: int = 64) -> DataFrame:
    """(text_id, position, gram): the k bytes from each position on, fewer at a text's end and none after it.

    Positions of 32 bits hold any text that a binary column can; they are narrowed by a checked cast.
    """
    position = F.col("position") if width == 64 else narrowed(F.col("position"))
    return positions(texts, k, chunk).select("text_id", position.alias("position"), at(F.col("piece"), F.col("i"), k).alias("gram"))


#: Positions that are put in order of their grams at a time, and those of one gram that a row holds at most.
SLAB, ROW = 1 << 20, 1 << 10


def packed_postings(texts: DataFrame, alphabet: Alphabet, k: int, chunk: int = 1 << 16, width: int = 64) -> DataFrame:
    """(gram, text_id, position), the last two arrays of one length: the rows of postings(), many to a row."""
    top = F.length("t")
    pieces = texts.where("t IS NOT NULL").select("text_id", top.alias("n"), F.explode(F.sequence(F.lit(0), top, F.lit(chunk))).alias("base"), "t")
    owned = F.least(F.lit(chunk), F.col("n") + 1 - F.col("base")).cast("int").alias("owned")
    pieces = pieces.select("text_id", F.col("base").cast("long").alias("base"), owned, at(F.col("t"), F.col("base"), chunk + k - 1).alias("piece"))
    canonical, places = sorted({g[0] for g in alphabet.groups}), pa.int32() if width == 32 else pa.int64()

    def pack(batches):
        for batch in batches:
            sizes = np.cumsum(batch.column("owned").to_numpy())
            begin = 0
            while begin < len(sizes):
                # A slab has one piece at least.
                end = max(begin + 1, int(np.searchsorted(sizes, (sizes[begin - 1] if begin else 0) + SLAB, "right")))
                yield packed(batch.slice(begin, end - begin), canonical, k, places)
                begin = end

    return pieces.mapInArrow(pack, f"gram binary, text_id array<bigint>, position array<{'int' if width == 32 else 'bigint'}>")


def packed(pieces: pa.RecordBatch, canonical: list[int], k: int, places: pa.DataType) -> pa.RecordBatch:
    """The positions that pieces (text_id, base, owned, piece) own, in order of gram, text and position as they come."""
    owned = pieces.column("owned").to_numpy().astype(np.int64)
    cut = pieces.column("piece").to_pylist()
    sizes = np.array([len(x) for x in cut], dtype=np.int64)
    starts = np.cumsum(sizes + k) - sizes - k
    joined = b"".join(x + bytes(k) for x in cut)
    # Symbols count from 1 in order of their bytes; after a text there are zeros, so a shorter gram comes first.
    table = np.zeros(256, dtype=np.uint64)
    table[canonical] = np.arange(1, len(canonical) + 1)
    symbols = table[np.frombuffer(joined, dtype=np.uint8)]
    symbols[((starts + sizes)[:, None] + np.arange(k)).ravel()] = 0
    ahead = np.cumsum(owned) - owned
    total = int(owned.sum())
    where = np.repeat(starts - ahead, owned) + np.arange(total)
    base, most = len(canonical) + 1, 1
    code = np.zeros(total, dtype=np.uint64)
    for d in range(k):
        if most * base > 1 << 63:
            # Ranks of what was seen so far are as good.
            code = np.unique(code, return_inverse=True)[1].astype(np.uint64)
            most = total
        code, most = code * np.uint64(base) + symbols[where + d], most * base
    order = np.argsort(code.astype(np.uint16) if most <= 1 << 16 else code, kind="stable")
    code = code[order]
    first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
    # A frequent gram is several rows, so rows are of one size and can be spread.
    counts = np.diff(np.append(first, total))
    rows = -(-counts // ROW)
    begin = np.repeat(first, rows) + (np.arange(rows.sum()) - np.repeat(np.cumsum(rows) - rows, rows)) * ROW
    offsets = pa.array(np.append(begin, total).astype(np.int32))
    ends = np.repeat(starts + sizes, owned)
    grams = [joined[a:b] for a, b in zip(where[order[begin]], np.minimum(where + k, ends)[order[begin]])]
    texts = np.repeat(pieces.column("text_id").to_numpy(), owned)[order]
    position = (np.repeat(pieces.column("base").to_numpy() - ahead, owned) + np.arange(total))[order]
    lists = [pa.ListArray.from_arrays(offsets, pa.array(texts, pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(position, pa.int64()).cast(places))]
    return pa.RecordBatch.from_arrays([pa.array(grams, pa.binary()), *lists], ["gram", "text_id", "position"])


def unpacked(packs: DataFrame, *others: str) -> DataFrame:
    """(text_id, position, gram) and other columns of packed postings."""
    each = packs.select("gram", *others, F.posexplode("text_id").alias("i", "text_id"), F.col("position").alias("positions"))
    return each.select("text_id", F.get("positions", F.col("i")).alias("position"), "gram", *others)


def narrowed(position: Column) -> Column:
    """A 64-bit position as 32 bits; one that doesn't fit is an error."""
    wide = F.raise_error(F.lit("a position doesn't fit 32 bits")).cast("int")
    return F.when(position.between(-(1 << 31), (1 << 31) - 1), position.cast("int")).otherwise(wide)


def slice_bytes(alphabet: Alphabet, k: int) -> int:
    """How many first bytes of a gram name its slice: about a hundred slices, or one for each first byte."""
    size, symbols = 1, alphabet.num_dense_symbols
    while size < k and symbols ** (size + 1) <= 256:
        size += 1
    return size


def slice_column(gram: Column, size: int) -> Column:
    return F.concat(F.lit("s"), F.hex(F.substring(gram, F.lit(1), F.lit(size))))


def gram_counts(posts: DataFrame) -> DataFrame:
    """(gram, n) of the distinct grams."""
    return posts.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def prefixes(grams: DataFrame) -> DataFrame:
    """(kmer, gram, n): each distinct gram under each of its prefixes."""
    return grams.select("gram", "n", F.explode(F.sequence(F.lit(0), F.length("gram"))).alias("depth")).select(F.substring("gram", F.lit(1), F.col("depth")).alias("kmer"), "gram", "n")


def kmer_counts(grams: DataFrame) -> DataFrame:
    """(depth, kmer, n): occurrences of every string of up to k bytes that occurs."""
    return prefixes(grams).groupBy("kmer").agg(F.sum("n").alias("n")).select(F.length("kmer").alias("depth"), "kmer", "n")


def text_offsets(texts: DataFrame) -> DataFrame:
    """(text_id, start, sentinel) in the concatenation of all texts, each followed by a sentinel, in order of text_id.

    Sums of blocks of ids give the offsets of the blocks; only within a block rows are ordered.
    """
    block = F.floor(F.col("text_id") / 4096).alias("block")
    sizes = texts.select("text_id", block, (F.length("t") + 1).cast("long").alias("n"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sizes.groupBy("block").agg(F.sum("n").alias("n")).select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("block").orderBy("text_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.withColumn("start", F.coalesce(F.sum("n").over(within), F.lit(0))).join(blocks, "block")
    return placed.select("text_id", (F.col("base") + F.col("start")).alias("start"), (F.col("base") + F.col("start") + F.col("n") - 1).alias("sentinel"))


def resolve_positions(requests: DataFrame, offsets: DataFrame, block: int = 1 << 14) -> DataFrame:
    """(request_id, text_id, position) of (request_id, idx), idx in the concatenation. A text's sentinel belongs to it.

    An equi-join on blocks of indices, of which each text fills one or more, instead of a join on ranges.
    """
    spans = offsets.select("text_id", "start", "sentinel", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor(F.col("sentinel") / block))).alias("block"))
    asked = requests.withColumn("block", F.floor(F.col("idx") / block))
    return asked.join(spans, "block").where("idx BETWEEN start AND sentinel").select("request_id", "text_id", (F.col("idx") - F.col("start")).alias("position"))


def symbol_histogram(texts: DataFrame, alphabet: Alphabet, chunk: int = 1 << 16) -> DataFrame:
    """(symbol, n): how often each dense symbol occurs in the concatenation, the sentinel included."""
    seen = positions(texts, 1, chunk).select(at(F.col("piece"), F.col("i"), 1).alias("byte")).groupBy("byte").agg(F.count(F.lit(1)).alias("n"))
    # An empty string is what stands at a text's end.
    symbol = F.when(F.length("byte") == 0, F.lit(0)).otherwise(alphabet.encode(F.ascii(F.decode("byte", "ISO-8859-1"))))
    return seen.select(symbol.alias("symbol"), "n")


def c_array(histogram: DataFrame) -> DataFrame:
    """(symbol, smaller): how many symbols of the concatenation are smaller. At most 256 rows."""
    before = Window.orderBy("symbol").rowsBetween(Window.unboundedPreceding, -1)
    return histogram.select("symbol", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("smaller"))
