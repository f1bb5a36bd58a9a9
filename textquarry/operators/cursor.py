"""Cursors: a search that is extended to the front, one symbol at a time."""

from __future__ import annotations

from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .build import at

if TYPE_CHECKING:
    from .index import TextIndex


class Cursors:
    """Many cursors at once: (query_id, q) and their hits, found together when they are asked for and then kept.

    Immutable, so branching a search is keeping the old one. Extending narrows the hits that are known, without a search
    from scratch. In a saved index those of queries of up to k bytes are its postings, which are at rest; other hits are
    written to the checkpoint folder.
    """

    def __init__(self, index: TextIndex, folded: DataFrame, hits: DataFrame | None = None):
        self.index, self.folded, self._hits = index, folded, hits

    def queries(self, which: str = "true") -> DataFrame:
        return self.folded.where(which).select("query_id", F.col("q").alias("query"))

    @property
    def _at_rest(self) -> str:
        """Which queries' hits aren't kept, as the index has them."""
        return f"length(q) <= {self.index.k}" if self.index.filed else "false"

    def locate(self) -> DataFrame:
        """(query_id, text_id, position) of all cursors."""
        if self._hits is None:
            self._hits = cut(self.index.locate_many(self.queries(f"NOT ({self._at_rest})")))
        return self._hits.unionByName(self.index.locate_many(self.queries(self._at_rest))) if self.index.filed else self._hits

    def count(self) -> DataFrame:
        """(query_id, n) of all cursors, 0 included."""
        if self._hits is None:
            return self.index.count_many(self.queries())
        n = self._hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
        if self.index.filed:
            n = n.unionByName(self.index.count_many(self.queries(self._at_rest)))
        return self.folded.select("query_id").join(n, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("n"))

    def extend_query_front(self, symbol: int | DataFrame) -> Cursors:
        """Each query with a symbol before it: one for all, or those of (query_id, symbol).

        A hit in a saved index stays, moved by one, if the symbol stands before it: if the first k bytes of the longer
        query are there. Without filed grams to tell, the texts are passed over once, whatever was known.
        """
        if isinstance(symbol, int):
            io = bytes([self.index.alphabet.dense_to_io(self.index.alphabet.io_to_dense(symbol))])
            folded = self.folded.select("query_id", F.concat(F.lit(io), "q").alias("q"))
        else:
            front = symbol.select("query_id", self.index.alphabet.fold(F.unhex(F.lpad(F.hex("symbol"), 2, "0"))).alias("front"))
            folded = self.folded.join(front, "query_id").select("query_id", F.concat("front", "q").alias("q"))
        longer = Cursors(self.index, folded)
        if self._hits is None:
            return longer
        if not self.index.filed:
            longer.locate()
            return longer
        k = self.index.k
        near = folded.where(F.length("q") > k).select("query_id", at(F.col("q"), F.lit(0), k).alias("query"))
        known = self._hits.unionByName(self.index.locate_many(self.queries(f"length(q) = {k}")))
        moved = known.select("query_id", "text_id", (F.col("position") - 1).alias("position")).where("position >= 0")
        return Cursors(self.index, folded, cut(moved.join(self.index.locate_many(near), ["query_id", "text_id", "position"])))


@dataclass(frozen=True)
class Cursor:
    """One cursor: its query, and `many`, the hits as Cursors with one row. Immutable, like those."""

    index: TextIndex
    query: bytes
    many: Cursors | None = None

    def extended_by(self, front: bytes) -> Cursor:
        """The cursor of front + query. Bytes outside the alphabet are an error, whether or not there are hits."""
        canonical = bytes(self.index.alphabet.dense_to_io(self.index.alphabet.io_to_dense(b)) for b in front)
        many = self.many
        for b in reversed(canonical):
            many = many and many.extend_query_front(b)
        return Cursor(self.index, canonical + self.query, many)

    def extend_query_front(self, symbol: int) -> Cursor:
        return self.extended_by(bytes([symbol]))

    def searched(self) -> Cursor:
        """This cursor with its hits found and kept, so that extending it narrows them."""
        many = self.many or self.index.cursors_for_many_queries(self.index.queries([self.query]))
        many.locate()
        return Cursor(self.index, self.query, many)

    def count(self) -> int:
        return self.many.count().first()["n"] if self.many else self.index.count(self.query)

    def locate(self) -> DataFrame:
        return self.many.locate().select("text_id", "position") if self.many else self.index.locate(self.query)


def extend_hits(hits: DataFrame, texts: DataFrame, symbol: int) -> DataFrame:
    """The (query_id, text_id, position) of hits that the canonical byte stands before, moved onto it."""
    before = hits.where("position > 0").join(texts, "text_id")
    return before.where(at(F.col("t"), F.col("position") - 1, 1) == F.lit(bytes([symbol]))).select("query_id", "text_id", (F.col("position") - 1).alias("position"))
