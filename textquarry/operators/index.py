"""The index: counting and locating many patterns as joins with filed grams."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.alphabet import Alphabet
from ..plans.config import IndexConfig
from . import build, scan
from .build import at
from .cursor import Cursor, Cursors

QUERIES = "query_id long, query binary"
HITS = ("query_id", "text_id", "position")
#: Up to so many queries or seeds are broadcast; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 20000
#: Up to so many distinct grams are literals of the scan of the postings, beside the slices they lie in.
LITERAL_GRAMS = 500
#: Up to so many queries are literals of a pass over the texts.
LITERAL_QUERIES = 16


@dataclass(frozen=True)
class TextIndex:
    """Tables of an index. texts: (text_id, t); postings: (text_id, position, gram); grams: (gram, n).

    Those of a saved index (filed) are at rest, and postings are partitioned by slice, the first bytes of the gram. An
    index that isn't saved has nothing at rest to look into: it is searched by one pass over the texts.
    """

    alphabet: Alphabet
    config: IndexConfig
    texts: DataFrame
    postings: DataFrame
    grams: DataFrame
    filed: bool = False
    #: The postings of a saved index as they lie, many of a gram in a row.
    packs: DataFrame | None = None

    @property
    def k(self) -> int:
        return self.config.gram_length(self.alphabet.num_searchable_dense_symbols)

    @property
    def spark(self):
        return self.texts.sparkSession

    # What the index knows about itself

    def num_texts(self) -> int:
        return self.texts.count()

    def total_text_len(self) -> int:
        """Bytes of all texts and a sentinel for each."""
        return self.texts.agg(F.coalesce(F.sum(F.length("t") + 1), F.lit(0))).first()[0]

    def kmer_counts(self) -> DataFrame:
        return build.kmer_counts(self.grams)

    def text_offsets(self) -> DataFrame:
        return build.text_offsets(self.texts)

    # Queries

    def fold_queries(self, queries: DataFrame, strict: bool = False) -> DataFrame:
        """(query_id, q) of (query_id, query); a byte outside the alphabet is an error, strict: an unsearchable one too."""
        return queries.select(F.col("query_id").cast("long").alias("query_id"), self.alphabet.fold(F.col("query").cast("binary"), strict=strict).alias("q"))

    def queries(self, patterns: list[bytes]) -> DataFrame:
        return self.spark.createDataFrame([(i, bytearray(p)) for i, p in enumerate(patterns)], QUERIES)

    def seeds(self, folded: DataFrame) -> DataFrame:
        """(query_id, shift, gram, tiles): the filed grams that make up each query, shift after its start, and their number.

        A query of up to k bytes: each gram that it is a prefix of, any of which is a hit. A longer one: the grams at its
        start and every k bytes on, the last one at its end; a hit has all of them, so no text is looked at.
        """
        k = self.k
        short = folded.where(F.length("q") <= k).join(build.prefixes(self.grams).select("kmer", "gram"), F.col("q") == F.col("kmer"))
        short = short.select("query_id", F.lit(0).alias("shift"), "gram", F.lit(1).alias("tiles"))
        tiles = F.ceil(F.length("q") / k).cast("int")
        long_ = folded.where(F.length("q") > k).select("query_id", "q", tiles.alias("tiles"), F.explode(F.sequence(F.lit(0), tiles - 1)).alias("i"))
        shift = F.least(F.col("i") * k, F.length("q") - k)
        return short.unionByName(long_.select("query_id", shift.alias("shift"), at(F.col("q"), shift, k).alias("gram"), "tiles"))

    def filed_hits(self, folded: DataFrame) -> DataFrame:
        """(query_id, text_id, position) from the postings: only slices and row groups with a seed's gram are read."""
        seeds, filed = self.seeds(folded), self.packs
        known = seeds.limit(BROADCAST_ROWS + 1).collect()
        if len(known) <= BROADCAST_ROWS:
            grams = sorted({bytes(r.gram) for r in known})
            filed = filed.where(F.col("slice").isin(sorted({slice_of(g, self.slice_bytes) for g in grams})))
            if len(grams) <= LITERAL_GRAMS:
                filed = filed.where(F.col("gram").isin([bytearray(g) for g in grams]))
            seeds = F.broadcast(self.spark.createDataFrame(known, seeds.schema))
            several = {r.tiles > 1 for r in known}
        else:
            # Dynamic pruning by slice is left to the planner.
            seeds, several = seeds.withColumn("slice", build.slice_column(F.col("gram"), self.slice_bytes)), {True, False}
        found = build.unpacked(filed.join(seeds, [c for c in ("slice", "gram") if c in seeds.columns]), "query_id", "shift", "tiles")
        found = found.select("query_id", "text_id", (F.col("position") - F.col("shift")).alias("position"), "tiles")
        single = found.where("tiles = 1").select(*HITS)
        # Tiles of one hit meet by its place; a place has each tile once. They move before they are counted, as few of a task
        # meet in it and counting them there would hold them all.
        joint = found.where("tiles > 1 AND position >= 0").repartition("query_id", "text_id", "position").groupBy(*HITS, "tiles").agg(F.count(F.lit(1)).alias("n")).where("n = tiles").select(*HITS)
        return single if several <= {False} else joint if several == {True} else single.unionByName(joint)

    def scanned_hits(self, folded: DataFrame) -> DataFrame:
        """(query_id, text_id, position) by one pass over the texts: a few queries are literals; of more, each position's
        first bytes are looked up."""
        if few := self.literals(folded):
            return scan.scan_locate(self.texts, few, self.config.chunk)
        cut_at = F.least(F.length("q"), F.lit(self.k))
        seen = folded.agg(F.collect_set(cut_at).alias("sizes"), F.max(F.length("q")).alias("longest"), F.count(F.lit(1)).alias("n")).first()
        keyed = folded.select("query_id", "q", at(F.col("q"), F.lit(0), cut_at).alias("key"))
        # At most k + 1 different lengths of keys.
        spread = build.positions(self.texts, max(1, seen.longest or 0), self.config.chunk)
        keys = F.array_distinct(F.array(*[at(F.col("piece"), F.col("i"), n) for n in sorted(seen.sizes)] or [F.lit(b"")]))
        spread = spread.select("text_id", "position", "piece", "i", F.explode(keys).alias("key"))
        found = spread.join(F.broadcast(keyed) if seen.n <= BROADCAST_ROWS else keyed, "key")
        return found.where(at(F.col("piece"), F.col("i"), F.length("q")) == F.col("q")).select(*HITS)

    def literals(self, folded: DataFrame) -> dict[int, bytes]:
        """The queries, if they are few; nothing otherwise."""
        known = folded.limit(LITERAL_QUERIES + 1).collect()
        if len(known) > LITERAL_QUERIES or any(r.q is None or r.query_id is None for r in known):
            return {}
        few = {r.query_id: bytes(r.q) for r in known}
        return few if len(few) == len(known) else {}

    @property
    def slice_bytes(self) -> int:
        return build.slice_bytes(self.alphabet, self.k)

    def locate_many(self, queries: DataFrame, strict: bool = False) -> DataFrame:
        """(query_id, text_id, position): every hit of every query, overlapping ones included, in no order.

        A query without hits has no rows; the same query under two ids is answered under both. Query ids are unique.
        """
        folded = self.fold_queries(queries, strict)
        return self.filed_hits(folded) if self.filed else self.scanned_hits(folded)

    def count_many(self, queries: DataFrame, strict: bool = False) -> DataFrame:
        """(query_id, n) for every query, 0 included. In a saved index queries of up to k bytes are looked up, others located."""
        every = queries.select(F.col("query_id").cast("long").alias("query_id"))
        if not self.filed:
            if few := self.literals(self.fold_queries(queries, strict)):
                return scan.scan_count(self.texts, few)
            found = self.locate_many(queries, strict).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
            return every.join(found, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("n"))
        folded = self.fold_queries(queries, strict)
        short = folded.where(F.length("q") <= self.k).join(self.kmer_counts(), F.col("q") == F.col("kmer")).select("query_id", "n")
        longer = self.filed_hits(folded.where(F.length("q") > self.k)).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
        found = folded.select(F.col("query_id"), F.length("q").alias("size")).join(short.unionByName(longer), "query_id", "left")
        return found.select("query_id", F.coalesce("n", F.lit(0)).alias("n"))

    def locate_nested(self, queries: DataFrame) -> DataFrame:
        """(query_id, hits): the hits of each query as one array, empty where there are none. For queries with few hits."""
        hits = self.locate_many(queries).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("text_id", "position"))).alias("hits"))
        none = F.array().cast("array<struct<text_id:bigint,position:bigint>>")
        return queries.select(F.col("query_id").cast("long").alias("query_id")).join(hits, "query_id", "left").select("query_id", F.coalesce("hits", none).alias("hits"))

    def document_frequency(self, queries: DataFrame) -> DataFrame:
        """(query_id, n_texts): in how many texts each query occurs."""
        n = self.locate_many(queries).select("query_id", "text_id").distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("n_texts"))
        return queries.select(F.col("query_id").cast("long").alias("query_id")).join(n, "query_id", "left").select("query_id", F.coalesce("n_texts", F.lit(0)).alias("n_texts"))

    def without_hits(self, queries: DataFrame) -> DataFrame:
        return queries.join(self.locate_many(queries).select("query_id").distinct(), "query_id", "left_anti")

    def count(self, query: bytes) -> int:
        return self.count_many(self.queries([query])).first()["n"]

    def locate(self, query: bytes) -> DataFrame:
        return self.locate_many(self.queries([query])).select("text_id", "position")

    # Cursors

    def cursor_empty(self) -> Cursor:
        return Cursor(self, b"")

    def cursor_for_query(self, query: bytes) -> Cursor:
        return Cursor(self, b"").extended_by(query)

    def cursor_for_dense_query(self, symbols: list[int]) -> Cursor:
        """The cursor of a query given in dense symbols."""
        return Cursor(self, bytes(self.alphabet.dense_to_io(s) for s in symbols))

    def cursors_for_many_queries(self, queries: DataFrame, strict: bool = False) -> Cursors:
        """A cursor for each row of (query_id, query), searched together."""
        return Cursors(self, self.fold_queries(queries, strict))


def slice_of(gram: bytes, size: int) -> str:
    """The slice of postings that a gram is filed in."""
    return "s" + gram[:size].hex().upper()


def build_index(texts: DataFrame, alphabet: Alphabet, config: IndexConfig | None = None, on_invalid: str = "error") -> TextIndex:
    """An index over (text_id, text); lazy until it is queried or saved. Text ids are unique."""
    config = config or IndexConfig()
    folded = build.fold_texts(texts, alphabet, on_invalid)
    posts = build.postings(folded, config.gram_length(alphabet.num_searchable_dense_symbols), config.chunk, config.index_width)
    return TextIndex(alphabet, config, folded, posts, build.gram_counts(posts))


def require_texts(index: TextIndex) -> TextIndex:
    if not index.texts.head(1):
        raise ValueError("an index needs at least one text")
    return index
