"""Line dedup by two Bloom filters for once-seen and twice-seen line hashes.

Three passes over the documents, which never move:

1. Each input partition sets the bits of its lines in two packed filters: a line whose bits the first one already has
   goes into the second. Filters are merged in a tree: bits set in both of two first filters are set in the second, all
   others by OR. The merged second filter is broadcast; beyond a checked size there is none, and every line is suspected.
2. Lines that the second filter has are suspected repeats. Only those shuffle, as their 128-bit hash and doc_id; counting
   distinct documents confirms them exactly and gives the first document of each.
3. The confirmed lines, broadcast up to a checked number and else joined to groups of documents, are dropped.

Bloom filters have no false negatives and counting is exact, so the result is. Lines are told apart by their 128-bit hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import common as C
from .common import batched, compress, expand, mix, texts_of, unpacked

SPACE = b" \t\n\x0b\x0c\r"
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
BITS_PER_LINE, PROBES = 10, 3
#: The largest filter that is made and broadcast, and the most confirmed lines that are.
FILTER_BYTES, BROADCAST_LINES = 128 << 20, 1 << 20
SLICE = 1 << 20
LANES = 16


def line_keys(text: bytes) -> list[bytes]:
    return [x.strip(SPACE) for x in text.translate(LOWER).split(b"\n")]


def digests(keys: list[bytes]) -> np.ndarray:
    """(keys, 2) halves of 128-bit hashes."""
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(k) for k in keys]), np.uint64).reshape(-1, 2)


class Lines:
    """The distinct keys of each of several texts: hashes, and the text of each."""

    def __init__(self, texts: list[bytes], min_chars: int):
        keys, sizes = [], []
        for text in texts:
            own = [k for k in set(line_keys(text)) if len(k) >= min_chars and (min_chars < 2 or len(k.decode("utf-8", "replace")) >= min_chars)]
            keys += own
            sizes.append(len(own))
        self.hash = digests(keys)
        self.owner = np.repeat(np.arange(len(texts)), sizes)


def places(h: np.ndarray, bits: int) -> np.ndarray:
    a, b = h[:, 0], mix(h[:, 1]) | np.uint64(1)
    return ((a[None, :] + np.arange(PROBES, dtype=np.uint64)[:, None] * b[None, :]) & np.uint64(bits - 1)).astype(np.int64)


def has(filter_: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether all probes of each hash are set."""
    return ((filter_[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(0)


def put(filter_: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(filter_, at.ravel() >> 3, np.left_shift(1, at.ravel() & 7).astype(np.uint8))


def insert(once: np.ndarray, twice: np.ndarray, h: np.ndarray) -> None:
    """Hashes of (document, key), into filters of packed bits."""
    order = np.lexsort((h[:, 1], h[:, 0]))
    h = h[order]
    new = np.append(True, (h[1:] != h[:-1]).any(1)) if len(h) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    multi = np.diff(np.append(first, len(h))) > 1
    at = places(h[first], len(once) * 8)
    put(twice, at[:, has(once, at) | multi])
    put(once, at)


def merged(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    once, twice = pairs[0][0].copy(), pairs[0][1].copy()
    for a, b in pairs[1:]:
        twice |= b | (once & a)
        once |= a
    return once, twice


def filter_bits(docs: DataFrame, filter_bytes: int) -> int:
    """Bits for all lines, counted by one pass; 0 if that is more than filter_bytes."""
    lines = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    n = docs.agg(F.coalesce(F.sum(lines), F.lit(0))).first()[0]
    bits = 1 << max(10, (max(1, n) * BITS_PER_LINE - 1).bit_length())
    return bits if bits <= filter_bytes * 8 else 0


def twice_seen(docs: DataFrame, bits: int, min_chars: int) -> bytes:
    """The merged second filter, at most filter_bytes, as compressed bytes."""
    size = min(SLICE, bits // 8)

    def build(parts):
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for b in batched(parts):
            insert(once, twice, Lines(texts_of(b), min_chars).hash)
        rows = [(s // size, compress(once[s : s + size].tobytes()), compress(twice[s : s + size].tobytes())) for s in range(0, len(once), size) if once[s : s + size].any()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], names=["slice", "once", "twice"])

    def merge(t):
        once, twice = merged([(np.frombuffer(expand(a), np.uint8), np.frombuffer(expand(b), np.uint8)) for a, b in zip(t.column("once").to_pylist(), t.column("twice").to_pylist())])
        return pa.table({"slice": t.column("slice")[:1].combine_chunks(), "once": pa.array([compress(once.tobytes())], pa.binary()), "twice": pa.array([compress(twice.tobytes())], pa.binary())})

    schema = "slice int, once binary, twice binary"
    built = docs.select("text").mapInArrow(build, schema).withColumn("lane", F.pmod(F.spark_partition_id(), F.lit(LANES)))
    lanes = built.groupBy("slice", "lane").applyInArrow(merge, schema)
    whole = np.zeros(bits // 8, np.uint8)
    for r in lanes.groupBy("slice").applyInArrow(merge, schema).select("slice", "twice").collect():
        whole[r.slice * size : (r.slice + 1) * size] = np.frombuffer(expand(bytes(r.twice)), np.uint8)
    return compress(whole.tobytes())


def suspects(docs: DataFrame, known, min_docs: int, min_chars: int) -> DataFrame:
    """(key, doc_id) of the lines that the filter has: from each batch the min_docs smallest documents of each key.

    Fewer than that many in every batch is what keys of fewer than min_docs documents have, so these rows decide.
    """
    out = T.StructType([T.StructField("key", T.BinaryType()), docs.schema["doc_id"]])
    arrow = to_arrow_schema(out)

    def find(parts):
        twice = None if known is None else np.frombuffer(expand(known.value), np.uint8)
        for b in batched(parts, 20000):
            lines = Lines(texts_of(b), min_chars)
            use = np.ones(len(lines.hash), bool) if twice is None else has(twice, places(lines.hash, len(twice) * 8)) if len(lines.hash) else np.zeros(0, bool)
            h, owner = lines.hash[use], lines.owner[use]
            if not len(h):
                continue
            ids = b.column("doc_id").combine_chunks()
            # Places of documents in order of id, null last; rows with one id are one document.
            rank = np.empty(len(ids), np.int64)
            by = pc.sort_indices(ids).to_numpy()
            in_order = ids.take(pa.array(by)).to_pylist()
            rank[by] = np.cumsum([1, *(x != y for x, y in zip(in_order, in_order[1:]))])
            order = np.lexsort((rank[owner], h[:, 1], h[:, 0]))
            h, owner = h[order], owner[order]
            new_key = np.append(True, (h[1:] != h[:-1]).any(1))
            new = new_key | np.append(True, rank[owner[1:]] != rank[owner[:-1]])
            h, owner, new_key = h[new], owner[new], new_key[new]
            start = np.maximum.accumulate(np.where(new_key, np.arange(len(h)), 0))
            few = np.arange(len(h)) - start < min_docs
            raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), int(few.sum()), [None, pa.py_buffer(np.ascontiguousarray(h[few]).tobytes())])
            yield from pa.Table.from_arrays([raw.cast(pa.binary()), ids.take(pa.array(owner[few]))], names=arrow.names).cast(arrow).to_batches()

    return docs.select("doc_id", "text").mapInArrow(find, out)


class Confirmed:
    """Confirmed keys in order of their hash, with the first document of each (null: none has an id)."""

    def __init__(self, keys: pa.Array, first: pa.Array):
        h = np.frombuffer(b"".join(keys.to_pylist()), np.uint64).reshape(-1, 2)
        order = np.lexsort((h[:, 1], h[:, 0]))
        self.hash, self.first = h[order], first.take(pa.array(order))
        starts = np.flatnonzero(np.append(True, self.hash[1:, 0] != self.hash[:-1, 0])) if len(h) else np.zeros(0, np.int64)
        self.longest = int(np.diff(np.append(starts, len(h))).max(initial=0))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 if it isn't there."""
        found = np.full(len(h), -1)
        if len(self.hash):
            at = np.searchsorted(self.hash[:, 0], h[:, 0])
            for k in range(self.longest):
                place = np.minimum(at + k, len(self.hash) - 1)
                hit = (self.hash[place] == h).all(1)
                found[hit] = place[hit]
        return found


def dropped(table: pa.Table, lines: Confirmed, keep: str) -> tuple[list, list, list]:
    """New texts, lines and dropped lines of each row."""
    ids, nulls, texts = table.column("doc_id").to_pylist(), table.column("text").is_null().to_pylist(), texts_of(table)
    keys = [line_keys(t) for t in texts]
    at = lines.find(digests([k for own in keys for k in own])).tolist()
    first, out, n_lines, n_dropped, s = lines.first.to_pylist(), [], [], [], 0
    for i, null, text, own in zip(ids, nulls, texts, keys):
        hit = at[s : s + len(own)]
        s += len(own)
        if max(hit) < 0:
            kept = text.split(b"\n")
            out.append(None if null else text)
        else:
            kept, seen = [], set()
            for place, line in zip(hit, text.split(b"\n")):
                if place < 0:
                    kept.append(line)
                elif keep == "first" and first[place] == i and place not in seen:
                    kept.append(line)
                    seen.add(place)
            out.append(None if null else b"\n".join(kept))
        n_lines.append(len(own))
        n_dropped.append(len(own) - len(kept))
    return [None if x is None else x.decode() for x in out], n_lines, n_dropped


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep: str = "none", counts: tuple[str, str] = ("n_lines", "n_dropped"), filter_bytes: int = FILTER_BYTES, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """All columns of docs, with text without its repeated lines, and n_lines, n_dropped, named by counts.

    A text is split at \\n; a line's key is the line stripped of ASCII white space with A-Z lower-cased. Keys of at
    least min_chars code points that at least min_docs documents have lose their lines: everywhere (keep="none"), or
    everywhere but at the first place in the document with the smallest doc_id (keep="first").

    doc_id is an integer. Null text: one empty line, stays null. Null doc_id: such rows count as one document, after all
    others. Rows that share a doc_id count as one document, and each of them may keep a line. Empty table: empty result.
    Extra columns pass through; one with a name in counts gives way.
    """
    spark = docs.sparkSession
    docs = docs.drop(*counts)
    bits = filter_bits(docs, filter_bytes)
    known = spark.sparkContext.broadcast(twice_seen(docs, bits, min_chars)) if bits else None
    pairs = suspects(docs, known, min_docs, min_chars).distinct()
    often = pairs.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).where(F.col("n") >= min_docs).select("key", "first")
    often = C.cut(often)
    out = docs.withColumn(counts[0], F.lit(0).cast("long")).withColumn(counts[1], F.lit(0).cast("long")).schema
    arrow = to_arrow_schema(out)
    text_at = docs.columns.index("text")

    def rebuilt(table: pa.Table, lines: Confirmed) -> pa.Table:
        texts, n_lines, n_dropped = dropped(table, lines, keep)
        table = table.set_column(text_at, "text", pa.array(texts, pa.large_string()))
        return table.append_column(counts[0], pa.array(n_lines, pa.int64())).append_column(counts[1], pa.array(n_dropped, pa.int64())).cast(arrow)

    if often.count() <= broadcast_lines:
        found = often.toArrow().combine_chunks()
        chosen = spark.sparkContext.broadcast(C.freeze(found))

        def drop(parts):
            t = C.thaw(chosen.value).combine_chunks()
            lines = Confirmed(t.column("key").combine_chunks(), t.column("first").combine_chunks())
            for b in batched(parts, 2000):
                yield from rebuilt(b, lines).to_batches()

        return docs.mapInArrow(drop, out)
    packed = C.pack(docs, C.group_count(docs))

    def asked(t):
        """Distinct keys of a group of documents."""
        h = np.unique(Lines(texts_of(unpacked(t)), min_chars).hash, axis=0)
        return pa.table({"g": pa.array([t.column("g")[0].as_py()] * len(h), pa.int32()), "key": pa.array([x.tobytes() for x in h], pa.binary())})

    told = packed.groupBy("g").applyInArrow(asked, "g int, key binary").join(often, "key")

    def drop_group(left, right):
        if not left.num_rows:
            return C.empty_like(arrow)
        return rebuilt(unpacked(left), Confirmed(right.column("key").combine_chunks(), right.column("first").combine_chunks()))

    return packed.groupBy("g").cogroup(told.groupBy("g")).applyInArrow(drop_group, out)


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = C.read_documents(spark, sf_dir).select("doc_id", "text")
    done = line_dedup(docs, min_docs=10, min_chars=1, keep="none")
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP8_SQL = """
WITH split AS (
  SELECT rowid AS row_no, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line_no
  FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key
  FROM split
), often AS (
  SELECT line_key FROM keyed WHERE length(line_key) >= 1 GROUP BY line_key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE often.line_key IS NOT NULL))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE often.line_key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN often USING (line_key) GROUP BY row_no, doc_id
"""
