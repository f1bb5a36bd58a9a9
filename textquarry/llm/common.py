"""What the corpus operators share: grouping documents into compressed blobs, cutting lineage, small codecs.

Several operators ask the corpus as a whole something about each document ("which of my lines occur elsewhere?").
They all go the same way: documents are packed once into groups by a hash of doc_id (`pack`), every group sends
what it knows to buckets of the hash space, the buckets answer each group, and the group, cogrouped with its
answers, decides. A group never sends a value twice, so a value that a third of all rows share reaches its bucket
once per group. One lazy plan holds all of it: the exchange of the packed documents is shared by all steps, and a
lost executor costs only the tasks it had done.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans.lineage import cut, shared_folder, stored  # noqa: F401

FLUSH_BYTES = 24 << 20
#: What a group of documents has at most, but for one longer document: bytes of text and rows.
GROUP_BYTES = 8 << 20
GROUP_ROWS = 1 << 16
#: Up to so many ids are broadcast.
BROADCAST_IDS = 500_000
SEND = "to int, sender int, payload binary"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read_documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def compress(data: bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def freeze(table: pa.Table | pa.RecordBatch, level: int = 1) -> bytes:
    """Arrow data as compressed bytes."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write(table)
    return compress(sink.getvalue(), level)


def thaw(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(expand(data)).read_all()


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending uint64 as compressed differences, byte planes apart."""
    step = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    return compress(np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_sorted(data: bytes) -> np.ndarray:
    planes = np.frombuffer(expand(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def group_of(groups: int) -> Column:
    """The group of a row: by doc_id; rows without one by their text and where they lie, so that they are spread."""
    h = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).otherwise(F.xxhash64("text", F.spark_partition_id()))
    return F.pmod(h, F.lit(groups)).cast("int")


def group_of_id(groups: int) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int")


def group_count(docs: DataFrame, group_bytes: int | None = None, group_rows: int | None = None) -> int:
    """Groups for pack(): one for each GROUP_BYTES of text or GROUP_ROWS rows, measured, whatever the shuffle's partitions."""
    n, total = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    return max(1, -(-total // (group_bytes or GROUP_BYTES)), -(-n // (group_rows or GROUP_ROWS)))


def pack(docs: DataFrame, groups: int) -> DataFrame:
    """docs as rows (g int, blob binary): compressed Arrow tables of rows with the same g, hashed from doc_id.

    The result is already partitioned by g; every use of it in one plan shares that exchange.
    """
    spark = docs.sparkSession
    g = "__group"
    while g in docs.columns:
        g += "_"
    tagged = docs.withColumn(g, group_of(groups))

    def blobs(batches):
        held, size = [], 0

        def flush():
            table = pa.Table.from_batches(held)
            to = table.column(g).to_numpy()
            order = np.argsort(to, kind="stable")
            rest = table.drop_columns([g]).take(pa.array(order)).combine_chunks()
            to = to[order]
            starts = np.flatnonzero(np.diff(to, prepend=-1))
            ends = np.append(starts[1:], len(to))
            for s, e in zip(starts.tolist(), ends.tolist()):
                part = pa.Table.from_batches(rest.slice(s, e - s).to_batches())
                yield pa.RecordBatch.from_arrays([pa.array([int(to[s])], pa.int32()), pa.array([freeze(part, 3)], pa.binary())], names=["g", "blob"])

        for batch in batches:
            for s in range(0, batch.num_rows, 2000):
                held.append(batch.slice(s, 2000))
                size += held[-1].get_total_buffer_size() * held[-1].num_rows // max(1, batch.num_rows)
                if size >= FLUSH_BYTES:
                    yield from flush()
                    held, size = [], 0
        if held and sum(b.num_rows for b in held):
            yield from flush()

    return tagged.mapInArrow(blobs, "g int, blob binary").repartition(partitions(spark), "g")


def unpacked(table: pa.Table) -> pa.Table | None:
    """All rows of a group's blobs, in order of doc_id."""
    parts = [thaw(x) for x in table.column("blob").to_pylist() if x is not None]
    if not parts:
        return None
    whole = pa.concat_tables(parts).combine_chunks()
    return whole.sort_by([("doc_id", "ascending")])


def texts_of(table: pa.Table) -> list[bytes]:
    """The column text as UTF-8; null is empty."""
    return [x if x is not None else b"" for x in table.column("text").cast(pa.large_string()).cast(pa.large_binary()).to_pylist()]


def drop_rows(docs: DataFrame, ids: DataFrame, once: bool = False) -> DataFrame:
    """docs without the rows whose doc_id is in ids; with `once`, only the first row of each doc_id that stays.

    Rows with a null doc_id stay. Few ids are broadcast, and documents don't move; of more, each group of documents gets its own.
    """
    gone = cut(ids.select("doc_id").where("doc_id IS NOT NULL").distinct())
    repeats = once and docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").head(1)
    if not repeats and gone.count() <= BROADCAST_IDS:
        return docs.join(F.broadcast(gone), "doc_id", "left_anti").select(*docs.columns)
    groups = group_count(docs)
    packed = pack(docs, groups)
    gone = gone.groupBy(group_of_id(groups).alias("g")).agg(F.collect_list("doc_id").alias("ids"))
    arrow = to_arrow_schema(docs.schema)

    def rest(left, right):
        if not left.num_rows:
            return empty_like(arrow)
        known = {i for x in right.column("ids").to_pylist() for i in x} if right.num_rows else set()
        table, at = unpacked(left), []
        for k, i in enumerate(table.column("doc_id").to_pylist()):
            if i is None or i not in known:
                at.append(k)
                if once and i is not None:
                    known.add(i)
        return table.take(pa.array(at, pa.int64())).cast(arrow)

    return packed.groupBy("g").cogroup(gone.groupBy("g")).applyInArrow(rest, docs.schema)


def batched(parts, rows: int = 4000, size: int = 16 << 20):
    """Tables of at most `rows` rows and about `size` bytes of text, from Arrow batches."""
    for batch in parts:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        upto, s = np.cumsum(lengths), 0
        while s < batch.num_rows:
            e = int(np.searchsorted(upto, upto[s] - lengths[s] + size)) + 1
            e = min(e, s + rows, batch.num_rows)
            yield pa.Table.from_batches([batch.slice(s, e - s)])
            s = e


def sends(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table({"to": pa.array([r[0] for r in rows], pa.int32()), "sender": pa.array([r[1] for r in rows], pa.int32()), "payload": pa.array([r[2] for r in rows], pa.binary())})


def bucket_slices(values: np.ndarray, bucket: np.ndarray):
    """(bucket, positions in values) for each bucket in use, positions ascending."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    starts = np.flatnonzero(np.diff(b, prepend=-1))
    for s, e in zip(starts, np.append(starts[1:], len(b))):
        yield int(b[s]), order[s:e]


def empty_like(schema: pa.Schema) -> pa.Table:
    return pa.Table.from_batches([], schema=schema)
