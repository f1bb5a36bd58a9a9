"""Quality classifier: an interpolated modified Kneser-Ney model of UTF-8 bytes, trained on trusted text.

Symbols are the bytes of a text, so that letters of every script stay apart; n-grams have order five, and a 5-gram `abcde`
is a 40-bit number. The whole of the trusted text is counted. Counts and all distinct 5-grams of the corpus are sharded by the middle `bcd`, where everything
that orders five and four need comes together: contexts abcd and bcd, and the distinct a before bcde. The lower orders
are a table over triples of bytes, bounded by the alphabet and not by the corpus; it is made of sums by shard and sent to
each shard. Shards answer each group of documents with the probabilities of its distinct 5-grams, and the mean over a
text's bytes gives its perplexity. Documents above their language's quantile of trusted perplexity are rejected.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import common as C
from .common import compress, expand, freeze, mix, pack_sorted, sends, texts_of, thaw, unpack_sorted, unpacked

ORDER = 5
HELD_OUT = 5
CHUNK_BYTES = 1 << 20
EDGE = 0


def byte_classes() -> np.ndarray:
    """A symbol for each byte: itself, but digits are one, control characters are a space and line ends a line feed.
    0 stands before a text; a byte 0 is 255, which UTF-8 doesn't use.
    """
    table = np.arange(256, dtype=np.uint8)
    table[[*range(1, 32), 127]] = 32
    table[[10, 13]] = 10
    table[48:58] = 48
    table[0] = 255
    return table


def classes_of(text: bytes, table: np.ndarray) -> np.ndarray:
    return table[np.frombuffer(text, np.uint8)]


def grams(texts: list[bytes], table: np.ndarray):
    """(5-grams, bytes per text) for runs of texts of about a million bytes."""
    held, sizes, total = [], [], 0

    def joined():
        edge = np.zeros(ORDER - 1, np.uint8)
        s = np.concatenate([x for h in held for x in (edge, h)]).astype(np.uint64)
        g = s[4:] | (s[3:-1] << np.uint64(8)) | (s[2:-2] << np.uint64(16)) | (s[1:-3] << np.uint64(24)) | (s[:-4] << np.uint64(32))
        return g[s[4:] > 0], np.array(sizes)

    for text in texts:
        held.append(classes_of(text, table))
        sizes.append(len(held[-1]))
        total += sizes[-1] + ORDER - 1
        if total >= CHUNK_BYTES:
            yield joined()
            held, sizes, total = [], [], 0
    if held:
        yield joined()


def counted(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.unique(np.concatenate(parts), return_counts=True)


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(n, first)


def shard_of(gram: np.ndarray, shards: int) -> np.ndarray:
    return (mix((gram >> np.uint64(8)) & np.uint64(0xFFFFFF)) % np.uint64(shards)).astype(np.int64)


def count_of_counts(n: np.ndarray) -> np.ndarray:
    return np.array([np.count_nonzero(n == k) for k in range(1, 5)], np.int64)


def discounts(seen: np.ndarray) -> np.ndarray:
    """D for counts 0, 1, 2 and 3 or more, from the number of n-grams seen once to four times."""
    n1, n2, n3, n4 = (float(x) for x in seen)
    if min(n1, n2, n3, n4) <= 0:
        return np.array([0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0, *(min(max(x, 0.05), k) for k, x in enumerate(d, 1))])


class Level:
    """One order of the model: keys ascending, a key is its context and, in the last byte, a class."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, d: np.ndarray):
        self.keys = keys
        context = keys >> np.uint64(8)
        first = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(keys) else np.zeros(0, np.int64)
        self.context = context[first]
        total = np.add.reduceat(n, first).astype(np.float64) if len(keys) else np.zeros(0)
        kind = np.minimum(n, 3)
        self.share = (n - d[kind]) / np.repeat(total, np.diff(np.append(first, len(keys)))) if len(keys) else np.zeros(0)
        self.rest = np.add.reduceat(d[kind], first) / total if len(keys) else np.zeros(0)

    def over(self, keys: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Probabilities of keys, given those of the next lower order."""
        if not len(self.keys):
            return lower
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        share = np.where(self.keys[at] == keys, self.share[at], 0.0)
        context = keys >> np.uint64(8)
        at = np.minimum(np.searchsorted(self.context, context), len(self.context) - 1)
        return share + np.where(self.context[at] == context, self.rest[at], 1.0) * lower


class Lower:
    """Orders three to one, from the continuation counts of class triples (cde: distinct b before it)."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        bits = np.uint64(0xFFFF)
        k2, n2 = summed(keys & bits, np.ones(len(keys), np.int64))
        k1, n1 = summed(k2 & np.uint64(0xFF), np.ones(len(k2), np.int64))
        self.levels = [Level(k, m, discounts(count_of_counts(m))) for k, m in ((k1, n1), (k2, n2), (keys, n))]

    def __call__(self, grams3: np.ndarray) -> np.ndarray:
        p = np.full(len(grams3), 1 / 256)
        for level, mask in zip(self.levels, (0xFF, 0xFFFF, 0xFFFFFF)):
            p = level.over(grams3 & np.uint64(mask), p)
        return p


def orders_5_4(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the 5-grams of a shard the 4-grams and their continuation counts."""
    return summed(keys & np.uint64(0xFFFFFFFF), np.ones(len(keys), np.int64))


class Lookup:
    """Values by key from a table that is open to collisions; those few are searched."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        self.shift = np.uint64(64 - max(4, int(4 * max(1, len(keys))).bit_length()))
        self.table = np.zeros(1 << int(64 - self.shift), np.int32)
        self.table[self.slots(keys)] = np.arange(len(keys))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.table[self.slots(keys)]
        wrong = np.flatnonzero(self.keys[at] != keys)
        at[wrong] = np.searchsorted(self.keys, keys[wrong])
        return self.values[at]


def perplexities(docs: DataFrame, trusted: DataFrame, groups: int | None = None) -> DataFrame:
    """All columns of docs but text, and n_scored (bytes), perplexity, trusted and held_out: one row per row of docs.

    trusted has the doc_id of the documents to train on. One in HELD_OUT of them, by a hash of doc_id, is kept from
    training; all text of the others is used. An empty text has null perplexity. Columns of those names in
    docs give way.
    """
    groups = groups or C.group_count(docs)
    shards = groups
    docs = docs.drop("n_scored", "perplexity", "trusted", "held_out")
    packed = C.pack(docs, groups)
    table = byte_classes()
    ids = trusted.select("doc_id").where("doc_id IS NOT NULL").distinct()
    ids = ids.groupBy(C.group_of_id(groups).alias("g")).agg(F.collect_list("doc_id").alias("ids"))

    def trusted_of(docs_: pa.Table, right: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Which documents are trusted, and which of those are held out."""
        known = {i for x in right.column("ids").to_pylist() for i in x} if right.num_rows else set()
        ids = docs_.column("doc_id").to_pylist()
        use = np.array([i in known for i in ids], bool)
        return use, use & np.array([zlib.crc32(str(i).encode()) % HELD_OUT == 0 for i in ids], bool)

    def distinct_grams(texts: list[bytes]) -> np.ndarray:
        parts = [np.unique(g) for g, _ in grams(texts, table)]
        return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)

    def ask(left, right):
        if not left.num_rows:
            return sends([])
        g, docs_ = left.column("g")[0].as_py(), unpacked(left)
        texts, (use, held) = texts_of(docs_), trusted_of(docs_, right)
        keys = distinct_grams(texts)
        k, n = counted([x for x, _ in grams([t for t, u in zip(texts, use & ~held) if u], table)])
        place, place_k, rows = shard_of(keys, shards), shard_of(k, shards), []
        for s, at in C.bucket_slices(place, place):
            own = np.flatnonzero(place_k == s)
            rows.append((s, g, freeze(pa.table({"asked": pa.array([pack_sorted(keys[at])]), "keys": pa.array([pack_sorted(k[own])]), "n": pa.array([n[own]], pa.list_(pa.int64()))}))))
        return sends(rows)

    def model_of(t: pa.Table):
        keys, n = [], []
        for x in t.column("payload").to_pylist():
            x = thaw(x)
            keys.append(unpack_sorted(x.column("keys")[0].as_py()))
            n.append(np.array(x.column("n")[0].values.to_numpy(), np.int64))
        return summed(np.concatenate(keys), np.concatenate(n))

    def lower_counts(t):
        keys, n = model_of(t)
        k4, n4 = orders_5_4(keys, n)
        k3, n3 = summed(k4 & np.uint64(0xFFFFFF), np.ones(len(k4), np.int64))
        part = (k3 >> np.uint64(8)).astype(np.int64) % 16
        rows = [(r, 0, freeze(pa.table({"k": pa.array(k3[at]), "n": pa.array(n3[at])}))) for r, at in C.bucket_slices(part, part)]
        seen = np.concatenate([count_of_counts(n), count_of_counts(n4)])
        return sends([*rows, (16, 0, freeze(pa.table({"k": pa.array(np.arange(8, dtype=np.uint64)), "n": pa.array(seen)})))])

    def add_up(t):
        """Sums of one part of the class triples; the parts' size is bounded by the alphabet."""
        k, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for x in t.column("payload").to_pylist():
            x = thaw(x)
            k, n = summed(np.concatenate((k, x.column("k").to_numpy())), np.concatenate((n, x.column("n").to_numpy())))
        return sends([(s, t.column("to")[0].as_py(), freeze(pa.table({"k": pa.array(k), "n": pa.array(n)}))) for s in range(shards)])

    def answer(left, right):
        if not left.num_rows or not right.num_rows:
            return sends([])
        s, parts = left.column("to")[0].as_py(), {p: thaw(x) for p, x in zip(right.column("sender").to_pylist(), right.column("payload").to_pylist())}
        seen = parts.pop(16).column("n").to_numpy()
        lower = Lower(*summed(np.concatenate([x.column("k").to_numpy() for x in parts.values()]), np.concatenate([x.column("n").to_numpy() for x in parts.values()]))) if parts else Lower(np.zeros(0, np.uint64), np.zeros(0, np.int64))
        keys, n = model_of(left)
        five, four = Level(keys, n, discounts(seen[:4])), Level(*orders_5_4(keys, n), discounts(seen[4:]))
        asked = [unpack_sorted(thaw(x).column("asked")[0].as_py()) for x in left.column("payload").to_pylist()]
        every = np.unique(np.concatenate(asked))
        p = five.over(every, four.over(every & np.uint64(0xFFFFFFFF), lower(every & np.uint64(0xFFFFFF))))
        p = np.log(p).astype(np.float32)
        return sends([(g, s, compress(p[np.searchsorted(every, a)].tobytes())) for g, a in zip(left.column("sender").to_pylist(), asked)])

    out = T.StructType([*docs.drop("text").schema, T.StructField("n_scored", T.LongType()), T.StructField("perplexity", T.DoubleType()), T.StructField("trusted", T.BooleanType()), T.StructField("held_out", T.BooleanType())])
    arrow = to_arrow_schema(out)
    tagged = "sender int, payload binary, ids array<" + docs.schema["doc_id"].dataType.simpleString() + ">"

    def score(left, right):
        if not left.num_rows:
            return C.empty_like(arrow)
        docs_ = unpacked(left)
        texts = texts_of(docs_)
        answers = {s: np.frombuffer(expand(x), np.float32) for s, x in zip(right.column("sender").to_pylist(), right.column("payload").to_pylist()) if s >= 0}
        names = right.filter(pa.array([s < 0 for s in right.column("sender").to_pylist()], pa.bool_()))
        keys = distinct_grams(texts)
        value, place = np.zeros(len(keys), np.float32), shard_of(keys, shards)
        for s, at in C.bucket_slices(place, place):
            value[at] = answers[s]
        look, n, sums = Lookup(keys, value), [], []
        for g, sizes in grams(texts, table):
            total = np.concatenate((np.zeros(1), np.cumsum(look(g), dtype=np.float64)))
            ends = np.cumsum(sizes)
            n.append(sizes)
            sums.append(total[ends] - total[ends - sizes])
        n, sums = np.concatenate(n), np.concatenate(sums)
        known, held = trusted_of(docs_, names)
        result = np.exp(-sums / np.maximum(n, 1))
        docs_ = docs_.drop_columns(["text"]).append_column("n_scored", pa.array(n)).append_column("perplexity", pa.array(result, mask=n == 0)).append_column("trusted", pa.array(known)).append_column("held_out", pa.array(held))
        return docs_.cast(arrow)

    asked = packed.groupBy("g").cogroup(ids.groupBy("g")).applyInArrow(ask, C.SEND).repartition(C.partitions(docs.sparkSession), "to")
    lower = asked.groupBy("to").applyInArrow(lower_counts, C.SEND).groupBy("to").applyInArrow(add_up, C.SEND)
    answers = asked.groupBy("to").cogroup(lower.groupBy("to")).applyInArrow(answer, C.SEND)
    right = answers.select("to", "sender", "payload", F.lit(None).cast(tagged.split("ids ")[1]).alias("ids"))
    right = right.unionByName(ids.select(F.col("g").alias("to"), F.lit(-1).alias("sender"), F.lit(None).cast("binary").alias("payload"), "ids"))
    return packed.groupBy("g").cogroup(right.groupBy("to")).applyInArrow(score, out)


def classify_quality(docs: DataFrame, trusted: DataFrame, quantile: float = 0.99, slack: float = 1.15, doubt: float = 2.5, least: int = 30) -> DataFrame:
    """All columns of docs but text, and n_scored, perplexity, trusted, held_out, bound, limit and kept: one row per row of docs.

    bound is what the perplexity may be at least, perplexity * exp(-doubt / sqrt(n_scored)): few bytes tell little.
    A document is rejected if that is above its language's limit: the quantile of the held-out trusted documents of that
    language, or of all languages where fewer than `least` are held out. If those are fewer than `least` too, their quantile
    can't be told, and the limit is slack times it (without any, slack times that of those trained on).

    Null or empty text: no perplexity, kept. Null language: a language of its own. Null doc_id: scored, never trusted.
    Repeated rows are scored alike, and count alike in training. Without trusted text all is kept. Empty table: empty
    result. Extra columns pass through; bound, limit and kept of docs give way.
    """
    scored = perplexities(docs.drop("bound", "limit", "kept"), trusted)
    scored = C.cut(scored.withColumn("bound", F.col("perplexity") * F.exp(-doubt / F.sqrt(F.greatest("n_scored", F.lit(1))))))
    use = scored.where(F.col("held_out") & F.col("bound").isNotNull())
    held = bool(use.head(1))
    if not held:
        use = scored.where(F.col("trusted") & F.col("bound").isNotNull())
    cut_at = F.percentile_approx("bound", quantile, 10000).alias("q")
    by = use.groupBy("lang").agg(cut_at, F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select(F.col("lang").alias("__lang"), ((1.0 if held else slack) * F.col("q")).alias("__q"))
    overall, n = use.agg(cut_at, F.count(F.lit(1))).first()
    if not held or n < least:
        overall = overall and slack * overall
    limit = F.coalesce("__q", F.lit(overall).cast("double"))
    joined = scored.join(by, F.col("lang").eqNullSafe(F.col("__lang")), "left").withColumn("limit", limit).drop("__lang", "__q")
    return joined.withColumn("kept", F.coalesce(F.col("bound") <= F.col("limit"), F.lit(True)))


def trusted_documents(labels: DataFrame) -> DataFrame:
    """doc_id of the documents labelled as good. Toxic ones are among them: a limit without slack would reject half of
    them for words that the model hasn't seen, and they are judged by op5.
    """
    return labels.where("quality = 1").select("doc_id")


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = C.read_documents(spark, sf_dir).select("doc_id", "text", "lang")
    done = classify_quality(docs, trusted_documents(C.read_documents(spark, sf_dir, "labels")))
    return done.select("doc_id", "lang", "n_scored", "perplexity", "bound", "limit", "kept")
