"""Near-duplicates by ProbMinHash over weighted word shingles, banding, and exact verification.

Each distinct shingle of a text, weighted by how often it occurs, sends arrivals of a Poisson process of that rate to
random registers; a register keeps the shingle that came first. Arrivals after the time by which all registers are
filled can't matter, so the process stops there. Two texts agree in a register with the probability Jaccard similarity
of their shingles. Bands of registers find candidates.

Equal texts, which are told by the 128-bit hash of their words, are folded before banding. In a bucket of a band all are
compared with one leader, for several choices of leader in turn, and what is linked grows together to components. Large
buckets that still hold several components get more and more leaders, each of which leaves once it has met the others;
only small ones are looked at pair by pair, across components. No link is lost, and no row is the pair of all by all.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import common as C
from .common import mix, pack_sorted, texts_of, unpack_sorted
from .words import Words, shingles

SHINGLE = 5
#: A leader with more pairs than that is joined in several parts.
HOT_PAIRS = 5000
#: Up to so many links are connected by one task, whose memory they bound; more in rounds of joins.
LINKS_A_TASK = 1_000_000
MASK = np.uint64((1 << 48) - 1)


def cleaned(texts: list[bytes]) -> list[bytes]:
    """Lower-cased words, one space apart."""
    return [b" ".join(t.decode("utf-8", "replace").lower().encode().split()) for t in texts]


def weighted(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, 48-bit shingle, how often) in order. A text of fewer than five words is one shingle."""
    words = Words(texts, punctuation=True)
    h, owner = shingles(words, SHINGLE)
    short = np.flatnonzero(words.per_text < SHINGLE)
    if len(short):
        h = np.concatenate((h, np.array([xxhash.xxh3_64_intdigest(texts[i]) for i in short.tolist()], np.uint64)))
        owner = np.concatenate((owner, short))
    if len(texts) > 1 << 16:
        raise ValueError("at most 65536 texts at once")
    key, n = np.unique((owner.astype(np.uint64) << np.uint64(48)) | (h & MASK), return_counts=True)
    return (key >> np.uint64(48)).astype(np.int64), key & MASK, n


def signatures(owner: np.ndarray, h: np.ndarray, weight: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """(texts, registers) shingles that came first."""
    total = np.bincount(owner, weight, texts)
    stop = registers * (np.log(registers) + 3) / np.maximum(total, 1)
    signature = np.zeros((texts, registers), np.uint64)
    todo = np.unique(owner)
    while len(todo):
        use = np.isin(owner, todo)
        doc, x, w = owner[use], h[use], weight[use]
        when, keys, times, who = np.zeros(len(doc)), [], [], []
        r = 0
        while len(doc):
            draw = mix(x + np.uint64((0x9E3779B97F4A7C15 * (r + 1)) & (2**64 - 1)))
            when = when - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / w
            live = when <= stop[doc]
            doc, x, w, when, draw = doc[live], x[live], w[live], when[live], draw[live]
            # The draw's low bits, scrambled once more, choose the register.
            keys.append(doc * registers + (mix(draw ^ np.uint64(0xD6E8FEB86659FD93)) % np.uint64(registers)).astype(np.int64))
            times.append(when)
            who.append(x)
            r += 1
        keys, times, who = np.concatenate(keys), np.concatenate(times), np.concatenate(who)
        order = np.argsort(-times)
        filled = np.zeros(texts * registers, bool)
        filled[keys] = True
        signature.ravel()[keys[order]] = who[order]
        todo = todo[~filled.reshape(texts, registers)[todo].all(1)]
        stop[todo] *= 2
    return signature


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Of two weighted sets: the sum over common elements i of 1 / sum over j of max(x_j / x_i, y_j / y_i)."""
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = b[at] == a
    if not both.any():
        return 0.0
    if x.max() == x.min() and y.max() == y.min():
        common = int(both.sum())
        # Equal weights on each side: scaling them changes nothing.
        return common / (len(a) + len(b) - common)
    i, k = np.flatnonzero(both), at[both]
    only_a, only_b = float(x.sum() - x[i].sum()), float(y.sum() - y[k].sum())
    xs, ys = x[i].astype(float), y[k].astype(float)
    ratio = ys / xs
    order = np.argsort(ratio)
    xs, ys, ratio = xs[order], ys[order], ratio[order]
    upto = np.searchsorted(ratio, ratio, "right")
    sum_x, sum_y = np.cumsum(xs)[upto - 1] + only_a, ys.sum() - np.cumsum(ys)[upto - 1] + only_b
    return float((1 / (sum_x / xs + sum_y / ys)).sum())


def signed(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, words (128-bit hash of the words in order), the band hashes, the shingles with their weights, and a sketch, one
    byte of each register, of each row.
    """
    out = T.StructType([docs.schema["doc_id"], T.StructField("words", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("shingles", T.BinaryType()), T.StructField("weights", T.BinaryType()), T.StructField("sketch", T.BinaryType())])
    arrow = to_arrow_schema(out)

    def sign(parts):
        for b in C.batched(parts, 1 << 14, 2 << 20):
            texts = cleaned(texts_of(b))
            owner, h, n = weighted(texts)
            signature = signatures(owner, h, n, len(texts), bands * rows).reshape(len(texts), bands, rows)
            band = np.zeros((len(texts), bands), np.uint64)
            for r in range(rows):
                band = mix(band + signature[:, :, r])
            sketch = signature.reshape(len(texts), -1).astype(np.uint8)
            flat = pa.array(band.view(np.int64).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, bands), pa.int32()), flat)
            ends, keys, weights = np.searchsorted(owner, np.arange(len(texts) + 1)), [], []
            for s, e in zip(ends[:-1].tolist(), ends[1:].tolist()):
                keys.append(pack_sorted(h[s:e]))
                weights.append(b"" if n[s:e].max() == 1 else C.compress(n[s:e].astype(np.uint32).tobytes()))
            yield from pa.Table.from_arrays([b.column("doc_id"), pa.array([xxhash.xxh3_128_digest(t) for t in texts], pa.binary()), lists, pa.array(keys, pa.binary()), pa.array(weights, pa.binary()), pa.array([x.tobytes() for x in sketch], pa.binary())], names=arrow.names).cast(arrow).to_batches()

    return docs.select("doc_id", "text").mapInArrow(sign, out)


def shingle_sets(own: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingles, weights, sketch) of the texts in nodes, once each however many rows have them."""
    sets = own.select(F.col("words").alias("node"), "shingles", "weights", "sketch")
    few = nodes.count() <= C.BROADCAST_IDS
    if few:
        sets = sets.join(F.broadcast(nodes), "node", "left_semi")
    sets = sets.groupBy("node").agg(*[F.first(c).alias(c) for c in ("shingles", "weights", "sketch")])
    return sets if few else sets.join(nodes, "node", "left_semi")


def salted(pairs: DataFrame, two: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """pairs and the sets of their leaders b, both with a salt where a leader has very many pairs; and what to join them on."""
    hot = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_PAIRS).select("b", F.ceil(F.col("n") / HOT_PAIRS).cast("int").alias("salts"))
    if not hot.head(1):
        return pairs, two, ["b"]
    salts = F.coalesce("salts", F.lit(1))
    pairs = pairs.join(hot, "b", "left").withColumn("salt", F.pmod(F.xxhash64("a"), salts).cast("int")).drop("salts")
    two = two.join(hot, "b", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    return pairs, two, ["b", "salt"]


def likely(pairs: DataFrame, sketches: DataFrame, similarity: float, registers: int) -> DataFrame:
    """The pairs whose sketches agree as often as those of that similarity do, but for one in fifty thousand.

    Most pairs of a bucket are far less alike. What is compared is a byte a register, instead of all shingles.
    """
    least = math.floor(registers * similarity - 4.1 * math.sqrt(registers * similarity * (1 - similarity)))
    both = pairs.join(sketches.select(F.col("node").alias("a"), F.col("sketch").alias("x")), "a").join(sketches.select(F.col("node").alias("b"), F.col("sketch").alias("y")), "b")
    out = T.StructType([pairs.schema["a"], pairs.schema["b"]])

    def agree(parts):
        for batch in parts:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, registers) for c in ("x", "y"))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(1) >= least))

    return both.select("a", "b", "x", "y").mapInArrow(agree, out)


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose probability Jaccard similarity is at least `similarity`, with it."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("ha"), F.col("weights").alias("wa"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("hb"), F.col("weights").alias("wb"))
    pairs, two, on = salted(pairs, two)
    joined = pairs.join(one, "a").join(two, on).select("a", "b", "ha", "wa", "hb", "wb")
    out = T.StructType([pairs.schema["a"], pairs.schema["b"], T.StructField("similarity", T.DoubleType())])
    arrow = to_arrow_schema(out)

    def opened(keys: bytes, weights: bytes):
        k = unpack_sorted(keys)
        return k, np.frombuffer(C.expand(weights), np.uint32).astype(np.int64) if weights else np.ones(len(k), np.int64)

    def check(parts):
        last, side = None, None
        for batch in parts:
            a, b, s = [], [], []
            for i, j, ha, wa, hb, wb in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ha", "wa", "hb", "wb"))):
                if last != j:
                    last, side = j, opened(hb, wb)
                x = probability_jaccard(*opened(ha, wa), *side)
                if x >= similarity:
                    a.append(i)
                    b.append(j)
                    s.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(a, arrow.field("a").type), pa.array(b, arrow.field("b").type), pa.array(s, pa.float64())], names=arrow.names)

    return joined.mapInArrow(check, out)


def connected(links: DataFrame) -> DataFrame:
    """(node, component) of a bounded number of links (u, v), by hooking and pointer jumping in arrays of one task."""
    out = T.StructType([T.StructField("node", links.schema["u"].dataType), T.StructField("component", links.schema["u"].dataType)])
    arrow = to_arrow_schema(out)

    def connect(parts):
        held = [pa.Table.from_batches([b]) for b in parts if b.num_rows]
        if not held:
            return
        table = pa.concat_tables(held)
        ends = pa.chunked_array([*table.column("u").chunks, *table.column("v").chunks]).combine_chunks()
        # Numbers in the order of nodes.
        names = pc.unique(ends)
        names = names.take(pc.sort_indices(names))
        at = pc.index_in(ends, names).to_numpy()
        u, v = at[: len(table)], at[len(table) :]
        label = np.arange(len(names))
        while True:
            low = np.minimum(label[u], label[v])
            new = label.copy()
            # The label's own node is hooked too, so trees merge and not only leaves.
            for x in (u, v, label[u], label[v]):
                np.minimum.at(new, x, low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        yield from pa.Table.from_arrays([names, names.take(pa.array(label))], names=arrow.names).cast(arrow).to_batches()

    return links.coalesce(1).mapInArrow(connect, out)


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(node, component): the smallest node that links (a, b) connect each node to, by hooking and pointer jumping.

    known: components from links before, which count as links of each node to its component.
    """
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if known is not None:
        both = both.unionByName(known.where("node != component").select(F.col("node").alias("u"), F.col("component").alias("v")))
    if both.count() <= LINKS_A_TASK:
        return C.cut(connected(both))
    both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # Each node is its own neighbour, so one aggregation hooks it to the least label about it.
    label = C.cut(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("component")).withColumnRenamed("u", "node"))
    while True:
        near = both.join(label, F.col("u") == F.col("node")).select(F.col("v").alias("node"), "component", F.lit(None).cast(label.schema["component"].dataType).alias("old"))
        hooked = near.unionByName(label.withColumn("old", F.col("component"))).groupBy("node").agg(F.min("component").alias("low"), F.max("old").alias("old"))
        up = label.select(F.col("node").alias("p"), F.col("component").alias("top"))
        jumped = C.cut(hooked.join(up, F.col("low") == F.col("p"), "left").select("node", F.least("low", F.coalesce("top", "low")).alias("component"), "old"))
        label = jumped.select("node", "component")
        if not jumped.where("component != old").head(1):
            return label


def mixed_buckets(parts: DataFrame) -> DataFrame:
    """(band, value, n) of the buckets that hold several components."""
    seen = parts.groupBy("band", "value").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n"))
    return seen.where("low != high").select("band", "value", "n")


def near_duplicates(docs: DataFrame, similarity: float = 0.8, bands: int = 24, rows: int = 5, rounds: int = 2, pairwise: int = 512) -> DataFrame:
    """doc_id, class_id: one row per row of docs.

    Documents are linked if the probability Jaccard similarity of their 5-word shingles, weighted by occurrence, is at
    least `similarity`; for texts without repeated shingles that is the Jaccard similarity. Classes are the components of
    links; class_id is the smallest doc_id. Two texts of that similarity share a band with probability
    1 - (1 - similarity**rows)**bands, 0.99993 by default, and pass the comparison of their sketches with 0.99998.

    Words are lower-cased and split at white space. A text of fewer than five words is one shingle: it is linked to texts
    with the same words only, and so are null and empty texts, which have none. A null doc_id counts as larger than all:
    it is in a class but never its class_id, unless all are null. Rows that share a doc_id are rows of their own. Repeated
    rows are in one class. Empty table: empty result. Extra columns are ignored.
    """
    own = C.stored(signed(docs.select("doc_id", "text"), bands, rows), "signed")
    texts = own.groupBy("words").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    member = texts.select(F.col("words").alias("node"), F.posexplode("bands").alias("band", "value"))
    crowded = member.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    member = C.cut(member.join(crowded.select("band", "value"), ["band", "value"], "left_semi"))
    sets = C.cut(shingle_sets(own, member.select("node").distinct()))
    sketches = C.cut(sets.select("node", "sketch"))
    label = None
    parts = member.withColumn("component", F.col("node"))

    def linked(pairs: DataFrame) -> None:
        """Verifies pairs (a, b), b being the leader, and lets components grow."""
        nonlocal label
        found = C.cut(verified(C.cut(likely(pairs.distinct(), sketches, similarity, bands * rows)), sets, similarity))
        if found.head(1):
            label = components(found, label)

    for k in range(rounds):
        # A leader for each bucket, by another order each round; those of the bucket's other components try it.
        rank = F.struct(F.xxhash64("node", F.lit(k)), "node")
        lead = parts.groupBy("band", "value").agg(F.min(rank).alias("lead"), F.min_by("component", rank).alias("led"), F.max("component").alias("high"), F.min("component").alias("low")).where("high != low")
        linked(parts.join(lead, ["band", "value"]).where("component != led").select(F.col("node").alias("a"), F.col("lead.node").alias("b")))
        if label is not None:
            parts = with_components(member, label)
    # The buckets that still hold several components, and nothing else, go on.
    parts = C.cut(parts.join(mixed_buckets(parts), ["band", "value"]))
    leaders = 32
    while parts.where(F.col("n") > pairwise).head(1):
        # About so many leaders in each large bucket, by a hash, and the least one in any case; every other member meets them all.
        h = F.xxhash64("node", F.lit(leaders))
        least = parts.where(F.col("n") > pairwise).groupBy("band", "value").agg(F.min(h).alias("least"))
        ranked = C.cut(parts.join(least, ["band", "value"], "left").withColumn("leads", F.coalesce((h == F.col("least")) | (F.pmod(h, F.col("n")) < leaders), F.lit(False)) & F.col("least").isNotNull()).drop("least"))
        lead = ranked.where("leads").select("band", "value", F.col("node").alias("b"), F.col("component").alias("led"))
        linked(ranked.join(lead, ["band", "value"]).where("component != led AND (NOT leads OR node > b)").select(F.col("node").alias("a"), "b"))
        rest = ranked.where("NOT leads").select("band", "value", "node", "component")
        rest = rest if label is None else with_components(rest.drop("component"), label)
        parts, leaders = C.cut(rest.join(mixed_buckets(rest), ["band", "value"])), leaders * 8
    # In small buckets every pair across components.
    other = parts.select("band", "value", F.col("node").alias("b"), F.col("component").alias("c2"))
    linked(parts.join(other, ["band", "value"]).where("node > b AND component != c2").select(F.col("node").alias("a"), "b"))
    names = texts.select("words", F.col("rep").alias("class_id"))
    if label is not None:
        # A class is named by the least id of its members.
        least = texts.select(F.col("words").alias("node"), "rep").join(label, "node").groupBy("component").agg(F.min("rep").alias("least"))
        named = label.join(least, "component").select(F.col("node").alias("words"), "least")
        names = names.join(named, "words", "left").select("words", F.coalesce("least", "class_id").alias("class_id"))
    return own.select("doc_id", "words").join(names, "words").select("doc_id", "class_id")


def with_components(member: DataFrame, label: DataFrame) -> DataFrame:
    joined = member.join(label, "node", "left")
    return C.cut(joined.select("band", "value", "node", F.coalesce("component", "node").alias("component")))


def op9_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(C.read_documents(spark, sf_dir))
