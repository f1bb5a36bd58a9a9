"""Toxicity by a convolutional text classifier, trained in numpy.

A word is the sum of hashed embeddings: of the word and of its first bytes, so that inflections share. Filters of
several widths run over the words, the maximum over the text of each is taken, and a linear layer scores those.
One embedding dimension starts from the class log odds of its bucket and one filter of each width reads it; everything
is then trained by Adam. Thresholds are calibrated on labelled rows that training did not see, by the language that the
function words of a text suggest; scores are stretched so that each language's threshold is at 0.7.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import common as C
from .words import Words, batches

BUCKETS, DIM = 1 << 16, 12
WIDTHS = ((1, 12), (2, 6), (3, 6))
PREFIXES = (None, 4, 5)
FUNCTION_WORDS = {
    "en": "the of and to in is that it was for on with as at by this from are".split(),
    "fr": "le la les de des et que un une du est pour dans sur avec pas au".split(),
    "de": "der die das und den von zu mit sich des auf für ist im dem nicht ein als".split(),
    "es": "el los las de y en que del se por con para una su al lo como".split(),
}
LANGUAGES = [*FUNCTION_WORDS]


def buckets_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, 3) buckets, words per text, and a guess at each text's language (len(LANGUAGES): none)."""
    words = Words(texts)
    ids = np.stack([1 + ((words.hashes(p) ^ np.uint64(i * 0x5BD1E995)) % np.uint64(BUCKETS - 1)).astype(np.int32) for i, p in enumerate(PREFIXES)], 1)
    marks = np.zeros((BUCKETS, len(LANGUAGES)), np.int8)
    for k, lang in enumerate(LANGUAGES):
        listed = Words([" ".join(FUNCTION_WORDS[lang]).encode()])
        marks[1 + (listed.hashes() % np.uint64(BUCKETS - 1)).astype(np.int32), k] = 1
    votes = np.stack([np.bincount(words.owner, marks[ids[:, 0], k], len(texts)) for k in range(len(LANGUAGES))], 1)
    return ids, words.per_text, np.where(votes.max(1) > 0, votes.argmax(1), len(LANGUAGES))


def lowered(texts: list[bytes]) -> list[bytes]:
    return [t.decode("utf-8", "replace").lower().encode() for t in texts]


class Convolution:
    """The network's weights; arrays only."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.embed = (r.normal(0, 0.1, (BUCKETS, DIM))).astype(np.float32)
        self.embed[0] = 0
        self.filters = [r.normal(0, 0.3, (w, DIM, n)).astype(np.float32) for w, n in WIDTHS]
        self.bias = [np.zeros(n, np.float32) for _, n in WIDTHS]
        self.out = r.normal(0, 0.1, sum(n for _, n in WIDTHS)).astype(np.float32)
        self.out_bias = np.zeros(1, np.float32)
        at = 0
        for f, (w, n) in zip(self.filters, WIDTHS):
            f[:, :, 0] *= 0.1
            f[:, 0, 0] = 1.0 / w
            self.out[at] = 1.0
            at += n

    def laid_out(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words with two empty places before each text and three at the end, so that windows don't span texts; starts."""
        pad = 2
        start = np.cumsum(counts + pad) - counts
        rows = np.zeros((int((counts + pad).sum()) + pad + 1, ids.shape[1]), np.int32)
        rows[np.repeat(start - (np.cumsum(counts) - counts), counts) + np.arange(len(ids))] = ids
        return rows, start

    def pooled(self, rows: np.ndarray, start: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        x = self.embed[rows[:, 0]]
        for k in range(1, rows.shape[1]):
            x += self.embed[rows[:, k]]
        # Each text owns the places from the two before its words to its last word.
        begin = start - 2
        maps, tops = [], []
        for f, b in zip(self.filters, self.bias):
            n = len(x) - len(f) + 1
            y = x[:n] @ f[0]
            for k in range(1, len(f)):
                y += x[k : k + n] @ f[k]
            y = np.maximum(y + b, 0)
            maps.append(y)
            tops.append(np.maximum.reduceat(y[: begin[-1] + counts[-1] + 2], begin, axis=0))
        return np.concatenate(tops, 1), maps, x

    def logits(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        rows, start = self.laid_out(ids, counts)
        return self.pooled(rows, start, counts)[0] @ self.out + self.out_bias[0]


def log_odds(ids: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Per bucket how much more often texts of class 1 have it, 0 where that may be chance."""
    a, b = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    ends = np.cumsum(counts)
    for s in range(0, len(counts), 500):
        n = counts[s : s + 500]
        own = ids[ends[s] - counts[s] : ends[s + len(n) - 1]]
        pairs = np.unique(np.repeat(np.repeat(np.arange(len(n)), n), ids.shape[1]).astype(np.int64) * BUCKETS + own.ravel())
        bucket, hot = pairs % BUCKETS, labels[s + pairs // BUCKETS] > 0
        a += np.bincount(bucket[hot], minlength=BUCKETS)
        b += np.bincount(bucket[~hot], minlength=BUCKETS)
    odds = np.log((a + 0.5) / (labels.sum() + 1)) - np.log((b + 0.5) / (len(labels) - labels.sum() + 1))
    sure = odds / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    return np.where((sure > 2.2) & (a > 1), odds, 0).astype(np.float32)


def backward(net: Convolution, rows: np.ndarray, start: np.ndarray, n: np.ndarray, y: np.ndarray, weight: np.ndarray):
    """Gradients of the weighted log loss of a batch: of filters, bias, out and out_bias, and (buckets, gradients) of the embedding."""
    top, maps, x = net.pooled(rows, start, n)
    p = 1 / (1 + np.exp(-(top @ net.out + net.out_bias[0])))
    d = ((p - y) * weight / len(y)).astype(np.float32)
    grads: list = [*[np.zeros_like(f) for f in net.filters], *[np.zeros_like(b) for b in net.bias], top.T @ d, np.array([d.sum()], np.float32)]
    back = d[:, None] * net.out[None, :] * (top > 0)
    touched, deltas, at = [], [], 0
    for k, (m, f) in enumerate(zip(maps, net.filters)):
        for c in range(f.shape[2]):
            place = np.array([a - 2 + m[a - 2 : a + s, c].argmax() for a, s in zip(start, n)])
            g = back[:, at + c]
            for j in range(len(f)):
                grads[k][j, :, c] += g @ x[place + j]
                touched.append(rows[place + j])
                deltas.append(g[:, None] * f[j, :, c][None, :])
            grads[len(net.filters) + k][c] += g.sum()
        at += f.shape[2]
    who, delta = np.concatenate(touched), np.concatenate(deltas)
    flat, which = np.unique(who.ravel(), return_inverse=True)
    g = np.zeros((len(flat), DIM), np.float32)
    np.add.at(g, which, np.repeat(delta, who.shape[1], 0))
    g[flat == 0] = 0
    return grads, flat, g


def train(texts: list[bytes], labels: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.003, seed: int = 7) -> Convolution:
    net, r = Convolution(seed), np.random.default_rng(seed)
    # A megabyte at a time: hashing words takes some fifty bytes for each of a text.
    parts = [buckets_of(lowered(texts[s:e]))[:2] for s, e in batches(texts)]
    ids, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    ends = np.cumsum(counts)
    net.embed[:, 0] = log_odds(ids, counts, labels) / 2
    params = [net.embed, *net.filters, *net.bias, net.out, net.out_bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    weight = np.where(labels > 0, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum())) * len(labels)
    step = 0
    for _ in range(epochs):
        order = r.permutation(len(texts))
        for s in range(0, len(order), batch):
            pick = order[s : s + batch]
            n = counts[pick]
            rows, start = net.laid_out(np.concatenate([ids[ends[i] - counts[i] : ends[i]] for i in pick]), n)
            grads, flat, g = backward(net, rows, start, n, labels[pick], weight[pick])
            grads[-2] += 1e-4 * net.out
            step += 1
            scale = rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for i, p_ in enumerate(params):
                sel = flat if i == 0 else slice(None)
                gr = g if i == 0 else grads[i - 1]
                first[i][sel] = 0.9 * first[i][sel] + 0.1 * gr
                second[i][sel] = 0.999 * second[i][sel] + 0.001 * gr * gr
                p_[sel] -= scale * first[i][sel] / (np.sqrt(second[i][sel]) + 1e-7)
    return net


def raw_scores(net: Convolution, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Score before calibration, and the guessed language, of each text."""
    scores, langs = np.zeros(len(texts)), np.full(len(texts), len(LANGUAGES))
    for s, e in batches(texts):
        ids, counts, langs[s:e] = buckets_of(lowered(texts[s:e]))
        scores[s:e] = 1 / (1 + np.exp(-net.logits(ids, counts)))
    return scores, langs


def best_threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """The middle of the gap between two scores that gives the best F1."""
    order = np.argsort(-scores)
    s, y = scores[order], labels[order]
    f1 = 2 * np.cumsum(y) / (np.arange(1, len(y) + 1) + y.sum())
    f1[np.append(s[1:] == s[:-1], False)] = -1
    k = int(f1.argmax())
    return float(np.clip((s[k] + (s[k + 1] if k + 1 < len(s) else 0)) / 2, 1e-4, 1 - 1e-4))


def thresholds(scores: np.ndarray, langs: np.ndarray, labels: np.ndarray, least: int = 20) -> np.ndarray:
    """By language, the overall one where fewer than `least` toxic rows speak it."""
    overall = best_threshold(scores, labels) if labels.sum() else 0.5
    found = np.full(len(LANGUAGES) + 1, overall)
    for k in range(len(LANGUAGES)):
        own = langs == k
        if labels[own].sum() >= least and (1 - labels[own]).sum() >= least:
            found[k] = best_threshold(scores[own], labels[own])
    return found


def calibrated(scores: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.where(scores < at, 0.7 * scores / at, 0.7 + 0.3 * (scores - at) / (1 - at))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 4000, sample_bytes: int = 48 << 20) -> tuple[Convolution, np.ndarray]:
    """The network and the thresholds, from at most `sample` labelled rows of each class and `sample_bytes` of text.

    Rows are taken in order of a hash of doc_id, so that reruns agree. Three in four train, the others calibrate. The limit
    of bytes is applied by sums of sizes before any text moves; ids whose rows have more than a quarter of it are left out.
    """
    use = labels.where((F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) != 1) & F.col("toxic").isNotNull())
    use = use.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64(F.col("doc_id"), F.lit("toxicity")))
    picked = [use.where(F.col("toxic") == c).orderBy("h").limit(sample) for c in (0, 1)]
    # At most 2 * sample rows; a broadcast of that size is bounded.
    chosen = picked[0].unionByName(picked[1])
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    sizes = rows.groupBy("h").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("n")).where(F.col("n") <= sample_bytes // 4).orderBy("h").collect()
    upto = np.cumsum([x.n for x in sizes])
    use = [x.h for x, n in zip(sizes, upto) if n <= sample_bytes]
    # A list of at most 2 * sample numbers.
    rows = rows.where(F.col("h").isin(use)).orderBy("h", "text").select("text", "toxic", "h")
    found = [((r.text or "").encode(), r.toxic, r.h % 4 == 3) for r in rows.toLocalIterator()] if use else []
    if not any(t for _, t, _ in found) or all(t for _, t, _ in found):
        return Convolution(), np.full(len(LANGUAGES) + 1, 0.999)
    texts, y, held = [t for t, _, _ in found], np.array([t for _, t, _ in found], np.float32), np.array([h for _, _, h in found])
    if not (y[held].any() and y[~held].any()):
        held[:] = False
    net = train([t for t, h in zip(texts, held) if not h], y[~held])
    scores, langs = raw_scores(net, texts)
    use_ = held if held.any() else ~held
    return net, thresholds(scores[use_], langs[use_], y[use_])


def toxicity(docs: DataFrame, net: Convolution, at: np.ndarray) -> DataFrame:
    """doc_id, score, predicted: one row per row of docs, from the whole text alone.

    Null or empty text: the score of a text without words. Null doc_id passes through. Empty table: empty result. Extra
    columns are ignored. Texts are scored whole, whatever their length.
    """
    out = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    arrow = to_arrow_schema(out)

    def score(parts):
        for b in C.batched(parts, 1000):
            raw, langs = raw_scores(net, C.texts_of(b))
            final = calibrated(raw, at[langs])
            yield from pa.Table.from_arrays([b.column("doc_id"), pa.array(final), pa.array((final >= 0.7).astype(np.int32))], names=arrow.names).cast(arrow).to_batches()

    return docs.select("doc_id", "text").mapInArrow(score, out)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = C.read_documents(spark, sf_dir)
    net, at = fit(docs, C.read_documents(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    return toxicity(docs, net, at).select("doc_id", held_out.alias("held_out"), "score", "predicted")
