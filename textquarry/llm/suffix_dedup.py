"""Suffix dedup: bytes covered by long strings that an earlier document has too.

The classes of equal strings of `min_len` bytes come from a Burrows-Wheeler transform by threshold-bounded interval
expansion (`string_classes`): intervals of suffixes with a common prefix are extended backward, breadth first, so that
common prefixes come by increasing length; intervals of one suffix leave the queue, and at `min_len` it stops.

To split that work, strings are routed by content, so that equal strings meet in one transform:

1. Every window of min_len bytes has the least hash of its k-grams as fingerprint. Groups of documents send their
   distinct fingerprints to buckets, which answer which of them several documents have. Windows without such a
   fingerprint occur in one document only.
2. The other windows, joined to pieces along runs with the same least hash of 8-grams, go to the bucket of that hash;
   equal pieces of a group travel once, with the smallest doc_id.
3. A bucket concatenates its distinct pieces, makes the transform, and takes the smallest doc_id over each class of
   equal windows. Groups get that number for each window of their pieces and mark the windows of later documents.

Buckets that follow one another are a part, and a group sends one message to a part (`layout`). A bucket that a common
8-gram makes too large for one transform is routed again by the fingerprints of its windows (`in_turns`).
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import common as C
from .common import bucket_slices, compress, expand, freeze, mix, pack_sorted, sends, texts_of, thaw, unpack_sorted, unpacked

NULL_ID = (1 << 63) - 1
CHUNK = 1 << 20
GRAM = 8
#: Buckets for each group of documents, and groups for each part of the buckets.
BUCKETS_A_GROUP = 4
GROUPS_A_PART = 4
LEAST_PARTS = 64
#: Symbols of one transform, but for windows that share a fingerprint.
MOST_SYMBOLS = 6 << 20
#: Answers that a part holds before it compresses them.
REPLY_BYTES = 32 << 20
LONGEST_RUN = 64


def layout(groups: int) -> tuple[int, int]:
    """Parts, and buckets of each. n groups send n * n / GROUPS_A_PART messages, once there are more than LEAST_PARTS parts."""
    buckets = BUCKETS_A_GROUP * groups
    parts = min(buckets, max(LEAST_PARTS, -(-groups // GROUPS_A_PART)))
    return parts, -(-buckets // parts)


def ramp(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def grams8(b: np.ndarray) -> np.ndarray:
    x = b.astype(np.uint64)
    x = (x[:-1] << np.uint64(8)) | x[1:]
    x = (x[:-2] << np.uint64(16)) | x[2:]
    return (x[:-4] << np.uint64(32)) | x[4:]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def fingerprints(g: np.ndarray, min_len: int) -> np.ndarray:
    """For each window of min_len bytes the least hash (48 bits) of its k-grams; g: the 8-grams."""
    parts = max(1, min_len // 16)
    n = len(g) - 8 * (parts - 1)
    h = np.zeros(n, np.uint64)
    for i in range(parts):
        h = (h ^ g[8 * i : 8 * i + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return sliding_min(mix(h) >> np.uint64(16), min_len - 8 * parts + 1)


def spread(h: np.ndarray) -> np.ndarray:
    """48-bit values one to one to such that fill ranges evenly; least hashes crowd at the low end."""
    return (h * np.uint64(0x9E3779B97F4A7C15)) & np.uint64((1 << 48) - 1)


class Chunk:
    """Segments of documents, one after another in `raw`; every window of a document starts in one segment."""

    def __init__(self, raw: bytes, doc: list[int], base: list[int], at: list[int], size: list[int], min_len: int):
        self.raw, self.doc, self.base, self.at = raw, np.array(doc), np.array(base), np.array(at)
        self.ok = np.ones(len(raw) - min_len + 1, bool)
        for a, n in zip(at, size):
            self.ok[a + n - min_len + 1 : a + n] = False
        self.grams = grams8(np.frombuffer(raw, np.uint8))


def chunks(texts: list[bytes], min_len: int):
    held, doc, base, at, size, total = [], [], [], [], [], 0
    for i, text in enumerate(texts):
        for s in range(0, len(text) - min_len + 1, CHUNK):
            part = text[s : s + CHUNK + min_len - 1]
            held.append(part)
            doc.append(i)
            base.append(s)
            at.append(total)
            size.append(len(part))
            total += len(part)
            if total >= CHUNK:
                yield Chunk(b"".join(held), doc, base, at, size, min_len)
                held, doc, base, at, size, total = [], [], [], [], [], 0
    if held:
        yield Chunk(b"".join(held), doc, base, at, size, min_len)


def runs_of(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths, as places in `at`, of runs of adjacent positions with one value."""
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.flatnonzero((values[1:] != values[:-1]) | (at[1:] != at[:-1] + 1)) + 1
    starts = np.concatenate(([0], new))
    return starts, np.diff(np.append(starts, len(at)))


def fingerprint_runs(chunk: Chunk, min_len: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint, first window and number of windows of each run."""
    at = np.flatnonzero(chunk.ok)
    values = fingerprints(chunk.grams, min_len)[at]
    s, n = runs_of(values, at)
    return spread(values[s]), at[s], n


def distinct(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct h, and whether several documents have each."""
    order = np.argsort(h)
    h, doc = h[order], doc[order]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    differs = np.concatenate(([False], (h[1:] == h[:-1]) & (doc[1:] != doc[:-1]))) if len(h) else np.zeros(0, bool)
    return h[first], np.logical_or.reduceat(differs, first) if len(first) else differs


def ranges(h: np.ndarray, buckets: int):
    """(bucket, start, end) of ascending 48-bit values by ranges of equal width."""
    edges = np.searchsorted(h, (np.arange(buckets + 1, dtype=np.float64) * (2.0**48 / buckets)).astype(np.uint64))
    return [(b, int(s), int(e)) for b, (s, e) in enumerate(zip(edges[:-1], edges[1:])) if e > s]


def order_of(key: np.ndarray, bits: int) -> np.ndarray:
    """Stable order of key, whose values have so many bits. With room for the places beside them, a plain sort does."""
    places = max(1, int(len(key) - 1).bit_length())
    if bits + places > 64:
        return np.argsort(key, kind="stable")
    return (np.sort((key << np.uint64(places)) | np.arange(len(key), dtype=np.uint64)) & np.uint64((1 << places) - 1)).astype(np.int64)


def suffix_array(s: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Order of the suffixes of s, each up to its sentinel 0, dist symbols on; equal ones by place. Where in it a string
    of the first few symbols begins that the row before hasn't, and how many symbols those are.

    Prefix doubling from keys of a few symbols; only suffixes that still share their prefix are sorted again.
    """
    n = len(s)
    dense = np.cumsum(np.bincount(s, minlength=257) > 0) - 1 + (s.min() > 0)
    width = max(1, int(dense[-1]).bit_length())
    step = max(1, min(8, (64 - n.bit_length()) // width))
    symbol, key = dense[s].astype(np.uint64), np.zeros(n, np.uint64)
    for i in range(step):
        part = np.zeros(n, np.uint64)
        part[: n - i] = symbol[i:]
        part *= dist > i
        key = (key << np.uint64(width)) | part
    sa = order_of(key, width * step)
    key = key[sa]
    new = np.concatenate(([True], key[1:] != key[:-1]))
    rank = np.empty(n, np.int32)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), np.int32(0)))
    tied = np.flatnonzero(~new | ~np.append(new[1:], True))
    heads, depth = new, step
    longest, bits = int(dist.max()), int(n).bit_length()
    while len(tied) and step < longest:
        p = sa[tied]
        second = np.where(dist[p] > step, rank[np.minimum(p + step, n - 1)] + 1, 0)
        pair = (rank[p].astype(np.uint64) << np.uint64(bits)) | second.astype(np.uint64)
        order = order_of(pair, 2 * bits)
        p, pair = p[order], pair[order]
        sa[tied] = p
        new = np.concatenate(([True], pair[1:] != pair[:-1]))
        rank[p] = np.maximum.accumulate(np.where(new, tied, 0))
        tied = tied[~new | ~np.append(new[1:], True)]
        step *= 2
    return sa, heads, depth


def string_classes(s: np.ndarray, dist: np.ndarray, min_len: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in s at which a string of min_len symbols without sentinel begins that begins elsewhere too, class by
    class, and where each class starts in them.

    The queue starts with the intervals of the few symbols that the suffixes were first sorted by.
    """
    sa, heads, depth = suffix_array(s, dist)
    bwt = s[sa - 1]
    order = np.argsort(bwt, kind="stable")
    lf = np.empty(len(s), np.int32)
    lf[order] = np.arange(len(s), dtype=np.int32)
    if depth > min_len:
        heads, depth = np.arange(len(s)) == 0, 0
    rows = np.flatnonzero((~heads | ~np.append(heads[1:], True)) & (dist[sa] > depth)).astype(np.int32)
    interval = np.cumsum(heads, dtype=np.int32)[rows]
    for _ in range(min_len - depth):
        # Prepend each symbol to each interval of the queue; both are in ascending order, and so is what comes of it.
        symbol = bwt[rows]
        some = symbol > 0
        rows, interval, symbol = rows[some], interval[some], symbol[some]
        order = np.argsort(symbol, kind="stable")
        symbol, interval, rows = symbol[order], interval[order], lf[rows[order]]
        new = np.concatenate(([True], (symbol[1:] != symbol[:-1]) | (interval[1:] != interval[:-1]))) if len(rows) else np.zeros(0, bool)
        several = ~new | ~np.append(new[1:], True)[: len(new)]
        interval = np.cumsum(new, dtype=np.int32)[several]
        rows = rows[several]
        if not len(rows):
            break
    starts = np.flatnonzero(np.concatenate(([True], interval[1:] != interval[:-1]))) if len(rows) else np.zeros(0, np.int64)
    return sa[rows], starts


def in_turns(pieces: list[bytes], docs: np.ndarray, min_len: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """What earliest() gives, by transforms of about `most` symbols: windows are routed by their fingerprints."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    windows, ends = sizes - min_len + 1, np.cumsum(sizes)
    raw, done, cuts = b"".join(pieces), 0, []
    for _, at in bucket_slices(ends // (1 << 20), ends // (1 << 20)):
        s, e = int(at[0]), int(at[-1]) + 1
        begin = int(ends[s] - sizes[s])
        window = np.repeat(ends[s:e] - sizes[s:e] - begin, windows[s:e]) + ramp(windows[s:e])
        values = fingerprints(grams8(np.frombuffer(raw, np.uint8, int(ends[e - 1]) - begin, begin)), min_len)[window]
        first, n = runs_of(values, window)
        cuts.append((mix(values[first]), done + first, begin + window[first], n, np.repeat(np.arange(s, e), windows[s:e])[first]))
        done += len(window)
    value, where, start, n, piece = (np.concatenate(x) for x in zip(*cuts))
    turn = (value % np.uint64(-(-int((n + min_len).sum()) // most))).astype(np.int64)
    least = np.empty(done, np.int64)
    for _, at in bucket_slices(turn, turn):
        known: dict[bytes, int] = {}
        own = np.array([known.setdefault(raw[x:y], len(known)) for x, y in zip(start[at].tolist(), (start[at] + n[at] + min_len - 1).tolist())])
        doc = np.full(len(known), NULL_ID, np.int64)
        np.minimum.at(doc, own, docs[piece[at]])
        best, own_windows = earliest(list(known), doc, min_len, None)
        first = np.cumsum(own_windows) - own_windows
        step = ramp(n[at])
        least[np.repeat(where[at], n[at]) + step] = best[np.repeat(first[own], n[at]) + step]
    return least, windows


def earliest(pieces: list[bytes], docs: np.ndarray, min_len: int, most: int | None = MOST_SYMBOLS) -> tuple[np.ndarray, np.ndarray]:
    """For each window of each of the distinct pieces the smallest document that has it; and windows per piece.

    Of more symbols than `most`, by several transforms.
    """
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    if most and int(sizes.sum()) + len(sizes) > most:
        return in_turns(pieces, docs, min_len, most)
    own = np.repeat(np.arange(len(pieces)), sizes + 1)
    place = ramp(sizes + 1)
    s = np.zeros(len(own), np.uint16)
    dist = sizes[own] + 1 - place
    s[dist > 1] = np.frombuffer(b"".join(pieces), np.uint8).astype(np.uint16) + 1
    at, starts = string_classes(s, dist.astype(np.int32), min_len)
    windows = sizes - min_len + 1
    first = np.cumsum(windows) - windows
    least = np.repeat(docs, windows)
    if len(at):
        best = np.minimum.reduceat(docs[own[at]], starts)
        least[first[own[at]] + place[at]] = np.repeat(best, np.diff(np.append(starts, len(at))))
    return least, windows


def pack_pieces(pieces: list[bytes], docs: np.ndarray, bucket: np.ndarray, buckets: int) -> bytes:
    """Pieces in order of their buckets (0 to buckets - 1), each with a document."""
    counts = np.bincount(bucket, minlength=buckets).astype(np.uint32)
    sizes = np.fromiter(map(len, pieces), np.uint32, len(pieces))
    return compress(counts.tobytes() + sizes.tobytes() + docs.astype(np.int64).tobytes() + b"".join(pieces))


def unpack_pieces(data: bytes, buckets: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, the borders of the pieces in them, documents, and the borders of the buckets in the pieces."""
    raw = expand(data)
    upto = np.concatenate(([0], np.cumsum(np.frombuffer(raw, np.uint32, buckets), dtype=np.int64)))
    n = int(upto[-1])
    sizes = np.frombuffer(raw, np.uint32, n, 4 * buckets)
    start = 4 * buckets + 12 * n
    return raw, np.concatenate(([start], start + np.cumsum(sizes, dtype=np.int64))), np.frombuffer(raw, np.int64, n, 4 * buckets + 4 * n), upto


def pack_frames(frames: list[bytes]) -> bytes:
    return b"".join(struct.pack("<Q", len(x)) + x for x in frames)


def unpack_frames(data: bytes) -> bytes:
    out, at = [], 0
    while at < len(data):
        n = struct.unpack_from("<Q", data, at)[0]
        out.append(expand(data[at + 8 : at + 8 + n]))
        at += 8 + n
    return b"".join(out)


def suffix_dedup(docs: DataFrame, min_len: int = 50, groups: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (of removed bytes, [start, end)) and kept (binary), one row per row of docs.

    Removed is each byte covered by a string of min_len bytes of the text that also starts in a document with a smaller
    doc_id. Strings are those of the input; overlapping ones count.

    doc_id is an integer. Null text: empty. Null doc_id: after all others, and not earlier than one another. Rows that share a doc_id are one
    document: none is earlier. Empty table: empty result. Extra columns are ignored. Texts of any length are read in
    segments of 1 MB that overlap by min_len - 1 bytes.
    """
    if min_len < 16:
        raise ValueError("min_len must be 16 or more")
    groups = groups or C.group_count(docs)
    parts, buckets = layout(groups)
    packed = C.pack(docs.select("doc_id", "text"), groups)

    def ids_of(table):
        return np.array([NULL_ID if i is None else i for i in table.column("doc_id").to_pylist()], np.int64)

    def ask(table):
        g, docs_ = table.column("g")[0].as_py(), unpacked(table)
        ids, hs, owners = ids_of(docs_), [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for chunk in chunks(texts_of(docs_), min_len):
            h, at, _ = fingerprint_runs(chunk, min_len)
            hs.append(h)
            owners.append(ids[chunk.doc[np.searchsorted(chunk.at, at, "right") - 1]])
        h, multi = distinct(np.concatenate(hs), np.concatenate(owners))
        rows = []
        for b, s, e in ranges(h, parts):
            x = pack_sorted(h[s:e])
            rows.append((b, g, struct.pack("<I", len(x)) + x + np.packbits(multi[s:e]).tobytes()))
        return sends(rows)

    def repeated(table):
        b, who, lists, multis = table.column("to")[0].as_py(), table.column("sender").to_pylist(), [], []
        for x in table.column("payload").to_pylist():
            n = struct.unpack_from("<I", x)[0]
            lists.append(unpack_sorted(x[4 : 4 + n]))
            multis.append(np.unpackbits(np.frombuffer(x, np.uint8, offset=4 + n), count=len(lists[-1])).astype(bool))
        h = np.concatenate(lists)
        order = np.argsort(h)
        same = np.diff(h[order]) == 0
        again = np.zeros(len(h), bool)
        again[order] = np.append(same, False) | np.insert(same, 0, False)
        again |= np.concatenate(multis)
        ends = np.cumsum([len(x) for x in lists])
        return sends([(g, b, np.packbits(again[e - len(x) : e]).tobytes()) for g, x, e in zip(who, lists, ends) if again[e - len(x) : e].any()])

    def cut_pieces(left, right):
        if not left.num_rows or not right.num_rows:
            return sends([])
        g, docs_ = left.column("g")[0].as_py(), unpacked(left)
        ids, texts = ids_of(docs_), texts_of(docs_)
        runs = [fingerprint_runs(c, min_len) for c in chunks(texts, min_len)]
        h = np.unique(np.concatenate([r[0] for r in runs]))
        again = np.zeros(len(h), bool)
        masks = dict(zip(right.column("sender").to_pylist(), right.column("payload").to_pylist()))
        for b, s, e in ranges(h, parts):
            if b in masks:
                again[s:e] = np.unpackbits(np.frombuffer(masks[b], np.uint8), count=e - s)
        h = h[again]
        known: dict[bytes, int] = {}
        first, where, doc, start, piece = [], [], [], [], []
        for chunk, (values, at, n) in zip(chunks(texts, min_len), runs):
            near = np.minimum(np.searchsorted(h, values), len(h) - 1)
            hit = h[near] == values
            if not hit.any():
                continue
            window = np.repeat(at[hit], n[hit]) + ramp(n[hit])
            least = sliding_min(mix(chunk.grams), min_len - GRAM + 1)[window]
            s, n = runs_of(least, window)
            cuts = -(-n // LONGEST_RUN)
            step = ramp(cuts) * LONGEST_RUN
            s, n = np.repeat(s, cuts) + step, np.minimum(np.repeat(n, cuts) - step, LONGEST_RUN)
            to = (mix(least[s] ^ np.uint64(0xA5A5)) % np.uint64(parts * buckets)).astype(np.int64)
            a = window[s]
            seg = np.searchsorted(chunk.at, a, "right") - 1
            d = chunk.doc[seg]
            raw, before = chunk.raw, len(known)
            found = [known.setdefault(raw[x:y], len(known)) for x, y in zip(a.tolist(), (a + n + min_len - 1).tolist())]
            found = np.array(found)
            doc.append(d)
            start.append(chunk.base[seg] + a - chunk.at[seg])
            piece.append(found)
            # A piece's number is that of its first use, in order.
            fresh = np.flatnonzero(found >= before)
            fresh = fresh[np.unique(found[fresh], return_index=True)[1]]
            first.append(d[fresh])
            where.append(to[fresh])
        if not known:
            return sends([])
        first, where, keys = ids[np.concatenate(first)], np.concatenate(where), list(known)
        place, rows = np.empty(len(keys), np.int64), []
        part = where // buckets
        for b, at in bucket_slices(part, part):
            at = at[np.argsort(where[at], kind="stable")]
            place[at] = np.arange(len(at))
            rows.append((b, g, pack_pieces([keys[i] for i in at.tolist()], first[at], where[at] % buckets, buckets)))
        piece = np.concatenate(piece)
        windows = np.fromiter(map(len, keys), np.int64, len(keys)) - min_len + 1
        uses = {"doc": pa.array(np.concatenate(doc), pa.int32()), "start": pa.array(np.concatenate(start), pa.int64()), "part": pa.array(part[piece], pa.int32()), "place": pa.array(place[piece], pa.int32()), "windows": pa.array(windows[piece], pa.int32())}
        rows.append((-1 - g, g, freeze(pa.table(uses))))
        return sends(rows)

    def answer(table):
        b = table.column("to")[0].as_py()
        if b < 0:
            return sends([(-1 - b, -1, table.column("payload")[0].as_py())])
        who = table.column("sender").to_pylist()
        held = [unpack_pieces(x, buckets) for x in table.column("payload").to_pylist()]
        open_, size, frames, last = [[] for _ in who], 0, [[] for _ in who], [0] * len(who)
        for k in range(buckets):
            known: dict[bytes, int] = {}
            own = []
            for raw, edge, _, upto in held:
                edge = edge[upto[k] : upto[k + 1] + 1].tolist()
                own.append(np.array([known.setdefault(raw[x:y], len(known)) for x, y in zip(edge[:-1], edge[1:])], np.int64))
            if known:
                least = np.full(len(known), NULL_ID, np.int64)
                for at, (_, _, docs_, upto) in zip(own, held):
                    least[at] = np.minimum(least[at], docs_[upto[k] : upto[k + 1]])
                best, windows = earliest(list(known), least, min_len)
                first = np.cumsum(windows) - windows
                for i, at in enumerate(own):
                    if len(at):
                        n = windows[at]
                        values = best[np.repeat(first[at], n) + ramp(n)]
                        open_[i].append(np.diff(values, prepend=last[i]).tobytes())
                        last[i] = int(values[-1])
                        size += values.nbytes
            if size >= REPLY_BYTES or k == buckets - 1:
                for i, x in enumerate(open_):
                    if x:
                        frames[i].append(compress(b"".join(x)))
                open_, size = [[] for _ in who], 0
        rows = [(g, b, pack_frames(x)) for g, x in zip(who, frames)]
        return sends(rows)

    out = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("kept", T.BinaryType()),
    ])
    arrow = to_arrow_schema(out)

    def remove(left, right):
        if not left.num_rows:
            return C.empty_like(arrow)
        table = unpacked(left)
        ids, texts = ids_of(table), texts_of(table)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        offset = ends - sizes
        begin, stop = np.zeros(int(ends[-1]) + 1, np.int8), np.zeros(int(ends[-1]) + 1, np.int8)
        best = {who: x for who, x in zip(right.column("sender").to_pylist(), right.column("payload").to_pylist())}
        if -1 in best:
            uses = thaw(best.pop(-1))
            doc, start, part, place, windows = (uses.column(c).to_numpy().astype(np.int64) for c in ("doc", "start", "part", "place", "windows"))
            for b, at in bucket_slices(part, part):
                least = np.cumsum(np.frombuffer(unpack_frames(best[b]), np.int64))
                n = np.zeros(int(place[at].max()) + 1, np.int64)
                n[place[at]] = windows[at]
                first = np.cumsum(n) - n
                w = windows[at]
                step = ramp(w)
                later = least[np.repeat(first[place[at]], w) + step] < np.repeat(ids[doc[at]], w)
                pos = (np.repeat(offset[doc[at]] + start[at], w) + step)[later]
                begin[pos] = 1
                stop[pos + min_len] = 1
        gone = np.cumsum(begin - stop, dtype=np.int32)[:-1] > 0
        edge = np.zeros(len(gone) + 1, bool)
        edge[offset] = True
        left_of = np.concatenate(([False], gone[:-1]))
        opens = np.flatnonzero(gone & (~left_of | edge[:-1]))
        closes = np.flatnonzero(gone & (~np.append(gone[1:], False) | edge[1:])) + 1
        removed = np.concatenate(([0], np.cumsum(gone)))
        n_removed = removed[ends] - removed[offset]
        buf = np.frombuffer(b"".join(texts), np.uint8)
        kept = [t if not r else buf[o:e][~gone[o:e]].tobytes() for t, r, o, e in zip(texts, n_removed.tolist(), offset.tolist(), ends.tolist())]
        owner = np.searchsorted(ends, opens, "right")
        spans = pa.StructArray.from_arrays([pa.array(opens - offset[owner]), pa.array(closes - offset[owner])], names=["start", "end"])
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(texts) + 1)), pa.int32()), spans)
        return pa.Table.from_arrays([table.column("doc_id"), pa.array(sizes), pa.array(n_removed), lists, pa.array(kept, pa.large_binary())], names=arrow.names).cast(arrow)

    asked = packed.groupBy("g").applyInArrow(ask, C.SEND)
    again = asked.groupBy("to").applyInArrow(repeated, C.SEND)
    pieces = packed.groupBy("g").cogroup(again.groupBy("to")).applyInArrow(cut_pieces, C.SEND)
    answers = pieces.groupBy("to").applyInArrow(answer, C.SEND)
    return packed.groupBy("g").cogroup(answers.groupBy("to")).applyInArrow(remove, out)


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    done = suffix_dedup(C.read_documents(spark, sf_dir), min_len=50)
    return done.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
