"""Benchmark decontamination by the q-gram lemma.

Two strings of w characters within e edits share w - q + 1 - q * e q-grams at least, on diagonals that differ by at most
e. All q-grams of a text that a benchmark item has are found through a hashed table; the places of the text that have one,
counted in overlapping bands of diagonals, tell which items may match where; hits close together narrow that to windows of
the item, and banded alignment of each such window decides.

A q-gram that an item repeats many times (rules of dashes, tables) is filed at every few places only, and bands are wider by
that step, so that no match is lost and a hit costs a few rows. Long texts are cut to segments that overlap by more than
a match, and a segment with too many hits is halved, so the work at a time is bounded.

The benchmark is taken in blocks of bounded size, each broadcast; each block is a pass over the documents.
"""

from __future__ import annotations

import math
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import common as C
from .suffix_dedup import ramp

Q = 8
TABLE_BITS = 20
#: Not a character; Q of them end each text.
END = 0x110000
#: A q-gram that an item has more often than REPEATS is filed at one place of each STEP.
REPEATS, STEP = 4, 8
SEGMENT = 1 << 17
#: Windows are aligned about places that are multiples of this.
GRID = 16
MOST_HITS = 1 << 20


def normal(text: str | None) -> str:
    """Lower case, runs of white space as one space."""
    return re.sub(r"\s+", " ", (text or "").lower()).strip()


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def grams8(x: np.ndarray) -> np.ndarray:
    """A hash of each eight characters; those of equal ones are equal."""
    h = x.astype(np.uint64)
    for step, factor in ((1, 0x9E3779B97F4A7C15), (2, 0xBF58476D1CE4E5B9), (4, 0x94D049BB133111EB)):
        h = h[:-step] * np.uint64(factor) + h[step:] if len(h) > step else h[:0]
        h = h ^ (h >> np.uint64(31))
    return h


def window_hashes(x: np.ndarray, width: int) -> np.ndarray:
    """A hash of each `width` characters and their number."""
    base = 0x9E3779B97F4A7C15
    power, back = np.full(len(x) + 1, base, np.uint64), np.full(len(x) + 1, pow(base, -1, 1 << 64), np.uint64)
    power[0] = back[0] = 1
    power, back = np.cumprod(power, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(C.mix(x.astype(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64)))
    return C.mix((sums[width:] - sums[:-width]) * back[: len(x) - width + 1] + np.uint64(width))


def slot(grams: np.ndarray) -> np.ndarray:
    return ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


class Items:
    """A block of benchmark items: windows, budgets and the postings of their q-grams; those too short for one apart."""

    def __init__(self, ids: list, texts: list[str], window: int, edits: float):
        keep = [i for i, t in enumerate(texts) if len(t) >= Q]
        self.ids, self.texts = [ids[i] for i in keep], [points(texts[i]) for i in keep]
        self.short: dict[str, list] = {}
        for i, t in zip(ids, texts):
            if 0 < len(t) < Q:
                self.short.setdefault(t, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for t in self.short:
            self.automaton.add_word(t, t)
        self.automaton.make_automaton()
        self.window = np.array([min(window, len(t)) for t in self.texts], np.int64)
        # No larger budget than the lemma can filter: at least two q-grams must be shared.
        self.budget = np.array([max(0, min(math.floor(edits * w), (w - Q - 1) // Q)) for w in self.window.tolist()], np.int64)
        self.needed = self.window - Q + 1 - Q * self.budget
        grams = [grams8(t) for t in self.texts]
        flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        counts = np.array([len(g) for g in grams], np.int64)
        owner, place = np.repeat(np.arange(len(grams)), counts), ramp(counts)
        order = np.lexsort((place, owner, flat))
        flat, owner, place = flat[order], owner[order].astype(np.int32), place[order].astype(np.int32)
        if len(flat):
            # Runs of one q-gram in one item; of long runs, the first place of each step.
            run = np.append(True, (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1]))
            start = np.flatnonzero(run)
            size = np.repeat(np.diff(np.append(start, len(flat))), np.diff(np.append(start, len(flat))))
            step = place // STEP
            kept = (size <= REPEATS) | run | np.append(True, step[1:] != step[:-1])
            self.thin = np.zeros(len(grams), bool)
            self.thin[owner[~kept]] = True
            flat, owner, place = flat[kept], owner[kept], place[kept]
        self.gram, first = np.unique(flat, return_index=True)
        self.first, self.count = first.astype(np.int32), np.diff(np.append(first, len(flat))).astype(np.int32)
        self.owner, self.place = owner, place
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[slot(self.gram)] = True
        most = int(self.budget.max(initial=0))
        self.band = max(8, 2 * most + 2)
        # Diagonals of one match differ by its edits, and by a step where places were left out.
        self.overlap = most + STEP
        self.reach = (self.band + self.overlap + 1) // 2 + most + STEP + 1 + GRID // 2
        self.overhang = int(self.window.max(initial=0)) + most + Q
        # Each window's number is that of the first with the same characters, by their hash.
        n = np.array([len(t) for t in self.texts], np.int64) - self.window + 1
        self.offset = np.cumsum(n) - n
        self.own, self.start = np.repeat(np.arange(len(n)), n), ramp(n)
        hashes = np.concatenate([window_hashes(t, int(w)) for t, w in zip(self.texts, self.window)]) if len(n) else np.zeros(0, np.uint64)
        _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        self.same = first[which]


def align(pieces: np.ndarray, text: np.ndarray, centre: np.ndarray, reach: int, budget: int) -> np.ndarray:
    """For each row of pieces (strings of one length) the fewest edits, budget + 1 if more, to a substring of text that
    begins about centre: from reach before it to reach after it, on 2 * reach + 1 diagonals.
    """
    width, n = 2 * reach + 1, pieces.shape[1]
    at = (centre - reach)[:, None] + np.arange(n + width)[None, :]
    region = np.where((at >= 0) & (at < len(text)), text[np.clip(at, 0, len(text) - 1)], END)
    steps = np.arange(width, dtype=np.int16)
    cost = np.zeros((len(pieces), width), np.int16)
    for i in range(n):
        down = np.full_like(cost, budget + 2)
        down[:, :-1] = cost[:, 1:] + 1
        cost = np.minimum(cost + (region[:, i : i + width] != pieces[:, i : i + 1]), down)
        cost = np.minimum.accumulate(cost - steps, axis=1) + steps
    return np.minimum(cost.min(1), budget + 1)


def candidates(text: np.ndarray, items: Items):
    """(item, window, where its start falls in the text, least edits) of the windows to align; None if there are too many hits.

    text may be several texts, END after each.
    """
    g = grams8(text)
    at = np.flatnonzero(items.table[slot(g)])
    near = np.minimum(np.searchsorted(items.gram, g[at]), len(items.gram) - 1)
    real = items.gram[near] == g[at]
    at, near = at[real], near[real]
    n = items.count[near].astype(np.int64)
    if n.sum() > MOST_HITS and len(text) > 4 * items.overhang:
        return None
    post = np.repeat(items.first[near].astype(np.int64), n) + ramp(n)
    at = np.repeat(at, n)
    item, place = items.owner[post].astype(np.int64), items.place[post].astype(np.int64)
    longest = max(map(len, items.texts))
    diagonal = at - place + longest
    per = int(diagonal.max(initial=0) // items.band + 2)
    keys, who = [], []
    # A band of width band + overlap: each hit also counts in the bands before whose overlap it lies in.
    for shift in range(items.overlap // items.band + 2):
        band = diagonal // items.band - shift
        inside = np.flatnonzero((band >= 0) & (diagonal - band * items.band < items.band + items.overlap))
        keys.append(item[inside] * per + band[inside])
        who.append(inside)
    keys, who = np.concatenate(keys), np.concatenate(who)
    # A first look at how many fall in one cell of a table, then at distinct places.
    cell = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
    some = np.bincount(cell, minlength=1 << TABLE_BITS)[cell] >= items.needed[keys // per]
    keys, who = keys[some], who[some]
    found = []
    for thin in (False, True):
        use = items.thin[keys // per] == thin
        # Places of the item, or of the text where the item's aren't all filed; each counts once in a band.
        found.append(windows(keys[use], at[who[use]] if thin else place[who[use]], thin, per, longest, items))
    return np.concatenate(found)


def windows(keys: np.ndarray, p: np.ndarray, thin: bool, per: int, longest: int, items: Items) -> np.ndarray:
    """(item, window, where, least edits that its q-grams allow) of the windows with enough of the places p."""
    order = np.lexsort((p, keys))
    key, p = keys[order], p[order]
    new = np.append(True, (key[1:] != key[:-1]) | (p[1:] != p[:-1])) if len(key) else np.zeros(0, bool)
    key, p = key[new], p[new]
    own = key // per
    need, w, budget = items.needed[own], items.window[own], items.budget[own] * thin
    # `need` places close together: inside one window, of the text with its edits.
    ahead = np.arange(len(key)) + need - 1
    last = np.minimum(ahead, len(key) - 1)
    close = np.flatnonzero((ahead < len(key)) & (key[last] == key) & (p[last] - p <= w - Q + budget)) if len(key) else np.zeros(0, np.int64)
    if not len(close):
        return np.zeros((0, 4), np.int64)
    k, last, item, w, budget = key[close], last[close], own[close], w[close], budget[close]
    centre = (k % per) * items.band - longest + (items.band + items.overlap) // 2
    # In the text, a window that holds them lies about them by its edits; in the item, by the diagonals of the band less.
    slack = (items.band + items.overlap + 1) // 2 + STEP + budget if thin else 0
    shift = centre if thin else 0
    low = np.maximum(0, p[last] + Q - w - budget - shift - slack)
    high = np.minimum(np.array([len(t) for t in items.texts])[item] - w, p[close] + budget - shift + slack)
    if thin:
        # One range for a band: where a q-gram repeats, nearly all windows are in it.
        first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        low, high = np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
        k, item, w, centre = k[first], item[first], w[first], centre[first]
    else:
        # Ranges of one band ascend; none is said twice.
        low[1:] = np.where(k[1:] == k[:-1], np.maximum(low[1:], high[:-1] + 1), low[1:])
    n = np.maximum(0, high - low + 1)
    start, item, where = np.repeat(low, n) + ramp(n), np.repeat(item, n), np.repeat(centre, n)
    bound = np.zeros(len(start), np.int64)
    if not thin:
        # Each q-gram that is missing is hit by an edit, and an edit hits Q of them.
        wide = np.int64(1 << 32)
        flat, k, w = key * wide + p, np.repeat(k, n), np.repeat(w, n)
        c = np.searchsorted(flat, k * wide + start + w - Q, "right") - np.searchsorted(flat, k * wide + start)
        bound = np.maximum(0, -((c - (w - Q + 1)) // Q))
    where = (start + where + GRID // 2) // GRID * GRID
    columns = (bound, where, items.same[items.offset[item] + start], item)
    order = np.lexsort(columns)
    rows = np.stack(columns[::-1], 1)[order]
    # Of equal ones the least bound.
    return rows[np.append(True, (rows[1:, :3] != rows[:-1, :3]).any(1))]


def fewest_edits(text: np.ndarray, starts: np.ndarray, items: Items, found: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(text, item, edits, where) of the items with a window within its budget; starts: where the texts begin."""
    # A window may begin as far before its text as it is aligned about, and by its edits more.
    owner = np.searchsorted(starts, np.maximum(0, found[:, 2] + 2 * items.reach), "right") - 1
    pair = owner * len(items.ids) + found[:, 0]
    order = np.lexsort((found[:, 3], pair))
    found, pair, owner = found[order], pair[order], owner[order]
    new = np.append(True, pair[1:] != pair[:-1])
    rank, group = ramp(np.diff(np.append(np.flatnonzero(new), len(pair)))), np.cumsum(new) - 1
    edits, budget = np.full(len(found), 1 << 20), items.budget[found[:, 0]]
    best = np.full(group[-1] + 1, 1 << 20)

    def verify(rows: np.ndarray) -> None:
        # A rule of dashes has one window, wherever it starts, and so have items that share a passage.
        tries, which = np.unique(found[rows, 1:3], axis=0, return_inverse=True)
        window, most, result = items.window[items.own[tries[:, 0]]], items.budget[items.own[tries[:, 0]]], np.zeros(len(tries), np.int64)
        for w, e in {*zip(window.tolist(), most.tolist())}:
            own = np.flatnonzero((window == w) & (most == e))
            for s in range(0, len(own), 1024):
                part = tries[own[s : s + 1024]]
                pieces = np.stack([items.texts[i][p : p + w] for i, p in zip(items.own[part[:, 0]].tolist(), items.start[part[:, 0]].tolist())])
                result[own[s : s + 1024]] = align(pieces, text, part[:, 1], items.reach, e)
        edits[rows] = result[which.ravel()]
        np.minimum.at(best, group[rows], edits[rows])

    # In order of their bounds; what can't be better than what is known isn't aligned.
    for low, high in ((0, 2), (2, 16), (16, 128), (128, len(found))):
        rows = np.flatnonzero((rank >= low) & (rank < high) & (found[:, 3] < best[group]) & (found[:, 3] <= budget))
        if len(rows):
            verify(rows)
    order = np.lexsort((found[:, 2], edits, pair))
    first = order[np.append(True, np.diff(pair[order]) != 0)]
    good = first[edits[first] <= budget[first]]
    return list(zip(owner[good].tolist(), found[good, 0].tolist(), edits[good].tolist(), np.maximum(0, found[good, 2]).tolist()))


def leaks(texts: list[str], items: Items) -> list[tuple[int, object, int, int]]:
    """(text, item's id, edits, place) of each item that has a window in the text, with its fewest edits."""
    best: dict[tuple[int, int], tuple[int, int]] = {}
    out = []
    if items.short:
        for d, t in enumerate(texts):
            seen: dict[str, int] = {}
            for end, word in items.automaton.iter(t):
                s, e = end + 1 - len(word), end + 1
                if word not in seen and not (s and t[s - 1].isalnum() and word[0].isalnum()) and not (e < len(t) and t[e].isalnum() and word[-1].isalnum()):
                    seen[word] = s
            out += [(d, i, 0, s) for word, s in seen.items() for i in items.short[word]]

    def search(text: np.ndarray, starts: np.ndarray, first: int, base: int) -> None:
        """A run of whole texts, or a segment of one, which begins at base."""
        found = candidates(text, items)
        if found is None:
            half = len(text) // 2
            search(text[: half + items.overhang], starts, first, base)
            cut = int(np.searchsorted(starts, half, "right")) - 1
            search(text[half:], np.concatenate(([0], starts[cut + 1 :] - half)), first + cut, base + half if not cut else half - int(starts[cut]))
        elif len(found):
            for k, i, edits, where in fewest_edits(text, starts, items, found):
                own = max(0, where - int(starts[k])) + (base if k == 0 else 0)
                best[first + k, i] = min(best.get((first + k, i), (1 << 30, 0)), (edits, own))

    if items.texts:
        gap, held, starts, first, total = np.full(items.overhang + 4 * items.reach, END, np.uint32), [], [], 0, 0
        for d, t in enumerate(texts):
            x = points(t)
            if len(x) > SEGMENT:
                for s in range(0, len(x), SEGMENT):
                    search(np.concatenate((x[s : s + SEGMENT + items.overhang], gap)), np.zeros(1, np.int64), d, s)
                x = x[:0]
            held += [x, gap]
            starts.append(total)
            total += len(x) + len(gap)
            if total >= SEGMENT or d + 1 == len(texts):
                search(np.concatenate(held), np.array(starts), first, 0)
                held, starts, first, total = [], [], d + 1, 0
    return out + [(d, items.ids[i], edits, where) for (d, i), (edits, where) in sorted(best.items())]


#: The block that this worker has built last.
BUILT: dict = {}


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 80, edits: float = 0.075, block_chars: int = 8 << 20) -> DataFrame:
    """doc_id, item_id, edits, place: one row per row of docs and benchmark item that leaks into it.

    An item leaks if a window of it (80 characters, all of a shorter item) is in the text within edits times its length of
    edits, where an edit changes a character; both in lower case, with runs of white space as one space. edits is the
    least of all its windows; place is about where, in characters. Items of fewer than eight characters, which have no
    8-gram, leak if they are in the text as they are, at bounds of words; edits is 0.

    Null or empty texts and items: no rows. Null ids pass through. Repeated rows repeat their rows, and so do repeated
    items. Empty tables: empty result. Extra columns are ignored. Texts of any length are searched whole.
    """
    spark = docs.sparkSession
    items = benchmark.select("item_id", "text").where(F.length("text") > 0)
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_chars))
    item_type = benchmark.schema["item_id"].dataType
    out = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("item_id", item_type), T.StructField("edits", T.LongType()), T.StructField("place", T.LongType())])
    arrow = to_arrow_schema(out)

    def searched(block):
        def search(parts):
            key = (block._path if hasattr(block, "_path") else None, window, edits)
            known = BUILT.get(key) if key[0] else None
            if known is None:
                known = Items(*block.value, window, edits)
                BUILT.clear()
                BUILT[key] = known
            for b in C.batched(parts, 2000, 1 << 20):
                ids, texts = b.column("doc_id").to_pylist(), [normal(x) for x in b.column("text").to_pylist()]
                if rows := [(ids[d], i, e, p) for d, i, e, p in leaks(texts, known)]:
                    yield from pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], names=arrow.names).to_batches()

        return docs.select("doc_id", "text").mapInArrow(search, out)

    found = None
    for k in range(blocks):
        # A block is bounded by block_chars.
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        part = searched(spark.sparkContext.broadcast(([r.item_id for r in own], [normal(r.text) for r in own])))
        found = part if found is None else found.unionByName(part)
    return found


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    return decontaminate(C.read_documents(spark, sf_dir), C.read_documents(spark, sf_dir, "benchmark"))
