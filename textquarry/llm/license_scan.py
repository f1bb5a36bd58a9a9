"""License scan: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies.

Templates fall into classes by their number L of word shingles, up to powers of two. For a class a text is cut into
blocks of L shingles, and each two adjacent blocks are a window, so that every run of L shingles lies in a window.
A window's MinHash signature is the minimum of its blocks' signatures. Bands have one row and an index from their value
to templates; their number is such that a
window with a run that holds the least part of a template that counts as a match collides with it in some band with
probability `certainty` at least. Windows that collide are compared with the template by their shingles themselves.
"""

from __future__ import annotations

import math
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import common as C
from .words import Words, batches, shingles

SHINGLE = 5
#: Share of the larger one's shingles from which on two templates are versions of one another.
VERSIONS = 0.6
TEMPLATE_CHARS = 16 << 20


def builtin_templates() -> dict[str, str]:
    """License notices and texts by name, from license_templates.txt."""
    text = resources.files(__package__).joinpath("license_templates.txt").read_text(encoding="utf-8")
    parts = (x.partition("\n") for x in text.split("\n=== ")[1:])
    return {name.strip(): body.strip() for name, _, body in parts}


class Templates:
    """Shingles of the templates, by class; arrays only."""

    def __init__(self, templates: dict[str, str], containment: float, certainty: float):
        self.names = sorted(templates)
        self.containment = containment
        self.sets = [np.unique(shingles(Words([templates[n].lower().encode()]), SHINGLE)[0]) for n in self.names]
        self.runs = [len(shingles(Words([templates[n].lower().encode()]), SHINGLE)[0]) for n in self.names]
        if short := [n for n, r in zip(self.names, self.runs) if r == 0]:
            raise ValueError(f"templates of fewer than {SHINGLE} words: {short}")
        self.classes: dict[int, list[int]] = {}
        for i, r in enumerate(self.runs):
            self.classes.setdefault(1 << max(0, (r - 1).bit_length()), []).append(i)
        self.bands = {size: max(self.bands_for(i, size, certainty) for i in own) for size, own in self.classes.items()}
        # Versions of one another: of similar size, most of their shingles in common.
        self.versions = {i: {j for j, b in enumerate(self.sets) if i != j and np.isin(a, b).sum() >= VERSIONS * max(len(a), len(b))} for i, a in enumerate(self.sets)}
        # The index: for each class and band the templates in order of their least hash.
        self.index: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for size, own in self.classes.items():
            for row in range(self.bands[size]):
                low = np.array([row_hash(self.sets[i], row).min() for i in own], np.uint64)
                order = np.argsort(low, kind="stable")
                self.index[size, row] = low[order], np.array(own)[order]

    def bands_for(self, i: int, size: int, certainty: float) -> int:
        """Bands of one row that find the template in a window of 2 * size shingles."""
        n = len(self.sets[i])
        shared = math.ceil(self.containment * n)
        jaccard = min(1 - 1e-9, shared / (2 * size + n - shared))
        return max(1, math.ceil(math.log(1 - certainty) / math.log(1 - jaccard)))


def row_hash(h: np.ndarray, row: int) -> np.ndarray:
    x = (h ^ np.uint64((0x9E3779B97F4A7C15 * (2 * row + 1)) & (2**64 - 1))) * np.uint64((0xBF58476D1CE4E5B9 + (row << 17) * 2) & (2**64 - 1) | 1)
    return x ^ (x >> np.uint64(32))


def scan(texts: list[bytes], t: Templates) -> list[tuple[int, int, float, int]]:
    """(text, template, containment, first word) of the windows that match, the best of each text and template."""
    words = Words(texts)
    h, owner = shingles(words, SHINGLE)
    best: dict[tuple[int, int], tuple[float, int]] = {}
    if not len(h):
        return []
    begin = np.flatnonzero(np.diff(owner, prepend=-1))
    count = np.diff(np.append(begin, len(h)))
    place = np.arange(len(h)) - np.repeat(begin, count)
    for size in t.classes:
        block = np.flatnonzero(place % size == 0)
        block_owner = owner[block]
        last = np.append(block_owner[1:] != block_owner[:-1], True)
        ends = np.append(block[1:], len(h))
        hits: set[tuple[int, int]] = set()
        for row in range(t.bands[size]):
            low = np.minimum.reduceat(row_hash(h, row), block)
            low = np.where(last, low, np.minimum(low, np.append(low[1:], low[-1:])))
            known, templates = t.index[size, row]
            first, last_ = np.searchsorted(known, low), np.searchsorted(known, low, "right")
            for b in np.flatnonzero(first < last_).tolist():
                hits.update((i, b) for i in templates[first[b] : last_[b]].tolist())
        for i, b in hits:
            s, e = block[b], ends[b] if last[b] else ends[b + 1]
            share = float(np.isin(t.sets[i], h[s:e]).mean())
            if share >= t.containment:
                key = (int(block_owner[b]), i)
                best[key] = max(best.get(key, (0.0, 0)), (share, -int(place[s])))
    # At one place, of versions of one another those that match best.
    span = {i: 2 * max(len(t.sets[i]), 1) for i in range(len(t.names))}
    beaten = {(d, i) for (d, i), (share, first) in best.items() for j in t.versions[i] if (d, j) in best and best[d, j][0] > share and abs(best[d, j][1] - first) <= span[i]}
    return [(d, i, share, -first) for (d, i), (share, first) in sorted(best.items()) if (d, i) not in beaten]


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = 0.8, certainty: float = 0.9999) -> DataFrame:
    """doc_id, license, containment, first_word: one row per row of docs and template found in it.

    Words are runs of letters and digits, lower-cased; shingles have five words. first_word is where the best window
    starts. Containment is the share of the template's shingles that the window has. Of templates that are versions of
    one another, like headers that differ in a number, a place has the ones that match best.

    Templates ride with the tasks, so their text is limited: to 16 MB, beyond which it is an error.

    Null, empty and wordless texts: no rows. Null doc_id passes through. Repeated rows repeat their matches. Empty table:
    empty result. Extra columns are ignored. Texts of any length are scanned whole.
    """
    if templates and sum(map(len, templates.values())) > TEMPLATE_CHARS:
        raise ValueError("templates are too large to send with each task")
    known = Templates(templates or builtin_templates(), containment, certainty)
    id_type = docs.schema["doc_id"].dataType
    out = T.StructType([T.StructField("doc_id", id_type), T.StructField("license", T.StringType()), T.StructField("containment", T.DoubleType()), T.StructField("first_word", T.LongType())])
    arrow = to_arrow_schema(out)

    def find(parts):
        for batch in parts:
            for b in C.batched([batch], 2000):
                ids, texts = b.column("doc_id").to_pylist(), [x.decode("utf-8", "replace").lower().encode() for x in C.texts_of(b)]
                for x, y in batches(texts):
                    if rows := [(ids[x + d], known.names[i], share, first) for d, i, share, first in scan(texts[x:y], known)]:
                        yield from pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], names=arrow.names).to_batches()

    return docs.select("doc_id", "text").mapInArrow(find, out)


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(C.read_documents(spark, sf_dir), containment=0.8)
