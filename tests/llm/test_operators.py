"""Each corpus operator against a brute-force version, on small and awkward tables."""

import hashlib
import itertools
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from textquarry.llm import chat_repair as chat
from textquarry.llm import common, near_dedup, perplexity
from textquarry.llm import suffix_dedup as suffix
from textquarry.llm.decontamination import Items, decontaminate, leaks, normal
from textquarry.llm.license_scan import Templates, builtin_templates, license_scan, scan
from textquarry.llm.line_dedup import has, insert, line_dedup, merged, places
from textquarry.llm.mixing import mix_sources, unit_hash
from textquarry.llm.near_dedup import components, near_duplicates, probability_jaccard, signatures, weighted
from textquarry.llm.quality_rules import quality_rules
from textquarry.llm.suffix_dedup import earliest, suffix_dedup
from textquarry.llm.toxicity import LANGUAGES, Convolution, backward, buckets_of, fit, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g int, blob string, `to` string, words string, bands int, kept boolean, key double, bin int, size long, target long, n_lines string, limit double, score string"
ALPHA = [bytes([c]).decode() for c in range(97, 123)]


def prose(r, n):
    return " ".join("".join(r.choices(ALPHA, k=r.randint(2, 8))) for _ in range(n))


def awkward():
    """Nulls everywhere, empty and long texts, copies, near copies, repeated rows and shared lines."""
    r = random.Random(5)
    base, shared = [prose(r, 80) for _ in range(6)], prose(r, 15)
    long_ = "\n".join(prose(r, 30) for _ in range(2000))
    texts = [*base, base[0], base[0], base[1].replace(base[1].split()[40], "zzz"), None, "", " \n\t\n ", long_, long_ + "\n" + shared, "a", "a a a a a a", "x\x0by\x1f é"]
    texts += [f"{prose(r, 60)}\n  {shared.upper() if i % 2 else shared}\t\n{prose(r, 3)}" for i in range(12)]
    rows = [(i, t, "en" if i % 3 else None, None if i % 4 == 0 else f"s{i % 3}") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, base[2], None, None), (None, None, None, None), (-7, base[4] + " tail", "fr", "é")]
    return [(*x, None if x[1] is None else len(x[1]), 1, "b", "t", "w", 2, True, 0.5, 3, 4, 5, "l", 1.5, "s") for x in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).cache()


@pytest.fixture(scope="module")
def rows():
    return [(x[0], x[1], x[3]) for x in awkward()]


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_suffix_dedup(docs, rows, none):
    texts = [(i, (t or "").encode()) for i, t, _ in rows]
    size, first = 50, {}
    for i, t in texts:
        for p in range(len(t) - size + 1):
            s = t[p : p + size]
            first[s] = min(first.get(s, 1 << 63), (1 << 63) - 1 if i is None else i)
    expected = []
    for i, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - size + 1):
            if first[t[p : p + size]] < ((1 << 63) - 1 if i is None else i):
                gone[p : p + size] = b"\1" * size
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        expected.append((i, len(t), sum(gone), spans, bytes(c for c, x in zip(t, gone) if not x)))
    got = [(r.doc_id, r.n_bytes, r.n_removed, [tuple(s) for s in r.spans], bytes(r.kept)) for r in suffix_dedup(docs, size).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert suffix_dedup(none, size).collect() == []
    with pytest.raises(ValueError):
        suffix_dedup(docs, 5)


def test_interval_expansion():
    r = random.Random(1)
    for _ in range(40):
        base = bytes(r.choices(b"ab\0\xff", k=120))
        pieces = list(dict.fromkeys([base[i : i + r.randint(16, 40)] for i in (r.randint(0, 80) for _ in range(12))] + [b"a" * r.randint(16, 60)]))
        owners = np.array([r.randint(0, 9) for _ in pieces])
        least: dict[bytes, int] = {}
        for p, d in zip(pieces, owners.tolist()):
            for i in range(len(p) - 15):
                least[p[i : i + 16]] = min(least.get(p[i : i + 16], 99), d)
        assert earliest(pieces, owners, 16)[0].tolist() == [least[p[i : i + 16]] for p in pieces for i in range(len(p) - 15)]


def test_suffix_dedup_parts(docs):
    for groups in (1, 16, 103, 1260, 6300):
        parts, buckets = suffix.layout(groups)
        assert parts * buckets >= 4 * groups and groups * parts <= max(64 * groups, groups * (groups + 3) / 4)
    cut = [sorted(map(str, suffix_dedup(docs, 50, groups=n).collect())) for n in (1, 40)]
    assert cut[0] == cut[1]


def test_suffix_dedup_even_parts():
    r = random.Random(3)
    chunk = next(suffix.chunks([bytes(r.choices(range(97, 123), k=400_000))], 50))
    h = np.unique(suffix.fingerprint_runs(chunk, 50)[0])
    sizes = [e - s for _, s, e in suffix.ranges(h, 300)]
    assert len(sizes) == 300 and max(sizes) < 2 * sum(sizes) / 300


def test_suffix_dedup_common_gram(monkeypatch):
    """Pieces that all have one 8-gram, which is one bucket, in transforms of bounded size."""
    r, made = random.Random(2), []
    pieces = list({bytes(r.choices(b"abcd", k=r.randint(20, 40))) + b"the same" + bytes(r.choices(b"abcd", k=r.randint(20, 40))) for _ in range(900)} | {b"a" * 60})
    pieces += [p[5:] + b"x" for p in pieces[:300]]
    owners = np.array([r.randint(0, 99) for _ in pieces])
    classes = suffix.string_classes
    monkeypatch.setattr(suffix, "string_classes", lambda s, *rest: made.append(len(s)) or classes(s, *rest))
    whole, split = earliest(pieces, owners, 30), earliest(pieces, owners, 30, 10_000)
    assert whole[0].tolist() == split[0].tolist() and whole[1].tolist() == split[1].tolist()
    assert made[0] > 60_000 and len(made) > 6 and max(made[1:]) < 20_000


@pytest.mark.parametrize(("keep", "sizes"), [("none", {}), ("first", {}), ("first", {"filter_bytes": 0}), ("first", {"broadcast_lines": 0}), ("none", {"filter_bytes": 0, "broadcast_lines": 0})])
def test_line_dedup(docs, rows, none, keep, sizes):
    """With and without filters, and by broadcast or by groups: the same result."""
    key = lambda x: x.encode().strip(b" \t\n\x0b\x0c\r").translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))
    owners: dict[bytes, set] = {}
    for i, t, _ in rows:
        for x in (t or "").split("\n"):
            owners.setdefault(key(x), set()).add((1 << 63) - 1 if i is None else i)
    often = {k: min(o) for k, o in owners.items() if len(k) and len(o) >= 10}
    assert often
    got = [(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in line_dedup(docs, 10, 1, keep, **sizes).collect()]
    expected = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in often or (keep == "first" and often[key(x)] == i)]
        expected.append((i, None if t is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert line_dedup(none, **sizes).collect() == []


def test_bloom_filters():
    """Merged from parts, the second filter has every hash that two parts or documents have, and few others."""
    r = np.random.default_rng(1)
    h = r.integers(0, 1 << 63, (20000, 2)).astype(np.uint64)
    parts = [np.concatenate((h[k * 4000 : (k + 1) * 4000], h[:500], h[k * 4000 + 1000 : k * 4000 + 1100])) for k in range(5)]
    filters = [(np.zeros(1 << 15, np.uint8), np.zeros(1 << 15, np.uint8)) for _ in parts]
    for p, f in zip(parts, filters):
        insert(*f, p[:2000])
        insert(*f, p[2000:])
    once, twice = merged([merged(filters[:2]), merged(filters[2:])])
    again = has(twice, places(h, 1 << 18))
    known, n = np.unique(np.concatenate(parts), axis=0, return_counts=True)
    must = {x.tobytes() for x in known[n > 1]}
    assert has(once, places(h, 1 << 18)).all() and all(again[k] for k in range(len(h)) if h[k].tobytes() in must)
    assert again.sum() <= len(must) + 200


def test_quality_rules(docs, rows, none):
    got = quality_rules(docs, "source", 4).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    norm = lambda x: re.sub(" +", " ", re.sub("[1-9]", "0", re.sub("[\t\x0b\x0c\r]", " ", x)).lower().strip(" "))
    often: dict = {}
    for i, t, s in rows:
        for x in (t or "").split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", x):
                often.setdefault((s, norm(x)), set()).add((i, t))
    for i, t, s in rows:
        if i is None:
            continue
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        places = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)} if len(windows) < 3000 else set()
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        removed = sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in lines if len(often[s, norm(x)]) > 4)
        r = by[i][0]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words, r.removed_words) == (len(words), sum(map(len, words)), len(lines) - len(set(lines)), len(places), removed), i
        failed = len(words) < 50 or 100 * len(places) > 50 * len(words)
        assert (r.base_failed, r.kept) == (failed, not failed and removed <= 0.5 * len(words))
    assert quality_rules(none).collect() == []


def test_quality_rules_take_lines_out(docs, rows):
    norm = lambda x: re.sub(" +", " ", re.sub("[1-9]", "0", re.sub("[\t\x0b\x0c\r]", " ", x)).lower().strip(" "))
    words = lambda x: len(re.findall(r"[^\x20\x09-\x0D]+", x))
    often: dict = {}
    for i, t, s in rows:
        for x in (t or "").split("\n"):
            often.setdefault((s, norm(x)), set()).add((i, t))
    expected = []
    for i, t, s in rows:
        left = t if t is None else "\n".join(x for x in t.split("\n") if not words(x) or len(often[s, norm(x)]) <= 1)
        expected.append((i, words(t or "") - words(left or ""), left))
    assert sum(t != left for (_, t, _), (_, _, left) in zip(rows, expected)) > 3
    got = [(r.doc_id, r.removed_words, r.text) for r in quality_rules(docs, "source", 1).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_mix_sources(docs, rows, none):
    got = mix_sources(docs, bins=8).collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total: dict = {}
    for _, t, s in rows:
        total[s] = total.get(s, 0) + size(t)
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: [5, 2, 1][k % 3] for k, s in enumerate(order)}
    target, free = {}, set(total)
    while free:
        level = (1.5 * sum(total.values()) - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * total[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 2.0 * total[s] for s in over}
        free -= over
    taken: dict = {}
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == total[r.source]
        assert r.taken == r.copies * r.size <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, x in taken.items():
        assert abs(x - target[s]) <= max(size(t) for _, t, o in rows if o == s)
    again = mix_sources(docs.repartition(7), bins=64).select("doc_id", "taken").collect()
    assert sorted(map(str, again)) == sorted(str(r) for r in mix_sources(docs, bins=8).select("doc_id", "taken").collect())
    assert mix_sources(none).collect() == []


@pytest.mark.parametrize("weight", [1.0, 0.2, 0.05])
def test_bins_of_keys(spark, weight):
    """Bins are in the order of keys and even, whatever the weight."""
    d = spark.range(200000).select((-F.log(unit_hash(F.col("id").cast("string"), "x")) / weight).alias("key")).withColumn("bin", F.floor(F.log("key") * 1024))
    bins = d.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).orderBy("bin").collect()
    assert max(b.n for b in bins) < 0.002 * 200000 and all(a.high < b.low for a, b in zip(bins, bins[1:]))


def test_toxicity(spark, docs, rows, none):
    r = random.Random(3)
    train = []
    for i in range(400):
        words = prose(r, 30).split()
        toxic = i % 4 == 0
        if toxic:
            words[r.randrange(30)] = r.choice(["scumlet", "scumlord", "vileness"])
        train.append((i, " ".join(words), toxic))
    table = spark.createDataFrame([(i, t) for i, t, _ in train], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(x)) for i, _, x in train], "doc_id long, toxic int")
    net, at = fit(table, labels)
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    got = {x.doc_id: x for x in toxicity(table, net, at).where(held).collect()}
    right = sum(got[i].predicted == int(x) for i, _, x in train if i in got)
    assert right >= 0.95 * len(got) > 0
    scored = toxicity(docs, net, at).collect()
    assert len(scored) == len(rows) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.7) for x in scored)
    assert toxicity(none, net, at).collect() == []
    empty, at = fit(table, labels.limit(0))
    assert isinstance(empty, Convolution) and len(at) == len(LANGUAGES) + 1


def test_convolution():
    """Forward by words and windows told plainly, and gradients by differences."""
    r = np.random.default_rng(5)
    net = Convolution(1)
    net.filters, net.bias = [f + r.normal(0, 0.3, f.shape).astype(np.float32) for f in net.filters], [b + 0.05 for b in net.bias]
    texts = [b"one two three two", b"", b"four", b"five one six seven eight"]
    ids, counts, _ = buckets_of(texts)
    y, weight = np.array([1, 0, 1, 0], np.float32), np.array([1.0, 2.0, 0.5, 1.0])

    def direct(net):
        out, s = [], 0
        for n in counts.tolist():
            x = [np.zeros(12)] * 2 + [net.embed[ids[s + k]].sum(0) for k in range(n)] + [np.zeros(12)] * 3
            s += n
            top = [max(0.0, max(sum(x[p + j] @ f[j, :, c] for j in range(len(f))) + b[c] for p in range(n + 2))) for f, b in zip(net.filters, net.bias) for c in range(f.shape[2])]
            out.append(float(np.dot(top, net.out)) + net.out_bias[0])
        return np.array(out)

    def loss(net):
        z = direct(net)
        return float((weight * (np.log1p(np.exp(z)) - y * z)).mean())

    assert net.logits(ids, counts) == pytest.approx(direct(net), rel=1e-4, abs=1e-5)
    rows, start = net.laid_out(ids, counts)
    grads, flat, g = backward(net, rows, start, counts, y, weight)
    checks = [(a, d) for a, d in zip([*net.filters, *net.bias, net.out, net.out_bias], grads)]
    for a, d in checks:
        for k in r.choice(a.size, min(6, a.size), replace=False):
            at, old, h = np.unravel_index(k, a.shape), a.ravel()[k], 1e-2
            a[at] = old + h
            up = loss(net)
            a[at] = old - h
            down = loss(net)
            a[at] = old
            assert d[at] == pytest.approx((up - down) / (2 * h), abs=2e-3)
    for k in r.choice(len(flat), 6, replace=False):
        old = net.embed[flat[k], 3]
        net.embed[flat[k], 3] = old + 1e-2
        up = loss(net)
        net.embed[flat[k], 3] = old - 1e-2
        down = loss(net)
        net.embed[flat[k], 3] = old
        assert g[k, 3] == pytest.approx((up - down) / 2e-2, abs=2e-3)


def legal(roles):
    return re.fullmatch("s?(ua)+|", "".join(r[0] for r in roles)) is not None


def test_chat_costs():
    table, ends = chat.moves(chat.COSTS), chat.endings(chat.COSTS)
    for n in (1, 2, 3, 4):
        for roles in itertools.product(range(4), repeat=n):
            best, todo = None, [(0.0, 0, chat.START)]
            seen = set()
            while todo:
                todo.sort()
                c, i, q = todo.pop(0)
                if i == n and q == chat.ASSISTANT:
                    best = c
                    break
                if (i, q) in seen:
                    continue
                seen.add((i, q))
                todo += [(c + chat.COSTS["insert"], i, x) for x in chat.LEGAL[q]]
                if i < n:
                    for to in (1, 2, 3):
                        label = 0 if to == roles[i] else chat.COSTS["relabel" if roles[i] else "relabel_unknown"]
                        if to in chat.LEGAL[q]:
                            todo.append((c + label, i + 1, to))
                        if to == q:
                            todo.append((c + label + chat.COSTS["merge"], i + 1, to))
            cost, _ = chat.forward(list(roles), table, [0.0, *[chat.INFINITE] * 3])
            end = chat.best_end(cost, ends)
            assert cost[end] + ends[end][0] == best, roles


def test_chats(spark):
    r = random.Random(2)
    turns = [(c, t, r.choice(["user", "assistant", "system", None, "Human ", "odd"]), r.choice(["hi <|user|>", None, "", "ho"]), "x") for c in range(8) for t in range(r.randint(1, 6))]
    # One conversation is most of the table and lies in several partitions.
    turns += [(99, t, r.choice(["user", "assistant"]), str(t), "x") for t in range(400)] + [(None, None, "user", "n", "x")] * 2
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, part string")
    out = chat.repair_chats(df).orderBy("conv_id", "seq").collect()
    table, ends = chat.moves(chat.COSTS), chat.endings(chat.COSTS)
    for c in {t[0] for t in turns}:
        own = [x for x in out if x.conv_id == c]
        assert len({x.seq for x in own}) == len(own)
        text = "".join(x.rendered for x in own)
        assert legal(re.findall(r"<\|(system|user|assistant)\|>\n", text)) and text.endswith("<|end|>\n")
        assert sum(x.action != "insert" for x in own) == sum(t[0] == c for t in turns)
        if c == 99:
            assert [x.turn for x in own if x.turn is not None] == list(range(400))
            cost, _ = chat.forward([chat.role_of(t[2]) for t in turns if t[0] == 99], table, [0.0, *[chat.INFINITE] * 3])
            end = chat.best_end(cost, ends)
            price = {"keep": 0, "relabel": 2, "relabel+merge": 3, "merge": 1, "insert": 3}
            assert sum(price[x.action] for x in own) == cost[end] + ends[end][0]
    assert chat.repair_chats(df.limit(0)).collect() == []


def kneser_ney(texts):
    """An independent model: the probability of a symbol after its context, from the formulas, in dictionaries."""
    pad = [[0, 0, 0, 0, *(10 if c in (10, 13) else 255 if not c else 32 if c < 32 or c == 127 else 48 if 48 <= c < 58 else c for c in t)] for t in texts]
    counts = [{} for _ in range(6)]
    for s in pad:
        for i in range(4, len(s)):
            g = tuple(s[i - 4 : i + 1])
            counts[5][g] = counts[5].get(g, 0) + 1
    for n in range(4, 0, -1):
        for g in counts[n + 1]:
            counts[n][g[1:]] = counts[n].get(g[1:], 0) + 1
    d, by = [None] * 6, [{} for _ in range(6)]
    for n in range(1, 6):
        c = [sum(v == k for v in counts[n].values()) for k in range(5)]
        if min(c[1:]) == 0:
            d[n] = [0, 0.5, 1.0, 1.5]
        else:
            y = c[1] / (c[1] + 2 * c[2])
            d[n] = [0, *(min(max(k - (k + 1) * y * c[k + 1] / c[k], 0.05), k) for k in (1, 2, 3))]
        for g, v in counts[n].items():
            by[n].setdefault(g[:-1], []).append(v)

    def p(context, symbol, n=5):
        if not n:
            return 1 / 256
        context = context[len(context) - n + 1 :] if n > 1 else ()
        lower = p(context, symbol, n - 1)
        if context not in by[n]:
            return lower
        seen = by[n][context]
        v = counts[n].get((*context, symbol), 0)
        return (v - d[n][min(v, 3)]) / sum(seen) + sum(d[n][min(x, 3)] for x in seen) / sum(seen) * lower

    def perplexity_of(text):
        s = [0, 0, 0, 0, *(10 if c in (10, 13) else 255 if not c else 32 if c < 32 or c == 127 else 48 if 48 <= c < 58 else c for c in text)]
        return float(np.exp(-np.mean([np.log(p(tuple(s[i - 4 : i]), s[i])) for i in range(4, len(s))])))

    return p, perplexity_of


def test_kneser_ney():
    """Probabilities sum to one over the alphabet, and are those of the formula."""
    table = perplexity.byte_classes()
    text = [b"the cat sat on the mat and the rat sat on the cat " * 3, "été là\0\t 12".encode()]
    keys, n = perplexity.counted([g for g, _ in perplexity.grams(text, table)])
    k4, n4 = perplexity.orders_5_4(keys, n)
    k3, n3 = perplexity.summed(k4 & np.uint64(0xFFFFFF), np.ones(len(k4), np.int64))
    lower = perplexity.Lower(k3, n3)
    five = perplexity.Level(keys, n, perplexity.discounts(perplexity.count_of_counts(n)))
    four = perplexity.Level(k4, n4, perplexity.discounts(perplexity.count_of_counts(n4)))
    direct, _ = kneser_ney(text)
    for context in (int(keys[3] >> 8), int(keys[40] >> 8), 0x01020304):
        every = (np.uint64(context << 8)) | np.arange(256, dtype=np.uint64)
        p = five.over(every, four.over(every & np.uint64(0xFFFFFFFF), lower(every & np.uint64(0xFFFFFF))))
        assert p.min() > 0 and p.sum() == pytest.approx(1)
        assert p == pytest.approx([direct(tuple(context.to_bytes(4, "big")), s) for s in range(256)])


def test_quality_classifier(spark, docs, rows, none, monkeypatch):
    r = random.Random(9)
    good = [(i, " ".join(r.choices(["river", "stone", "under", "green", "walks", "slowly"], k=60)), "en") for i in range(60)]
    bad = [(100 + i, "".join(r.choices("#%&XQ!?zj", k=300)), "en") for i in range(10)]
    table = spark.createDataFrame(good + bad, "doc_id long, text string, lang string")
    trusted = spark.createDataFrame([(i,) for i in range(40)], "doc_id long")
    got = {x.doc_id: x for x in perplexity.classify_quality(table, trusted).collect()}
    assert all(got[i].kept for i, _, _ in good) and not any(got[i].kept for i, _, _ in bad)
    # The whole plan against the formula, in one group and in many.
    _, direct = kneser_ney([t.encode() for i, t, _ in good if i < 40 and zlib.crc32(str(i).encode()) % perplexity.HELD_OUT])
    monkeypatch.setattr(common, "GROUP_ROWS", 7)
    many = {x.doc_id: x for x in perplexity.classify_quality(table, trusted).collect()}
    for i, t, _ in good[:3] + bad[:3]:
        assert got[i].perplexity == pytest.approx(direct(t.encode()), rel=1e-4) and many[i].perplexity == pytest.approx(got[i].perplexity)
    odd = perplexity.classify_quality(docs, trusted).collect()
    assert len(odd) == len(rows) and all(x.kept for x in odd if not x.n_scored)
    assert perplexity.classify_quality(none, trusted).collect() == []
    assert all(x.kept for x in perplexity.classify_quality(docs, trusted.limit(0)).collect())


def test_quality_of_other_scripts(spark):
    """Russian and Greek sentences against the same letters in another order."""
    r = random.Random(4)
    words = {"ru": "река камень зелёный медленно идёт через старый город вечером тихо дождь".split(), "el": "ποταμός πέτρα πράσινο αργά περπατά παλιά πόλη βράδυ ήσυχα βροχή".split()}
    good, bad = [], []
    for k, (lang, own) in enumerate(words.items()):
        good += [(1000 * k + i, " ".join(r.choices(own, k=50)), lang) for i in range(220)]
        for i in range(10):
            w = r.choices(own, k=50)
            bad.append((1000 * k + 500 + i, " ".join("".join(r.sample(x, len(x))) for x in w), lang))
    table = spark.createDataFrame(good + bad, "doc_id long, text string, lang string")
    got = {x.doc_id: x.kept for x in perplexity.classify_quality(table, spark.createDataFrame([(i,) for i, _, _ in good], "doc_id long")).collect()}
    assert not any(got[i] for i, _, _ in bad) and sum(got[i] for i, _, _ in good) >= 0.97 * len(good)


def test_quality_limit(spark):
    """The limit is the quantile of enough held-out documents and nothing above it; toxic documents of quality are trusted."""
    r = random.Random(11)
    good = [(i, " ".join(r.choices(["river", "stone", "under", "green", "walks", "slowly"], k=60)), "en") for i in range(250)]
    labels = spark.createDataFrame([(i, int(i < 220), i % 2) for i in range(250)], "doc_id long, quality int, toxic int")
    trusted = perplexity.trusted_documents(labels)
    assert sorted(x.doc_id for x in trusted.collect()) == list(range(220))
    got = perplexity.classify_quality(spark.createDataFrame(good, "doc_id long, text string, lang string"), trusted).collect()
    held = [x.bound for x in got if x.held_out]
    assert 30 <= len(held) <= 100 and {x.limit for x in got} == {max(held)}
    assert all(x.kept == (x.bound <= max(held)) for x in got)


def brute_classes(rows, similarity=0.8):
    """doc_id's class and links by looking at every pair of texts; rows of one text are one."""
    by: dict = {}
    for i, t in rows:
        w = tuple((t or "").lower().encode().split())
        by.setdefault(w, []).append(i)
    texts = list(by)
    sets = []
    for w in texts:
        n: dict = {}
        for x in [w[k : k + 5] for k in range(len(w) - 4)] or [w]:
            n[x] = n.get(x, 0) + 1
        sets.append(n)
    label = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        x, y = sets[a], sets[b]
        both, every = x.keys() & y.keys(), x.keys() | y.keys()
        if max(x.values()) == max(y.values()) == 1:
            alike = len(both) / len(every)
        else:
            alike = sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in every) for i in both)
        if alike >= similarity:
            old, new = label[b], label[a]
            label = [new if x == old else x for x in label]
    least: dict = {}
    for w, c in zip(texts, label):
        least[c] = min([i for i in (*by[w], least.get(c)) if i is not None], default=None)
    return sorted(((i, least[label[k]]) for k, w in enumerate(texts) for i in by[w]), key=repr)


def test_near_duplicates(docs, rows, none):
    got = near_duplicates(docs).collect()
    assert sorted(((x.doc_id, x.class_id) for x in got), key=repr) == brute_classes([(i, t) for i, t, _ in rows])
    assert near_duplicates(none).collect() == []


def test_near_copies_are_recalled(spark):
    """Links of texts of similarity 0.8 and more, which brute force finds: nine in ten at least, here all but few."""
    r = random.Random(12)
    table = []
    for k in range(60):
        w = prose(r, r.randint(6, 150)).split()
        table.append((k, " ".join(w)))
        for c in range(1, 4):
            x = w[:]
            for _ in range(r.randint(1, max(1, len(w) // 45))):
                x[r.randrange(len(x))] = "zz"
            table.append((k + 100 * c, " ".join(x)))
    # Ids that two texts share, and near copies without one.
    table += [(0, table[8][1] + " z"), (None, table[12][1] + " y"), (None, table[16][1])]
    expected = brute_classes(table)
    got = sorted(((x.doc_id, x.class_id) for x in near_duplicates(spark.createDataFrame(table, "doc_id long, text string")).collect()), key=repr)
    linked = sum(i != c for i, c in expected)
    assert linked > 60 and sum(a == b for a, b in zip(got, expected)) >= len(expected) - 0.05 * linked


def test_near_duplicates_of_one_bucket(spark, monkeypatch):
    """Texts that all share bands, of which some are linked and most aren't: leaders by rounds find what all pairs find."""
    r = random.Random(7)
    base = prose(r, 60).split()
    table = []
    for i in range(150):
        # Similarities of about 0.6 to the others of the bucket, and a close copy of some.
        w = base[:52] + prose(r, 8).split()
        r.shuffle(tail := w[46:])
        table.append((i, " ".join(w[:46] + tail)))
        if i % 10 == 0:
            table.append((1000 + i, table[-1][1] + " z"))
    df = spark.createDataFrame(table, "doc_id long, text string")
    monkeypatch.setattr(near_dedup, "HOT_PAIRS", 20)
    expected = brute_classes(table)
    got = near_duplicates(df, bands=40, rows=1, rounds=1, pairwise=8)
    assert sorted((x.doc_id, x.class_id) for x in got.collect()) == sorted(expected)


def test_many_short_texts(spark):
    """More texts than a batch may have, in one partition."""
    df = spark.range(0, 70000, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.floor(F.col("id") / 2)).alias("text"))
    got = near_duplicates(df)
    assert got.where("class_id != doc_id - doc_id % 2").count() == 0 and got.count() == 70000


@pytest.mark.parametrize("most", [0, 1000])
def test_components(spark, monkeypatch, most):
    monkeypatch.setattr(near_dedup, "LINKS_A_TASK", most)
    r = random.Random(1)
    edges = [(a, b) for a, b in ((r.randrange(60), r.randrange(60)) for _ in range(40)) if a != b]
    halves, label = [edges[:20], edges[20:] + [(100 + i, 101 + i) for i in range(12)]], None
    for half in halves:
        label = components(spark.createDataFrame(half, "a long, b long"), label)
    expected = {x: x for e in halves[0] + halves[1] for x in e}
    for _ in expected:
        for a, b in halves[0] + halves[1]:
            expected[a] = expected[b] = min(expected[a], expected[b])
    assert {x.node: x.component for x in label.collect()} == expected


def test_probability_jaccard():
    r = np.random.default_rng(0)
    for _ in range(30):
        a, b = np.unique(r.integers(0, 30, 20)).astype(np.uint64), np.unique(r.integers(0, 30, 20)).astype(np.uint64)
        x, y = r.integers(1, 5, len(a)), r.integers(1, 5, len(b))
        u, v = dict(zip(a.tolist(), x.tolist())), dict(zip(b.tolist(), y.tolist()))
        direct = sum(1 / sum(max(u.get(j, 0) / u[i], v.get(j, 0) / v[i]) for j in u.keys() | v.keys()) for i in u.keys() & v.keys())
        assert probability_jaccard(a, x, b, y) == pytest.approx(direct)


def test_signatures_estimate():
    r = random.Random(4)
    words = prose(r, 300).split()
    other = words[:260] + prose(r, 40).split()
    texts = [" ".join(words).encode(), " ".join(other).encode()]
    owner, h, n = weighted(texts)
    s = signatures(owner, h, n, 2, 2000)
    exact = probability_jaccard(h[owner == 0], n[owner == 0], h[owner == 1], n[owner == 1])
    assert abs((s[0] == s[1]).mean() - exact) < 0.05


def sellers(piece, text):
    """The fewest edits of piece to any substring of text."""
    x, steps = np.array([ord(c) for c in text]), np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for i, c in enumerate(piece, 1):
        new = np.append(i, np.minimum(row[:-1] + (x != ord(c)), row[1:] + 1))
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.min())


def test_decontaminate(spark, docs, rows, none):
    r = random.Random(8)
    items = [(k, prose(r, 40)) for k in range(20)] + [(50, "short"), (51, None), (52, ""), (53, "twelve bytes"), (54, "ähnlich über grösste " * 6)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    planted = []
    for k in range(20):
        t = bytearray(items[k][1].encode())
        start = r.randint(0, len(t) - 80)
        piece = t[start : start + 80]
        for _ in range(6):
            p = r.randrange(len(piece))
            piece[p : p + r.choice([0, 1])] = bytes(r.choices(b"abcdef", k=r.choice([0, 1])))
        planted.append((1000 + k, f"{prose(r, 30)} {piece.decode().upper()}\n {prose(r, 30)}"))
    clean = [(2000 + k, prose(r, 100)) for k in range(30)] + [(2100, "shorten"), (2101, prose(r, 4000))]
    extra = [(None, items[0][1]), (3000, None), (3001, ""), (3002, "twelve   BYTES"), (3003, "a Short one"), (3004, "x " + items[-1][1].upper().replace("Ü", "u")), (3005, f"{prose(r, 30000)} {items[3][1][5:90]} {prose(r, 9)}")]
    table = spark.createDataFrame(planted + clean + extra, "doc_id long, text string")
    for block in (8 << 20, 900):
        got = {(x.doc_id, x.item_id) for x in decontaminate(table, benchmark, block_chars=block).collect()}
        assert got == {(1000 + k, k) for k in range(20)} | {(None, 0), (3002, 53), (3003, 50), (3004, 54), (3005, 3)}
    assert decontaminate(none, benchmark).collect() == []
    assert decontaminate(docs, benchmark.limit(0)).collect() == []
    own = spark.createDataFrame([(7, rows[2][1])], "item_id long, text string")
    assert {x.doc_id for x in decontaminate(docs, own).collect()} == {2, None}


@pytest.mark.parametrize("seed", range(3))
def test_fewest_edits(seed):
    """Of random texts with damaged passages, repeated characters among them: every leak, with its least edits."""
    r = random.Random(seed)
    items = [prose(r, 12) for _ in range(4)] + ["-" * 60, "ab" * 40, "| a | b | " + "---|" * 14, prose(r, 6) + "=" * 30 + prose(r, 6)]
    texts = []
    for _ in range(12):
        t = list(prose(r, r.randint(0, 6)))
        i = r.choice(items)
        s = r.randint(0, max(0, len(i) - 40))
        piece = list(i[s : s + r.randint(20, 60)])
        for _ in range(r.randint(0, 5)):
            p = r.randrange(len(piece))
            piece[p : p + r.randint(0, 1)] = r.choices("ab-= ", k=r.randint(0, 1))
        at = r.randint(0, len(t))
        texts.append(normal("".join(t[:at] + piece + t[at:])))
    known = Items(list(range(len(items))), [normal(i) for i in items], 40, 0.075)
    got = {(d, i): e for d, i, e, _ in leaks(texts, known)}
    expected = {}
    for d, t in enumerate(texts):
        for i, x in enumerate(map(normal, items)):
            w, budget = int(known.window[i]), int(known.budget[i])
            least = min(sellers(p, t) for p in {x[s : s + w] for s in range(len(x) - w + 1)})
            if least <= budget:
                expected[d, i] = least
    assert expected and got == expected


def test_rules_of_dashes():
    """Long runs of one character in the text and in items: bounded work."""
    known = Items(list(range(10)), ["-" * 200] * 8 + ["=" * 100, "ab" * 80], 80, 0.075)
    began = time.process_time()
    got = leaks(["-" * 300000 + "ab" * 100], known)
    assert {(i, e) for _, i, e, _ in got} == {*((i, 0) for i in range(8)), (9, 0)}
    assert time.process_time() - began < 30


def test_license_scan(spark, docs, rows, none):
    r = random.Random(6)
    known = builtin_templates()
    assert len(known) >= 50
    table = [(k, f"{prose(r, r.randint(0, 200))}\n{t.upper()}\n{prose(r, 50)}") for k, t in enumerate(known.values())]
    table += [(1000, prose(r, 300)), (1001, None), (1002, ""), (None, known["mit-notice"]), (1003, prose(r, 40000) + " " + known["isc-text"]), (1003, known["isc-text"])]
    got = license_scan(spark.createDataFrame([(*x, "x") for x in table], "doc_id long, text string, license string")).collect()
    found = {(x.doc_id, x.license) for x in got}
    assert {(k, n) for k, n in enumerate(known)} <= found and (None, "mit-notice") in found
    assert not {d for d, _ in found} & {1000, 1001, 1002} and sum((x.doc_id, x.license) == (1003, "isc-text") for x in got) == 2
    assert license_scan(none).collect() == [] and license_scan(docs).collect() == []
    # Every document and template by its shingles at every window, against the scan.
    words_of = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    sets = {n: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for n, w in ((n, words_of(t)) for n, t in known.items())}
    text = f"{prose(r, 30)} {known['bsd-2-clause-text']} {prose(r, 30)} {' '.join(known['zlib-text'].split()[:110])} {known['gpl-2.0-header'].replace('hope', 'belief')}"
    w = words_of(text)
    every = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    share = {n: len(s & every) / len(s) for n, s in sets.items()}
    versions = lambda n: [m for m in sets if m != n and len(sets[n] & sets[m]) >= 0.6 * max(len(sets[n]), len(sets[m]))]
    expected = {n for n in sets if share[n] >= 0.8 and not any(share[m] > share[n] for m in versions(n))}
    assert {x.license for x in license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()} == expected
    assert {"bsd-2-clause-text", "zlib-text", "gpl-2.0-header"} <= expected and not expected & {"bsd-4-clause-text", "isc-text", "gpl-3.0-or-later-header"}
    t = Templates(known, 0.8, 0.9999)
    # Parts of a template around the limit.
    words = known["unlicense-text"].lower().split()
    assert scan([" ".join(words[: int(len(words) * 0.9)]).encode()], t) and not scan([" ".join(words[: len(words) // 2]).encode()], t)


def test_drop_rows(spark, docs, rows):
    gone = spark.createDataFrame([(3,), (None,), (12345,)], "doc_id long")
    left = common.drop_rows(docs, gone).collect()
    assert len(left) == sum(i != 3 for i, _, _ in rows) and left[0].asDict().keys() == set(docs.columns)
    assert len(common.drop_rows(docs, gone, once=True).collect()) == len({i for i, _, _ in rows if i not in (3, None)}) + 2
