import random

import pytest

from pyspark.sql import functions as F

from textquarry import queries
from textquarry.functions import bits
from textquarry.functions.alphabet import ascii_dna, ascii_dna_with_n
from textquarry.operators import build, rank, suffixes
from textquarry.plans.config import IndexConfig, PerformancePriority
from textquarry.sources.readers import literal_texts

REQUESTS = "request_id long, text_id long, symbol int, idx long"


@pytest.mark.parametrize(("size", "block"), [(2, 3), (27, 16), (256, 1024)])
def test_rank_against_naive(spark, size, block):
    r = random.Random(size)
    texts = [[r.randrange(size) for _ in range(n)] for n in (0, 1, 50)] + [[0] * 40]
    table = rank.rank_table(spark.createDataFrame([(i, bytearray(t)) for i, t in enumerate(texts)], "text_id long, t binary"), size, block)
    asked = [(i, c, k) for i, t in enumerate(texts) for c in {0, 1, size - 1} for k in range(len(t) + 1)]
    got = {x.request_id: x["rank"] for x in table.rank_many(spark.createDataFrame([(n, *a) for n, a in enumerate(asked)], REQUESTS)).collect()}
    assert got == {n: texts[i][:k].count(c) for n, (i, c, k) in enumerate(asked)}
    places = [(i, k) for i, t in enumerate(texts) for k in range(len(t))]
    got = {x.request_id: x.symbol for x in table.symbol_at_many(spark.createDataFrame([(n, *a) for n, a in enumerate(places)], "request_id long, text_id long, idx long")).collect()}
    assert got == {n: texts[i][k] for n, (i, k) in enumerate(places)}


@pytest.mark.parametrize("size", [2, 256])
def test_rank_everywhere(spark, size):
    """The ranks of rank_many at every place, though no request moves: one exchange, and no join."""
    r = random.Random(size)
    texts = [[r.randrange(size) for _ in range(n)] for n in (0, 1, 63, 64, 65, 1023, 1024, 1025, 2500)] + [[1] * 1200]
    df = spark.createDataFrame([(i, bytearray(t)) for i, t in enumerate(texts)] + [(99, None)], "text_id long, t binary")
    symbols = sorted({0, 1, 48 % size, 49 % size, 92 % size, size - 1})
    got = rank.rank_table(df, size, 16).rank_everywhere(symbols)
    assert got.dtypes == [("text_id", "bigint"), ("idx", "bigint"), ("symbol", "int"), ("rank", "bigint")]
    rows = [tuple(x) for x in got.collect()]
    assert sorted(rows) == [(i, k, c, t[:k].count(c)) for i, t in enumerate(texts) for k in range(len(t) + 1) for c in symbols]
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange") == 1 and "Join" not in plan
    with pytest.raises(ValueError):
        rank.rank_table(df, size).rank_everywhere([size])


@pytest.mark.parametrize("name", ["rank_part", "rank_checkpoint_dna"])
def test_rank_queries_move_texts_only(spark, name):
    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_rank_errors(spark):
    table = rank.rank_table(spark.createDataFrame([(0, bytearray(b"\0\1"))], "text_id long, t binary"), 2)
    for symbol, idx in ((2, 0), (0, 3), (0, 5000)):
        with pytest.raises(Exception, match="out of range"):
            table.rank_many(spark.createDataFrame([(0, 0, symbol, idx)], REQUESTS)).collect()
    with pytest.raises(Exception, match="out of range"):
        table.symbol_at_many(spark.createDataFrame([(0, 0, 2)], "request_id long, text_id long, idx long")).collect()
    with pytest.raises(ValueError):
        rank.rank_table(table.texts, 1)


@pytest.mark.parametrize("priority", list(PerformancePriority))
@pytest.mark.parametrize("long", [False, True])
def test_suffix_views(spark, priority, long):
    texts = [b"A", b"", b"NTNNTNNTN"]
    if long:
        # Copies and repeats, longer than the first key and than a piece.
        base = bytes(random.Random(3).choices(b"ATN", k=60))
        texts += [base, base, b"AT" * 40, base[:31] + b"A"]
    folded = build.fold_texts(literal_texts(spark, texts), ascii_dna_with_n())
    sa = suffixes.suffix_array(folded, ascii_dna_with_n(), priority, 16)
    rows = [tuple(r) for r in sa.orderBy("sa_row").collect()]
    code = {b"A": 1, b"T": 4, b"N": 5}
    order = sorted(((t[p:], i, p) for i, t in enumerate(texts) for p in range(len(t) + 1)), key=lambda x: ([code[bytes([c])] for c in x[0]], x[1]))
    assert [(r[1], r[2]) for r in rows] == [(i, p) for _, i, p in order]
    assert [r[3] for r in rows] == [code[texts[i][p - 1 : p]] if p else 0 for _, i, p in order]
    where = {(r[1], r[2]): r[0] for r in rows}
    assert {r.sa_row: r.lf for r in suffixes.lf_mapping(sa, 4).collect()} == {where[i, p]: where[i, p - 1] for i, p in where if p}
    assert {r.text_id for r in suffixes.borders(sa).collect()} == set(range(len(texts)))
    assert [r.sa_row for r in suffixes.sampled(sa, 5).orderBy("sa_row").collect()] == list(range(0, len(rows), 5))


def test_build_chain(spark):
    texts = literal_texts(spark, [b"cccaaagggttt", b"acgtacgtacgt"])
    views = suffixes.build_views(texts, ascii_dna(), IndexConfig(5, index_width=32), block=7)
    sa = {r.sa_row: r for r in views.sa.collect()}
    assert [r.sa_row for r in views.sampled.orderBy("sa_row").collect()] == [0, 5, 10, 15, 20, 25] and dict(views.sampled.dtypes)["position"] == "int"
    assert views.borders.count() == 2 and views.lf.count() == 24
    asked = spark.createDataFrame([(b * 8 + s, b, s, min(7, 26 - 7 * b)) for b in range(4) for s in range(5)], REQUESTS)
    got = {x.request_id: x["rank"] for x in views.ranks.rank_many(asked).collect()}
    assert got == {b * 8 + s: sum(r.symbol == s for k, r in sa.items() if k // 7 == b) for b in range(4) for s in range(5)}


def test_bits(spark):
    r = random.Random(2)
    rows = [(i, x, n, bytearray(r.randrange(16) for _ in range(i))) for i, (x, n) in enumerate([(1, 0), (2, 64), (3, 63), (2**63 - 1, 5), (2**62, 62), (2**62 + 1, 1), (-1, 64), (-1, 63)])]
    df = spark.createDataFrame(rows, "i int, x long, n int, s binary")
    packed = bits.pack_nibbles(F.col("s"))
    got = df.select("i", bits.popcount(F.col("x")), bits.popcount_before(F.col("x"), F.col("n")), bits.ceil_log2(F.col("x")), packed, bits.unpack_nibbles(packed, F.col("i")), bits.zero_places(F.col("s"))).collect()
    for (i, ones, before, width, p, back, zeros), (_, x, n, s) in zip(sorted(got), rows):
        u = x % 2**64
        assert (ones, before, width) == (bin(u).count("1"), bin(u % 2**n).count("1"), None if x < 1 else (x - 1).bit_length())
        assert bytes(p) == bytes(16 * a + b for a, b in zip(s[::2], [*s[1::2], 0])) and back == s and zeros == [k for k, c in enumerate(s) if not c]
    nibbles = spark.createDataFrame([(bytearray([13, 0, 6, 3, 15, 5]),)], "s binary").select(F.hex(bits.pack_nibbles(F.col("s"))), bits.nibble_at(bits.pack_nibbles(F.col("s")), F.lit(4)))
    assert tuple(nibbles.first()) == ("D063F5", 15)
    with pytest.raises(Exception, match="four bits"):
        spark.createDataFrame([(bytearray([1, 16]),)], "s binary").select(bits.pack_nibbles(F.col("s"))).collect()
    power = spark.createDataFrame([(3, 5), (7, 0), (-2, 3), (2, 62)], "b long, e int").select(bits.integer_power(F.col("b"), F.col("e")))
    assert [x[0] for x in power.collect()] == [243, 1, -8, 2**62]
