import random
import re

import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from textquarry.functions.alphabet import ascii_dna, ascii_dna_with_n, u8_until
from textquarry.operators import build
from textquarry.operators.cursor import extend_hits
from textquarry.operators.index import build_index, require_texts
from textquarry.operators.scan import naive_hits, scan_count, scan_locate
from textquarry.plans.config import IndexConfig, PerformancePriority
from textquarry.sources.readers import fasta_texts, literal_texts
from textquarry.sources.store import load_index, save_index
from textquarry.streaming.locate import locate_stream


def hits(index, patterns):
    found = {i: set() for i in range(len(patterns))}
    for r in index.locate_many(index.queries(patterns)).collect():
        assert (r.text_id, r.position) not in found[r.query_id]
        found[r.query_id].add((r.text_id, r.position))
    return found


GOLDEN = [
    ([b"cccaaagggttt"], ascii_dna(), 2, {b"gg": {(0, 6), (0, 7)}, b"c": {(0, 0), (0, 1), (0, 2)}, b"ta": set()}),
    ([b"cccaaagggttt", b"acgtacgtacgt"], ascii_dna(), 4, {b"gg": {(0, 6), (0, 7)}, b"gt": {(0, 8), (1, 2), (1, 6), (1, 10)}}),
    ([bytes([0, 4, 3, 2, 1, 5, 8, 6, 7, 8]), bytes([5, 7, 3, 4, 2, 1, 5, 8]), b""], u8_until(8), 2, {bytes([1, 5, 8]): {(0, 4), (1, 5)}}),
    ([b"aACGT", b"acGtn"], ascii_dna_with_n(), 3, {b"AC": {(0, 1), (1, 0)}, b"GTN": {(1, 2)}, b"": {(i, p) for i in (0, 1) for p in range(6)}}),
    ([b""], ascii_dna(), 3, {b"": {(0, 0)}, b"A": set(), b"ACGTA": set()}),
]


@pytest.mark.parametrize("case", range(len(GOLDEN)))
def test_golden(spark, case):
    texts, alphabet, k, expected = GOLDEN[case]
    index = build_index(literal_texts(spark, texts), alphabet, IndexConfig(lookup_table_depth=k))
    assert hits(index, list(expected)) == dict(enumerate(expected.values()))
    counts = {r.query_id: r.n for r in index.count_many(index.queries(list(expected))).collect()}
    assert counts == {i: len(x) for i, x in enumerate(expected.values())}


@pytest.mark.parametrize("seed", range(4))
def test_random_against_naive(spark, seed):
    r = random.Random(seed)
    texts = [bytes(r.choices(b"ACGT", k=r.choice([0, 3, 60, 700]))) for _ in range(r.randint(1, 4))]
    patterns = [bytes(r.choices(b"ACGT", k=r.randint(0, 9))) for _ in range(12)]
    for t in texts:
        s = r.randint(0, len(t))
        patterns.append(t[s : s + r.randint(0, 40)])
    index = build_index(literal_texts(spark, texts), ascii_dna(), IndexConfig(lookup_table_depth=r.randint(1, 5), chunk=r.choice([7, 64, 65536])))
    expected = {i: naive_hits(dict(enumerate(texts)), p) for i, p in enumerate(patterns)}
    assert hits(index, patterns) == expected
    assert {x.query_id: x.n for x in index.count_many(index.queries(patterns)).collect()} == {i: len(x) for i, x in expected.items()}
    asked = dict(enumerate(patterns))
    assert {x.query_id: x.n for x in scan_count(index.texts, asked).collect()} == {i: len(x) for i, x in expected.items()}
    seen = {(x.query_id, x.text_id, x.position) for x in scan_locate(index.texts, asked, 50).collect()}
    assert seen == {(i, *h) for i, x in expected.items() for h in x}


def test_cursor(spark):
    index = build_index(literal_texts(spark, [b"AaACGT", b"AacGtn", b"GTGTGT"]), ascii_dna_with_n())
    c = index.cursor_for_query(b"GT")
    assert c.count() == 5
    longer = c.extend_query_front(ord("c"))
    assert (longer.count(), c.count()) == (2, 5)
    assert {tuple(h) for h in longer.locate().collect()} == {(0, 3), (1, 2)}
    assert index.cursor_empty().count() == index.total_text_len() == 21
    none = longer.extend_query_front(ord("n")).extend_query_front(ord("n"))
    assert none.count() == 0
    with pytest.raises(ValueError):
        none.extend_query_front(ord("x"))
    moved = extend_hits(index.locate_many(index.queries([b"GT"])), index.texts, ord("C"))
    assert {(h.text_id, h.position) for h in moved.collect()} == {(0, 3), (1, 2)}


def test_errors(spark):
    with pytest.raises(ValueError):
        require_texts(build_index(literal_texts(spark, []), ascii_dna()))
    with pytest.raises(ValueError):
        IndexConfig(suffix_array_sampling_rate=0)
    with pytest.raises(Exception, match="not in the alphabet"):
        build_index(literal_texts(spark, [b"ACX"]), ascii_dna()).count(b"A")
    index = build_index(literal_texts(spark, [b"ACN"]), ascii_dna_with_n())
    with pytest.raises(Exception, match="not in the alphabet"):
        index.count(b"AX")
    assert index.count(b"N") == 1
    with pytest.raises(Exception, match="not in the alphabet"):
        index.count_many(index.queries([b"N"]), strict=True).collect()


def test_statistics(spark):
    index = build_index(literal_texts(spark, [b"cccaaagggttt", b"acgtacgtacgt"]), ascii_dna())
    assert (index.num_texts(), index.total_text_len()) == (2, 26)
    histogram = build.symbol_histogram(index.texts, ascii_dna())
    assert {r.symbol: r.n for r in histogram.collect()} == {0: 2, 1: 6, 2: 6, 3: 6, 4: 6}
    assert {r.symbol: r.smaller for r in build.c_array(histogram).collect()} == {0: 0, 1: 2, 2: 8, 3: 14, 4: 20}
    offsets = index.text_offsets()
    assert sorted(map(tuple, offsets.collect())) == [(0, 0, 12), (1, 13, 25)]
    asked = spark.createDataFrame([(i, i) for i in (0, 12, 13, 25)], "request_id long, idx long")
    assert sorted(map(tuple, build.resolve_positions(asked, offsets, 4).collect())) == [(0, 0, 0), (12, 0, 12), (13, 1, 0), (25, 1, 12)]
    nested = {r.query_id: [tuple(h) for h in r.hits] for r in index.locate_nested(index.queries([b"gt", b"ttttt"])).collect()}
    assert nested == {0: [(0, 8), (1, 2), (1, 6), (1, 10)], 1: []}
    assert {r.query_id: r.n_texts for r in index.document_frequency(index.queries([b"gt", b"ggg", b"tttt"])).collect()} == {0: 2, 1: 1, 2: 0}


def test_store(spark, tmp_path):
    index = build_index(literal_texts(spark, [b"aACGT", b"acGtn", b""]), ascii_dna_with_n(), IndexConfig(3, 2))
    saved = save_index(index, str(tmp_path / "index"))
    patterns = [b"AC", b"GTN", b"", b"T"]
    assert hits(saved, patterns) == hits(index, patterns)
    assert (saved.alphabet, saved.k, saved.num_texts()) == (index.alphabet, index.k, 3)
    assert {x.query_id: x.n for x in saved.count_many(saved.queries(patterns)).collect()} == {i: len(x) for i, x in hits(index, patterns).items()}
    spark.createDataFrame([('{"format_version": 99}',)], "value string").write.mode("overwrite").text(str(tmp_path / "index/manifest"))
    with pytest.raises(ValueError, match="format"):
        load_index(spark, str(tmp_path / "index"))


@pytest.mark.parametrize("seed", range(3))
def test_saved_against_naive(spark, tmp_path, seed):
    r = random.Random(seed)
    texts = [bytes(r.choices(b"ACGT", k=r.choice([0, 3, 60, 700]))) for _ in range(4)] + [b"A" * 300]
    patterns = [bytes(r.choices(b"ACGT", k=r.randint(0, 9))) for _ in range(10)] + [b"A" * n for n in (1, 4, 9, 40)]
    patterns += [t[s : s + r.randint(5, 60)] for t in texts for s in [r.randint(0, len(t))]]
    config = IndexConfig(lookup_table_depth=r.randint(2, 5), priority=r.choice(list(PerformancePriority)), index_width=r.choice([32, 64]))
    saved = save_index(build_index(literal_texts(spark, texts), ascii_dna(), config), str(tmp_path / "index"))
    assert saved.config == config
    expected = {i: naive_hits(dict(enumerate(texts)), p) for i, p in enumerate(patterns)}
    assert hits(saved, patterns) == expected
    assert {x.query_id: x.n for x in saved.count_many(saved.queries(patterns)).collect()} == {i: len(x) for i, x in expected.items()}


def test_plans_of_a_saved_index(spark, tmp_path, capsys, monkeypatch):
    """Postings are read by slice and gram, seeds are broadcast, and no text is read; many seeds still give the same hits."""
    r = random.Random(5)
    texts = [bytes(r.choices(b"ACGT", k=2000)) for _ in range(5)]
    saved = save_index(build_index(literal_texts(spark, texts), ascii_dna(), IndexConfig(lookup_table_depth=6)), str(tmp_path / "index"))
    patterns = [texts[0][7:13], texts[1][100:150], texts[2][5:22]]
    found = saved.locate_many(saved.queries(patterns))
    found.explain("formatted")
    plan = capsys.readouterr().out
    scans = [x for x in plan.split("\n\n") if "Scan parquet" in x and "Batched" in x]
    assert scans and all("postings" in x for x in scans)
    for x in scans:
        assert re.search(r"PartitionFilters: \[.*slice#\d+ (IN|INSET) \(?s", x)
        assert "gram" in x.split("PushedFilters:")[1].split("\n")[0].replace("IsNotNull(gram)", "")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "CartesianProduct" not in plan
    expected = hits(saved, patterns)
    monkeypatch.setattr("textquarry.operators.index.BROADCAST_ROWS", 2)
    assert hits(saved, patterns) == expected


@pytest.mark.parametrize(("k", "alphabet"), [(2, ascii_dna_with_n()), (5, ascii_dna_with_n()), (40, ascii_dna_with_n()), (9, u8_until(254))])
def test_packed_postings(spark, monkeypatch, k, alphabet):
    """The same postings as one by one, in order, few to a row, over pieces and slabs; also where codes of grams outgrow 64 bits."""
    monkeypatch.setattr(build, "ROW", 7)
    r = random.Random(k)
    symbols = bytes(sorted({g[0] for g in alphabet.groups}))
    texts = build.fold_texts(literal_texts(spark, [b"", symbols[:1] * 300, *[bytes(r.choices(symbols, k=n)) for n in (1, 50, 90, 200)], symbols[:2] * 60]), alphabet)
    pieces = texts.select("text_id", F.lit(0).cast("long").alias("base"), (F.length("t") + 1).cast("int").alias("owned"), F.col("t").alias("piece")).toArrow().combine_chunks().to_batches()[0]
    rows = build.packed(pieces, sorted(symbols), k, pa.int64()).to_pylist()
    assert all(1 <= len(x["text_id"]) == len(x["position"]) <= 7 for x in rows)
    flat = [(x["gram"], *y) for x in rows for y in zip(x["text_id"], x["position"])]
    expected = sorted((bytes(x.gram), x.text_id, x.position) for x in build.postings(texts, k).collect())
    assert flat == expected
    spread = build.unpacked(build.packed_postings(texts, alphabet, k, 16, 32))
    assert dict(spread.dtypes)["position"] == "int"
    assert sorted((bytes(x.gram), x.text_id, x.position) for x in spread.collect()) == expected


def test_rows_of_a_saved_index(spark, tmp_path):
    """Locating reads rows of many postings; a common gram isn't one row for each of its positions."""
    saved = save_index(build_index(literal_texts(spark, [b"A" * 5000]), ascii_dna(), IndexConfig(lookup_table_depth=3)), str(tmp_path / "index"))
    assert spark.read.parquet(str(tmp_path / "index/postings")).count() <= 12
    assert saved.locate(b"AA").count() == 4999 and saved.postings.count() == 5001


def test_cursors_keep_what_is_not_at_rest(spark, tmp_path):
    """In a saved index short queries' hits stay where they are; without one, extending is one pass and no join."""
    index = build_index(literal_texts(spark, [b"ACGTACGT", b"GTTTACG"]), ascii_dna(), IndexConfig(lookup_table_depth=3))
    saved = save_index(index, str(tmp_path / "index"))
    first = saved.cursors_for_many_queries(saved.queries([b"", b"ACG", b"GT"]))
    assert first.locate().count() == 17 + 3 + 3 and first._hits.count() == 0
    second = first.extend_query_front(ord("T"))
    assert {r.query_id: r.n for r in second.count().collect()} == {0: 5, 1: 2, 2: 0}
    assert sorted(tuple(r) for r in second._hits.collect()) == [(1, 0, 3), (1, 1, 3)]
    third = second.extend_query_front(ord("G"))
    assert {r.query_id: r.n for r in third.count().collect()} == {0: 3, 1: 1, 2: 0}
    assert sorted((r.query_id, r.text_id, r.position) for r in third.locate().collect() if r.query_id) == [(1, 0, 2)]
    for df in (index.count_many(index.queries([b"AC", b""])), index.locate_many(index.queries([b"AC", b"T"]))):
        assert "Join" not in df._jdf.queryExecution().executedPlan().toString()


def test_cursors(spark, tmp_path):
    texts = [b"AaACGT", b"AacGtn", b"GTGTGT"]
    index = build_index(literal_texts(spark, texts), ascii_dna_with_n(), IndexConfig(lookup_table_depth=3))
    for own in (index, save_index(index, str(tmp_path / "index"))):
        first = own.cursors_for_many_queries(own.queries([b"GT", b"", b"NN"]))
        n = lambda c: {r.query_id: r.n for r in c.count().collect()}
        assert n(first) == {0: 5, 1: 21, 2: 0}
        lazy = first.extend_query_front(ord("c"))
        first.locate()
        longer = first.extend_query_front(ord("c"))
        assert n(longer) == n(lazy) == {0: 2, 1: 2, 2: 0} and n(first) == {0: 5, 1: 21, 2: 0}
        fronts = spark.createDataFrame([(0, ord("A")), (1, ord("a")), (2, ord("n"))], "query_id long, symbol int")
        assert n(longer.extend_query_front(fronts)) == {0: 2, 1: 2, 2: 0}
        assert {tuple(h) for h in longer.locate().collect() if h.query_id == 0} == {(0, 0, 3), (0, 1, 2)}
        one = own.cursor_for_query(b"GT").searched()
        assert (one.count(), one.extended_by(b"aC").count(), own.cursor_for_dense_query([2, 3, 4]).count()) == (5, 2, 2)
        assert {tuple(h) for h in one.extend_query_front(ord("C")).locate().collect()} == {(0, 3), (1, 2)}


def test_fasta(spark, tmp_path):
    (tmp_path / "x.fa").write_bytes(b">one first\r\nACGT\r\nAC\n>two\n\nGG\n")
    assert {(r.name, bytes(r.text)) for r in fasta_texts(spark, str(tmp_path / "x.fa")).collect()} == {("one first", b"ACGTAC"), ("two", b"GG")}


def test_stream(spark, tmp_path):
    index = build_index(literal_texts(spark, [b"cccaaagggttt", b"acgtacgtacgt"]), ascii_dna(), IndexConfig(lookup_table_depth=2))
    index.queries([b"gg", b"gta", b"tacgtac"]).write.parquet(str(tmp_path / "q"))
    stream = spark.readStream.schema("query_id long, query binary").parquet(str(tmp_path / "q"))
    q = locate_stream(stream, index).writeStream.format("memory").queryName("located").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    found = {tuple(r) for r in spark.sql("select query_id, text_id, position from located").collect()}
    assert found == {(0, 0, 6), (0, 0, 7), (1, 1, 2), (1, 1, 6), (2, 1, 3)}
