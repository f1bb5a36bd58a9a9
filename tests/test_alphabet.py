import pytest

from textquarry.functions import alphabet as A


@pytest.mark.parametrize(
    ("made", "dense", "searchable"),
    [(A.ascii_dna(), 5, 4), (A.ascii_dna_with_n(), 6, 4), (A.ascii_dna_iupac(), 16, 15), (A.ascii_dna_iupac_as_dna_with_n(), 6, 4), (A.ascii_amino_acid(), 23, 22), (A.ascii_amino_acid_iupac(), 28, 27), (A.ascii_printable(), 96, 95), *[(A.u8_until(m), m + 2, m + 1) for m in (1, 8, 254)], (A.Alphabet.from_io_symbols(b"0123456789"), 11, 10)],
)
def test_sizes(made, dense, searchable):
    assert (made.num_dense_symbols, made.num_searchable_dense_symbols) == (dense, searchable)
    assert made.contains_sentinel()
    for b in made.io_symbols():
        assert made.io_to_dense(made.dense_to_io(made.io_to_dense(b))) == made.io_to_dense(b)
    assert made.try_dense_to_io(0) is None and made.try_dense_to_io(dense) is None


@pytest.mark.parametrize("groups", [[], [b"A", b""], [b"AA"], [b"A", b"BA"], [bytes([i]) for i in range(256)]])
def test_bad_groups(groups):
    with pytest.raises(ValueError):
        A.Alphabet.from_ambiguous_io_symbols(groups)


def test_bad_values():
    with pytest.raises(ValueError):
        A.Alphabet.from_io_symbols(b"AB", 2)
    with pytest.raises(ValueError):
        A.u8_until(255)
    with pytest.raises(ValueError):
        A.ascii_dna().io_to_dense(ord("N"))
    with pytest.raises(ValueError):
        A.ascii_dna().dense_to_io(0)
    assert A.ascii_dna().try_io_to_dense(ord("N")) is None
    assert A.ascii_dna() == A.ascii_dna()


def test_fold(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(bytearray(b"aCgT"),), (bytearray(b"ACN"),), (None,), (bytearray(b""),)], "t binary")
    a = A.ascii_dna()
    assert [r[0] and bytes(r[0]) for r in df.select(a.fold(F.col("t"), "null")).collect()] == [b"ACGT", None, None, bytearray()]
    assert [r[0] and bytes(r[0]) for r in df.select(a.fold(F.col("t"), "drop")).collect()] == [b"ACGT", b"AC", None, bytearray()]
    with pytest.raises(Exception, match="not in the alphabet"):
        df.select(a.fold(F.col("t"))).collect()
    zero = A.Alphabet.from_ambiguous_io_symbols([b"\x00\x01", b"\xff\xfe"])
    one = spark.createDataFrame([(bytearray(b"\x01\x00\xfe\xff"),)], "t binary")
    assert bytes(one.select(zero.fold(F.col("t"))).first()[0]) == b"\x00\x00\xff\xff"
    codes = spark.createDataFrame([(65,), (78,)], "c int")
    assert [r[0] for r in codes.select(a.encode(F.col("c"), checked=False)).collect()] == [1, None]
    with pytest.raises(Exception, match="not in the alphabet"):
        codes.select(a.encode(F.col("c"))).collect()
