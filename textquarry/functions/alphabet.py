"""Alphabets: many-to-one maps from bytes to dense symbols, as values and as Column expressions.

Dense symbol 0 is the sentinel that ends every text; groups of bytes count from 1. The first byte of a group is its
canonical one. Texts and queries are binary columns, one byte a symbol, in which every byte is canonical.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LATIN = "ISO-8859-1"


@dataclass(frozen=True)
class Alphabet:
    """groups[i] holds the bytes of dense symbol i + 1; the last n_unsearchable groups are nominally unsearchable."""

    groups: tuple[bytes, ...]
    n_unsearchable: int = 0

    def __post_init__(self):
        if not self.groups:
            raise ValueError("an alphabet needs a symbol")
        if len(self.groups) > 255:
            raise ValueError("an alphabet has at most 255 groups")
        if any(not g for g in self.groups):
            raise ValueError("a group of symbols is empty")
        every = b"".join(self.groups)
        if len(set(every)) != len(every):
            raise ValueError("a byte occurs twice")
        if not 0 <= self.n_unsearchable < len(self.groups):
            raise ValueError("at least one symbol must be searchable")

    @classmethod
    def from_io_symbols(cls, symbols: Iterable[int] | bytes, n_unsearchable: int = 0) -> Alphabet:
        return cls(tuple(bytes([s]) for s in symbols), n_unsearchable)

    @classmethod
    def from_ambiguous_io_symbols(cls, groups: Iterable[bytes], n_unsearchable: int = 0) -> Alphabet:
        return cls(tuple(bytes(g) for g in groups), n_unsearchable)

    def io_to_dense(self, symbol: int) -> int:
        found = self.try_io_to_dense(symbol)
        if found is None:
            raise ValueError(f"byte {symbol} is not in the alphabet")
        return found

    def try_io_to_dense(self, symbol: int) -> int | None:
        return next((i for i, g in enumerate(self.groups, 1) if symbol in g), None)

    def dense_to_io(self, symbol: int) -> int:
        found = self.try_dense_to_io(symbol)
        if found is None:
            raise ValueError(f"dense symbol {symbol} stands for no byte")
        return found

    def try_dense_to_io(self, symbol: int) -> int | None:
        return self.groups[symbol - 1][0] if 1 <= symbol <= len(self.groups) else None

    def io_symbols(self) -> list[int]:
        return sorted(b"".join(self.groups))

    @property
    def num_dense_symbols(self) -> int:
        return len(self.groups) + 1

    @property
    def num_searchable_dense_symbols(self) -> int:
        return len(self.groups) - self.n_unsearchable

    def contains_sentinel(self) -> bool:
        return True

    def searchable(self) -> bytes:
        return b"".join(self.groups[: self.num_searchable_dense_symbols])

    def to_df(self, spark: SparkSession) -> DataFrame:
        """io, dense, canonical_io, searchable: at most 256 rows."""
        rows = [(b, i, g[0], i <= self.num_searchable_dense_symbols) for i, g in enumerate(self.groups, 1) for b in g]
        return spark.createDataFrame(rows, "io int, dense int, canonical_io int, searchable boolean")

    def pattern(self, symbols: bytes | None = None) -> str:
        """A character class body for the bytes of the alphabet."""
        return "".join(f"\\x{b:02x}" for b in sorted(b"".join(self.groups) if symbols is None else symbols))

    def encode(self, symbol: Column, checked: bool = True) -> Column:
        """Dense symbol of a column of byte values; an unknown byte is an error, or null if not checked."""
        table = F.create_map(*[F.lit(x) for b in self.io_symbols() for x in (b, self.io_to_dense(b))])
        return self._checked(F.try_element_at(table, symbol), symbol, "byte is not in the alphabet") if checked else F.try_element_at(table, symbol)

    def decode(self, symbol: Column, checked: bool = True) -> Column:
        """Canonical byte of a column of dense symbols; the sentinel and unknown ones are errors, or null."""
        table = F.create_map(*[F.lit(x) for i, g in enumerate(self.groups, 1) for x in (i, g[0])])
        return self._checked(F.try_element_at(table, symbol), symbol, "dense symbol stands for no byte") if checked else F.try_element_at(table, symbol)

    @staticmethod
    def _checked(found: Column, symbol: Column, message: str) -> Column:
        return F.when(found.isNull() & symbol.isNotNull(), F.raise_error(F.concat(F.lit(message + ": "), symbol.cast("string"))).cast("int")).otherwise(found)

    def valid(self, text: Column, strict: bool = False) -> Column:
        """Whether all bytes of a binary column are in the alphabet (strict: and searchable)."""
        return ~F.decode(text, LATIN).rlike(f"[^{self.pattern(self.searchable() if strict else None)}]")

    def fold(self, text: Column, on_invalid: str = "error", strict: bool = False) -> Column:
        """A binary column with every byte made canonical. on_invalid: error, null, or drop (the bytes)."""
        t = F.decode(text, LATIN)
        if on_invalid == "drop":
            t = F.regexp_replace(t, f"[^{self.pattern()}]+", "")
        if more := [(b, g[0]) for g in self.groups for b in g[1:] if g[0]]:
            t = F.translate(t, bytes(b for b, _ in more).decode("latin-1"), bytes(c for _, c in more).decode("latin-1"))
        for g in self.groups:
            # translate() would delete what maps to byte 0.
            if g[0] == 0 and len(g) > 1:
                t = F.regexp_replace(t, f"[{self.pattern(g[1:])}]", "\x00")
        folded = F.encode(t, LATIN)
        if on_invalid == "drop":
            return folded
        bad = F.lit(None) if on_invalid == "null" else F.raise_error(F.lit("a byte is not in the alphabet"))
        return F.when(self.valid(text, strict) | text.isNull(), folded).otherwise(bad.cast("binary"))


def _pairs(letters: str) -> list[bytes]:
    return [(c + c.lower()).encode() for c in letters]


def ascii_dna() -> Alphabet:
    return Alphabet.from_ambiguous_io_symbols(_pairs("ACGT"))


def ascii_dna_with_n() -> Alphabet:
    return Alphabet.from_ambiguous_io_symbols(_pairs("ACGTN"), 1)


def ascii_dna_iupac() -> Alphabet:
    return Alphabet.from_ambiguous_io_symbols(_pairs("ACGTNRYKMSWBDHV"))


def ascii_dna_iupac_as_dna_with_n() -> Alphabet:
    return Alphabet.from_ambiguous_io_symbols([*_pairs("ACGT"), b"".join(_pairs("NRYKMSWBDHV"))], 1)


def ascii_amino_acid() -> Alphabet:
    return Alphabet.from_ambiguous_io_symbols(_pairs("ACDEFGHIKLMNOPQRSTUVWY"))


def ascii_amino_acid_iupac() -> Alphabet:
    return Alphabet.from_ambiguous_io_symbols([*_pairs("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), b"*"])


def u8_until(last: int) -> Alphabet:
    return Alphabet.from_io_symbols(range(last + 1))


def ascii_printable() -> Alphabet:
    return Alphabet.from_io_symbols(range(0x20, 0x7F))


PRESETS = {
    "ascii_dna": ascii_dna, "ascii_dna_with_n": ascii_dna_with_n, "ascii_dna_iupac": ascii_dna_iupac,
    "ascii_dna_iupac_as_dna_with_n": ascii_dna_iupac_as_dna_with_n, "ascii_amino_acid": ascii_amino_acid,
    "ascii_amino_acid_iupac": ascii_amino_acid_iupac, "ascii_printable": ascii_printable,
}
