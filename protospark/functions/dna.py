"""DNA as Column expressions: complements, degenerate motifs, packing into integers, distances."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The IUPAC nucleotide codes and the bases each stands for, in the order in which motifs are expanded.
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T",
    "M": "AC", "R": "AG", "W": "AT", "S": "CG", "Y": "CT", "K": "GT",
    "V": "ACG", "H": "ACT", "D": "AGT", "B": "CGT",
    "X": "GATC", "N": "GATC",
}
#: Each code's complement.
CODES, COMPLEMENTS = "ACGTMRWSYKVHDBXN", "TGCAKYWSRMBDHVXN"
#: The low bit of each base in a packed sequence.
LOW_BITS = 0x5555555555555555
#: Longest sequence that packs into a long.
MAX_PACKED = 31


def check_motif(motif: str) -> str:
    motif = motif.upper()
    if not motif or set(motif) - set(IUPAC):
        raise ValueError(f"not an IUPAC motif: {motif!r}")
    return motif


def reverse_complement_text(motif: str) -> str:
    return motif.upper().translate(str.maketrans(CODES, COMPLEMENTS))[::-1]


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), CODES, COMPLEMENTS)


def iupac_regex(motif: str) -> str:
    """Regular expression of a degenerate motif."""
    return "".join(b if len(b) == 1 else f"[{''.join(sorted(b))}]" for b in (IUPAC[c] for c in check_motif(motif)))


def expand_iupac(motif: str) -> list[str]:
    """All sequences that a degenerate motif stands for; N and X run through G, A, T, C."""
    return ["".join(p) for p in product(*(IUPAC[c] for c in check_motif(motif)))]


def matches(word: Column, motif: str) -> Column:
    """Whether a word of the motif's length is an instance of it; one membership test per place, no regular expression."""
    test = F.length(word) == len(motif)
    for i, c in enumerate(check_motif(motif)):
        test = test & F.substring(word, i + 1, 1).isin(list(IUPAC[c]))
    return test


def is_acgt(seq: Column, length: int) -> Column:
    return seq.rlike(f"^[ACGT]{{{length}}}$")


def gc_fraction(seq: Column) -> Column:
    """Part of G and C among all letters; null for an empty sequence."""
    return F.try_divide(F.length(F.regexp_replace(seq, "[^GC]", "")), F.length(seq))


def packed(seq: Column) -> Column:
    """Two bits a base, as a long: up to 31 bases of ACGT."""
    return F.conv(F.translate(seq, "ACGT", "0123"), 4, 10).cast("long")


def hamming_packed(a: Column, b: Column) -> Column:
    """Bases that differ between two packed sequences of equal length."""
    x = a.bitwiseXOR(b)
    return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(LOW_BITS)))
