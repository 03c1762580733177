"""Sequence functions as Column expressions; all stay inside Spark's own evaluation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The standard genetic code, amino acids of the codons in TCAG order of their three bases.
BASES = "TCAG"
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
#: Residues of a protein, and letters that stand for several.
RESIDUES, AMBIGUOUS = "ACDEFGHIKLMNPQRSTVWY", "BJOUXZ"
STOP_CODON = "TAA"

CODE = dict(sorted((a + b + c, AMINO_ACIDS[16 * i + 4 * j + k])
                   for i, a in enumerate(BASES) for j, b in enumerate(BASES) for k, c in enumerate(BASES)))
FAMILIES = {aa: [c for c in CODE if CODE[c] == aa] for aa in sorted(set(AMINO_ACIDS))}


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def codons(dna: Column) -> Column:
    """The codons in frame 0, upper-case; one or two bases left over are dropped."""
    return F.regexp_extract_all(F.upper(dna), F.lit("(?s).{3}"), F.lit(0))


def codon_index(codon: Column) -> Column:
    """0..63 for a codon of A, C, T and G (in this order of worth), null for any other."""

    def base(i: int) -> Column:  # two bits of the letters' codes tell A, C, T and G apart
        return F.shiftright(F.ascii(F.substring(codon, i, 1)), 1).bitwiseAND(F.lit(3))

    known = (F.length(codon) == 3) & (F.translate(codon, "ACTG", "") == "")
    return F.when(known, base(1) * 16 + base(2) * 4 + base(3))


def by_codon(values: dict, codon: Column) -> Column:
    """The value of a codon: an array lookup by its index, which doesn't search like a map."""
    order = [a + b + c for a in "ACTG" for b in "ACTG" for c in "ACTG"]
    kind = "double" if any(isinstance(v, float) for v in values.values()) else "string"
    table = F.array(*[F.lit(values.get(c)).cast(kind) for c in order])
    return F.get(table, codon_index(codon))


def translate(dna: Column) -> Column:
    """The protein of a coding sequence: stops are ``*``, codons with other letters ``X``."""
    return F.array_join(F.transform(codons(dna), lambda c: F.coalesce(by_codon(CODE, c), F.lit("X"))), "")


def gc_count(dna: Column) -> Column:
    return F.length(dna) - F.length(F.translate(F.upper(dna), "GC", ""))


def gc_content(dna: Column) -> Column:
    """The share of G and C among all letters; 0 for an empty sequence."""
    return F.when(F.length(dna) > 0, gc_count(dna) / F.length(dna)).otherwise(F.when(dna.isNotNull(), F.lit(0.0)))


def reverse_complement(dna: Column) -> Column:
    return F.reverse(F.translate(dna, "ACGTacgt", "TGCAtgca"))


def is_dna(seq: Column) -> Column:
    return seq.rlike("^[ACGTNacgtn]+$")


def expected_protein(dna: Column) -> Column:
    """The protein without one stop at its end."""
    return F.regexp_replace(translate(dna), r"\*$", "")


def inner_stop(protein: Column) -> Column:
    """Whether a stop stands before the last letter."""
    return F.instr(protein, "*").between(1, F.length(protein) - 1)


def stops_early(dna: Column) -> Column:
    """Whether a stop codon comes before the last codon of an upper-case sequence, without translating it."""
    return dna.rlike("^(?:[A-Z]{3})*?(?:TAA|TAG|TGA)[A-Z]{3}")


def first_codon(start: Column) -> Column:
    """The codon of a base position (0-based)."""
    return F.floor(start / 3).cast("int")


def last_codon(end: Column) -> Column:
    """The codon of the base before ``end``."""
    return F.floor((end - 1) / 3).cast("int")


def replace_codon(dna: Column, index: Column, codon: Column) -> Column:
    return F.overlay(dna, codon, (index * 3 + 1).cast("int"), F.lit(3))


def hash_uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone, whatever the partitioning."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def literal_map_of_arrays(values: dict[str, list[str]]) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
