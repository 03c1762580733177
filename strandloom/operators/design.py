"""Synonymous coding sequences for proteins: best codons, weighted or rank-matched draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import seq
from strandloom.operators import codon_usage


def clean_protein(protein: Column) -> Column:
    return F.regexp_replace(F.upper(protein), r"\*+$", "")


def protein_problem(protein: Column) -> Column:
    """Why a protein can't be designed; null for a sound one."""
    p = clean_protein(protein)
    return (
        F.when(F.coalesce(F.length(p), F.lit(0)) == 0, "empty")
        .when(p.rlike(f"[{seq.AMBIGUOUS}]"), "ambiguous")
        .when(~p.rlike(f"^[{seq.RESIDUES}]+$"), "non_standard")
    )


def best_codons(ranked: dict[str, list[str]]) -> dict[str, str]:
    return {aa: codons[0] for aa, codons in ranked.items()}


def ranked_codons(weight: dict[str, float]) -> dict[str, list[str]]:
    """The codons of each amino acid by w_i downwards, then codon."""
    return {aa: sorted(family, key=lambda c: (-weight.get(c, 0.0), c)) for aa, family in seq.FAMILIES.items()}


def max_cai(protein: Column, weight: dict[str, float]) -> Column:
    """The sequence of every residue's best codon, and a stop."""
    best = seq.literal_map(best_codons(ranked_codons(weight)))
    letters = F.split(clean_protein(protein), "")
    return F.concat(F.array_join(F.transform(letters, lambda a: F.try_element_at(best, a)), ""), F.lit(seq.STOP_CODON))


def flattened(shares: list[float], temperature: float) -> list[float]:
    """Shares made more equal by a temperature above 1."""
    raised = [max(p, 1e-12) ** (1 / temperature) for p in shares]
    return [p / sum(raised) for p in raised]


def temperature_shares(usage: DataFrame, temperature: float) -> DataFrame:
    """amino_acid, codon, share, flat_share, flat_to: draw shares, flattened, and their running sum."""
    family = Window.partitionBy("amino_acid")
    share = F.col("w_i") / F.sum("w_i").over(family)
    raised = F.pow(F.greatest("share", F.lit(1e-12)), F.lit(1 / temperature))
    down = family.orderBy(F.col("w_i").desc(), "codon").rowsBetween(Window.unboundedPreceding, 0)
    return (
        usage.select("amino_acid", "codon", "w_i", share.alias("share"))
        .withColumn("flat_share", raised / F.sum(raised).over(family))
        .withColumn("flat_to", F.sum("flat_share").over(down))
        .drop("w_i")
    )


def _draw_table(weight: dict[str, float], temperature: float) -> Column:
    """By amino acid, its codons with the upper ends of their shares."""
    pairs = []
    for aa, family in ranked_codons(weight).items():
        total = sum(weight.get(c, 0.01) for c in family)
        ends, end = [], 0.0
        for c, p in zip(family, flattened([weight.get(c, 0.01) / total for c in family], temperature)):
            end += p
            ends.append(F.struct(F.lit(c).alias("codon"), F.lit(2.0 if c == family[-1] else end).alias("to")))
        pairs += [F.lit(aa), F.array(*ends)]
    return F.create_map(*pairs)


def weighted(
    protein: Column, weight: dict[str, float], seed: Column, temperature: float = 1.5, n_terminal: int = 30
) -> Column:
    """Codons drawn by w_i, flatter at the start; the draw depends on ``seed`` and position alone."""
    flat, plain = _draw_table(weight, temperature), _draw_table(weight, 1.0)
    letters = F.split(clean_protein(protein), "")
    # the draws first, so that each is computed once and not once per option
    drawn = F.transform(
        letters, lambda aa, i: F.struct(aa.alias("aa"), i.alias("i"), seq.hash_uniform(seed, i.cast("string")).alias("u"))
    )

    def pick(d: Column) -> Column:
        options = F.when(d["i"] < n_terminal, F.try_element_at(flat, d["aa"]))
        options = options.otherwise(F.try_element_at(plain, d["aa"]))
        return F.element_at(F.filter(options, lambda o: d["u"] < o["to"]), 1)["codon"]

    return F.concat(F.array_join(F.transform(drawn, pick), ""), F.lit(seq.STOP_CODON))


def candidates(targets: DataFrame, n: int) -> DataFrame:
    """The targets, each n times with candidate = 0 .. n - 1."""
    return targets.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("candidate"))


def own_ranks(targets: DataFrame, key: str, dna: str) -> DataFrame:
    """key, ranks: for each target the rank of every codon in the usage of its own sequence, as a map."""
    usage = codon_usage.usage_per_sequence(targets, key, dna)
    order = Window.partitionBy(key, "amino_acid").orderBy(F.col("w_i").desc(), "codon")
    ranked = usage.select(key, "codon", (F.row_number().over(order) - 1).alias("rank"))
    return ranked.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("codon", "rank"))).alias("ranks"))


def harmonized(
    dna: Column, source: dict[str, float] | Column, host: dict[str, float], seed: Column, noise: float = 0.1
) -> Column:
    """Each codon replaced by the host's codon of the same rank; with probability ``noise`` drawn by w_i.

    ``source``: the w_i of the sequences' own genome, or a column that maps
    codons to their ranks. A codon that it doesn't hold has rank 0, one of a
    rank beyond the host's family gets the family's last.
    """
    host_ranked = ranked_codons(host)
    if isinstance(source, dict):
        ranks = {c: float(rank) for family in ranked_codons(source).values() for rank, c in enumerate(family)}

        def rank(codon: Column) -> Column:
            return seq.by_codon(ranks, codon).cast("int")

    else:

        def rank(codon: Column) -> Column:
            return F.try_element_at(source, codon)

    families = seq.literal_map_of_arrays(host_ranked)
    draws = _draw_table(host, 1.0)
    body = F.regexp_replace(F.upper(dna), "(TAA|TAG|TGA)$", "")
    drawn = F.transform(seq.codons(body), lambda c, i: F.struct(
        c.alias("codon"), seq.hash_uniform(seed, F.lit("noise"), i.cast("string")).alias("chance"),
        seq.hash_uniform(seed, i.cast("string")).alias("u")))

    def pick(d: Column) -> Column:
        aa = seq.by_codon(seq.CODE, d["codon"])
        options = F.try_element_at(draws, aa)
        other = F.element_at(F.filter(options, lambda o: d["u"] < o["to"]), 1)["codon"]
        family = F.try_element_at(families, aa)
        same = F.get(family, F.least(F.coalesce(rank(d["codon"]), F.lit(0)), F.size(family) - 1))
        return F.when(d["chance"] < noise, other).otherwise(same)

    return F.concat(F.array_join(F.transform(drawn, pick), ""), F.lit(seq.STOP_CODON))


def identity_violations(designs: DataFrame, dna: str, protein: str) -> DataFrame:
    """The rows whose sequence doesn't translate to their protein."""
    return designs.where(
        F.col(dna).isNotNull()
        & F.col(protein).isNotNull()
        & (seq.expected_protein(F.col(dna)) != clean_protein(F.col(protein)))
    )
