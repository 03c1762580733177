"""Adaptation, codon number, comparison and scoring of sequences."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import seq

_UNSCORED = ("*", "M", "W")


def cai(dna: Column, weight: dict[str, float]) -> Column:
    """The codon adaptation index: the geometric mean of w_i over codons with synonyms; 1 if there are none.

    Null for sequences that don't end at a codon's end.
    """
    logs = {c: math.log(w if w > 0 else 0.01) for c, w in weight.items() if seq.CODE[c] not in _UNSCORED}
    # one pass: the sum of the logs and their number
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"))
    scored = F.transform(seq.codons(dna), lambda c: seq.by_codon(logs, c))
    mean = F.aggregate(
        scored,
        start,
        lambda a, x: F.when(x.isNull(), a).otherwise(F.struct((a["sum"] + x).alias("sum"), (a["n"] + 1).alias("n"))),
        lambda a: F.when(a["n"] > 0, F.exp(a["sum"] / a["n"])).otherwise(1.0),
    )
    return F.when(F.length(dna) % 3 == 0, mean)


def effective_codons(sequences: DataFrame, key: str, dna: str) -> DataFrame:
    """key, nc: the effective number of codons, from the homozygosity of each family of synonyms."""
    code = [(c, a, len(seq.FAMILIES[a])) for c, a in seq.CODE.items() if a != "*" and len(seq.FAMILIES[a]) > 1]
    families = sequences.sparkSession.createDataFrame(code, "codon string, amino_acid string, synonyms int")
    found = sequences.select(key, F.explode(seq.codons(F.col(dna))).alias("codon")).join(F.broadcast(families), "codon")
    per_codon = found.groupBy(key, "amino_acid", "synonyms", "codon").agg(F.count("*").alias("n"))
    per_family = per_codon.groupBy(key, "amino_acid", "synonyms").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares")
    )
    share = F.col("squares") / (F.col("n") * F.col("n"))
    raw = (F.col("synonyms") * share - 1) / (F.col("synonyms") - 1)
    homozygosity = F.when(F.col("n") <= 1, 1.0).otherwise(F.greatest(raw, 1 / F.col("synonyms")))
    by_size = per_family.withColumn("f", homozygosity).groupBy(key).agg(
        *[F.avg(F.when(F.col("synonyms") == k, F.col("f"))).alias(f"f{k}") for k in (2, 3, 4, 6)]
    )
    f3 = F.coalesce("f3", (F.col("f2") + F.col("f4")) / 2)
    terms = [F.lit(9) / F.col("f2"), F.lit(1) / f3, F.lit(5) / F.col("f4"), F.lit(3) / F.col("f6")]
    total = F.lit(2.0)
    for t in terms:
        total = total + F.coalesce(t, F.lit(0.0))
    return by_size.select(key, F.least(total, F.lit(61.0)).alias("nc"))


def compared_codons(pairs: DataFrame, key: str, one: str, other: str, weight: dict[str, float]) -> DataFrame:
    """One row per codon position of two sequences: position (1-based), both codons, their w_i, whether changed."""
    both = pairs.where(F.col(one).isNotNull() & F.col(other).isNotNull())
    zipped = F.arrays_zip(seq.codons(F.col(one)).alias("a"), seq.codons(F.col(other)).alias("b"))
    rows = both.select(key, F.posexplode(zipped).alias("at", "c")).where("c.a is not null and c.b is not null")
    a, b = F.col("c.a"), F.col("c.b")
    return rows.select(
        key,
        (F.col("at") + 1).alias("position"),
        seq.by_codon(seq.CODE, a).alias("amino_acid"),
        a.alias("original_codon"),
        seq.by_codon(weight, a).alias("original_w_i"),
        b.alias("optimized_codon"),
        seq.by_codon(weight, b).alias("optimized_w_i"),
        (a != b).alias("changed"),
    )


@dataclass(frozen=True)
class Scoring:
    cai: float = 0.5
    gc: float = 0.3
    structure: float = 0.2
    mfe_threshold: float = -30.0
    motif_penalty: float = 0.05


def composite_score(cai_score: Column, gc: Column, mfe: Column, host_gc: float, rule: Scoring = Scoring()) -> Column:
    """The weighted sum of adaptation, closeness to the host's GC, and lack of 5' structure."""
    likeness = 1 - F.least(F.lit(1.0), F.abs(gc - F.lit(host_gc)) / 0.5)
    against = abs(rule.mfe_threshold) or 1.0
    openness = F.when(mfe.isNull(), 1.0).otherwise(1 - F.least(F.lit(1.0), F.abs(mfe) / against))
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), cai_score))
    return rule.cai * clipped + rule.gc * likeness + rule.structure * openness


def penalised(score: Column, hits: Column, rule: Scoring = Scoring()) -> Column:
    return score - rule.motif_penalty * F.coalesce(hits, F.lit(0))


def ranked_variants(variants: DataFrame, keep: int) -> DataFrame:
    """The best ``keep`` variants of each target: without hits first, then without structure, then by score.

    The rank limits each task's rows before the shuffle, so a target with very
    many variants arrives as a few rows per task.
    """
    clean = F.size(F.coalesce("forbidden_hits", F.array())) == 0
    unstructured = ~F.coalesce("has_strong_structure", F.lit(False))
    once = variants.where("composite_score is not null and not isnan(composite_score)").select(
        "target_idx", "variant_number", clean.alias("clean"), unstructured.alias("unstructured"), "composite_score"
    )
    once = once.groupBy("target_idx", "variant_number").agg(
        F.max(F.struct("clean", "unstructured", "composite_score")).alias("v")
    )
    best = Window.partitionBy("target_idx").orderBy(
        F.col("clean").desc(), F.col("unstructured").desc(), F.col("composite_score").desc(), "variant_number"
    )
    ranked = once.select("target_idx", "variant_number", "v.*").withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= keep).withColumn("is_recommended", F.col("rank") == 1)
