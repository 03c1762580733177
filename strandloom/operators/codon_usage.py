"""Coding sequences, their validation, and codon usage tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import seq
from strandloom.workspace import keep

#: Fixed value: the relative adaptiveness of a codon that never occurs.
LEAST_WEIGHT = 0.01


def cds_reason() -> Column:
    """Why a coding sequence is left out; null for a valid one."""
    dna = F.upper(F.trim("nucleotide_seq"))
    return (
        F.when(F.coalesce(F.trim("locus_tag"), F.lit("")) == "", "no_locus_tag")
        .when(F.coalesce(F.length(dna), F.lit(0)) == 0, "no_sequence")
        .when(F.length(dna) % 3 != 0, "partial_codon")
        .when(seq.stops_early(dna), "inner_stop")
    )


def checked_cds(cds: DataFrame) -> DataFrame:
    """The table with ``reason``; sequences in upper case."""
    return cds.withColumn("reason", cds_reason()).withColumn("nucleotide_seq", F.upper(F.trim("nucleotide_seq")))


def valid_cds(cds: DataFrame) -> DataFrame:
    """The first valid row of each locus_tag, by added_at, then sequence."""
    good = checked_cds(cds).where("reason is null").drop("reason").withColumn("locus_tag", F.trim("locus_tag"))
    first = Window.partitionBy("locus_tag").orderBy("added_at", "nucleotide_seq", "location", "product")
    # The shuffle that the window needs, by a set number of partitions: adaptive execution doesn't merge these, and what
    # is done with sequences afterwards is heavy for its bytes.
    partitions = int(cds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    good = good.repartition(partitions, "locus_tag")
    return good.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")


def genetic_code(like: DataFrame) -> DataFrame:
    return like.sparkSession.createDataFrame(list(seq.CODE.items()), "codon string, amino_acid string")


def codon_counts(sequences: DataFrame, dna: str = "nucleotide_seq") -> DataFrame:
    """codon, amino_acid, count of all 64 codons; codons with other letters aren't counted."""
    found = sequences.select(F.explode(seq.codons(F.col(dna))).alias("codon")).groupBy("codon").agg(
        F.count("*").alias("count")
    )
    code = genetic_code(sequences)
    return code.join(found, "codon", "left").select("codon", "amino_acid", F.coalesce("count", F.lit(0)).alias("count"))


def usage_columns(family: list[str]) -> dict[str, Column]:
    """frequency, w_i and rscu from ``count``, within families of synonymous codons."""
    whole = Window.partitionBy(*family)
    total, most, n = F.sum("count").over(whole), F.max("count").over(whole), F.count("*").over(whole)
    weight = F.when(n == 1, 1.0).when(most == 0, LEAST_WEIGHT)
    weight = weight.otherwise(F.when(F.col("count") == 0, LEAST_WEIGHT).otherwise(F.col("count") / most))
    return {
        "frequency": F.when(total > 0, F.col("count") / total).otherwise(0.0),
        "w_i": weight,
        "rscu": F.when(total > 0, F.col("count") * n / total).otherwise(0.0),
    }


def codon_usage(sequences: DataFrame, dna: str = "nucleotide_seq") -> DataFrame:
    """The usage table: codon, amino_acid, count, frequency, w_i, rscu; always 64 rows."""
    return codon_counts(sequences, dna).withColumns(usage_columns(["amino_acid"]))


def usage_per_sequence(sequences: DataFrame, key: str, dna: str) -> DataFrame:
    """A usage table of each sequence: key and the columns of ``codon_usage``, for codons of its amino acids."""
    found = (
        sequences.select(key, F.explode(seq.codons(F.col(dna))).alias("codon"))
        .groupBy(key, "codon")
        .agg(F.count("*").alias("n"))
    )
    code = genetic_code(sequences)
    families = found.join(F.broadcast(code), "codon").select(key, "amino_acid").distinct()  # 64 rows
    every = families.join(F.broadcast(code), "amino_acid")
    counted = every.join(found, [key, "codon"], "left").select(
        key, "codon", "amino_acid", F.coalesce("n", F.lit(0)).alias("count")
    )
    return counted.withColumns(usage_columns([key, "amino_acid"]))


def synonym_ranks(usage: DataFrame) -> DataFrame:
    """The table with ``rank`` (0-based) within each amino acid, by w_i downwards, then codon."""
    order = Window.partitionBy("amino_acid").orderBy(F.col("w_i").desc(), "codon")
    return usage.withColumn("rank", F.row_number().over(order) - 1)


def weights(usage: DataFrame) -> dict[str, float]:
    """w_i by codon; the 64 rows come to the driver and into plans as literals."""
    return {r["codon"]: r["w_i"] for r in usage.select("codon", "w_i").orderBy("codon").collect()}


def host_gc(sequences: DataFrame, dna: str = "nucleotide_seq") -> DataFrame:
    """The G and C share of all sequences joined; 0 if there are none."""
    share = F.sum(seq.gc_count(F.col(dna))) / F.sum(F.length(dna))
    return sequences.agg(F.coalesce(share, F.lit(0.0)).alias("host_gc"))


def host_table(cds: DataFrame, min_length: int = 0) -> DataFrame:
    """The usage table of a genome's valid sequences, kept for repeated use."""
    return keep(codon_usage(valid_cds(cds).where(F.length("nucleotide_seq") >= min_length)), "usage")
