"""Writers of designs and tables; each is one Spark write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 70


def wrapped(dna: Column, width: int = WIDTH) -> Column:
    return F.array_join(F.regexp_extract_all(dna, F.lit(f".{{1,{width}}}"), F.lit(0)), "\n")


def file_stem(header: Column) -> Column:
    """A header's first word with only letters, digits, ``_``, ``-`` and ``.``."""
    return F.regexp_replace(F.regexp_extract(F.trim(header), r"^\S*", 0), r"[^\p{L}\p{N}_.-]", "_")


def fasta_text(designs: DataFrame) -> DataFrame:
    """value: a FASTA record of each design (header, variant_number, dna_sequence, cai_score, gc_content, composite_score, mode)."""
    title = F.format_string(
        ">%s_variant_%d CAI=%.3f GC=%.1f%% score=%.3f mode=%s",
        file_stem(F.col("header")), "variant_number", "cai_score", F.col("gc_content") * 100, "composite_score", "mode",
    )
    return designs.select(F.concat(title, F.lit("\n"), wrapped(F.col("dna_sequence"))).alias("value"))


def write_fasta(designs: DataFrame, path: str) -> None:
    fasta_text(designs).write.mode("overwrite").text(path)


def write_recommended(designs: DataFrame, path: str) -> None:
    """The best design of every target, in the targets' order."""
    best = designs.where("variant_number = 1").orderBy("target_idx")
    fasta_text(best).write.mode("overwrite").text(path)


def write_fasta_per_target(designs: DataFrame, path: str) -> None:
    """One folder per target, named by its header; targets with equal names share it."""
    named = designs.withColumn("stem", file_stem(F.col("header")))
    value = F.concat(
        F.format_string(">%s_variant_%d", "stem", "variant_number"), F.lit("\n"), wrapped(F.col("dna_sequence"))
    )
    named.select("stem", value.alias("value")).repartition("stem").write.mode("overwrite").partitionBy("stem").text(path)


def write_tsv(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").csv(path, sep="\t", header=True)


def write_summary(usage: DataFrame, report: DataFrame, path: str) -> None:
    """A Markdown summary with a row for every target, in their order; its part files follow each other."""
    total = report.agg(F.count("*").alias("n"), F.count_if("qc_pass").alias("passed")).first()
    codons = usage.agg(F.sum("count")).first()[0]
    head = ["# Designs", "", f"{total['n']} targets, {total['passed']} pass all checks; codons counted: {codons}", ""]
    head += ["| " + " | ".join(report.columns) + " |", "|" + " - |" * len(report.columns)]
    top = report.sparkSession.createDataFrame([("\n".join(head),)], "value string").select(F.lit(-1).alias("at"), "value")
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in report.columns]
    rows = report.select("target_idx", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))
    top.unionByName(rows.withColumnRenamed("target_idx", "at")).orderBy("at").select("value").write.mode("overwrite").text(path)
