"""From a genome, an expression table and targets to ranked designs and their reports."""

from __future__ import annotations

import argparse
import json
import sys
import tomllib
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import seq
from strandloom.operators import codon_usage as cu
from strandloom.operators import design, metrics, motifs, qc, selection
from strandloom.sources import readers, sinks
from strandloom.workspace import keep

MODES = ("max_cai", "weighted", "harmonized")
SOURCE_MIN_LENGTH = 300  # shorter sequences of a source genome aren't counted


@dataclass(frozen=True)
class Settings:
    mode: str = "weighted"
    n_variants: int = 3
    oversample: int = 3
    seed: int = 0
    temperature: float = 1.5
    n_terminal: int = 30
    noise: float = 0.1
    repair: bool = True
    selection: selection.Selection = field(default_factory=selection.Selection)
    scoring: metrics.Scoring = field(default_factory=metrics.Scoring)
    limits: qc.Limits = field(default_factory=qc.Limits)

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}")
        if self.n_variants < 1 or self.oversample < 1:
            raise ValueError("n_variants and oversample must be at least 1")


def merged(base: dict, over: dict) -> dict:
    """``base`` with the entries of ``over``; dictionaries are merged at every level, all else is replaced."""
    both = dict(base)
    for k, v in over.items():
        both[k] = merged(both[k], v) if isinstance(v, dict) and isinstance(both.get(k), dict) else v
    return both


def settings_from(values: dict) -> Settings:
    """Settings from nested values (as in a settings file) laid over the defaults; unknown names are errors."""
    whole = merged(asdict(Settings()), values)
    try:
        whole["selection"] = selection.Selection(**whole["selection"])
        whole["scoring"] = metrics.Scoring(**whole["scoring"])
        whole["limits"] = qc.Limits(**whole["limits"])
        return Settings(**whole)
    except TypeError as e:
        raise ValueError(f"settings: {e}") from None


def read_settings(path: str) -> dict:
    """The values of a .toml or .json settings file."""
    with open(path, "rb") as f:
        return json.load(f) if path.lower().endswith(".json") else tomllib.load(f)


@dataclass
class Result:
    """``comparison``: the codons of DNA targets and their designs; ``unresolved``: the motif hits left in designs."""

    usage: DataFrame
    variants: DataFrame
    report: DataFrame
    comparison: DataFrame
    unresolved: DataFrame


def run(
    cds: DataFrame,
    targets: DataFrame,
    settings: Settings = Settings(),
    expression: DataFrame | None = None,
    source_cds: DataFrame | None = None,
) -> Result:
    """Usage table, ranked variants, one report row per target, compared codons and hits left.

    ``targets``: target_idx, header, protein_seq, original_dna. With an
    expression table (locus_tag, RPKM_average) the most expressed genes are the
    reference, else housekeeping genes. Harmonized designs match the codons'
    ranks in ``source_cds``, or else in each target itself, and need targets with
    DNA. Raises if no gene is valid, under 10 %
    of the expression table's tags match, or a design's protein has changed.
    """
    genes = keep(cu.valid_cds(cds), "genes")
    if not genes.limit(1).count():
        raise ValueError("no coding sequence of the genome is valid")
    if expression is not None and expression.limit(1).count():
        value = F.col("RPKM_average")
        table = expression.select(F.lit("given").alias("source"), "locus_tag", value.alias("rpkm"))
        rate = selection.match_rates(table, genes).first()["match_rate"]
        if rate < 0.1:
            raise ValueError(f"only {rate:.1%} of the expression table's tags are in the genome")
        best = selection.top_expressed(table, genes, settings.selection)
        reference = genes.join(best.select("locus_tag"), "locus_tag")
    else:
        reference = selection.housekeeping(genes, settings.selection)
    usage = keep(cu.codon_usage(reference), "usage")
    weight, host_gc = cu.weights(usage), cu.host_gc(reference).first()[0]

    sound = targets.where(design.protein_problem(F.col("protein_seq")).isNull())
    n = 1 if settings.mode == "max_cai" else settings.n_variants * settings.oversample
    tried = design.candidates(sound, n)
    seed = F.concat_ws("|", F.lit(str(settings.seed)), "target_idx", "candidate")
    if settings.mode == "max_cai":
        dna = design.max_cai(F.col("protein_seq"), weight)
    elif settings.mode == "weighted":
        dna = design.weighted(F.col("protein_seq"), weight, seed, settings.temperature, settings.n_terminal)
    else:
        if not sound.where("original_dna is null").isEmpty():
            raise ValueError("harmonized designs need coding sequences, but a target is a protein")
        if source_cds is not None:
            own = keep(cu.valid_cds(source_cds).where(F.length("nucleotide_seq") >= SOURCE_MIN_LENGTH), "source")
            if own.isEmpty():
                raise ValueError(f"no coding sequence of the source genome has {SOURCE_MIN_LENGTH} bases or more")
            source = cu.weights(cu.codon_usage(own))
        else:  # each target's own usage stands for its genome's
            tried = tried.join(design.own_ranks(sound, "target_idx", "original_dna"), "target_idx")
            source = F.col("ranks")
        dna = design.harmonized(F.col("original_dna"), source, weight, seed, settings.noise)
    drawn = keep(tried.select("target_idx", "header", "protein_seq", "candidate", dna.alias("dna_sequence")), "drawn")
    key = F.concat_ws(":", "target_idx", "candidate")
    if settings.repair:
        fixed = motifs.repaired(drawn.withColumn("item", key), "item", "dna_sequence", weight)
        drawn = drawn.drop("dna_sequence").withColumn("item", key).join(fixed.select("item", "dna_sequence"), "item")
    drawn = keep(drawn.withColumn("item", key), "designs")
    if design.identity_violations(drawn, "dna_sequence", "protein_seq").limit(1).count():
        raise RuntimeError("a design doesn't translate to its protein")

    hits = motifs.motif_hits(drawn, "item", "dna_sequence").groupBy("item").agg(
        F.count("*").alias("n_hits"), F.array_sort(F.collect_set("motif")).alias("forbidden_hits")
    )
    gc, cai = seq.gc_content(F.col("dna_sequence")), metrics.cai(F.col("dna_sequence"), weight)
    scored = drawn.join(hits, "item", "left").withColumns({"cai_score": cai, "gc_content": gc})
    plain = metrics.composite_score(
        F.col("cai_score"), F.col("gc_content"), F.lit(None).cast("double"), host_gc, settings.scoring
    )
    score = metrics.penalised(plain, F.col("n_hits"), settings.scoring)
    scored = scored.withColumns(
        {"composite_score": score, "variant_number": F.col("candidate"), "has_strong_structure": F.lit(False)}
    )
    scored = keep(scored.withColumn("mode", F.lit(settings.mode)), "scored")
    ranks = metrics.ranked_variants(scored, settings.n_variants).select("target_idx", "variant_number", "rank")
    variants = scored.join(ranks, ["target_idx", "variant_number"]).drop("item", "variant_number", "candidate")
    variants = variants.withColumnRenamed("rank", "variant_number")
    variants = keep(variants, "variants")
    best = variants.where("variant_number = 1")
    checked = qc.qc_summary(best, "target_idx", "dna_sequence", "has_strong_structure", settings.limits)
    given = targets.select(
        "target_idx", "original_dna", F.length(design.clean_protein(F.col("protein_seq"))).alias("length_aa"),
        metrics.cai(F.col("original_dna"), weight).alias("original_cai"), seq.gc_content(F.col("original_dna")).alias("original_gc"),
    )
    counts = variants.groupBy("target_idx").agg(F.count("*").alias("n_variants"))
    joined = best.drop("original_dna").join(given, "target_idx").join(counts, "target_idx").join(checked, "target_idx", "left")
    names = F.coalesce("forbidden_hits", F.array().cast("array<string>"))
    report = joined.select(
        "target_idx", sinks.file_stem(F.col("header")).alias("sequence_name"),
        F.when(F.col("original_dna").isNull(), "protein").otherwise("dna").alias("input_type"), "length_aa", "n_variants",
        "original_cai", F.col("cai_score").alias("recommended_cai"), (F.col("cai_score") - F.col("original_cai")).alias("cai_improvement"),
        "original_gc", F.col("gc_content").alias("recommended_gc"), F.lit(host_gc).alias("host_gc"),
        F.col("n_homopolymers").alias("homopolymer_count"), F.col("n_repeats").alias("repeat_count"),
        F.lit(None).cast("double").alias("mfe_5prime"), "has_strong_structure",
        F.coalesce("n_hits", F.lit(0)).alias("forbidden_motif_count"), F.array_join(names, ", ").alias("forbidden_motifs"),
        "composite_score", F.col("mode").alias("optimization_mode"), "qc_pass",
    )
    pairs = best.select("target_idx", "dna_sequence").join(targets.select("target_idx", "original_dna"), "target_idx")
    comparison = metrics.compared_codons(pairs, "target_idx", "original_dna", "dna_sequence", weight)
    unresolved = motifs.motif_hits(best, "target_idx", "dna_sequence")
    return Result(usage, variants, report, comparison, unresolved)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description="Design coding sequences for a host genome.")
    p.add_argument("--genome", required=True, help="GenBank file of the host")
    p.add_argument("--target", required=True, help="FASTA file of proteins or coding sequences")
    p.add_argument("--rnaseq", help="expression table (csv, tsv, txt, xlsx)")
    p.add_argument("--source-genome", help="GenBank file of the targets' own genome, for harmonized designs")
    p.add_argument("--config", help="settings file (.toml or .json), laid over the defaults")
    p.add_argument("--mode", choices=MODES)
    p.add_argument("--variants", type=int)
    p.add_argument("--output", default="output")
    p.add_argument("--seed", type=int)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("strandloom").getOrCreate()
    try:
        values = read_settings(a.config) if a.config else {}
        flags = {"mode": a.mode, "n_variants": a.variants, "seed": a.seed}
        settings = settings_from(values | {k: v for k, v in flags.items() if v is not None})
        given = readers.read_targets(spark, a.target)
        bad = given.where("problem is not null").limit(1).collect()
        if bad:
            raise ValueError(f"target {bad[0]['header']}: {bad[0]['problem']}")
        targets = given.withColumn("target_idx", F.monotonically_increasing_id()).drop("problem")
        genome = readers.read_genbank(spark, a.genome).withColumn("added_at", F.lit(None).cast("timestamp"))
        other = readers.read_genbank(spark, a.source_genome) if a.source_genome else None
        if other is not None:
            other = other.withColumn("added_at", F.lit(None).cast("timestamp"))
        table = readers.read_expression(spark, a.rnaseq) if a.rnaseq else None
        result = run(genome, targets, settings, table, other)
        sinks.write_fasta(result.variants, f"{a.output}/designs_fasta")
        sinks.write_tsv(result.report, f"{a.output}/report_tsv")
        sinks.write_recommended(result.variants, f"{a.output}/recommended_fasta")
        sinks.write_tsv(result.comparison.orderBy("target_idx", "position"), f"{a.output}/comparison_tsv")
        sinks.write_tsv(result.unresolved, f"{a.output}/unresolved_tsv")
        sinks.write_tsv(result.usage.orderBy("amino_acid", F.col("w_i").desc(), "codon"), f"{a.output}/usage_tsv")
        sinks.write_summary(result.usage, result.report, f"{a.output}/summary_md")
        print(f"{result.report.count()} targets designed; results in {a.output}")
    except (ValueError, FileNotFoundError) as e:
        print(e, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
