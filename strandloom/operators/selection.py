"""Reference gene sets: the most expressed genes of a source, or housekeeping genes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Words in the products of housekeeping genes.
HOUSEKEEPING = (
    "ribosomal protein", "30S ribosomal", "50S ribosomal", "elongation factor", "translation initiation factor",
    "chaperone", "chaperonin", "GroEL", "GroES", "DnaK", "glyceraldehyde-3-phosphate dehydrogenase", "enolase",
    "phosphoglycerate kinase", "pyruvate kinase", "fructose-bisphosphate aldolase", "DNA-directed RNA polymerase",
)


@dataclass(frozen=True)
class Selection:
    min_length: int = 500
    top_percent: float = 10
    min_genes: int = 30
    fallback_genes: int = 20


def expression_table(expression: DataFrame) -> DataFrame:
    """source, locus_tag, rpkm: the mean of a gene's sound measurements in each source.

    Repeated deliveries of a measurement count once; null, NaN and negative
    values, and blank tags, don't.
    """
    value = F.col("RPKM_average")
    sound = expression.select(
        "source", "expr_id", F.regexp_replace("locus_tag", r"(?U)^\s+|\s+$", "").alias("locus_tag"), value.alias("rpkm")
    ).where("locus_tag <> '' and source is not null and rpkm >= 0 and not isnan(rpkm)")
    once = sound.groupBy("source", "locus_tag", "expr_id").agg(F.max("rpkm").alias("rpkm"))
    return once.groupBy("source", "locus_tag").agg(F.avg("rpkm").alias("rpkm"))


def match_rates(table: DataFrame, genes: DataFrame) -> DataFrame:
    """source, n_tags, n_matched, match_rate of an expression table's tags among the genes."""
    known = genes.select("locus_tag", F.lit(True).alias("known")).distinct()
    counted = table.join(known, "locus_tag", "left").groupBy("source").agg(
        F.count("*").alias("n_tags"), F.count("known").alias("n_matched")
    )
    return counted.withColumn("match_rate", F.col("n_matched") / F.col("n_tags"))


def top_expressed(table: DataFrame, genes: DataFrame, rule: Selection = Selection()) -> DataFrame:
    """source, locus_tag, rpkm, rank, n_genes, expanded: each source's most expressed genes.

    Of the matched genes of sufficient length, the top percent (rounded half to
    even, one at least); where that gives too few, twice the percentage, 20 at
    least. Ties go to the smaller tag. The window holds one row per gene of a
    source, so it is bounded by the genome.
    """
    long = genes.where(F.length("nucleotide_seq") >= rule.min_length).select("locus_tag").distinct()
    matched = table.join(long, "locus_tag")
    by_source = Window.partitionBy("source")
    ranked = matched.withColumn(
        "rank", F.row_number().over(by_source.orderBy(F.col("rpkm").desc(), "locus_tag"))
    ).withColumn("n", F.count("*").over(by_source))

    def taken(percent: float):
        return F.greatest(F.lit(1), F.bround(F.col("n") * F.lit(float(percent)) / 100).cast("int"))

    few = taken(rule.top_percent) < rule.min_genes
    wider = max(2 * rule.top_percent, 20)
    wanted = F.when(few, taken(wider)).otherwise(taken(rule.top_percent))
    return (
        ranked.withColumn("n_genes", wanted)
        .withColumn("expanded", few)
        .where(F.col("rank") <= F.col("n_genes"))
        .select("source", "locus_tag", "rpkm", "rank", "n_genes", "expanded")
    )


def housekeeping(genes: DataFrame, rule: Selection = Selection()) -> DataFrame:
    """The genes with ``mode``: housekeeping ones, or all long ones, or all, whichever first are enough."""
    product = F.lower(F.coalesce("product", F.lit("")))
    named = F.exists(F.array(*[F.lit(w.lower()) for w in HOUSEKEEPING]), lambda w: F.contains(product, w))
    marked = genes.withColumn("long", F.length("nucleotide_seq") >= rule.min_length).withColumn("named", named)
    n_named, n_long = marked.agg(F.count_if(F.col("long") & F.col("named")), F.count_if(F.col("long"))).first()
    mode = "housekeeping" if n_named >= rule.fallback_genes else "all_cds_fallback" if n_long else "all_cds"
    chosen = {"housekeeping": F.col("long") & F.col("named"), "all_cds_fallback": F.col("long"), "all_cds": F.lit(True)}
    return marked.where(chosen[mode]).drop("long", "named").withColumn("mode", F.lit(mode))
