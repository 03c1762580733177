"""Quality checks of sequences: GC windows, homopolymers, repeats, stems."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import seq


@dataclass(frozen=True)
class Limits:
    gc_range: tuple[float, float] = (0.25, 0.65)
    gc_window: int = 50
    gc_deviation: float = 0.15
    max_run: int = 6
    repeat_length: int = 12
    five_prime: int = 150
    stem: int = 6
    loop: int = 3


def gc_marks(dna: Column) -> Column:
    """The sequence with 1 for G and C, and 0 for any other letter."""
    return F.regexp_replace(F.regexp_replace(F.upper(dna), "[GC]", "1"), "[^1]", "0")


def window_gc(marks: Column, width: int) -> Column:
    """The GC share of every window of ``width`` marks, as an array; of the whole sequence if it is shorter.

    ``marks`` should be a column, not an expression, so that it is computed once and not once per window.
    """
    windows = F.transform(
        F.sequence(F.lit(1), F.length(marks) - (width - 1)),
        lambda i: F.length(F.replace(F.substring(marks, i, F.lit(width)), F.lit("0"), F.lit(""))) / width,
    )
    return F.when(F.length(marks) >= width, windows).otherwise(F.array(_share(marks)))


def _share(marks: Column) -> Column:
    ones = F.length(F.replace(marks, F.lit("0"), F.lit("")))
    return F.when(F.length(marks) > 0, ones / F.length(marks)).otherwise(0.0)


def gc_extremes(sequences: DataFrame, key: str, dna: str, limits: Limits = Limits()) -> DataFrame:
    """key, overall_gc, min_gc, max_gc, gc_ok."""
    marked = sequences.where(F.col(dna).isNotNull()).select(key, gc_marks(F.col(dna)).alias("marks"))
    shares = marked.select(
        key, _share(F.col("marks")).alias("overall_gc"), window_gc(F.col("marks"), limits.gc_window).alias("w")
    )
    low, high = limits.gc_range
    return shares.select(
        key,
        "overall_gc",
        F.array_min("w").alias("min_gc"),
        F.array_max("w").alias("max_gc"),
        F.col("overall_gc").between(low, high).alias("gc_ok"),
    )


def gc_regions(sequences: DataFrame, key: str, dna: str, limits: Limits = Limits()) -> DataFrame:
    """key, region_start, region_end, direction, gc: windows far from the overall share, merged where they overlap."""
    width = limits.gc_window
    marked = sequences.where(F.length(dna) >= width).select(key, gc_marks(F.col(dna)).alias("marks"))
    shares = marked.select(key, _share(F.col("marks")).alias("overall"), window_gc(F.col("marks"), width).alias("w"))
    placed = F.transform("w", lambda g, i: F.struct(i.alias("at"), g.alias("gc")))
    off = F.filter(placed, lambda x: F.abs(x["gc"] - F.col("overall")) > limits.gc_deviation)
    # only the windows that are far off leave their sequence's row
    far = shares.select(key, "overall", F.explode(off).alias("x")).select(
        key,
        "x.at",
        "x.gc",
        F.when(F.col("x.gc") > F.col("overall"), "high").otherwise("low").alias("direction"),
    )
    by_seq = Window.partitionBy(key).orderBy("at")
    new = (
        F.lag("at").over(by_seq).isNull()
        | (F.lag("direction").over(by_seq) != F.col("direction"))
        | (F.col("at") - F.lag("at").over(by_seq) > width)
    )
    islands = far.withColumn("new", new.cast("int")).withColumn("island", F.sum("new").over(by_seq))
    return islands.groupBy(key, "island", "direction").agg(
        F.min("at").alias("region_start"), (F.max("at") + width).alias("region_end"), F.min_by("gc", "at").alias("gc")
    ).drop("island")


def homopolymers(sequences: DataFrame, key: str, dna: str, limits: Limits = Limits()) -> DataFrame:
    """key, base, run_length, run_start (0-based) of every run of more than ``max_run`` equal letters."""
    pattern = rf"(.)\1{{{limits.max_run},}}"
    u = F.upper(F.col(dna))
    # a mark before and after each run splits the sequence into runs and what lies between
    marked = F.regexp_replace(u, rf"((.)\2{{{limits.max_run},}})", "#$1#")
    parts = F.split(marked, "#")
    found = sequences.where(u.rlike(pattern)).select(key, F.posexplode(parts).alias("nth", "part"), parts.alias("parts"))
    before = F.aggregate(F.slice("parts", F.lit(1), F.col("nth")), F.lit(0), lambda a, x: a + F.length(x))
    runs = found.where(F.col("nth") % 2 == 1)
    return runs.select(
        key,
        F.substring("part", 1, 1).alias("base"),
        F.length("part").alias("run_length"),
        before.alias("run_start"),
    )


def _kmers(u: Column, k: int) -> Column:
    """All k-mers in their order; none of a sequence too short to hold two beside each other."""
    at = F.when(F.length(u) >= 2 * k, F.sequence(F.lit(0), F.length(u) - k))
    return F.transform(at, lambda i: F.substring(u, i + 1, F.lit(k)))


def has_repeats(u: Column, k: int) -> Column:
    kmers = _kmers(u, k)
    return F.coalesce(F.size(F.array_distinct(kmers)) < F.size(kmers), F.lit(False))


def repeated_kmers(u: Column, k: int) -> Column:
    """(kmer, first_at, second_at) of neighbouring places of equal k-mers, found by sorting them inside the row."""
    places = F.array_sort(F.transform(_kmers(u, k), lambda kmer, i: F.struct(kmer.alias("kmer"), i.alias("at"))))
    rest = F.size(places) - 1
    pairs = F.zip_with(
        F.slice(places, F.lit(1), rest), F.slice(places, F.lit(2), rest),
        lambda a, b: F.when(a["kmer"] == b["kmer"], F.struct(a["kmer"].alias("kmer"), a["at"].alias("first_at"), b["at"].alias("second_at"))),
    )
    return F.filter(pairs, lambda x: x.isNotNull())


def repeats(sequences: DataFrame, key: str, dna: str, limits: Limits = Limits()) -> DataFrame:
    """key, kmer, first_at, second_at, copies, repeat_length: k-mers that occur more than once in a sequence.

    ``repeat_length``: how far the first two copies agree, without running into
    each other by more than the k-mer itself. All is compared inside a row;
    only the k-mers that repeat are shuffled.
    """
    k = limits.repeat_length
    u, first_at, second_at = F.col("u"), F.col("first_at"), F.col("second_at")
    upper = sequences.select(key, F.upper(F.col(dna)).alias("u")).where(has_repeats(u, k))
    pairs = upper.select(key, "u", F.explode(repeated_kmers(u, k)).alias("x")).select(key, "u", "x.*")
    # the first place where the copies differ ends the repeat
    room = F.least(F.length(u) - second_at, F.greatest(F.lit(k), second_at - first_at))

    def ends(i: Column) -> Column:
        return (i >= room) | (F.substring(u, first_at + i + 1, F.lit(1)) != F.substring(u, second_at + i + 1, F.lit(1)))

    length = F.element_at(F.filter(F.sequence(F.lit(k), room), ends), 1)
    return pairs.select(key, "kmer", "first_at", "second_at", length.alias("n")).groupBy(key, "kmer").agg(
        F.min("first_at").alias("first_at"), F.min("second_at").alias("second_at"), (F.count("*") + 1).alias("copies"),
        F.min_by("n", "first_at").alias("repeat_length"),
    )


def _stem_places(sequences: DataFrame, key: str, dna: str, limits: Limits) -> DataFrame:
    """key, places: where the k-mers (at, arm) stand whose reverse complement is in the 5' end, too."""
    k = limits.stem
    heads = sequences.select(key, F.upper(F.substring(dna, 1, limits.five_prime)).alias("head"))
    long = heads.where(F.length("head") >= 2 * k + limits.loop)
    every = F.lit(f"(?s)(?=(.{{{k}}}))")  # all k-mers by one scan; an expression inside a lambda is computed for each
    arms = long.select(
        key,
        F.regexp_extract_all("head", every, F.lit(1)).alias("arms"),
        F.regexp_extract_all(seq.reverse_complement(F.col("head")), every, F.lit(1)).alias("turned"),
    )
    # few k-mers have a complement in their head; the array of one makes the lambda's argument computed once
    placed = F.transform("arms", lambda x, i: F.struct(i.alias("at"), x.alias("arm")))
    some = F.transform(
        F.array(F.array_intersect("arms", "turned")),
        lambda shared: F.filter(placed, lambda x: F.array_contains(shared, x["arm"])),
    )
    return arms.select(key, some[0].alias("places"))


def stems(sequences: DataFrame, key: str, dna: str, limits: Limits = Limits()) -> DataFrame:
    """key, arm_start, partner_start, arm: k-mers of the 5' end whose reverse complement follows after a loop.

    A structure measure by sequence alone; it is no folding energy. All is
    compared inside a row; no k-mer is shuffled.
    """
    k = limits.stem
    places = _stem_places(sequences, key, dna, limits).select(key, "places", F.explode("places").alias("x"))
    partner = F.filter(
        "places",
        lambda y: (y["at"] >= F.col("x.at") + k + limits.loop) & (y["arm"] == seq.reverse_complement(F.col("x.arm"))),
    )
    pairs = places.select(key, "x", F.explode(partner).alias("y"))
    return pairs.select(key, F.col("x.at").alias("arm_start"), F.col("y.at").alias("partner_start"), F.col("x.arm").alias("arm"))


def stem_codons(pairs: DataFrame, key: str, limits: Limits = Limits()) -> DataFrame:
    """key, codon_index: the codons (but the first) that a stem's arms touch."""
    spans = pairs.select(key, F.explode(F.array("arm_start", "partner_start")).alias("start"))
    inside = F.sequence(seq.first_codon(F.col("start")), seq.last_codon(F.col("start") + limits.stem))
    return spans.select(key, F.explode(inside).alias("codon_index")).where("codon_index > 0").distinct()


def stem_codons_of(sequences: DataFrame, key: str, dna: str, limits: Limits = Limits()) -> DataFrame:
    """key, codon_index: what ``stem_codons`` gives of ``stems``, where each key has one row.

    The codons are gathered inside a row: pairs, of which there may be a
    thousand times as many as codons, aren't made, and nothing is aggregated.
    """
    turned = F.transform("places", lambda x: F.struct(x["at"].alias("at"), seq.reverse_complement(x["arm"]).alias("arm")))
    far = limits.stem + limits.loop
    both = _stem_places(sequences, key, dna, limits).select(key, "places", turned.alias("turned"))
    # of two k-mers that are each other's complement and far enough apart one is the arm and one the partner
    starts = F.filter(
        "places", lambda x: F.exists("turned", lambda y: (F.abs(y["at"] - x["at"]) >= far) & (y["arm"] == x["arm"]))
    )
    inside = F.flatten(
        F.transform(starts, lambda x: F.sequence(seq.first_codon(x["at"]), seq.last_codon(x["at"] + limits.stem)))
    )
    return both.select(key, F.explode(F.array_distinct(inside)).alias("codon_index")).where("codon_index > 0")


def qc_summary(sequences: DataFrame, key: str, dna: str, structure: str | None = None, limits: Limits = Limits()) -> DataFrame:
    """key, overall_gc, gc_ok, n_homopolymers, n_repeats, structure_ok, qc_pass, all in one pass over the rows.

    A sequence passes if its GC share is in range, no run of one base is too
    long, no k-mer repeats, and it isn't marked as strongly structured;
    ``structure`` names that mark, null or no column counts as unmarked.
    """
    u = F.upper(F.col(dna))
    low, high = limits.gc_range
    runs = F.size(F.regexp_extract_all(u, F.lit(rf"((.)\2{{{limits.max_run},}})"), F.lit(1)))
    gc = seq.gc_content(u)
    k = limits.repeat_length
    again = F.when(has_repeats(u, k), F.size(F.array_distinct(F.transform(repeated_kmers(u, k), lambda x: x["kmer"])))).otherwise(0)
    open_end = ~F.coalesce(F.col(structure), F.lit(False)) if structure else F.lit(True)
    return sequences.where(F.col(dna).isNotNull()).select(
        key, gc.alias("overall_gc"), gc.between(low, high).alias("gc_ok"), runs.alias("n_homopolymers"),
        again.alias("n_repeats"), open_end.alias("structure_ok"),
    ).withColumn("qc_pass", F.col("gc_ok") & (F.col("n_homopolymers") == 0) & (F.col("n_repeats") == 0) & F.col("structure_ok"))
