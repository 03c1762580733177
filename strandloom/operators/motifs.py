"""Forbidden motifs: finding them on both strands, and removing them by synonymous codons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions import seq
from strandloom.workspace import keep

#: Restriction sites and runs of one base (name, pattern, whether the other strand is searched too).
MOTIFS = (
    ("BsaI", "GGTCTC", True), ("BsmBI", "CGTCTC", True), ("SapI", "GCTCTTC", True), ("EcoRI", "GAATTC", True),
    ("BamHI", "GGATCC", True), ("HindIII", "AAGCTT", True), ("XhoI", "CTCGAG", True), ("NdeI", "CATATG", True),
    ("NcoI", "CCATGG", True), ("polyA7", "A{7,}", False), ("polyT7", "T{7,}", False), ("polyG7", "G{7,}", False),
    ("polyC7", "C{7,}", False),
)
#: Bases beside a hit in which an exchange of its codons may change motifs.
MARGIN = 12


def _hits(u: Column, pattern: Column) -> Column:
    """start and matched text of each non-overlapping match, by what lies before it."""
    found = F.regexp_extract_all(u, F.concat(F.lit("("), pattern, F.lit(")")), F.lit(1))
    between = F.split(u, pattern, -1)

    def place(match: Column, i: Column) -> Column:
        before = F.aggregate(F.slice(between, F.lit(1), i + 1), F.lit(0), lambda a, x: a + F.length(x))
        earlier = F.aggregate(F.slice(found, F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x))
        return F.struct((before + earlier).alias("start"), match.alias("matched"))

    return F.transform(found, place)


def motif_hits(sequences: DataFrame, key: str, dna: str, motifs=MOTIFS) -> DataFrame:
    """key, motif, strand, hit_start, hit_end (0-based, half open, on the forward strand), matched.

    A palindromic site is found on both strands. The motifs are a short list in
    the plan; rows without any motif are dropped before they are expanded.
    """
    u, length = F.upper(F.col(dna)), F.length(dna)

    def named(found: Column, name: str, strand: str) -> Column:
        def hit(h: Column) -> Column:
            size = F.length(h["matched"])
            start = h["start"] if strand == "+" else length - h["start"] - size
            return F.struct(
                F.lit(name).alias("motif"),
                F.lit(strand).alias("strand"),
                start.alias("hit_start"),
                (start + size).alias("hit_end"),
                h["matched"].alias("matched"),
            )

        return F.transform(found, hit)

    parts = []
    for name, pattern, both in motifs:
        parts.append(named(_hits(u, F.lit(pattern)), name, "+"))
        if both:
            parts.append(named(_hits(seq.reverse_complement(u), F.lit(pattern)), name, "-"))
    forward = "|".join(p for _, p, _ in motifs)
    both_ways = "|".join([forward, *[_reverse(p) for _, p, b in motifs if b]])
    some = sequences.where(u.rlike(both_ways))
    return some.select(key, F.explode(F.flatten(F.array(*parts))).alias("h")).select(key, "h.*")


def _reverse(pattern: str) -> str:
    return pattern[::-1].translate(str.maketrans("ACGT", "TGCA"))


def repaired(sequences: DataFrame, key: str, dna: str, weight: dict[str, float], motifs=MOTIFS) -> DataFrame:
    """key, ``dna``, rounds and has_hits: motifs removed by synonymous codons, the protein unchanged.

    ``key`` must be unique. In each round every hit is tried by itself: of all
    synonymous exchanges in its codons that leave fewer bases in motifs around
    it, the one that leaves fewest, of those the one with the largest w_i. A
    sequence's best exchanges are made at once, those too near an earlier one in
    the next round, until none is left; ``rounds`` counts the rounds that changed
    the sequence. Hits that no single exchange lessens remain.
    """
    either = "|".join([*[p for _, p, _ in motifs], *[_reverse(p) for _, p, b in motifs if b]])
    synonyms = seq.literal_map_of_arrays(
        {c: [s for s in seq.FAMILIES[a] if s != c] for c, a in seq.CODE.items() if a != "*"}
    )

    def in_motifs(text: Column) -> Column:
        return F.length(text) - F.length(F.regexp_replace(text, either, ""))

    def apart(made: Column, e: Column) -> Column:
        last = F.try_element_at(made, F.lit(-1))
        near = last.isNotNull() & (e["start"] < last["stop"] + 2 * MARGIN)
        return F.when(near, made).otherwise(F.concat(made, F.array(e)))

    state = keep(sequences.select(key, F.upper(F.col(dna)).alias("dna"), F.lit(0).alias("rounds"), F.lit(True).alias("open")), "repair")
    settled: DataFrame | None = None
    while True:
        hits = state.where(F.col("open") & F.col("dna").rlike(either)).select(key, "dna", F.explode(_hits(F.col("dna"), F.lit(either))).alias("h"))
        hit = hits.select(key, "dna", F.col("h.start").alias("start"), F.length("h.matched").alias("size"))
        indexes = F.sequence(seq.first_codon(F.col("start")), seq.last_codon(F.col("start") + F.col("size")))
        at = hit.select("*", F.explode(indexes).alias("i")).withColumn("codon", F.substring("dna", F.col("i") * 3 + 1, F.lit(3)))
        options = at.select("*", F.explode(F.try_element_at(synonyms, F.col("codon"))).alias("other"))

        def around(text: Column) -> Column:
            first = F.greatest(F.lit(1), F.col("start") + 1 - MARGIN)
            return F.substring(text, first, F.col("start") + F.col("size") + MARGIN + 1 - first)

        new = seq.replace_codon(F.col("dna"), F.col("i"), F.col("other"))
        tried = options.select(key, "start", "size", "i", "other", in_motifs(around(F.col("dna"))).alias("before"),
                               in_motifs(around(new)).alias("left"))
        rank = F.struct("left", -seq.by_codon(weight, F.col("other")), "i", "other")
        exchange = F.struct("start", (F.col("start") + F.col("size")).alias("stop"), "i", "other")
        best = tried.where("left < before").groupBy(key, "start").agg(F.min_by(exchange, rank).alias("e"))
        chosen = best.groupBy(key).agg(F.array_sort(F.collect_list("e")).alias("es"))
        none = F.slice(F.col("es"), 1, 0)
        chosen = chosen.select(key, F.aggregate("es", none, apart).alias("es"))
        mended = F.aggregate("es", F.col("dna"), lambda s, e: seq.replace_codon(s, e["i"], e["other"]))
        tried_all = state.where("open").join(chosen, key, "left").withColumn("new", F.when(F.col("es").isNotNull(), mended))
        better = F.coalesce(in_motifs(F.col("new")) < in_motifs(F.col("dna")), F.lit(False))  # so that rounds end
        moved = tried_all.select(
            key,
            F.when(better, F.col("new")).otherwise(F.col("dna")).alias("dna"),
            (F.col("rounds") + better.cast("int")).alias("rounds"),
            better.alias("open"),
        )
        state = keep(moved, "repair")
        done = state.where("not open")
        settled = done if settled is None else settled.unionByName(done)
        if state.where("open").isEmpty():
            break
    return settled.select(key, F.col("dna").alias(dna), "rounds", F.col("dna").rlike(either).alias("has_hits"))
