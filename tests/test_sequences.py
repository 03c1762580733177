import math
import random

import pytest
from pyspark.sql import functions as F

from strandloom.functions import seq
from strandloom.operators import codon_usage as cu
from strandloom.operators import design, metrics, motifs, qc
from strandloom.plans import queries


def values(spark, column, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("s"))).collect()]


def test_scalars(spark):
    assert values(spark, seq.translate, "ATGGCNTAA", "atgaa", "", None) == ["MX*", "M", "", None]
    assert values(spark, seq.gc_content, "GCGC", "atgc", "", "NNGC") == [1.0, 0.5, 0.0, 0.5]
    assert values(spark, seq.reverse_complement, "ATGCN", "aT") == ["NGCAT", "At"]
    assert values(spark, seq.is_dna, "ACGTN", "MKV", "") == [True, False, False]
    assert values(spark, seq.expected_protein, "ATGTAA", "ATGTAATAA") == ["M", "M*"]
    assert values(spark, lambda s: seq.inner_stop(seq.translate(s)), "ATGTAA", "ATGTAAATG", "TAAATG") == [False, True, True]
    assert values(spark, seq.stops_early, "ATGTAA", "ATGTAAATG", "TAAATG", "ATAAGC") == [False, True, True, False]


def usage(spark, *genes):
    df = spark.createDataFrame([(g,) for g in genes], "nucleotide_seq string")
    return {r["codon"]: r for r in cu.codon_usage(df).collect()}


def test_usage_table(spark):
    found = usage(spark, "ATG" + "CTG" * 3 + "CTT" + "TAA")
    assert len(found) == 64 and found["CTG"]["w_i"] == 1.0 and found["CTT"]["w_i"] == pytest.approx(1 / 3)
    assert found["CTA"]["w_i"] == 0.01 and found["ATG"]["w_i"] == 1.0 and found["GCT"]["w_i"] == 0.01
    ala = usage(spark, "ATGGCTGCCGCAGCGTAA")
    assert sum(r["rscu"] for r in ala.values() if r["amino_acid"] == "A") == pytest.approx(4)


def test_adaptation(spark):
    w = {c: 1.0 for c in seq.CODE} | {"CTT": 0.5, "GCT": 0.0}
    assert values(spark, lambda s: metrics.cai(s, w), "ATGATG", "ATGA", "CTTCTTCTG") == [
        1.0, None, pytest.approx(math.exp(2 * math.log(0.5) / 3)),
    ]
    low = "".join(f[0] * 20 for a, f in seq.FAMILIES.items() if a != "*")
    every = "".join(c * 20 for c in seq.CODE if seq.CODE[c] != "*")
    df = spark.createDataFrame([("low", low), ("every", every)], "k string, s string")
    nc = {r["k"]: r["nc"] for r in metrics.effective_codons(df, "k", "s").collect()}
    assert nc["low"] <= 25 and nc["every"] > 50


def test_score(spark):
    row = spark.createDataFrame([(1.0, 0.5, None), (2.0, 0.0, -60.0)], "c double, g double, m double")
    got = [r[0] for r in row.select(metrics.composite_score(F.col("c"), F.col("g"), F.col("m"), 0.5)).collect()]
    assert got == [pytest.approx(1.0), pytest.approx(0.5)]


def test_motifs_found_and_repaired(spark):
    rng = random.Random(3)
    genes = ["ATG" + "".join(rng.choice([c for c in seq.CODE if seq.CODE[c] != "*"]) for _ in range(60)) + "TAA" for _ in range(30)]
    genes += ["ATGGAATTCCTTGCTAAATAA", "ATGGAGACCAAAATG", "ATGAAAAAAAAAAAATAA", "ATGATG"]
    df = spark.createDataFrame(list(enumerate(genes)), "k int, dna string")
    hits = {(r["k"], r["motif"], r["strand"], r["hit_start"], r["matched"]) for r in motifs.motif_hits(df, "k", "dna").collect()}
    assert {(30, "EcoRI", "+", 3, "GAATTC"), (30, "EcoRI", "-", 3, "GAATTC"), (31, "BsaI", "-", 3, "GGTCTC")} <= hits
    for k, name, strand, start, matched in hits:
        part = genes[k][start : start + len(matched)]
        assert part == (matched if strand == "+" else matched[::-1].translate(str.maketrans("ACGT", "TGCA")))
    w = {c: 1.0 for c in seq.CODE}
    fixed = {r["k"]: r for r in motifs.repaired(df, "k", "dna", w).collect()}
    before = {r["k"]: r[1] for r in df.select("k", seq.translate(F.col("dna"))).collect()}
    after = {r["k"]: r[1] for r in spark.createDataFrame([(k, r["dna"]) for k, r in fixed.items()], "k int, s string")
             .select("k", seq.translate(F.col("s"))).collect()}
    assert before == after and not fixed[30]["has_hits"] and fixed[33]["rounds"] == 0
    assert sum(r["has_hits"] for r in fixed.values()) < len({h[0] for h in hits})


def test_all_hits_of_a_sequence_are_repaired(spark):
    genes = ["ATG" + "GAATTCGCTGCTGCTGCTGCTGCTGCTGCT" * 9 + "TAA", "ATG" + "AAA" * 5 + "GCTGCT" * 5 + "GAATTCTAA",
             "ATGGAATTCGAATTCGGATCCAAGCTTTAA", "ATG" + "AAA" * 10 + "TAA"]
    df = spark.createDataFrame(list(enumerate(genes)), "k int, dna string")
    fixed = {r["k"]: r for r in motifs.repaired(df, "k", "dna", {c: 1.0 for c in seq.CODE}).collect()}
    assert len(fixed) == 4 and not any(r["has_hits"] for r in fixed.values()) and fixed[0]["rounds"] == 1
    after = spark.createDataFrame([(k, r["dna"]) for k, r in fixed.items()], "k int, s string")
    got = dict(after.select("k", seq.translate(F.col("s"))).collect())
    assert got == dict(df.select("k", seq.translate(F.col("dna"))).collect())


def test_design(spark):
    w = {c: 0.2 for c in seq.CODE} | {"CTG": 1.0, "AAA": 0.9}
    proteins = ["MLKLL*", "MKFLILVAS", "", None, "MXZ", "M*K"]
    df = spark.createDataFrame(list(enumerate(proteins)), "k int, p string")
    problems = [r[0] for r in df.orderBy("k").select(design.protein_problem(F.col("p"))).collect()]
    assert problems == [None, None, "empty", "empty", "ambiguous", "non_standard"]
    sound = df.where(design.protein_problem(F.col("p")).isNull())
    best = sound.select("k", "p", design.max_cai(F.col("p"), w).alias("dna"))
    assert best.first()["dna"] == "ATGCTGAAACTGCTGTAA"
    many = design.candidates(sound, 20).withColumn("dna", design.weighted(F.col("p"), w, F.concat_ws("|", "k", "candidate")))
    assert design.identity_violations(many, "dna", "p").count() == 0 and many.select("dna").distinct().count() > 20
    again = design.candidates(sound, 20).repartition(7).withColumn(
        "dna", design.weighted(F.col("p"), w, F.concat_ws("|", "k", "candidate")))
    assert many.exceptAll(again).count() == 0
    other = {c: 0.2 for c in seq.CODE} | {"TTA": 1.0}
    same = best.select("p", design.harmonized(F.col("dna"), w, other, F.lit("1"), noise=0.0).alias("dna"))
    assert same.first()["dna"].startswith("ATGTTA") and design.identity_violations(same, "dna", "p").count() == 0


def test_quality(spark):
    text = "AT" * 50 + "GC" * 30 + "AT" * 50
    df = spark.createDataFrame([("a", text), ("b", "ATGAAAAAAAATGC"), ("c", "ATGC"), ("d", None)], "k string, s string")
    limits = qc.Limits(gc_window=30, gc_deviation=0.2)
    gc = [t.count("G") + t.count("C") for t in (text[i : i + 30] for i in range(len(text) - 29))]
    found = {r["k"]: r for r in qc.gc_extremes(df, "k", "s", limits).collect()}
    assert found["a"]["min_gc"] == min(gc) / 30 and found["a"]["max_gc"] == max(gc) / 30 and found["c"]["min_gc"] == 0.5
    regions = qc.gc_regions(df, "k", "s", limits).collect()
    assert any(r["k"] == "a" and r["direction"] == "high" for r in regions)
    assert [tuple(r) for r in qc.homopolymers(df, "k", "s").collect()] == [("b", "A", 8, 3)]
    again = spark.createDataFrame([("r", "ATGATGATGATG" + "A" * 10 + "ATGATGATGATG")], "k string, s string")
    assert {r["kmer"]: (r["first_at"], r["second_at"]) for r in qc.repeats(again, "k", "s").collect()}["ATGATGATGATG"] == (0, 22)
    arms = spark.createDataFrame([("s", "GGCCAATTTTTTGGCC"), ("t", "A" * 40)], "k string, s string")
    assert {r["k"] for r in qc.stems(arms, "k", "s", qc.Limits(stem=4)).collect()} == {"s"}


def test_stems_stay_in_their_row(spark):
    rng = random.Random(12)
    genes = ["".join(rng.choice("ACGT") for _ in range(rng.choice([14, 15, 90, 200]))) for _ in range(60)]
    genes += ["gaattc" * 30, "A" * 150 + "T" * 9, "ACGTNN" * 9, "", None, genes[0]]
    df = spark.createDataFrame([(i // 2, g) for i, g in enumerate(genes)], "k int, s string")  # two rows a key
    found = qc.stems(df, "k", "s")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    wanted = []
    for i, g in enumerate(genes):
        head = (g or "").upper()[:150]
        arms = [head[j : j + 6] for j in range(len(head) - 5)]
        turned = [a[::-1].translate(str.maketrans("ACGT", "TGCA")) for a in arms]
        wanted += [(i // 2, a, b, arms[a]) for a in range(len(arms)) for b in range(a + 9, len(arms)) if arms[a] == turned[b]]
    assert sorted(map(tuple, found.collect())) == sorted(wanted)


def test_stem_codons_without_a_join(spark):
    genes = ["GAATTC" * 30, "GGCCAATTTTTTGGCC" * 3, "A" * 60]
    stems = qc.stems(spark.createDataFrame(list(enumerate(genes)), "k int, s string"), "k", "s")
    found = qc.stem_codons(stems, "k")
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    touched = {(r.k, s // 3 + d) for r in stems.collect() for s in (r.arm_start, r.partner_start) for d in range((s % 3 + 5) // 3 + 1)}
    assert touched and sorted(map(tuple, found.collect())) == sorted(x for x in touched if x[1])


def test_stem_codons_inside_their_row(spark):
    rng = random.Random(13)
    genes = ["".join(rng.choice("ACGT") for _ in range(rng.choice([14, 15, 90, 200]))) for _ in range(60)]
    genes += ["gaattc" * 30, "AT" * 90, "A" * 150 + "T" * 9, "ACGTNN" * 9, "GAATTCGAATTC", "", None]
    df = spark.createDataFrame(list(enumerate(genes)), "k int, s string")
    found = qc.stem_codons_of(df, "k", "s")
    wanted = qc.stem_codons(qc.stems(df, "k", "s"), "k")
    assert found.schema["codon_index"].dataType == wanted.schema["codon_index"].dataType
    assert wanted.count() and sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))


def test_query_stem_codons_makes_no_pairs(spark, data):
    plan = queries.queries()["stem_codons"](spark, data)._jdf.queryExecution().executedPlan().toString()
    # one exploded array, and no aggregate: the genes' keys are distinct
    assert plan.count("Generate explode") == 1 and "Aggregate" not in plan
