import random
import zipfile

import pytest
from pyspark.sql import functions as F

from strandloom.functions import seq
from strandloom.operators import design
from strandloom.plans import pipeline
from strandloom.sources import readers, sinks
from strandloom.streaming.scoring import scored_stream, windowed_counts


def gene(n, rng):
    sense = [c for c in seq.CODE if seq.CODE[c] != "*"]
    return "ATG" + "".join(rng.choice(sense) for _ in range(n)) + "TAA"


@pytest.fixture(scope="module")
def genome(tmp_path_factory):
    rng = random.Random(1)
    genes = [gene(200, rng) for _ in range(12)]
    dna, features = "a" * 10, ""
    for i, g in enumerate(genes):
        start = len(dna) + 1
        if i == 3:
            g = g[::-1].translate(str.maketrans("ACGT", "TGCA"))
        dna += g.lower()
        place = f"{start}..{start + len(g) - 1}"
        place = f"complement({place})" if i == 3 else f"join({start}..{start + 99},{start + 100}..{start + len(g) - 1})" if i == 4 else place
        features += f'     CDS             {place}\n                     /locus_tag="G_{i:03}"\n'
        features += f'                     /product="30S ribosomal\n                     protein {i}"\n'
    features += '     CDS             5..99999\n                     /locus_tag="OUT"\n     gene            1..9\n'
    lines = "".join(f"{i + 1:9} {dna[i : i + 60]}\n" for i in range(0, len(dna), 60))
    path = tmp_path_factory.mktemp("genome") / "host.gb"
    path.write_text(f"LOCUS       MOCK1 {len(dna)} bp\nFEATURES             Location/Qualifiers\n{features}ORIGIN\n{lines}//\n")
    return str(path), genes


def test_genbank(spark, genome):
    path, genes = genome
    rows = {r["locus_tag"]: r for r in readers.read_genbank(spark, path).collect()}
    assert len(rows) == 13 and rows["OUT"]["nucleotide_seq"] is None
    assert all(rows[f"G_{i:03}"]["nucleotide_seq"] == g for i, g in enumerate(genes))
    assert rows["G_001"]["product"] == "30S ribosomal protein 1" and rows["G_001"]["contig"] == "MOCK1"


def test_expression_files(spark, tmp_path):
    header = "Gene ID{0}rep1{0}WT2{0}replicate_3{0}mean RPKM"
    for name, sep in (("t.csv", ","), ("t.txt", "\t")):
        (tmp_path / name).write_text(header.format(sep) + "\n" + sep.join(["g1", '"1,503.5"', "2", "3", "4"]) + "\n"
                                     + sep.join(["g2", "x", "2", "3", "4"]) + "\n")
        found = readers.read_expression(spark, str(tmp_path / name)).collect()
        assert [tuple(r) for r in found] == [("g1", 1503.5, 2.0, 3.0, 4.0)]
    (tmp_path / "bad.csv").write_text("foo,bar\n1,2\n")
    with pytest.raises(ValueError, match="no column"):
        readers.read_expression(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "neg.csv").write_text(header.format(",") + "\ng,-1,2,3,4\n")
    with pytest.raises(ValueError, match="negative"):
        readers.read_expression(spark, str(tmp_path / "neg.csv"))
    names = ["locus", "rep1", "rep2", "rep3", "mean"]
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cells = lambda r, vs: f'<row r="{r}">' + "".join(
        f'<c r="{chr(65 + i)}{r}" t="inlineStr"><is><t>{v}</t></is></c>' for i, v in enumerate(vs)) + "</row>"
    with zipfile.ZipFile(tmp_path / "t.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{cells(1, names)}{cells(2, ['g', 1, 2, 3, 4])}</sheetData></worksheet>")
    assert [tuple(r) for r in readers.read_expression(spark, str(tmp_path / "t.xlsx")).collect()] == [("g", 1.0, 2.0, 3.0, 4.0)]


def test_targets(spark, tmp_path):
    (tmp_path / "t.fa").write_text(">a one\nMKF\nLIL*\n>b\nATGAAATAA\n>c\nATGAA\n>d\nMXZ\n>e\nATGTAAATG\n>f\n\n")
    rows = {r["header"]: r for r in readers.read_targets(spark, str(tmp_path / "t.fa")).collect()}
    assert rows["a one"]["protein_seq"] == "MKFLIL" and rows["b"]["original_dna"] == "ATGAAATAA" and rows["b"]["problem"] is None
    assert {k: rows[k]["problem"] for k in "cdef"} == {"c": "partial_codon", "d": "ambiguous", "e": "inner_stop", "f": "empty"}


@pytest.mark.parametrize("mode", pipeline.MODES)
def test_run(spark, genome, tmp_path, mode):
    cds = readers.read_genbank(spark, genome[0]).withColumn("added_at", F.lit(None).cast("timestamp"))
    targets = spark.createDataFrame(
        [(0, "p one", "MKFLILVASGG", None), (1, "d/two", "MEFLAK", "ATGGAATTCCTTGCTAAATAA")],
        "target_idx int, header string, protein_seq string, original_dna string",
    )
    rule = pipeline.selection.Selection(min_length=300, fallback_genes=5)
    if mode == "harmonized":
        with pytest.raises(ValueError, match="protein"):
            pipeline.run(cds, targets, pipeline.Settings(mode=mode, n_variants=2, selection=rule))
        targets = targets.where("target_idx = 1")
    result = pipeline.run(cds, targets, pipeline.Settings(mode=mode, n_variants=2, selection=rule))
    rows = result.variants.collect()
    assert result.usage.count() == 64 and {r["variant_number"] for r in rows} <= {1, 2}
    assert {r["target_idx"] for r in rows} == ({1} if mode == "harmonized" else {0, 1})
    assert not any("GAATTC" in r["dna_sequence"] for r in rows)
    sinks.write_fasta(result.variants, str(tmp_path / "fa"))
    back = {r["header"].split()[0]: r["sequence"] for r in readers.read_fasta(spark, str(tmp_path / "fa")).collect()}
    stem = {"p one": "p", "d/two": "d_two"}
    assert back == {f"{stem[r['header']]}_variant_{r['variant_number']}": r["dna_sequence"] for r in rows}
    report = {r["target_idx"]: r for r in result.report.collect()}
    assert len(result.report.columns) == 20 and set(report) == {r["target_idx"] for r in rows}
    for r in report.values():
        assert r["n_variants"] == sum(v["target_idx"] == r["target_idx"] for v in rows)
        assert (r["original_cai"] is None) == (r["input_type"] == "protein")
        if r["qc_pass"]:
            assert r["homopolymer_count"] == r["repeat_count"] == 0
    assert {r["target_idx"] for r in result.comparison.collect()} == {1}
    assert result.unresolved.count() == sum(r["forbidden_motif_count"] for r in report.values())
    sinks.write_recommended(result.variants, str(tmp_path / "best"))
    best = [r["sequence"] for r in readers.read_fasta(spark, str(tmp_path / "best")).collect()]
    assert best == [r["dna_sequence"] for r in sorted(rows, key=lambda r: r["target_idx"]) if r["variant_number"] == 1]
    sinks.write_tsv(result.report, str(tmp_path / "tsv"))
    sinks.write_summary(result.usage, result.report, str(tmp_path / "md"))
    sinks.write_fasta_per_target(result.variants, str(tmp_path / "each"))


def test_settings_and_failures(spark, genome):
    with pytest.raises(ValueError):
        pipeline.Settings(n_variants=0)
    cds = readers.read_genbank(spark, genome[0]).withColumn("added_at", F.lit(None).cast("timestamp"))
    none = spark.createDataFrame([], "target_idx int, header string, protein_seq string, original_dna string")
    fake = spark.createDataFrame([(f"F{i}", 1.0) for i in range(20)], "locus_tag string, RPKM_average double")
    with pytest.raises(ValueError, match="tags"):
        pipeline.run(cds, none, expression=fake)
    with pytest.raises(ValueError, match="valid"):
        pipeline.run(cds.limit(0), none)


def test_streams(spark, tmp_path):
    df = spark.createDataFrame([("a", "ATGCTGCTT", "2024-01-01 00:10:00"), ("b", "ATG", "2024-01-01 03:00:00")], "k string, s string, t string")
    df.withColumn("t", F.to_timestamp("t")).write.parquet(str(tmp_path / "in"))
    weight = {c: 1.0 for c in seq.CODE}
    stream = spark.readStream.schema("k string, s string, t timestamp").parquet(str(tmp_path / "in"))
    q = scored_stream(stream, "s", weight, 0.5).writeStream.format("memory").queryName("scored").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r["k"]: r["cai_score"] for r in spark.table("scored").collect()} == {"a": 1.0, "b": 1.0}
    q = windowed_counts(stream, "t", "k").writeStream.format("memory").queryName("counts").outputMode("append").trigger(
        availableNow=True).start()
    q.awaitTermination(120)
    counts = {r["k"]: r["n"] for r in spark.table("counts").collect()}
    assert counts == {"a": 1}  # the window of the latest row is still open


def test_harmonized_ranks_of_the_sequence_itself_and_of_another_genome(spark):
    # leucine: CTG most, then TTA, then CTC
    dna = "CTG" * 3 + "TTA" * 2 + "CTC" + "TAA"
    df = spark.createDataFrame([(1, dna)], "k int, d string")
    host = {c: 0.01 for c in seq.CODE} | {"TTG": 1.0, "CTA": 0.5, "CTT": 0.25}
    own = design.own_ranks(df, "k", "d")
    made = df.join(own, "k").select(design.harmonized(F.col("d"), F.col("ranks"), host, F.lit("s"), 0.0)).first()[0]
    assert made == "TTG" * 3 + "CTA" * 2 + "CTT" + "TAA"
    source = {c: 0.01 for c in seq.CODE} | {"CTC": 1.0, "CTG": 0.5, "TTA": 0.25}
    made = df.select(design.harmonized(F.col("d"), source, host, F.lit("s"), 0.0)).first()[0]
    assert made == "CTA" * 3 + "CTT" * 2 + "TTG" + "TAA"


def test_settings_files(tmp_path):
    (tmp_path / "s.toml").write_text('mode = "max_cai"\n[scoring]\ncai = 0.7\n[limits]\nmax_run = 9\n')
    made = pipeline.settings_from(pipeline.read_settings(str(tmp_path / "s.toml")))
    assert made.mode == "max_cai" and made.scoring.cai == 0.7 and made.scoring.gc == 0.3 and made.limits.max_run == 9
    (tmp_path / "s.json").write_text('{"n_variants": 5, "selection": {"min_length": 1}}')
    made = pipeline.settings_from(pipeline.read_settings(str(tmp_path / "s.json")))
    assert made.n_variants == 5 and made.selection.min_length == 1 and made.mode == "weighted"
    with pytest.raises(ValueError, match="settings"):
        pipeline.settings_from({"scoring": {"unheard_of": 1}})
