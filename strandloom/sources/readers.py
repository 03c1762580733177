"""Readers of genome, sequence and expression files; all scan with Spark's own text and CSV sources."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import seq
from strandloom.operators.parse_errors import plain_number
from strandloom.workspace import ship_package

#: Header names of an expression table, besides those that equal a column's name.
EXPRESSION_ALIASES = {
    "locus_tag": "locus_tag locus gene_id geneid gene id tag",
    "RPKM_rep1": "rpkm_rep1 rpkm_wt1 rpkm_1 rpkm1 rep1 wt1 replicate_1 replicate1",
    "RPKM_rep2": "rpkm_rep2 rpkm_wt2 rpkm_2 rpkm2 rep2 wt2 replicate_2 replicate2",
    "RPKM_rep3": "rpkm_rep3 rpkm_wt3 rpkm_3 rpkm3 rep3 wt3 replicate_3 replicate3",
    "RPKM_average": "rpkm_average rpkm_avg average_rpkm avg_rpkm mean_rpkm rpkm_mean average mean",
}


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """header, sequence of every FASTA record; records are split by Spark's text source."""
    records = spark.read.text(path, lineSep=">").where("trim(value) <> ''")
    lines = F.split(F.regexp_replace("value", "\r", ""), "\n", 2)
    sequence = F.regexp_replace(F.coalesce(F.get(lines, F.lit(1)), F.lit("")), r"\s", "")
    return records.select(F.trim(F.get(lines, F.lit(0))).alias("header"), sequence.alias("sequence"))


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """header, input_type, protein_seq, original_dna, problem: FASTA records as design targets.

    A sequence of A, C, G, T and N alone is DNA, any other a protein. ``problem``
    names what makes a record unfit; it is null for a sound one.
    """
    given = read_fasta(spark, path).withColumn("sequence", F.upper("sequence"))
    dna = seq.is_dna(F.col("sequence"))
    protein = F.when(dna, seq.expected_protein(F.col("sequence"))).otherwise(F.regexp_replace("sequence", r"\*+$", ""))
    typed = given.select(
        "header",
        F.when(dna, "dna").otherwise("protein").alias("input_type"),
        protein.alias("protein_seq"),
        F.when(dna, F.col("sequence")).alias("original_dna"),
    )
    problem = (
        F.when(F.length(F.coalesce("original_dna", F.lit(""))) % 3 != 0, "partial_codon")
        .when(F.col("protein_seq") == "", "empty")
        .when(F.col("original_dna").isNotNull() & F.contains("protein_seq", F.lit("*")), "inner_stop")
        .when(F.col("protein_seq").rlike(f"[{seq.AMBIGUOUS}]"), "ambiguous")
        .when(~F.col("protein_seq").rlike(f"^[{seq.RESIDUES}]+$"), "non_standard")
    )
    return typed.withColumn("problem", problem)


def read_expression(spark: SparkSession, path: str) -> DataFrame:
    """locus_tag and the four RPKM columns of a csv, tsv, txt or xlsx table; unreadable rows are dropped.

    Header names are matched without case, blanks and punctuation. Raises if a
    column is missing or a value is negative.
    """
    if path.lower().endswith((".xlsx", ".xlsm")):
        raw = spark.createDataFrame(_sheet(path))
    elif path.lower().endswith(".xls"):
        raise ValueError("old binary .xls tables can't be read; save the table as .xlsx or .csv")
    else:
        sep = "," if path.lower().endswith(".csv") else "\t"
        raw = spark.read.csv(path, sep=sep, header=True, quote='"', escape='"')
    keys = {re.sub(r"[^0-9a-z]", "", c.lower()): c for c in reversed(raw.columns)}
    chosen = []
    for name, aliases in EXPRESSION_ALIASES.items():
        found = [keys[k] for k in (re.sub(r"[^0-9a-z]", "", a) for a in aliases.split()) if k in keys]
        if not found:
            raise ValueError(f"the table has no column {name}; accepted names: {aliases.replace(' ', ', ')}")
        text = F.col(f"`{found[0]}`").cast("string")
        if name == "locus_tag":
            chosen.append(F.trim(text).alias(name))
        else:
            chosen.append(plain_number(text).try_cast("double").alias(name))
    table = raw.select(*chosen).dropna()
    numbers = [c for c in EXPRESSION_ALIASES if c != "locus_tag"]
    if table.where(F.least(*numbers) < 0).limit(1).count():
        raise ValueError("the table has negative RPKM values")
    return table


def _sheet(path: str) -> pd.DataFrame:
    """The first sheet of a workbook, which fits on one machine by its format's limit of a million rows."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(path) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            for item in ET.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns):
                shared.append("".join(t.text or "" for t in item.iter(f"{{{ns['m']}}}t")))
        name = min(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))
        rows = []
        for row in ET.fromstring(z.read(name)).iter(f"{{{ns['m']}}}row"):
            cells = {}
            for c in row.findall("m:c", ns):
                text = c.findtext("m:v", None, ns) or "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t"))
                column = 0
                for letter in re.match("[A-Z]+", c.get("r")).group():
                    column = column * 26 + ord(letter) - 64
                cells[column - 1] = shared[int(text)] if c.get("t") == "s" else text
            rows.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
    width = len(rows[0]) if rows else 0
    return pd.DataFrame([r[:width] + [None] * (width - len(r)) for r in rows[1:]], columns=rows[0] if rows else [], dtype=str)


_FEATURE = re.compile(r"^ {5}(\S+)\s+(\S.*)$")
_QUALIFIER = re.compile(r'^ {21}/(\w+)(?:=(.*))?$')


def _extract(location: str, dna: str) -> str | None:
    """The bases of a feature's location; null for one that points outside the record."""
    location = location.replace(" ", "")
    for word, reverse in (("complement(", True), ("join(", False), ("order(", False)):
        if location.startswith(word) and location.endswith(")"):
            inner = location[len(word) : -1]
            if reverse:
                part = _extract(inner, dna)
                return None if part is None else part[::-1].translate(str.maketrans("ACGTacgt", "TGCAtgca"))
            parts, depth, start = [], 0, 0
            for i, c in enumerate(inner + ","):
                depth += (c == "(") - (c == ")")
                if c == "," and depth == 0:
                    parts.append(_extract(inner[start:i], dna))
                    start = i + 1
            return None if None in parts else "".join(parts)
    m = re.fullmatch(r"[<>]?(\d+)(?:\.\.[<>]?(\d+))?", location)
    if not m or int(m[2] or m[1]) > len(dna) or int(m[1]) < 1:
        return None
    return dna[int(m[1]) - 1 : int(m[2] or m[1])]


def read_genbank(spark: SparkSession, path: str) -> DataFrame:
    """The coding sequences of GenBank records, in the columns of ``cds``; one record is one row of the text source."""
    ship_package(spark)
    records = spark.read.text(path, lineSep="\n//").where("value rlike 'LOCUS'")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for text in b["value"] for r in _coding(text.replace("\r", ""))]
            if rows:
                yield pd.DataFrame(rows)

    shape = "locus_tag string, gene string, product string, nucleotide_seq string, location string, contig string"
    found = records.mapInPandas(parse, shape)
    protein = F.regexp_replace(seq.translate(F.col("nucleotide_seq")), r"\*+$", "")
    return found.select(
        "locus_tag", "gene", "product", "nucleotide_seq", protein.alias("amino_acid_seq"),
        F.length("nucleotide_seq").alias("length_nt"), F.length(protein).alias("length_aa"), "location", "contig",
    )


def _coding(text: str) -> list[dict]:
    head, _, origin = text.partition("\nORIGIN")
    dna = re.sub(r"[^A-Za-z]", "", origin.partition("\n")[2]).upper()
    name = re.search(r"^LOCUS\s+(\S+)", head, re.M)
    contig = name[1] if name else "unknown"
    rows, feature, qualifier = [], None, None
    for line in head.partition("\nFEATURES")[2].split("\n")[1:]:
        if m := _FEATURE.match(line):
            feature, qualifier = {"kind": m[1], "location": m[2].strip()}, None
            rows.append(feature)
        elif feature is not None and (m := _QUALIFIER.match(line)):
            qualifier = m[1]
            feature.setdefault(qualifier, (m[2] or "").strip().strip('"'))
        elif feature is not None and line.startswith(" " * 21):
            if qualifier is None:
                feature["location"] += line.strip()
            else:
                feature[qualifier] += " " + line.strip().strip('"')
    fields = ("locus_tag", "gene", "product", "location")
    return [
        {k: f.get(k) for k in fields} | {"nucleotide_seq": _extract(f["location"], dna), "contig": contig}
        for f in rows
        if f["kind"] == "CDS"
    ]

