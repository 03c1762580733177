import csv
import io
import re

import pytest

from strandloom.operators.parse_errors import NUMBER, read_lines

SCHEMA = "raw_id bigint, file_name string, line_no int, raw_line string"
HEADER = "locus_tag,RPKM_rep1,rep2,Rpkm-Rep3,rpkm mean"


@pytest.fixture(scope="module")
def aliases(spark):
    rows = [("locus_tag", "locus_tag"), ("RPKM_rep1", "rpkm_rep1"), ("RPKM_rep2", "rep2"), ("RPKM_rep3", "rpkm_rep3"),
            ("RPKM_average", "rpkm_mean"), ("note", "note")]
    return spark.createDataFrame(rows, "canonical string, alias string")


def parsed(spark, aliases, lines, header=HEADER, name="a.csv"):
    rows = [(1, name, 1, header)] + [(i + 2, name, i + 2, x) for i, x in enumerate(lines)]
    found = read_lines(spark.createDataFrame(rows, SCHEMA), aliases)
    errors = {r["raw_id"] - 2: r["reason"] for r in found.errors.collect()}
    return errors, {r["raw_id"] - 2: r for r in found.records.collect()}


CASES = [
    ("T1,1,2,3,4", None), ("T1,1,2,3", "column_count"), ("T1,1,2,3,4,5", "column_count"), ('"T1,1,2,3,4', "quoting"),
    ('T"1,1,2,3,4', "quoting"), ('"T""1",1,2,3,4', None), ('"T,1",1,2,3,4', None), ('"T1"x,1,2,3,4', "quoting"),
    (' "T1",1,2,3,4', "quoting"), (" ,1,2,3,4", "value"), ('"",1,2,3,4', "value"), ('T1,"1,234.5",2,3,4', None),
    ("T1, 1 ,2.,.5,1e-3", None), ("T1,-1,2,3,4", "value"), ("T1,+1,2,3,4", "value"), ("T1,1.2.3,2,3,4", "value"),
    ("T1,NaN,2,3,4", "value"), ("T1,1d,2,3,4", "value"), ("T1,.,2,3,4", "value"), ("T1,1e,2,3,4", "value"),
    ("T1,1,2,3,4\r", None), ("T1,1,2,3,", "value"), ("", "column_count"), (None, "column_count"), ('""""', "column_count"),
    ('"T1",1,2,3,"4"', None), ('T1,", 1",2,3,"4 ,"', None), ('T1," 1 2",2,3,4', "value"), ('"T1",1,2,"3"",4', "quoting"),
]


def test_reasons(spark, aliases):
    errors, records = parsed(spark, aliases, [c for c, _ in CASES], "﻿" + HEADER + "\r")
    assert errors == {i: r for i, (_, r) in enumerate(CASES) if r}
    assert set(records) == {i for i, (_, r) in enumerate(CASES) if not r}
    assert records[11]["RPKM_rep1"] == 1234.5 and records[12]["RPKM_rep3"] == 0.5
    assert records[5]["locus_tag"] == 'T"1' and records[20]["RPKM_average"] == 4.0


def test_against_a_csv_reader(spark, aliases):
    lines = ['"a,""b""",1,2,3,4', 'x,"1","2",3,4', "y,1,2,3,4"]
    _, records = parsed(spark, aliases, lines)
    for i, line in enumerate(lines):
        cells = next(csv.reader(io.StringIO(line)))
        assert records[i]["locus_tag"] == cells[0] and records[i]["RPKM_rep1"] == float(cells[1])


def test_tabs_missing_headers_and_odd_columns(spark, aliases):
    errors, records = parsed(spark, aliases, ["T1\t1\t2\t3\t4", "T1,1,2,3,4"], HEADER.replace(",", "\t"), "a.tsv")
    assert errors == {1: "column_count"} and records[0]["RPKM_rep2"] == 2.0
    rows = [(1, "n.csv", 2, "a,1,2,3,4", "x"), (1, "n.csv", 2, "a,1,2,3,4", "y")]
    clash = spark.createDataFrame(rows, SCHEMA + ", error string").selectExpr("*", "1 as sep", "2 as cells")
    found = read_lines(clash, aliases)
    assert [tuple(r) for r in found.errors.collect()] == [(1, "column_count")] and found.records.count() == 0
    empty = read_lines(spark.createDataFrame([], SCHEMA), aliases)
    assert empty.errors.count() == 0 and empty.records.count() == 0


def test_long_lines(spark, aliases):
    errors, records = parsed(spark, aliases, ['"' + '""' * 50_000 + '",1,2,3,4', "x" * 200_000 + ",1,2,3,4"])
    assert errors == {} and len(records[0]["locus_tag"]) == 50_000


def test_number_pattern():
    assert all(re.match(NUMBER, x) for x in ("0", "1.", ".5", "1e5", "1.5E-3"))
    assert not any(re.match(NUMBER, x) for x in ("", ".", "e5", "1e", "1 2", "0x1", "inf"))
