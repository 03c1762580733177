import json
from datetime import datetime, timedelta

import pytest

from strandloom.operators.drift import schema_drift

SCHEMA = "source string, file_name string, delivered_at timestamp, rec_no int, record string"


@pytest.fixture(scope="module")
def aliases(spark):
    rows = [("locus_tag", "locus_tag"), ("locus_tag", "gene_id"), ("RPKM_rep1", "rpkm_rep1"), ("batch", "batch_no")]
    return spark.createDataFrame(rows, "canonical string, alias string")


def feed(spark, files, source="s"):
    start = datetime(2024, 1, 1)
    rows = [
        (source, name, start + timedelta(days=d), i, r if isinstance(r, str) or r is None else json.dumps(r))
        for d, (name, records) in enumerate(files)
        for i, r in enumerate(records)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def changes(df, aliases):
    return {tuple(r)[1:] for r in schema_drift(df, aliases).changes.collect()}


def test_each_kind_of_change(spark, aliases):
    df = feed(spark, [
        ("z", [{"locus_tag": "a", "RPKM_rep1": 1.5}]),
        ("y", [{"Gene Id": "a", "RPKM_rep1": "1.5"}, {"Gene Id": "b", "RPKM_rep1": "2"}, {"Gene Id": "c", "RPKM_rep1": 3}]),
        ("x", [{"Gene Id": "a", "batch_no": 1}]),
        ("w", [{"gene id": 7, "batch_no": None, "new": True}]),
    ])
    assert changes(df, aliases) == {
        ("y", "locus_tag", "renamed"), ("y", "RPKM_rep1", "retyped"), ("x", "RPKM_rep1", "removed"),
        ("x", "batch", "added"), ("w", "locus_tag", "renamed"), ("w", "locus_tag", "retyped"), ("w", "new", "added"),
    }
    records = {(r["file_name"], r["rec_no"]): r for r in schema_drift(df, aliases).records.collect()}
    assert records["y", 0]["RPKM_rep1"] == 1.5 and records["w", 0]["locus_tag"] == "7"
    assert records["x", 0]["batch"] == "1" and len(records) == 6


def test_gaps_repeats_and_broken_records(spark, aliases):
    df = feed(spark, [("a", [{"locus_tag": "x"}] * 3), ("b", ["not json", None, "[1]"]), ("c", [{"locus_tag": "x"}])])
    assert changes(df, aliases) == {("b", "locus_tag", "removed"), ("c", "locus_tag", "added")}
    spans = schema_drift(df, aliases).lifespans.collect()
    assert sorted((r["first_file"], r["last_file"]) for r in spans) == [("a", "a"), ("c", "c")]


def test_json_types(spark, aliases):
    values = ["a", 1, True, [1], {"k": 1}, 1.5e300]
    df = feed(spark, [(str(i), [{"batch": v, "batch.x": 1}]) for i, v in enumerate(values)])
    assert {c[0] for c in changes(df, aliases) if c[2] == "retyped"} == {"1", "2", "3", "4", "5"}


def test_two_sources_ties_and_empty(spark, aliases):
    one = feed(spark, [("a", [{"batch": 1}]), ("b", [{"note": "n"}])], "s")
    other = feed(spark, [("c", [{"batch": 1}])], None)
    found = schema_drift(one.unionByName(other).selectExpr("*", "1 as seq", "2 as value"), aliases).changes
    assert {r["file_name"] for r in found.collect()} == {"b"}
    empty = schema_drift(spark.createDataFrame([], SCHEMA), aliases)
    assert empty.changes.count() == 0 and empty.records.count() == 0 and empty.lifespans.count() == 0


def test_rest_failed_casts_and_null_sources(spark, aliases):
    files = [("a", [{"locus_tag": "x", "RPKM_rep1": 1.5, "new": 1}]), ("b", [{"gene_id": "y", "locus_tag": "z", "RPKM_rep1": "none"}])]
    found = schema_drift(feed(spark, files, None), aliases)
    # of two keys of one field, each once in the file, the last by name stands for it
    assert {tuple(r) for r in found.changes.collect()} == {(None, "b", "new", "removed"), (None, "b", "RPKM_rep1", "retyped")}
    rows = {r["file_name"]: r for r in found.records.collect()}
    assert rows["a"]["rest"] == {"new": "1"} and rows["a"]["RPKM_rep1"] == 1.5
    assert rows["b"]["RPKM_rep1"] is None and {rows["b"]["locus_tag"], *rows["b"]["rest"].values()} == {"y", "z"}
    assert [tuple(r) for r in found.failed_casts.collect()] == [(None, "b", 0, "RPKM_rep1", "none")]
