"""Delimited text lines into typed records, and the lines that can't be read.

Every line is cut into cells by native array expressions, cells are exploded to
(row, column, value), joined to a table of rules, and the violations aggregated
per line; the clean lines are what an anti-join with the errors leaves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.workspace import keep

#: The rule of each canonical field; the value is trimmed and, for numbers, freed of commas.
NUMBER = r"^(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
RULES = [
    ("locus_tag", "text", r"."),
    ("RPKM_rep1", "number", NUMBER),
    ("RPKM_rep2", "number", NUMBER),
    ("RPKM_rep3", "number", NUMBER),
    ("RPKM_average", "number", NUMBER),
]
REASONS = ("quoting", "column_count", "value")

_CELL = "\u0001"  # stands for a separator outside quotes; the same character in a line becomes U+FFFD
_EDGES = r"(?U)^[\s\x{feff}]+|[\s\x{feff}]+$"


def field_key(name: Column) -> Column:
    """A field name without case, blanks, punctuation and byte-order marks."""
    return F.lower(F.regexp_replace(name, r"[^\p{L}\p{N}]", ""))


def alias_keys(aliases: DataFrame) -> DataFrame:
    """One canonical name per normalised alias; of several, the first by name."""
    return (
        aliases.select(field_key(F.col("alias")).alias("field_key"), F.col("canonical"))
        .where("field_key is not null and canonical is not null")
        .groupBy("field_key")
        .agg(F.min("canonical").alias("canonical"))
    )


def trimmed(value: Column) -> Column:
    return F.regexp_replace(value, _EDGES, "")


def plain_number(value: Column) -> Column:
    """The text of a number without thousands commas and surrounding blanks."""
    return trimmed(F.regexp_replace(value, ",", ""))


def _quoting_holds(parts: Column, sep: Column) -> Column:
    # Cut at every quote: even parts lie outside quotes and must begin and end at a separator.
    last = F.size(parts) - 1

    def fits(part: Column, at: Column) -> Column:
        opens = (at == 0) | part.startswith(sep)
        closes = (at == last) | part.endswith(sep)
        return (at % 2 == 1) | (part == "") | (opens & closes)

    return (last % 2 == 0) & ((last == 0) | F.forall(F.transform(parts, fits), lambda ok: ok))


def _cells(parts: Column, sep: Column) -> Column:
    last = F.size(parts) - 1

    def piece(part: Column, at: Column) -> Column:
        doubled = (part == "") & (at > 0) & (at < last)
        outside = F.when(doubled, F.lit('"')).otherwise(F.replace(part, sep, F.lit(_CELL)))
        return F.when(at % 2 == 1, part).otherwise(outside)

    return F.split(F.array_join(F.transform(parts, piece), ""), _CELL, -1)


def cut_lines(lines: DataFrame) -> DataFrame:
    """raw_id, file_name, line_no, sound (quoting holds), cells."""
    sep = F.when(F.lower("file_name").endswith(".csv"), F.lit(",")).otherwise(F.lit("\t"))
    text = F.translate(F.regexp_replace(F.coalesce("raw_line", F.lit("")), r"\r\z", ""), _CELL, "�")
    parts = F.split(text, '"', -1)
    cut = lines.select("raw_id", "file_name", "line_no", sep.alias("sep"), parts.alias("parts"))
    return cut.select(
        "raw_id",
        "file_name",
        "line_no",
        _quoting_holds(F.col("parts"), F.col("sep")).alias("sound"),
        _cells(F.col("parts"), F.col("sep")).alias("cells"),
    )


def file_headers(cut: DataFrame, aliases: DataFrame) -> DataFrame:
    """file_name, fields: the canonical name (or null) of every column, in order."""
    first = cut.where("line_no = 1").groupBy("file_name").agg(F.min_by("cells", "raw_id").alias("cells"))
    names = first.select("file_name", F.posexplode("cells").alias("pos", "name"))
    known = names.withColumn("field_key", field_key(F.col("name"))).join(alias_keys(aliases), "field_key", "left")
    listed = F.array_sort(F.collect_list(F.struct("pos", "canonical")))
    return known.groupBy("file_name").agg(F.transform(listed, lambda x: x["canonical"]).alias("fields"))


@dataclass
class ParsedLines:
    records: DataFrame
    errors: DataFrame


def read_lines(lines: DataFrame, aliases: DataFrame) -> ParsedLines:
    """Split delivered lines into typed records and errors with their reason.

    ``lines`` needs raw_id, file_name, line_no and raw_line; other columns are
    ignored. Line 1 of each file is its header and belongs to neither result.

    * errors: raw_id, reason - the first of ``quoting``, ``column_count``, ``value``.
    * records: raw_id, file_name, line_no, locus_tag and the four RPKM columns as doubles.

    A null line counts as an empty one, and so has one blank field. A file
    without line 1 has no fields: all its lines fail with ``column_count``. A
    field that a header doesn't have is null in the records. Where several
    header columns mean one field, every one is checked and the first is taken.
    Rows that repeat a raw_id are one line if equal; if they differ, an error of
    any of them counts. Rows with a null raw_id can't be told apart: together they
    are one line for the errors, and they are no records. Empty tables give empty
    results.
    """
    spark = lines.sparkSession
    cut = cut_lines(lines)
    # written, so that its true size decides about a broadcast; lines needn't be shuffled by their file
    headers = keep(file_headers(cut_lines(lines.where("line_no = 1")), aliases), "headers")
    body = cut.where("line_no is null or line_no <> 1").join(headers, "file_name", "left")
    structure = F.when(~F.col("sound"), F.lit(0)).when(
        F.col("fields").isNull() | (F.size("cells") != F.size("fields")), F.lit(1)
    )
    checked = body.withColumn("structure", structure)

    rules = spark.createDataFrame(RULES, "canonical string, kind string, pattern string")
    pairs = F.when(F.col("structure").isNull(), F.arrays_zip("fields", "cells"))
    long = checked.select("raw_id", "structure", F.explode_outer(pairs).alias("cell")).select(
        "raw_id", "structure", F.col("cell.fields").alias("canonical"), F.col("cell.cells").alias("value")
    )
    ruled = long.join(F.broadcast(rules), "canonical", "left")  # five rules
    shown = F.when(F.col("kind") == "number", plain_number(F.col("value"))).otherwise(trimmed(F.col("value")))
    broken = F.col("pattern").isNotNull() & ~F.coalesce(F.rlike(shown, F.col("pattern")), F.lit(False))
    found = ruled.select("raw_id", F.coalesce("structure", F.when(broken, F.lit(2))).alias("error"))
    first = found.where("error is not null").groupBy("raw_id").agg(F.min("error").alias("error"))
    reason = F.element_at(F.array(*map(F.lit, REASONS)), F.col("error") + 1)
    errors = first.select("raw_id", reason.alias("reason"))

    def cell(field: str) -> Column:
        at = F.array_position("fields", F.lit(field))
        return F.when(at > 0, F.try_element_at("cells", at.cast("int")))

    # lines without raw_id can't be told apart: they are judged as one line, and none is a record
    clean = body.where("raw_id is not null").join(errors.select("raw_id"), "raw_id", "left_anti").dropDuplicates(["raw_id"])
    typed = [
        (trimmed(cell(name)) if kind == "text" else plain_number(cell(name)).try_cast("double")).alias(name)
        for name, kind, _ in RULES
    ]
    return ParsedLines(clean.select("raw_id", "file_name", "line_no", *typed), errors)
