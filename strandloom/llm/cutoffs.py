"""Score cutoffs per source that keep a target share of its records.

A sketch with guaranteed rank error brackets each source's cutoff; the records
above the bracket are counted, and only bracketed values are sorted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.workspace import keep

#: The quantiles asked of the sketch, and its rank error (as a share of the source's records).
GRID, ERROR = 200, 1 / 400
#: A source with more distinct values in its bracket than this is bracketed again, within the bracket.
MOST_BRACKETED = 500_000


@dataclass
class Cutoffs:
    cutoffs: DataFrame
    kept: DataFrame


def _brackets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: source, rank (from the top, 1-based). Gives source, low, high around that rank."""
    points = [i / GRID for i in range(GRID + 1)]
    sketch = rows.groupBy("source").agg(
        F.count("*").alias("n"), F.percentile_approx("value", points, round(1 / ERROR)).alias("points")
    )
    at = (F.col("n") - F.col("rank") + 1) / F.col("n")
    low = F.floor((at - 2 * ERROR) * GRID)
    high = F.ceil((at + 2 * ERROR) * GRID)
    below, above = F.lit(float("-inf")), F.lit(float("inf"))
    return (
        sketch.join(wanted, "source")
        .where("rank <= n")
        .select(
            "source",
            F.when(low <= 0, below).otherwise(F.try_element_at("points", (low + 1).cast("int"))).alias("low"),
            F.when(high >= GRID, above).otherwise(F.try_element_at("points", (high + 1).cast("int"))).alias("high"),
        )
    )


def fraction_cutoffs(
    records: DataFrame,
    targets: DataFrame,
    *,
    source: str,
    key: str,
    value: str,
    percent: str,
    most_bracketed: int = MOST_BRACKETED,
) -> Cutoffs:
    """The cutoff of every source and the records at or above it.

    A source's cutoff is the largest of its values v such that 100 x (its
    records with value >= v) >= percent x (all its counted records).

    * cutoffs: source, cutoff, n_records (counted), n_kept.
    * kept: source, key, value of every record at or above its source's cutoff.

    Rows with the same source and key are one record, with its largest value.
    Records with a null key, and null, NaN and negative values don't count.
    Sources that are null, not in ``targets``, without percent or with one over
    100 have no cutoff and keep nothing; one of 0 or less keeps the records with
    the largest value. If a source has several percents the largest holds. Equal
    values are kept or left together. Empty tables give empty results. Other
    columns, whatever their names, are ignored.
    """
    v = F.col(value).cast("double")
    counted = records.select(F.col(source).alias("source"), F.col(key).alias("key"), v.alias("value")).where(
        "source is not null and key is not null and value >= 0 and not isnan(value)"
    )
    rows = keep(counted.groupBy("source", "key").agg(F.max("value").alias("value")), "scored")

    share = F.max(F.col(percent).cast("decimal(20,6)"))
    shares = targets.groupBy(F.col(source).alias("source")).agg(share.alias("percent")).where("percent <= 100")
    sizes = rows.groupBy("source").agg(F.count("*").alias("n_records"))
    rank = F.greatest(F.lit(1), F.ceil(F.col("percent") * F.col("n_records") / 100).cast("bigint"))
    wanted = keep(sizes.join(shares, "source").select("source", "n_records", rank.alias("rank")), "wanted")

    brackets = keep(_brackets(rows, wanted.select("source", "rank")), "brackets")
    while True:
        # Count what lies above each bracket, and check that the bracket holds the rank.
        placed = rows.join(brackets, "source")
        counts = placed.groupBy("source").agg(
            F.count_if(F.col("value") > F.col("high")).alias("n_above"),
            F.count_if(F.col("value") >= F.col("low")).alias("n_from_low"),
        )
        holds = (F.col("n_above") < F.col("rank")) & (F.col("rank") <= F.col("n_from_low"))
        checked = counts.join(wanted, "source").join(brackets, "source")
        checked = keep(
            checked.select(
                "source",
                F.when(holds, F.col("rank") - F.col("n_above")).otherwise(F.col("rank")).alias("rank"),
                F.when(holds, F.col("low")).otherwise(F.lit(float("-inf"))).alias("low"),
                F.when(holds, F.col("high")).otherwise(F.lit(float("inf"))).alias("high"),
            ),
            "checked",
        )
        inside = (F.col("value") >= F.col("low")) & (F.col("value") <= F.col("high"))
        bracketed = rows.join(checked, "source").where(inside)
        distinct = keep(bracketed.groupBy("source", "rank", "value").agg(F.count("*").alias("n")), "bracketed")
        crowded = distinct.groupBy("source").agg(F.count("*").alias("n")).where(F.col("n") > most_bracketed)
        crowded = [] if most_bracketed is None else crowded.limit(1).collect()
        if not crowded:
            break
        # Too many values to sort in one task: a narrower bracket within the bracket.
        narrower = _brackets(bracketed.select("source", "value"), checked.select("source", "rank"))
        narrower = keep(narrower.select("source", F.col("low").alias("low2"), F.col("high").alias("high2")), "narrower")
        joined = checked.join(narrower, "source").select(
            "source", F.greatest("low", "low2").alias("low"), F.least("high", "high2").alias("high")
        )
        tighter = keep(joined, "brackets")
        shrunk = tighter.join(checked, "source").where(
            (tighter["low"] > checked["low"]) | (tighter["high"] < checked["high"])
        )
        if not shrunk.limit(1).collect():
            break  # nothing narrower is left to find
        brackets = tighter

    down = Window.partitionBy("source").orderBy(F.col("value").desc())
    running = distinct.withColumn("n_down", F.sum("n").over(down))
    found = running.where(F.col("n_down") >= F.col("rank")).groupBy("source").agg(F.max("value").alias("cutoff"))
    found = keep(found, "cutoffs")
    kept = rows.join(found, "source").where(F.col("value") >= F.col("cutoff"))
    n_kept = kept.groupBy("source").agg(F.count("*").alias("n_kept"))
    cutoffs = found.join(wanted, "source").join(n_kept, "source")
    return Cutoffs(cutoffs.select("source", "cutoff", "n_records", "n_kept"), kept.select("source", "key", "value"))
