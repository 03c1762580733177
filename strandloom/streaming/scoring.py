"""Sequences that arrive as a stream, scored against a genome's fixed usage table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions import seq
from strandloom.operators import metrics


def scored_stream(arriving: DataFrame, dna: str, weight: dict[str, float], host_gc: float) -> DataFrame:
    """The stream with cai_score, gc_content and composite_score; stateless, so any trigger and output mode will do."""
    gc = seq.gc_content(F.col(dna))
    cai = metrics.cai(F.col(dna), weight)
    score = metrics.composite_score(cai, gc, F.lit(None).cast("double"), host_gc)
    return arriving.withColumns({"cai_score": cai, "gc_content": gc, "composite_score": score})


def windowed_counts(arriving: DataFrame, time: str, kind: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows per time window and kind; rows that come later than ``late`` are left out."""
    return (
        arriving.withWatermark(time, late)
        .groupBy(F.window(time, width).alias("window"), kind)
        .agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("window_start"), kind, "n")
    )
