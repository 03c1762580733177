"""The N best items of every group, by descending score bands.

Rows are range-partitioned into score bands once. Bands are worked from the
top; a band's rows whose group is filled already fall to an anti-join, and the
open groups take what they still need by exact rank, ties included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.workspace import keep

#: Lower ends of the bands, as shares of all rows from the top; the last band takes the rest.
BANDS = (1 / 16, 1 / 4, 1 / 2)
#: A group with more than this share of all rows is hot: at most 1/share groups are, so they may be broadcast.
HOT_SHARE = 1 / 1000


def top_n(
    rows: DataFrame,
    *,
    group: str,
    item: str,
    score: str,
    n: int,
    bands: tuple[float, ...] = BANDS,
) -> DataFrame:
    """group, item, score, rank: each group's n items by score downwards, then item upwards.

    Repeated rows of an item are one item; if its scores differ, the highest
    counts. Rows with a null group or item, or a null or NaN score, aren't
    ranked. Groups with fewer scored items give them all; n < 1 gives none.
    Infinite scores rank like any other. An empty table gives an empty result.
    Other columns, whatever their names, are ignored.
    """
    scored = rows.select(
        F.col(group).alias("group"), F.col(item).alias("item"), F.col(score).cast("double").alias("score")
    ).where("group is not null and item is not null and score is not null and not isnan(score)")

    scored = scored.groupBy("group", "item").agg(F.max("score").alias("score"))  # spreads hot groups over their items
    scored = keep(scored, "items")
    points = scored.agg(F.percentile_approx("score", [1 - b for b in bands], 1000)).first()[0] or []
    lows = sorted(set(points), reverse=True)
    band = F.lit(len(lows))
    for i, low in reversed(list(enumerate(lows))):
        band = F.when(F.col("score") >= low, F.lit(i)).otherwise(band)
    banded = keep(scored.withColumn("band", band), "banded", partition_by="band")

    sizes = banded.groupBy("group").agg(F.count("*").alias("n"))
    total = banded.count()
    hot = keep(sizes.where(F.col("n") > HOT_SHARE * total).select("group"), "hot")

    best = Window.partitionBy("group").orderBy(F.col("score").desc(), "item")
    taken: DataFrame | None = None  # what the bands so far gave: group, item, score, rank
    for i in range(len(lows) + 1):
        open_rows = banded.where(F.col("band") == i).select("group", "item", "score")
        if taken is None:
            offset = None
        else:
            have = taken.groupBy("group").agg(F.max("rank").alias("have"))
            have = keep(have, "have")
            filled = have.where(F.col("have") >= n).select("group")
            # Hot groups first: that anti-join is a broadcast of at most 1/HOT_SHARE keys and moves no row.
            hot_filled = filled.join(hot, "group", "left_semi")
            open_rows = open_rows.join(F.broadcast(hot_filled), "group", "left_anti").join(filled, "group", "left_anti")
            offset = have.where(F.col("have") < n)
        # Spark limits the groups by this rank before the shuffle too, so a hot group arrives as n rows a task.
        ranked = open_rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)
        if offset is not None:
            ranked = (
                ranked.join(offset, "group", "left")
                .withColumn("rank", F.col("rank") + F.coalesce("have", F.lit(0)))
                .where(F.col("rank") <= n)
                .drop("have")
            )
        part = keep(ranked.select("group", "item", "score", "rank"), "band")
        taken = part if taken is None else taken.unionByName(part)
    return taken.select(
        F.col("group").alias(group), F.col("item").alias(item), F.col("score").alias(score), F.col("rank").alias("rank")
    )
