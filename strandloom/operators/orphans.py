"""References to keys that don't exist, found by keyed state kept over time slices.

``OrphanState`` is incremental: each slice's references probe the index of the
parents that arrived so far, arriving parents resolve (as ``late``) the orphans
that wait for their key, and the slice's deletions reopen the references that
they no longer cover. Between slices the state lies in durable tables, and
after each slice its counts are taken.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.workspace import keep

#: The characters that Unicode counts as white space.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def clean_key(tag: Column) -> Column:
    """The key without surrounding whitespace; blank ones become null."""
    bare = F.btrim(tag, F.lit(BLANKS))
    return F.when(bare != "", bare)


@dataclass
class OrphanState:
    """Pending and settled orphans, and the counts after each slice.

    References are (ref_table, row_id, key, at), parents (key, added_at,
    retired_at). A reference is sound if some parent of its key holds
    ``added_at <= at < retired_at``; a null retired_at is open, a null added_at
    has always held. Slices come in order of time and hold the references whose
    ``at`` lies in them.
    """

    waiting: DataFrame | None = None
    settled: list[DataFrame] = field(default_factory=list)
    counts: list[DataFrame] = field(default_factory=list)
    until: list[int | None] = field(default_factory=list)  # the slices' ends, in microseconds

    def apply(
        self, references: DataFrame, living: DataFrame, deleted: DataFrame, arrived: DataFrame, arriving: DataFrame
    ) -> None:
        """One slice of references and parents.

        ``living``: parents that hold at some time of the slice; ``deleted``:
        those of them retired in it; ``arrived``: all up to its end;
        ``arriving``: those that arrive in it.
        """
        r, p = references.alias("r"), living.alias("p")
        begun = (F.col("r.key") == F.col("p.key")) & (_since(F.col("p.added_at")) <= F.col("r.at"))
        # Probe: a parent of the key had arrived; it may be deleted within the slice.
        resolved = r.join(p, begun, "left_semi")
        open_now = r.join(p, begun, "left_anti")
        # Deletions of the slice reopen what no other parent covers.
        ended = deleted.select("key").distinct()
        touched = keep(resolved.join(ended, "key", "left_semi").select("ref_table", "row_id", "key", "at"), "touched")
        covers = begun & (F.col("p.retired_at").isNull() | (F.col("r.at") < F.col("p.retired_at")))
        reopened = touched.alias("r").join(p, covers, "left_anti")

        first = arrived.groupBy("key").agg(F.min(_since(F.col("added_at"))).alias("first_at"))
        orphans = open_now.select("ref_table", "row_id", "key", "at").unionByName(reopened).join(first, "key", "left")
        reason = (
            F.when(F.col("first_at").isNull(), F.lit(None).cast("string"))
            .when(F.col("at") < F.col("first_at"), "late")
            .otherwise("deleted")
        )
        judged = keep(orphans.select("ref_table", "row_id", "key", "at", reason.alias("reason")), "orphans")
        self.settled.append(judged.where("reason is not null and at is not null"))
        still = judged.where("reason is null").drop("reason")

        if self.waiting is not None:
            # Arriving parents resolve what waited for them: those references came before their parent.
            keys = arriving.select("key").distinct()
            late = self.waiting.join(keys, "key", "left_semi").where("at is not null").withColumn("reason", F.lit("late"))
            self.settled.append(keep(late.select("ref_table", "row_id", "key", "at", "reason"), "resolved"))
            still = still.unionByName(self.waiting.join(keys, "key", "left_anti"))
        self.waiting = keep(still.select("ref_table", "row_id", "key", "at"), "waiting")
        rows = self.snapshot().groupBy("ref_table", "reason").agg(F.count_distinct("row_id").alias("n_orphans"))
        self.counts.append(keep(rows.withColumn("slice", F.lit(len(self.counts))), "counts"))

    def snapshot(self) -> DataFrame:
        """ref_table, row_id, key, at, reason; what still waits is ``missing``."""
        if self.waiting is None:
            raise ValueError("no slice has been applied")
        rows = self.waiting.withColumn("reason", F.lit("missing"))
        for part in self.settled:
            rows = rows.unionByName(part)
        return rows


def _since(added_at: Column) -> Column:
    return F.coalesce(added_at, F.lit("0001-01-01 00:00:00").cast("timestamp"))


def references_of(table: DataFrame, name: str, row_id: str, key: str, at: str) -> DataFrame:
    return table.select(
        F.lit(name).alias("ref_table"),
        F.col(row_id).cast("bigint").alias("row_id"),
        clean_key(F.col(key)).alias("key"),
        F.col(at).alias("at"),
    )


def orphan_references(references: DataFrame, parents: DataFrame, slices: int = 4) -> DataFrame:
    """Every reference without a valid parent, with its reason: ref_table, row_id, key, at, reason.

    ``references``: ref_table, row_id, key, at. ``parents``: key, added_at,
    retired_at, in any number of rows per key. Other columns are ignored.
    Keys are compared without surrounding whitespace; null and blank keys refer
    to nothing. ``missing``: no parent ever had the key; ``late``: the time is
    before the first added_at; ``deleted``: no parent of the key holds then. A
    reference without time is ``missing`` or not reported. Repeated rows are
    reported once. Empty tables give an empty result.
    """
    return orphan_state(references, parents, slices).snapshot().distinct()


def orphan_state(references: DataFrame, parents: DataFrame, slices: int = 4) -> OrphanState:
    """The state after all slices of the time line, which hold about equally many references each.

    The cuts are approximate quantiles over all references. ``counts`` holds the
    orphans by table and reason as they stood after each slice.
    """
    cuts = []
    if slices > 1:
        points = [i / slices for i in range(1, slices)]
        found = references.agg(F.percentile_approx(F.unix_micros("at"), points, 1000)).first()[0] or []
        cuts = sorted(set(found))
    number = F.lit(0)
    for c in cuts:
        number = number + F.coalesce(F.unix_micros("at") >= c, F.lit(False)).cast("int")
    refs = references.select("ref_table", "row_id", clean_key(F.col("key")).alias("key"), "at", number.alias("slice"))
    refs = keep(refs.where("key is not null"), "references", partition_by="slice")
    owners = parents.select(clean_key(F.col("key")).alias("key"), "added_at", "retired_at").where("key is not null")
    owners = keep(owners.distinct(), "parents")

    state = OrphanState()
    bounds = [None, *cuts, None]
    added, retired = F.unix_micros("added_at"), F.unix_micros("retired_at")
    for i in range(len(cuts) + 1):
        lower, upper = bounds[i], bounds[i + 1]
        arrived = owners if upper is None else owners.where(added.isNull() | (added < upper))
        arriving, living, deleted = arrived, arrived, retired.isNotNull()
        if lower is not None:
            arriving = arrived.where(added >= lower)
            living = arrived.where(retired.isNull() | (retired > lower))
        if upper is not None:
            deleted &= retired < upper
        state.apply(refs.where(F.col("slice") == i).drop("slice"), living, living.where(deleted), arrived, arriving)
        state.until.append(upper)
    return state


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """ref_table, month, reason, n_orphans of the result of ``orphan_references``."""
    return orphans.groupBy("ref_table", F.date_format("at", "yyyy-MM").alias("month"), "reason").agg(
        F.count("*").alias("n_orphans")
    )
