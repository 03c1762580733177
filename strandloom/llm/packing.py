"""Documents into containers of fixed capacity, by sum-of-squares packing.

Items are dealt to lots of bounded size by hash; each lot is packed on its own,
placing every item where the sum of the squared counts of open containers per
residual gap becomes smallest. Containers that end with much room left are
opened again, and their items pooled across lots and packed anew.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.tokens import FOLDER, VOCABULARY, token_counts
from strandloom.workspace import keep, ship_package

CAPACITY = 2048
#: Items a lot has on average (one task packs one lot), rounds of pooling, and the room that makes a container pool.
LOT, ROUNDS, LOOSE = 20_000, 3, 8


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The container number of each item, in the given order, and the room left in each container.

    ``open_at[g]`` containers have gap g. Moving one from gap g to g - s changes
    the sum of squares by 2 (open_at[g - s] - open_at[g] + 1); full and empty
    containers don't count.
    """
    open_at = np.zeros(capacity + 1, dtype=np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins = np.empty(len(sizes), dtype=np.int64)
    room: list[int] = []
    for i, s in enumerate(sizes):
        if s == 0:  # needs no room: the newest container, whatever its gap
            if not room:
                room.append(capacity)
                stacks[capacity].append(0)
                open_at[capacity] += 1
            bins[i] = len(room) - 1
            continue
        gap = capacity
        cost = 2 * open_at[capacity - s] + 1 if s < capacity else 0
        left = np.flatnonzero(open_at[s:])
        if len(left):
            change = 2 * (open_at[left] - open_at[left + s] + 1)
            if left[0] == 0:
                change[0] = 1 - 2 * open_at[s]
            k = int(change.argmin())
            if change[k] <= cost or left[k] + s == capacity:
                gap = int(left[k]) + int(s)
        if open_at[gap]:
            b = stacks[gap].pop()
            open_at[gap] -= 1
        else:
            b = len(room)
            room.append(capacity)
        bins[i] = b
        room[b] = gap - int(s)
        if room[b] > 0:
            stacks[room[b]].append(b)
            open_at[room[b]] += 1
    return bins, np.array(room, dtype=np.int64)


def _pack_lot(capacity: int, key: str, round_no: int):
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        order = rows.sort_values(["tokens", key, "piece_no"], ascending=[False, True, True], kind="stable")
        order = order.reset_index(drop=True)
        bins, room = sum_of_squares(order["tokens"].to_numpy(), capacity)
        order["container"] = f"r{round_no}-{order['lot'].iloc[0]}-" + pd.Series(bins).astype(str)
        order["room"] = room[bins]
        return order.drop(columns="lot")

    return pack


def pack_items(
    items: DataFrame, key: str, capacity: int = CAPACITY, lot: int = LOT, rounds: int = ROUNDS
) -> DataFrame:
    """items: key, piece_no, first_token, tokens (below ``capacity``); adds container and room."""
    ship_package(items.sparkSession)
    done: list[DataFrame] = []
    pool = items
    shape = items.schema.simpleString()[7:-1] + ",container:string,room:bigint"
    for i in range(rounds):
        lots = max(1, -(-pool.count() // lot))
        dealt = pool.withColumn("lot", F.pmod(F.xxhash64(key, "piece_no", F.lit(i)), F.lit(lots)))
        # few bytes and much work: as many tasks as lots, up to the cores, which adaptive execution would merge into one
        tasks = min(lots, max(1, pool.sparkSession.sparkContext.defaultParallelism) * 4)
        dealt = dealt.repartition(tasks, "lot")
        packed = keep(dealt.groupBy("lot").applyInPandas(_pack_lot(capacity, key, i), shape), "packed")
        loose = packed.where(F.col("room") > LOOSE)
        if i == rounds - 1 or loose.select("container").distinct().limit(2).count() < 2:
            done.append(packed)
            break
        done.append(packed.where(F.col("room") <= LOOSE))
        pool = loose.select(*items.columns)
    result = done[0]
    for d in done[1:]:
        result = result.unionByName(d)
    return result


def pack_documents(
    documents: DataFrame,
    *,
    key: str,
    text: str,
    capacity: int = CAPACITY,
    vocabulary: str = f"{FOLDER}/{VOCABULARY}",
    lot: int = LOT,
) -> DataFrame:
    """key, piece_no, first_token, n_tokens, container, room: every document in one container, whole.

    Only a document of more than ``capacity`` tokens is split: into pieces that
    fill a container each, and a rest that is packed like any other item. A
    null or empty text has no tokens and goes to some container in use. Rows
    that repeat a key are packed each; a null key is a key like any other. An
    empty table gives an empty result. Other columns are ignored.
    """
    sizes = keep(token_counts(documents, key, text, vocabulary), "tokens")
    pieces = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / capacity)).cast("int")
    cut = sizes.select(key, "n_tokens", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece_no"))
    first = F.col("piece_no") * F.lit(capacity).cast("bigint")
    cut = cut.select(
        key,
        "piece_no",
        first.alias("first_token"),
        F.least(F.col("n_tokens") - first, F.lit(capacity)).alias("tokens"),
    )
    whole = F.concat_ws("-", F.lit("full"), F.col(key).cast("string"), F.col("piece_no"), F.monotonically_increasing_id())
    full = cut.where(F.col("tokens") == capacity).select(
        "*", whole.alias("container"), F.lit(0).cast("bigint").alias("room")
    )
    packed = pack_items(cut.where(F.col("tokens") < capacity), key, capacity, lot)
    return full.unionByName(packed).withColumnRenamed("tokens", "n_tokens")
