"""Filling fixed-capacity containers: cost-balanced packing with few sequences open at a time.

An item's cost is linear plus quadratic in its tokens, as attention is. Items go, longest first,
each to the open sequence of least cost that still has room for it. Balance over all sequences
spreads the unused space evenly, so that no item fits into it; over ``OPEN`` sequences at a time
the cost decides as well, and each group is full before the next is opened.

Items are spread evenly over shards of about ``SHARD_ITEMS``, so no task sees more of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ligaquery.session import cut

SHARD_ITEMS = 8_000
#: Cost of n tokens: LINEAR * n + n * n.
LINEAR = 2048.0
#: Sequences open at a time: more balance the costs of more sequences, fewer leave less space unused.
OPEN = 4
SHARD = "pack_name STRING, capacity INT, shard INT, rid BIGINT, piece_no INT, n_tokens INT, container INT"


def place(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The sequence of each item, numbered without holes; ``sizes`` descend, are positive and at most ``capacity``.

    ``OPEN`` sequences are filled at a time, or as many as the rest needs at least: the items left go,
    longest first, to the open sequence of least cost that has room, and those that fit in none wait for
    the next sequences.
    """
    n, size, falling = len(sizes), sizes.tolist(), -sizes
    where, nxt, used, left = np.empty(n, np.int64), list(range(n + 1)), 0, int(sizes.sum())

    def waiting(i: int) -> int:
        """The first item from ``i`` on that is not placed; the steps to it are shortened."""
        while nxt[i] != i:
            nxt[i] = nxt[nxt[i]]
            i = nxt[i]
        return i

    first = waiting(0)
    while first < n:
        k = min(OPEN, -(-left // capacity))
        room, cost, i = [capacity] * k, [0.0] * k, first
        while i < n:
            most = max(room)
            if size[i] > most:
                i = waiting(int(np.searchsorted(falling, -most)))
                continue
            s = size[i]
            b = min((c, j) for j, c in enumerate(cost) if room[j] >= s)[1]
            where[i], nxt[i], room[b], left = used + b, i + 1, room[b] - s, left - s
            cost[b] += LINEAR * s + s * s
            i = waiting(i + 1)
        used, first = used + k, waiting(first)
    return np.unique(where, return_inverse=True)[1]


def _shard(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["n_tokens", "rid", "piece_no"], ascending=[False, True, True])
    return rows.assign(container=place(rows.n_tokens.to_numpy(np.int64), int(rows.capacity.iloc[0])).astype(np.int32))


def pack(items: DataFrame, row_id: str, size: str, packs: list[tuple[str, int]]) -> DataFrame:
    """(pack_name, capacity, container_id, row_id, piece_no, first_token, n_tokens) for each pack.

    An item over the capacity is cut into full pieces, each a container of its own, and a rest that
    is packed like any item. An item without tokens (also a null size) has one row with 0 tokens
    and a null container. Packs with a null or non-positive capacity are left out. Equal items and
    repeated ids are items of their own; an empty table gives an empty result.
    """
    packs = [(n, c) for n, c in packs if c is not None and c > 0]
    rows = cut(items.select(F.col(row_id).alias("id"), F.coalesce(F.col(size), F.lit(0)).cast("int").alias("size")))
    rows = rows.withColumn("rid", F.monotonically_increasing_id())  # on a checkpoint: the same in each pass
    shards = max(1, -(-rows.count() // SHARD_ITEMS))
    each = F.array(*(F.struct(F.lit(n).cast("string").alias("pack_name"), F.lit(c).cast("int").alias("capacity")) for n, c in packs))
    each = each if packs else F.array().cast("array<struct<pack_name:string,capacity:int>>")
    spread = rows.select("id", "rid", "size", F.inline(each))
    n_full = F.expr("size div capacity").cast("int")
    pieces = F.when(F.col("size") % F.col("capacity") > 0, n_full).otherwise(n_full - 1)
    cut_up = spread.select("*", F.explode(F.sequence(F.lit(0), F.greatest(pieces, F.lit(0)))).alias("piece_no"))
    cut_up = cut_up.withColumn("n_tokens", F.least("capacity", F.col("size") - F.col("piece_no") * F.col("capacity")))
    open_ = (F.col("n_tokens") > 0) & (F.col("n_tokens") < F.col("capacity"))
    shard = F.pmod(F.xxhash64("rid"), F.lit(shards)).cast("int")
    slim = cut_up.where(open_).select("pack_name", "capacity", shard.alias("shard"), "rid", "piece_no", "n_tokens")
    placed = slim.groupBy("pack_name", "capacity", "shard").applyInPandas(lambda pdf: _shard(pdf), SHARD)
    placed = placed.select("pack_name", "rid", "piece_no", F.concat_ws("-", F.lit("s"), "shard", "container").alias("container_id"))
    alone = F.when(F.col("n_tokens") > 0, F.concat_ws("-", F.lit("f"), "rid", "piece_no"))
    whole = cut_up.where(~open_).withColumn("container_id", alone)
    both = cut_up.where(open_).join(placed, ["pack_name", "rid", "piece_no"]).unionByName(whole)
    first = F.col("piece_no").cast("bigint") * F.col("capacity")
    return both.select("pack_name", "capacity", "container_id", F.col("id").alias(row_id), "piece_no", first.alias("first_token"), "n_tokens")


def fill(packed: DataFrame) -> DataFrame:
    """Per pack: containers, tokens, the least possible number of containers and the unused share."""
    boxes = packed.where("container_id IS NOT NULL").groupBy("pack_name", "capacity", "container_id").agg(F.sum("n_tokens").alias("n"))
    done = boxes.groupBy("pack_name", "capacity").agg(F.count(F.lit(1)).alias("containers"), F.sum("n").alias("tokens"), F.max("n").alias("fullest"))
    least = F.ceil(F.col("tokens") / F.col("capacity"))
    return done.withColumns({"least_containers": least, "unused_share": F.round(1 - F.col("tokens") / (F.col("containers") * F.col("capacity")), 6)})
