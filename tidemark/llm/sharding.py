"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Keys and virtual nodes lie on a ring of CELLS arcs. A key belongs to the first virtual node at or after it, clockwise.
A shard that has reached its bound, (1 + slack) times the mean load, is full: what would overflow it continues
clockwise to the next shard that is not. Only the load of each arc (CELLS numbers, whatever the input) reaches the
driver, which walks the ring once; the plan that comes back cuts an arc into stretches of its running load where it
overflows, so one hot key may be spread over several shards. No shard exceeds its bound by more than a row for each
stretch that it takes, and hence none falls below 1 - (shards - 1) * slack of the mean by more than that.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint, position_in_group

CELLS = 1 << 14
VIRTUAL_NODES = 128
SLACK = 0.002
END = 1 << 62


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[tuple[int, int]]:
    """(cell, shard) of the virtual nodes, clockwise. A shard's own nodes depend on its number only."""
    at = lambda s, v: int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big") % CELLS
    return sorted((at(s, v), s) for s in range(shards) for v in range(virtual_nodes))


def walk(loads: dict[int, int], shards: int, slack: float = SLACK, virtual_nodes: int = VIRTUAL_NODES) -> list[tuple[int, int, int, int]]:
    """(cell, low, high, shard): rows of the cell whose running load is in [low, high) go to the shard."""
    nodes = ring(shards, virtual_nodes)
    bound = (1 + slack) * sum(loads.values()) / shards
    free = [bound] * shards
    plan = []
    for cell, load in sorted(loads.items()):
        low, k = 0, bisect.bisect_left(nodes, (cell, -1))
        for step in range(len(nodes)):
            shard = nodes[(k + step) % len(nodes)][1]
            take = load - low if free[shard] >= load - low else int(free[shard])
            if take > 0 or not load:
                plan.append((cell, low, low + take, shard))
                free[shard] -= take
                low += take
            if low >= load:
                break
        if low < load:  # what rounding left
            plan.append((cell, low, load, max(range(shards), key=free.__getitem__)))
        plan[-1] = (*plan[-1][:2], END, plan[-1][3])  # rows without size may come last
    return plan


def shard(rows: DataFrame, key: str, size: str, shards: int = 24, slack: float = SLACK, virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """Adds shard (int) and slot (long, gapless from 0 in each shard) to rows.

    A null key is one key like any other, and rows that share a key, however many, may be cut between neighbouring
    shards; a null size counts as 0. An empty table gives an empty table. rows must have no columns named _*.
    """
    spark = rows.sparkSession
    at = F.pmod(F.xxhash64(F.lit("ring"), key), F.lit(CELLS)).cast("int")
    base = checkpoint(rows.select("*", at.alias("_cell"), F.monotonically_increasing_id().alias("_row")))
    loads = {r[0]: r[1] for r in base.groupBy("_cell").agg(F.sum(F.coalesce(F.col(size), F.lit(0)).cast("long"))).collect()}  # CELLS rows at most
    plan = spark.createDataFrame(walk(loads, shards, slack, virtual_nodes), "_cell int, _low long, _high long, shard int")
    run = position_in_group(base, ["_cell"], [key], "_row", "_before", of=size, salts=8)
    # At most CELLS + shards * (nodes of a shard) rows of 28 bytes.
    placed = run.join(F.broadcast(plan), (run["_cell"] == plan["_cell"]) & (run["_before"] >= plan["_low"]) & (run["_before"] < plan["_high"]))
    placed = checkpoint(placed.select(*[run[c] for c in rows.columns], run["_row"], "shard"))
    return position_in_group(placed, ["shard"], [key], "_row", "slot").drop("_row")
