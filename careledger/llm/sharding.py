"""Consistent hashing with virtual nodes and bounded loads.

The hash space is a ring of GRID cells. Each shard owns ``vnodes`` points on it, snapped to distinct
cells; a key belongs to the first point at or clockwise after its cell. A shard that is full passes what it
can't take on to the next point clockwise. Only counts per cell (at most GRID numbers, whatever
the input) reach the driver, which walks the ring over them; rows follow the resulting plan by
their rank within their cell.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from careledger.llm.storage import materialize

#: Cells of the ring, a power of two. Bounds what is collected and broadcast.
GRID_BITS = 14
GRID = 1 << GRID_BITS
VNODES = 64
#: Lanes in which the rows of a cell are ranked.
LANES = 32


def ring_points(n_shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node, sorted; a taken cell makes a later point move on clockwise."""
    if n_shards * vnodes > GRID // 2:
        raise ValueError("too many virtual nodes for the ring")
    owner: dict[int, int] = {}
    for v in range(vnodes):
        for s in range(n_shards):
            cell = int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], "big") % GRID
            while cell in owner:
                cell = (cell + 1) % GRID
            owner[cell] = s
    return sorted(owner.items())


def walk_ring(counts: dict[int, int], points: list[tuple[int, int]], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Place the counts of each cell: (cell, first rank, end rank, shard, first slot) runs that cover every key.

    All keys first try their own point. What doesn't fit moves clockwise to the next point whose shard
    has room, together with all else that overflowed in that round, in ring order.
    """
    cells, shards = [c for c, _ in points], [s for _, s in points]
    home, at = {}, 0
    for cell in range(GRID):
        while at < len(cells) and cells[at] < cell:
            at += 1
        home[cell] = at % len(cells)
    used, runs = [0] * len(capacity), []
    waiting = [(home[c], c, 0, n) for c, n in sorted(counts.items()) if n]
    while waiting:
        later = []
        for point, cell, first, end in waiting:
            while used[shards[point]] == capacity[shards[point]]:
                point = (point + 1) % len(points)
            s = shards[point]
            take = min(end - first, capacity[s] - used[s])
            runs.append((cell, first, first + take, s, used[s]))
            used[s] += take
            if first + take < end:
                later.append(((point + 1) % len(points), cell, first + take, end))
        waiting = later
    return runs


def cell_of(key: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 64 - GRID_BITS).cast("int")


def _row_hash(df: DataFrame) -> Column:
    """A hash of all columns of a row that can be hashed."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()])


def bounded_ring_shards(df: DataFrame, key: str, n_shards: int, vnodes: int = VNODES) -> DataFrame:
    """``df`` with shard (int) and slot (long, gapless from 0 in each shard); counts differ by one at most.

    Rows of a cell follow one another by a hash of the whole row in LANES lanes, so that a key, null included, which holds a large
    part of all rows is ranked by many tasks; rows alike in all columns are interchangeable. Reruns agree. An empty table gives no rows.
    Other columns are kept whatever their names; columns named shard or slot are replaced.
    """
    columns = [c for c in df.columns if c not in ("shard", "slot")]
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")
    tie = _row_hash(df)
    keyed = df.select(row, F.xxhash64(F.col(key)).alias("at"), tie.alias("tie"), cell_of(F.col(key)).alias("cell"), F.pmod(F.xxhash64(tie), F.lit(LANES)).alias("lane"))
    spark = df.sparkSession
    # At most GRID * LANES counts; of them the driver sees the GRID sums of cells only.
    lanes = materialize(keyed.groupBy("cell", "lane").agg(F.count(F.lit(1)).alias("n")), "ring-lanes")
    counts = {r[0]: r[1] for r in lanes.groupBy("cell").agg(F.sum("n")).collect()}
    total = sum(counts.values())
    capacity = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    runs = walk_ring(counts, ring_points(n_shards, vnodes), capacity)
    plan = spark.createDataFrame(runs, "cell int, first long, end long, shard int, slot0 long")
    before = lanes.select("cell", "lane", (F.sum("n").over(Window.partitionBy("cell").orderBy("lane")) - F.col("n")).alias("before"))
    order = Window.partitionBy("cell", "lane").orderBy("at", "tie")
    ranked = keyed.withColumn("nth", F.row_number().over(order).cast("long") - 1).join(before, ["cell", "lane"]).withColumn("rank", F.col("before") + F.col("nth"))
    # The plan has at most GRID runs plus a few splits per shard, whatever the size of df.
    placed = ranked.join(F.broadcast(plan), "cell").filter((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")))
    return placed.select(*[F.col(f"row.`{c}`") for c in columns], "shard", (F.col("slot0") + F.col("rank") - F.col("first")).alias("slot"))
