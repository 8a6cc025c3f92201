"""Sharding by a consistent-hash ring with bounded loads, in native operations.

Shards have virtual nodes on a ring of ``CELLS`` cells; a document's id says
its cell, and the next virtual node clockwise is its home.  A full shard takes
no more: what overflows goes on clockwise to the next shard with room.  The
capacities add up to the number of rows, so counts are at most one apart.

Documents are ranked within groups of a cell.  A cell has one group, or as many
as share its documents out so that none has much more than one in ``GROUPS`` of
all, by a hash of the whole row; so one frequent id spreads over many groups.
Only the counts of the cells and of the groups, ``CELLS`` and ``CELLS + GROUPS``
at most whatever the input, reach the driver; there the walk along the ring
turns them into ranges of ranks for each shard, and the documents meet those
ranges in a broadcast join.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import copies_numbered, saved

CELLS, GROUPS, VIRTUAL_NODES = 4096, 65_536, 64
#: Documents of a group at least, before a cell is divided.
GROUP_ROWS = 1_000


def _cell(name: str) -> int:
    return int(hashlib.md5(name.encode()).hexdigest()[:8], 16) % CELLS


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[list[int]]:
    """For every cell the shards in the order in which they are met clockwise."""
    nodes: list[list[int]] = [[] for _ in range(CELLS)]
    for s in range(shards):
        for v in range(virtual_nodes):
            nodes[_cell(f"shard {s} node {v}")].append(s)
    walk: list[list[int]] = [[] for _ in range(CELLS)]
    order: list[int] = []
    for i in range(2 * CELLS - 1, -1, -1):  # twice around, as the ring is closed
        here = sorted(set(nodes[i % CELLS]))
        order = here + [s for s in order if s not in here]
        walk[i % CELLS] = order
    return walk


def ranges(counts: dict[tuple[int, int], int], shards: int) -> list[tuple[int, int, int, int, int, int]]:
    """``(cell, part, low, high, shard, first_slot)``: ranks ``low`` to
    ``high`` - 1 of a group go to ``shard``, with slots from ``first_slot``."""
    walk = ring(shards)
    total = sum(counts.values())
    groups = sorted(counts)
    demand = [0] * shards
    for cell, part in groups:
        demand[walk[cell][0]] += counts[cell, part]
    room = [total // shards] * shards
    for s in sorted(range(shards), key=lambda s: (-demand[s], s))[: total % shards]:
        room[s] += 1  # the fullest homes get the odd rows
    slot, out, over = [0] * shards, [], []

    def put(group: tuple[int, int], low: int, s: int, n: int) -> int:
        n = min(n, room[s])
        if n:
            out.append((*group, low, low + n, s, slot[s]))
            room[s] -= n
            slot[s] += n
        return n

    for group in groups:
        n = put(group, 0, walk[group[0]][0], counts[group])
        if n < counts[group]:
            over.append((group, n))
    for group, low in over:
        for s in walk[group[0]][1:]:
            low += put(group, low, s, counts[group] - low)
            if low == counts[group]:
                break
    return out


def cell_of(id_: Column) -> Column:
    """The cell of an id (of null: that of the word)."""
    name = F.coalesce(id_.cast("string"), F.lit("null"))
    return (F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long") % CELLS).cast("int")


def sharded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, size`` (UTF-8 bytes of the
    text and 1), ``text_crc32, law`` (``rows``), ``shard, slot`` (from 0 without
    gaps in each shard) and ``grown_shard`` (null: under bounded loads the other
    rows decide too).

    Null text counts as empty; very long texts are read whole; null ids have one
    home.  Equal rows are counted
    before they are dealt and numbered after it.  Further columns are not read.
    Empty input: no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    key = ["doc_id", "size", "text_crc32"]
    rows = saved(rows.groupBy(*key).agg(F.count("*").alias("copies")).withColumn("cell", cell_of(F.col("doc_id"))), "shard-rows")
    loads = [(r.cell, r.n) for r in rows.groupBy("cell").agg(F.sum("copies").alias("n")).collect()]
    most = max(GROUP_ROWS, sum(n for _, n in loads) // GROUPS)
    parts = spark.createDataFrame([(c, -(-n // most)) for c, n in loads], "cell int, parts long")
    rows = rows.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64(*key), F.col("parts")).cast("int")).drop("parts")
    counts = {(r.cell, r.part): r.n for r in rows.groupBy("cell", "part").agg(F.sum("copies").alias("n")).collect()}
    plan = spark.createDataFrame(ranges(counts, shards), "cell int, part int, low long, high long, shard int, first_slot long")

    order = Window.partitionBy("cell", "part").orderBy(*key)
    end = F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = rows.withColumn("end", end).withColumn("begin", F.col("end") - F.col("copies"))
    met = ranked.join(F.broadcast(plan), ["cell", "part"]).filter("begin < high AND low < end")
    # slots of the range's first rank and of the one after its last
    first = F.col("first_slot") + F.greatest("begin", "low") - F.col("low")
    n = F.least("end", "high") - F.greatest("begin", "low")
    each = copies_numbered(met.select(*key, "shard", first.alias("first"), (first + n).alias("last")), F.col("first"), F.col("last"), "slot")
    return each.select(*key, F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
