"""Minimum-cost-flow resharding: a stored table of shards is brought to new capacities by moving the fewest bytes.

A layout is a table of files, each a block of one shard: rows dealt by a number of their own, so equal rows and hot keys spread. From the sizes of the old
shards and the capacities of the new ones a flow says how many bytes go from where to where (staying costs nothing, moving its rate a byte). Each old shard's
bytes, in block order, are cut at the flow's amounts: blocks inside one piece stay or move whole, a block on a cut is split between rows. Only files of blocks
that move or are split are read and written again; the others stay where they are. The driver sees one row a shard and fewer than LARGE rows of large size.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tessera.llm import common

#: Blocks of a shard, or more if they would hold more than so many bytes or rows.
BLOCKS = 16
BLOCK_BYTES = 1 << 28
BLOCK_ROWS = 1 << 20
#: A row of more than 1 / LARGE of all bytes is placed by itself; there are fewer than LARGE of them.
LARGE = 1024


@dataclass
class Layout:
    """Shards as files: the stored rows (shard, round, block, place, upto, large, size, row), a table of files (path, shard, round, block, rows, bytes).

    round: the resharding that wrote the file, moved and written: bytes of rows whose shard it changed and bytes of rows it wrote again.
    """

    shards: int
    rows: DataFrame
    files: DataFrame
    round: int = 0
    moved: int = 0
    written: int = 0


FILE = ["shard", "round", "block"]


# --- the flow, on shard sizes --------------------------------------------------------------------------------------------


def min_cost_flow(supply: list[int], capacity: list[int], cost: np.ndarray) -> np.ndarray:
    """flow[i, j] of all supplies into capacities (no smaller in sum) at least cost, by successive shortest paths; whole numbers."""
    left, room = np.array(supply, np.int64), np.array(capacity, np.int64)
    if left.sum() > room.sum():
        raise ValueError("capacities are below the supplies")
    cost = np.asarray(cost, np.float64)
    flow = np.zeros(cost.shape, np.int64)
    rows, cols = np.arange(len(left)), np.arange(len(room))
    while left.any():
        near = np.where(left > 0, 0.0, np.inf)  # distance of each old shard in the residual graph, and of each new one
        far = np.full(len(room), np.inf)
        by, came = np.full(len(room), -1), np.full(len(left), -1)  # where each was reached from; changed by shorter ways only, so no cycle arises
        while True:
            way = near[:, None] + cost
            first = way.argmin(axis=0)
            better = way[first, cols] < far - 1e-9
            far[better], by[better] = way[first, cols][better], first[better]
            back = np.where(flow > 0, far[None, :] - cost, np.inf)
            first = back.argmin(axis=1)
            nearer = back[rows, first] < near - 1e-9
            near[nearer], came[nearer] = back[rows, first][nearer], first[nearer]
            if not better.any() and not nearer.any():
                break
        j = int(np.where(room > 0, far, np.inf).argmin())
        path, amount, at = [], int(room[j]), j
        while True:
            i = int(by[at])
            path.append((i, at, 1))
            if came[i] < 0:
                amount = min(amount, int(left[i]))
                break
            at = int(came[i])
            path.append((i, at, -1))
            amount = min(amount, int(flow[i, at]))
        for i, at, sign in path:
            flow[i, at] += sign * amount
        left[path[-1][0]] -= amount
        room[j] -= amount
    return flow


def targets(total: int, weights: list[float]) -> list[int]:
    """Whole numbers in proportion to the weights that add up to total."""
    ends = [int(total * c) for c in np.cumsum(weights) / sum(weights)]
    ends[-1] = total
    return [b - a for a, b in zip([0, *ends], ends, strict=False)]


def place_large(large: list[tuple], total: int, weights: list[float]) -> tuple[dict[tuple, int], list[int], list[int]]:
    """The new shard of each large row (size, shard, ...), the sizes they give the shards, and the shards' goals.

    A row above every goal fills a shard alone and the other goals are set anew; else a row stays while its shard has room, or goes where most room is.
    """
    load, to, goal = [0] * len(weights), {}, targets(total, weights)
    open_ = list(range(len(weights)))
    for row in sorted(large, reverse=True):
        size, own = row[0], row[1]
        if len(open_) > 1 and size > max(goal[s] for s in open_):
            j = own if own in open_ else max(open_, key=lambda s: (goal[s], -s))
            open_.remove(j)
            total -= size
            goal[j] = size
            for s, g in zip(open_, targets(total, [weights[s] for s in open_]), strict=True):
                goal[s] = g
        elif own in open_ and load[own] + size <= goal[own]:
            j = own
        else:
            j = max(open_, key=lambda s: (goal[s] - load[s], -s))
        load[j] += size
        to[row] = j
    return to, load, goal


def rooms(goal: list[int], load: list[int], supply: int) -> list[int]:
    """What the other rows may take of each shard: goals less large rows, lowered alike where a shard's large rows are above its goal."""
    lo, hi = 0, max(goal, default=0) + 1
    while lo < hi:  # the greatest cut that still leaves room for all
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if sum(max(0, g - x - mid) for g, x in zip(goal, load, strict=True)) >= supply else (lo, mid - 1)
    room = [max(0, g - x - lo) for g, x in zip(goal, load, strict=True)]
    over = sum(room) - supply
    for j in range(len(room)):  # less than one byte a shard
        take = min(over, room[j], 1)
        room[j], over = room[j] - take, over - take
    return room


def pieces_of(flow: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(old shard, from, to, new shard): each old shard's bytes in order, what stays first."""
    out = []
    for i, row in enumerate(flow.tolist()):
        at = 0
        for j in sorted(range(len(row)), key=lambda j: (j != i, j)):
            if row[j]:
                out.append((i, at, at + row[j], j))
                at += row[j]
    return out


# --- layouts, on rows ----------------------------------------------------------------------------------------------------


def _write(rows: DataFrame, name: str) -> tuple[str, DataFrame]:
    spark = rows.sparkSession
    path = f"{common.shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").partitionBy(*FILE).parquet(path)
    kept = [f for f in rows.schema.fields if f.name not in FILE]
    return path, spark.read.schema(StructType([*kept, *(StructField(k, LongType() if k == "block" else IntegerType()) for k in FILE)])).parquet(path)


def _files(rows: DataFrame, path: str) -> DataFrame:
    found = rows.groupBy(*FILE).agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))
    return common.materialise(found.select(F.lit(path).alias("path"), *FILE, "rows", "bytes"), "files", keep=True)


def store(df: DataFrame, shard: Column, shards: int, size: Column) -> Layout:
    """Write a table as shards (numbers from 0; null is 0) of files of bounded size; size: whole positive bytes of a row.

    A row's block goes by its number in the scan, so the table should be one that a lost task reads again in the same order: files, not a shuffle's rows.
    """
    sized = df.select(F.monotonically_increasing_id().alias("uid"), F.coalesce(shard, F.lit(0)).cast("int").alias("shard"), size.cast("long").alias("size"), F.struct(*df.columns).alias("row"))
    sums = {r["shard"]: r for r in sized.groupBy("shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()}
    if any(not 0 <= s < shards for s in sums):
        raise ValueError("a shard number is out of range")
    blocks = [max(BLOCKS, -(-sums[s]["bytes"] // BLOCK_BYTES), -(-sums[s]["rows"] // BLOCK_ROWS)) if s in sums else 1 for s in range(shards)]
    total = sum(r["bytes"] for r in sums.values())
    block = F.pmod(F.xxhash64("uid"), F.element_at(F.array(*map(F.lit, blocks)), F.col("shard") + 1)).cast("long")
    in_block = Window.partitionBy(*FILE).orderBy("uid")
    large = F.col("size") * LARGE > total
    rows = sized.select("uid", "shard", F.lit(0).alias("round"), block.alias("block"), "size", large.alias("large"), "row")
    rows = rows.withColumn("place", F.row_number().over(in_block) - 1).withColumn(
        "upto", F.sum(F.when(F.col("large"), 0).otherwise(F.col("size"))).over(in_block.rowsBetween(Window.unboundedPreceding, 0))
    )
    path, rows = _write(rows.drop("uid"), "layout")
    return Layout(shards, rows, _files(rows, path))


def reshard(old: Layout, weights: list[float], cost: np.ndarray | None = None) -> Layout:
    """The layout brought to one shard for each weight, sizes in proportion to the weights, at least cost; cost: of a byte from old shard to new one.

    By default staying in the shard of the same number costs 0 and any move 1, so the fewest bytes move. Sizes differ from their goals by less than 1 / LARGE of
    all bytes for each piece a shard gets; a row above every goal has a shard of its own. Rows of 1 / LARGE of all bytes or more are placed one by one.
    """
    spark, new = old.rows.sparkSession, len(weights)
    if cost is None:
        cost = 1 - np.eye(old.shards, new)
    small = old.rows.groupBy(*FILE).agg(F.sum(F.when(F.col("large"), 0).otherwise(F.col("size"))).alias("bytes"))
    small = common.materialise(small, "blocks")
    supply = [0] * old.shards
    for r in small.groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect():
        supply[r["shard"]] = r["bytes"]
    large = [tuple(r) for r in old.rows.where("large").select("size", *FILE, "place").collect()]
    to, load, goal = place_large(large, sum(supply) + sum(r[0] for r in large), weights)
    flow = min_cost_flow(supply, rooms(goal, load, sum(supply)), cost)

    before = Window.partitionBy("shard").orderBy("round", "block").rowsBetween(Window.unboundedPreceding, -1)
    spread = small.withColumn("lo", F.coalesce(F.sum("bytes").over(before), F.lit(0)))
    cuts = F.broadcast(spark.createDataFrame(pieces_of(flow), "shard int, a long, b long, to int"))
    parts = spread.join(cuts, "shard").where("bytes > 0 AND a < lo + bytes AND b > lo").select(*FILE, "lo", "a", "b", "to")
    parts = common.materialise(parts.withColumn("part", F.count("*").over(Window.partitionBy(*FILE))), "parts")
    singles = spark.createDataFrame([(*row[1:], j) for row, j in to.items()], "shard int, round int, block long, place int, single int")
    leaves = parts.where("part > 1 OR to <> shard").select(*FILE).union(singles.where("single <> shard").select(*FILE)).distinct()
    leaves = common.materialise(leaves.withColumn("number", F.monotonically_increasing_id()), "leaves")

    # Rows of the files that change: a row goes where its middle byte lies, a large one to its own place.
    middle, kept = "2 * (lo + upto) - size", ["number", "place", "size", "large", "row", F.col("shard").alias("from")]
    touched = old.rows.join(F.broadcast(leaves), FILE)
    dealt = touched.where("NOT large").join(F.broadcast(parts), FILE).where(f"{middle} >= 2 * a AND {middle} < 2 * b").select(*kept, F.col("to").alias("shard"))
    apart = touched.where("large").join(F.broadcast(singles), [*FILE, "place"]).select(*kept, F.col("single").alias("shard"))
    again = Window.partitionBy("shard", "number").orderBy("place")
    fresh = dealt.union(apart).withColumn("at", F.row_number().over(again) - 1).withColumn(
        "upto", F.sum(F.when(F.col("large"), 0).otherwise(F.col("size"))).over(again.rowsBetween(Window.unboundedPreceding, 0))
    )
    fresh = fresh.select("shard", F.lit(old.round + 1).alias("round"), F.col("number").alias("block"), "size", "large", "row", F.col("at").alias("place"), "upto", "from")
    path, fresh = _write(fresh, "reshard")
    moved = fresh.agg(F.sum(F.when(F.col("from") != F.col("shard"), F.col("size"))), F.sum("size")).first()
    fresh = fresh.drop("from")
    same = old.files.join(F.broadcast(leaves), FILE, "left_anti").select(*old.files.columns)
    files = common.materialise(same.unionByName(_files(fresh, path)), "files", keep=True)
    return Layout(new, old.rows.join(F.broadcast(leaves), FILE, "left_anti").unionByName(fresh), files, old.round + 1, moved[0] or 0, moved[1] or 0)


def slots(layout: Layout) -> DataFrame:
    """The layout's rows with slot: each shard's rows numbered from 0 without gaps, file by file."""
    before = Window.partitionBy("shard").orderBy("round", "block").rowsBetween(Window.unboundedPreceding, -1)
    base = layout.files.select(*FILE, F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    return layout.rows.join(F.broadcast(base), FILE).withColumn("slot", F.col("base") + F.col("place"))


def text_size(text: str = "text") -> Column:
    """UTF-8 bytes of a text (null: none) and one."""
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long") + 1


#: The layout that op13 brings to 8 equal shards: 6 shards by source, so a hot source makes one of them large.
OLD, NEW = 6, 8


def op13_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, stored in 6 shards by source, brought to 8 shards of near equal bytes.

    Law `bytes`. A null text counts 1 byte and its crc32 is 0; a null source is shard 0; repeated rows are rows of their own; equal texts are not kept together,
    as a group of copies may be larger than a shard; an empty table gives no rows; columns of the table lie in a struct, so their names cannot clash.
    """
    docs = common.table(spark, sf_dir, "documents")
    old = store(docs, F.crc32(F.coalesce("source", F.lit("")).cast("binary")) % OLD, OLD, text_size())
    rows = slots(reshard(old, [1.0] * NEW))
    return rows.select(
        "row.doc_id", "size", F.crc32(F.coalesce("row.text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
