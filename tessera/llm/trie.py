"""Conversation prefix trie by prefix doubling.

Turns are named by dense numbers; blocks of 2, 4, 8 ... turns that stand at multiples of their size are named by the pair of names of their halves, one
join a round. A prefix of d turns is named by the pair of a shorter prefix (d without its lowest binary digit) and the block that follows it, again one
round for each binary digit. Prefixes of equal length and name are one node, and the smallest conversation that has it stands for it.

A node's smallest member begins or goes on a chain of nodes with that member, and a member's chain that starts further down lies below the node as a whole. So
sums over subtrees are one grouping of memberships: the rest of the member's chain for the node's own chain, whole chains for other members.

Hot keys (a conversation with very many turns, a turn that very many share) are met by a broadcast of the few keys above a share of all rows; places within a
conversation and sums along a chain are taken over a range partitioning that splits it.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import common

#: Ids that one joined piece of a node's list holds; pieces are made in parallel, and the digest, sequential by definition, streams over them.
PIECE = 4096
#: A conversation's first turns come from the first conversation of its block of so many ids.
FAMILY = 20


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def running(df: DataFrame, group: str, order: list[Column], value: Column, name: str) -> DataFrame:
    """df and `name`: the sum of value over the rows of the same group up to this one, which is counted; equal rows in any order.

    Rows are dealt by ranges of group and order, so a large group lies over many tasks; sums within a task's rows, then the sums of the tasks before.
    """
    out = [*df.columns, name]
    ranged = df.withColumn("_tie", F.monotonically_increasing_id()).withColumn("_v", value)
    ranged = ranged.repartitionByRange(group, *order, "_tie").sortWithinPartitions(group, *order, "_tie").drop("_tie")
    at = common.materialise(ranged.withColumn("_at", F.monotonically_increasing_id()), "running").withColumn("_task", F.shiftright("_at", 33))
    here = Window.partitionBy("_task", group)
    before = Window.partitionBy(group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = at.groupBy("_task", group).agg(F.sum("_v").alias("_all")).withColumn("_before", F.coalesce(F.sum("_all").over(before), F.lit(0))).drop("_all")
    at = at.withColumn("_here", F.sum("_v").over(here.orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)))
    return at.join(tasks, ["_task", group]).withColumn(name, (F.col("_here") + F.col("_before")).cast("long")).select(*out)


def dense(keys: DataFrame, name: str) -> DataFrame:
    """keys, one row each, and `name`: their numbers, from 0 without gaps. The driver sees one count a partition."""
    at = common.materialise(keys.withColumn("_at", F.monotonically_increasing_id()), "names").withColumn("_task", F.shiftright("_at", 33))
    counts = sorted((r["_task"], r["n"]) for r in at.groupBy("_task").agg(F.count("*").alias("n")).collect())
    first, total = [], 0
    for task, n in counts:
        first.append((task, total))
        total += n
    first = keys.sparkSession.createDataFrame(first, "_task long, _first long")
    return at.join(F.broadcast(first), "_task").withColumn(name, F.col("_first") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_task", "_first", "_at")


def named(rows: DataFrame, keys: list[str], name: str, members: bool = False) -> tuple[DataFrame, int]:
    """rows with the dense name of their keys, and their number; members: also the group's smallest conv_id as `top` and its rows as n_convs."""
    more = [F.min("conv_id").alias("top")] if members else []
    names = common.materialise(dense(rows.groupBy(*keys).agg(F.count("*").alias("n_convs"), *more), name), "names")
    total, most = names.agg(F.sum("n_convs"), F.max("n_convs")).first()
    keep = (name, "top", "n_convs") if members else (name,)
    return common.lookup(rows, names, keys, "n_convs", total or 0, keep, most or 0), total or 0


def rebuild(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns (conv_id, pos, turn_key, words) and the conversations (conv_id, length) after each takes its first turns from its family's first one.

    Turns go by number, null first, ties by a digest of role and text. Rows without conv_id belong to no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("turn_key"), words(text).alias("words")
    )
    turns = common.materialise(turns, "turns")
    order = [F.col("turn").asc_nulls_first(), F.col("turn_key").asc()]
    placed = running(turns, "conv_id", order, F.lit(1), "pos").select("conv_id", (F.col("pos") - 1).alias("pos"), "turn_key", "words")
    placed = common.materialise(placed, "placed")
    convs = placed.groupBy("conv_id").agg(F.count("*").alias("n")).select(
        "conv_id", "n", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("root"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).alias("h")
    )
    convs = common.materialise(convs, "convs")
    roots = convs.where("conv_id = root").select("root", F.col("n").alias("n_root"))
    convs = convs.join(roots, "root", "left").withColumn("shift", F.least("h", F.coalesce("n_root", F.lit(0))))
    convs = common.materialise(convs.select("conv_id", "n", "root", "h", "shift", (F.col("shift") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "convs")
    heads = placed.where(f"pos < 3 AND conv_id % {FAMILY} = 0").withColumnRenamed("conv_id", "root")
    headed = convs.join(heads, "root").where("pos < h").select("conv_id", "pos", "turn_key", "words")
    total, most = convs.agg(F.sum("n"), F.max("n")).first()
    own = common.lookup(placed, convs, ["conv_id"], "n", total or 0, ("h", "shift"), most or 0).where("pos >= h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("shift")).alias("pos"), "turn_key", "words")
    return common.materialise(headed.union(own), "rebuilt"), convs.select("conv_id", "length")


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, top, n_convs, words) of every prefix of every conversation: its node's smallest member and size, the words of its last turn."""
    blocks, _ = named(turns, ["turn_key"], "name")
    blocks = [common.materialise(blocks.select("conv_id", F.col("pos").alias("q"), "name", "words"), "blocks")]
    while True:
        left = blocks[-1].where("q % 2 = 0").select("conv_id", F.expr("q DIV 2").alias("q"), F.col("name").alias("a"))
        right = blocks[-1].where("q % 2 = 1").select("conv_id", F.expr("q DIV 2").alias("q"), F.col("name").alias("b"), "words")
        pairs = common.materialise(left.join(right, ["conv_id", "q"]), "pairs")
        if pairs.isEmpty():
            break
        blocks.append(common.materialise(named(pairs, ["a", "b"], "name")[0].select("conv_id", "q", "name", "words"), "blocks"))
    done: DataFrame | None = None
    for k in range(len(blocks) - 1, -1, -1):
        size = 1 << k
        ends = blocks[k].where("q % 2 = 0").select("conv_id", (F.col("q") * size).alias("at"), F.col("name").alias("b"), "words")
        whole = ends.where("at = 0").withColumn("a", F.lit(-1).cast("long"))
        if done is not None:
            whole = whole.unionByName(ends.where("at > 0").join(done.select("conv_id", F.col("depth").alias("at"), F.col("name").alias("a")), ["conv_id", "at"]))
        whole = common.materialise(whole.select("conv_id", (F.col("at") + size).alias("depth"), "a", "b", "words"), "prefix")
        part = named(whole, ["depth", "a", "b"], "name", members=True)[0].select("conv_id", "depth", "name", "top", "n_convs", "words")
        part = common.materialise(part, "prefix")
        done = part if done is None else done.union(part)
    return done.drop("name")


def digests(ends: DataFrame) -> DataFrame:
    """(depth, top, ends_sha256) of nodes at which conversations end, from (depth, top, conv_id): the SHA-256 of their ids, ascending, comma-joined."""
    at = running(ends.select(F.struct("depth", "top").alias("node"), "conv_id"), "node", [F.col("conv_id").asc()], F.lit(1), "place")
    pieces = at.groupBy("node", F.expr(f"(place - 1) DIV {PIECE}").alias("piece")).agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string"))).alias("ids"))
    pieces = common.materialise(pieces.select("node.depth", "node.top", "piece", "ids"), "pieces")
    many = pieces.where("piece > 0").select("depth", "top").distinct()
    few = pieces.join(many, ["depth", "top"], "left_anti").select("depth", "top", F.sha2("ids", 256).alias("ends_sha256"))

    def run(batches):
        node, digest = None, None
        for batch in batches:
            done = []
            for depth, top, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "top", "ids")), strict=True):
                if (depth, top) != node:
                    if node is not None:
                        done.append((*node, digest.hexdigest()))
                    node, digest = (depth, top), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield batch_of(done)
        if node is not None:
            yield batch_of([(*node, digest.hexdigest())])

    def batch_of(rows):
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["depth", "top", "ends_sha256"])

    long = pieces.join(many, ["depth", "top"], "left_semi").repartition("depth", "top").sortWithinPartitions("depth", "top", "piece")
    return few.union(long.mapInArrow(run, "depth long, top long, ends_sha256 string"))


def trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the prefix trie of the rebuilt conversations (conv_id, turn, role, text).

    conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256. Null role and text are
    empty, turns of equal number go by a digest of their content, repeated rows are turns of their own; rows without conv_id are left out; other columns are
    not read. No conversation, no node: an empty table gives an empty result. Texts of any length are read whole.
    """
    common.tune(conversations.sparkSession)
    turns, convs = rebuild(conversations.select(F.col("conv_id").cast("long"), "turn", "role", "text"))
    least, total = convs.agg(F.min("conv_id"), F.count("*")).first()
    root = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(least).cast("long").alias("top"), F.lit(total).alias("n_convs"), F.lit(0).cast("long").alias("words"))
    member = common.materialise(prefixes(turns).union(root), "member")
    own = member.where("conv_id = top").select("depth", "top", "n_convs", ((F.col("n_convs") - 1) * F.col("words")).alias("w"))
    above = member.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("top").alias("parent"))
    nodes = common.materialise(own.join(above.withColumnRenamed("conv_id", "top"), ["top", "depth"], "left"), "nodes")
    kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("top")).agg(F.count("*").alias("n_children"))
    nodes = common.materialise(nodes.join(kids, ["depth", "top"], "left").fillna(0, ["n_children"]), "nodes")
    chains = nodes.groupBy("top").agg(F.sum("w").alias("w_all"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    depths = member.groupBy(F.col("conv_id").alias("top")).agg(F.count("*").alias("n"))
    chains = common.materialise(chains.join(depths, "top"), "chains")
    size, most = chains.agg(F.sum("n"), F.max("n")).first()
    rest = running(nodes.select("top", "depth", "w"), "top", [F.col("depth").asc()], F.col("w"), "upto")
    rest = common.lookup(rest, chains, ["top"], "n", size or 0, ("w_all", "leaf"), most or 0)
    mine = rest.select("depth", "top", (F.col("w_all") - F.col("upto") + F.col("w")).alias("saved"), "leaf")
    others = member.where("conv_id <> top").select(F.col("conv_id"), "depth", F.col("top").alias("node"))
    others = common.lookup(others, chains.withColumnRenamed("top", "conv_id"), ["conv_id"], "n", size or 0, ("w_all", "leaf"), most or 0)
    others = others.select("depth", F.col("node").alias("top"), F.col("w_all").alias("saved"), "leaf")
    below = mine.union(others).groupBy("depth", "top").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))
    ends = member.join(convs.select("conv_id", F.col("length").alias("depth")), ["conv_id", "depth"]).select("depth", "top", "conv_id")
    out = nodes.join(below, ["depth", "top"]).join(digests(ends), ["depth", "top"], "left")
    return out.select(
        F.col("top").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", F.col("n_leaves").cast("long").alias("n_leaves"),
        F.col("saved_tokens").cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def op11_trie(spark, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations."""
    return trie(common.table(spark, sf_dir, "conversations"))
