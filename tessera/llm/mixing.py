"""Mixing sources to target weights by Sainte-Laguë apportionment.

Sources in order of code point (null last) have the given weights, repeating, and share a budget of words; a target stops at
`max_epochs` times its source's size and the excess is shared again by weight. Each source's documents are dealt by a seeded hash to
shards of about SHARD_WORDS words, and each shard's documents, in seeded order, form one stream cut into blocks of `block_words` words.
Sainte-Laguë gives each source an integer number of blocks by highest quotients of the targets, and then each shard of a source a
quota by highest quotients of the shards' sizes. A source's last block is as
long as its target asks for, so small sources get their words too. A shard takes all its blocks as often as its quota holds them, and the rest by
a seeded affine permutation of its block numbers, the last one cut. A document's taken words are the parts of the taken blocks that lie in it.

Nulls: a null text has size 0 and takes nothing; a null source is a source of its own, after the others; a null doc_id is kept.
Repeated rows are documents of their own. An empty table gives no rows. Other columns do not take part. Ties in order are between rows
with equal doc_id and size, which are interchangeable. What the driver holds is one row per source; shards' quotas are worked out by one
task per source over one row per shard (SHARD_WORDS words), all other steps are sums or windows over a shard.
"""

from __future__ import annotations

import heapq
import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import common

#: Words of a shard, about; one task orders and cuts one shard.
SHARD_WORDS = 1 << 20


def count_words(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep` of docs and the number of words of text as `size`."""
    names = list(keep)
    schema = ", ".join([*(f"`{c}` {t}" for c, t in docs.select(*names).dtypes), "size long"])

    def run(batches):
        for b in batches:
            out = np.zeros(b.num_rows, np.int64)
            for lo, hi, buf, offs in common.text_slices(b.column(len(names))):
                start, _ = common.word_bounds(buf, offs)
                at = np.searchsorted(start, offs)
                out[lo:hi] = np.diff(at)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array(out)], names=[*names, "size"])

    return docs.select(*names, "text").mapInArrow(run, schema)


def fill_targets(sizes: list[int], weights: list[float], budget: float, max_epochs: float) -> list[float]:
    """Share budget by weight; a share stops at max_epochs * size and its excess is shared again until none is above."""
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(budget)
    while open_:
        total = sum(weights[i] for i in open_)
        above = sorted(i for i in open_ if left * weights[i] / total >= max_epochs * sizes[i])
        if not above:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in above:
            out[i] = float(max_epochs * sizes[i])
        left -= sum(out[i] for i in above)
        open_ -= set(above)
    return out


def sainte_lague(votes: list[float] | np.ndarray, seats: int, most: np.ndarray | None = None) -> list[int]:
    """Seats by the highest quotients votes / (2 s + 1), ties to the earlier; no more than `most` each.

    The divisor below which no more seats fit is found by halving; a heap hands out the last few.
    """
    votes = np.asarray(votes, float)
    n, total = len(votes), float(votes.sum())
    cap = np.full(n, max(seats, 0)) if most is None else np.asarray(most, np.int64)
    if total <= 0 or seats <= 0:
        return [0] * n

    def fits(x: float) -> np.ndarray:
        """Seats whose quotient v / (s + 1/2) is 1 / x at least."""
        return np.minimum(cap, np.floor(votes * x + 0.5)).astype(np.int64)

    lo, hi = 0.0, 2.0 * (seats + n) / total + 1e-300
    if fits(hi).sum() <= seats:
        hi *= 1e6
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if fits(mid).sum() <= seats else (lo, mid)
    out = fits(lo)
    open_ = np.flatnonzero((votes > 0) & (out < cap))
    heap = list(zip((-votes[open_] / (2 * out[open_] + 1)).tolist(), open_.tolist(), strict=True))
    heapq.heapify(heap)
    for _ in range(seats - int(out.sum())):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        out[i] += 1
        if out[i] < cap[i]:
            heapq.heappush(heap, (-votes[i] / (2 * out[i] + 1), i))
    return out.tolist()


def in_words(blocks: int, goal: int, words: np.ndarray, block: int, max_epochs: int) -> np.ndarray:
    """Quotas in words of shards, `goal` in all or what max_epochs allows: whole blocks by highest quotients of the shards' sizes, and a last,
    shorter block for the rest, in the first shards with room."""
    room = max_epochs * words
    quota = np.array(sainte_lague(words, min(blocks, goal // block), room // block), np.int64) * block
    rest = np.minimum(room - quota, max(0, goal - int(quota.sum())))
    before = np.cumsum(rest) - rest
    return quota + np.clip(goal - int(quota.sum()) - before, 0, rest)


def step_of(blocks: np.ndarray, seed: int) -> np.ndarray:
    """For each number of blocks a step coprime to it, so that j -> (step * j + seed) mod blocks is a permutation."""
    step = np.maximum(1, (blocks * 0.6180339887).astype(np.int64) + seed % 7)
    while (bad := np.gcd(step, np.maximum(blocks, 1)) != 1).any():
        step[bad] += 1
    return step


def key_of() -> "F.Column":
    """Rows equal in doc_id, source and text are interchangeable."""
    return F.xxhash64("doc_id", "source", "text")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), budget_share: float = 1.0, max_epochs: int = 3, block_words: int = 64, seed: int = 7, carry: str = "doc_id") -> DataFrame:
    """doc_id, source, carry, size, source_size, target, taken of every document, how often it is taken whole, and the word ranges (starts, ends)
    of the blocks taken once more; see the module's text. carry: a column that is kept as `carried`."""
    spark = docs.sparkSession
    common.tune(spark)
    sized = common.materialise(count_words(docs.select("doc_id", "source", "text", key_of().alias("key"), F.col(carry).alias("carried")), "doc_id", "source", "key", "carried"), "mix-sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size")).orderBy(F.col("source").isNull(), F.encode("source", "utf-8")).collect()
    sizes = [int(r.source_size) for r in totals]
    targets = fill_targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], budget_share * sum(sizes), max_epochs)
    shards = [max(1, round(s / SHARD_WORDS)) for s in sizes]
    rows = [(i, r.source, s, t, n) for i, (r, s, t, n) in enumerate(zip(totals, sizes, targets, shards, strict=True))]
    plan = spark.createDataFrame(rows, "sid int, source string, source_size long, target double, shards int")
    plan = F.broadcast(plan) if len(rows) <= 100_000 else plan
    spread = F.xxhash64(F.col("key"), F.lit(seed))
    there = sized.join(plan, sized["source"].eqNullSafe(plan["source"])).select("doc_id", sized["source"], "key", "carried", "size", "source_size", "target", "sid", F.pmod(spread, F.col("shards")).cast("int").alias("shard"), spread.alias("h"))
    cells = there.groupBy("sid", "shard").agg(F.sum("size").alias("words"))
    seats = sainte_lague(targets, round(sum(targets) / block_words))
    # The last block of a source is as long as its target asks for, so a source below a block gets its words too.
    goals = [max(0, round(t)) for t in targets]
    want = spark.createDataFrame([(i, int(b), g) for i, (b, g) in enumerate(zip(seats, goals, strict=True))], "sid int, blocks long, goal long")

    def quotas(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard").reset_index(drop=True)
        out = in_words(int(pdf["blocks"].iloc[0]), int(pdf["goal"].iloc[0]), pdf["words"].to_numpy(np.int64), block_words, max_epochs)
        return pd.DataFrame({"sid": pdf["sid"].astype("int32"), "shard": pdf["shard"].astype("int32"), "words": pdf["words"], "quota": out})

    quota = cells.join(F.broadcast(want) if len(rows) <= 100_000 else want, "sid").groupBy("sid").applyInPandas(quotas, "sid int, shard int, words long, quota long")
    quota = quota.select(F.col("sid").alias("qs"), F.col("shard").alias("qh"), "words", "quota")
    order = Window.partitionBy("sid", "shard").orderBy("h", "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Documents without words take nothing and need no place.
    empty = there.where("size = 0").select("*", *(F.lit(0).cast("long").alias(c) for c in ("end", "words", "quota")))
    placed = there.where("size > 0").withColumn("end", F.sum("size").over(order)).join(quota, (F.col("sid") == F.col("qs")) & (F.col("shard") == F.col("qh"))).drop("qs", "qh").unionByName(empty)

    def take(batches):
        for b in batches:
            p = b.to_pandas()
            size, end, words, q = (p[c].to_numpy(np.int64) for c in ("size", "end", "words", "quota"))
            n = np.maximum(1, -(-words // block_words))
            whole, rest, step = q // np.maximum(words, 1), q % np.maximum(words, 1), step_of(n, seed)
            first, last = (end - size) // block_words, np.maximum(end - 1, 0) // block_words
            count = np.where(size > 0, last - first + 1, 0)
            at = np.repeat(np.arange(len(p)), count)
            j = first[at] + np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
            # Blocks in permuted order until `rest` words are taken; the shard's last block is short, the last one taken is cut.
            turn, short = (step[at] * j + seed) % n[at], n[at] * block_words - words[at]
            ahead = turn * block_words - np.where(turn > (step[at] * (n[at] - 1) + seed) % n[at], short, 0)
            length = np.where(j == n[at] - 1, block_words - short, block_words)
            until = j * block_words + np.clip(rest[at] - ahead, 0, length)
            start = np.maximum(j * block_words, end[at] - size[at])
            part = np.maximum(0, np.minimum(end[at], until) - start)
            hit = part > 0
            taken = whole * size + np.bincount(at, weights=part, minlength=len(p)).astype(np.int64)
            start = start - (end[at] - size[at])
            keep = [b.column(c) for c in ("doc_id", "source", "carried", "size", "source_size", "target")]
            cut = np.searchsorted(at[hit], np.arange(len(p) + 1))
            ranges = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x[hit])) for x in (start, start + part)]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(taken), pa.array(whole), *ranges], names=["doc_id", "source", "carried", "size", "source_size", "target", "taken", "whole", "starts", "ends"])

    kinds = dict(docs.dtypes)
    return placed.select("doc_id", "source", "carried", "size", "source_size", "target", "end", "words", "quota").mapInArrow(take, f"doc_id {kinds['doc_id']}, source string, carried {kinds[carry]}, size long, source_size long, target double, taken long, whole long, starts array<long>, ends array<long>")


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix as documents: a row for each time that a document is taken whole, and a row of the words of its blocks that are taken once more,
    in order, its neighbouring blocks together. n_chars, where there is one, follows the text. Documents of no taken words are left out."""
    names = docs.columns
    rows = common.numbered(docs, "mix-rows")
    taken = mix(rows.select("row.doc_id", "row.source", "row.text", "uid"), **how, carry="uid").where("taken > 0").select(F.col("carried").alias("uid"), "whole", "starts", "ends")
    rows = rows.join(taken, "uid").select(*(F.col("row")[c].alias(f"c{i}") for i, c in enumerate(names)), "whole", "starts", "ends")
    text, chars, n = names.index("text"), names.index("n_chars") if "n_chars" in names else None, len(names)

    def run(batches):
        for b in batches:
            at, out = [], []
            whole, starts, ends = (b.column(n + i).to_pylist() for i in range(3))
            for i, t in enumerate(b.column(text).to_pylist()):
                at += [i] * whole[i]
                out += [t] * whole[i]
                if starts[i]:
                    spans, runs = [m.span() for m in _WORD.finditer(t)], []
                    for s, e in zip(starts[i], ends[i], strict=True):
                        if runs and runs[-1][1] == s:
                            runs[-1][1] = e
                        else:
                            runs.append([s, e])
                    at.append(i)
                    out.append(" ".join(t[spans[s][0] : spans[e - 1][1]] for s, e in runs))
            cols = [b.column(i).take(pa.array(at, pa.int64())) for i in range(n)]
            cols[text] = pa.array(out, pa.string())
            if chars is not None:
                cols[chars] = pa.array([len(t) for t in out], cols[chars].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return rows.mapInArrow(run, docs.schema)


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it."""
    return mix(common.table(spark, sf_dir, "documents")).drop("source", "carried", "whole", "starts", "ends")
