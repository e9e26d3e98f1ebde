"""Common ground of the two operators on repeated passages: sampled anchors, an index of them, and greedy factors.

A sequence of symbols (words or bytes) is sampled at anchors: of every w consecutive k-grams the one with the least hash, the leftmost of
equals. A window of L = k + w - 1 symbols has one anchor, which depends on its content alone, so equal windows have equal anchors and a window
that occurs twice has an anchor that occurs twice. Neighbouring anchors are at most w <= k apart, so their k-grams leave no gap.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

#: An anchor's place, and how far before it the first and the last window start that have it, in one number.
SHIFT = 16


def sampled(values: np.ndarray, row: np.ndarray, first: np.ndarray, k: int, w: int):
    """Anchors of the rows' sequences: hash, row, and packed place. first: each row's first symbol."""
    length = k + w - 1
    if len(values) < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = common.grams_hash(values, k)
    j = np.flatnonzero(row[: len(values) - length + 1] == row[length - 1 :])
    if not len(j):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    pos = common.leftmost_minima(grams, w)[j]
    head = np.flatnonzero(np.r_[True, pos[1:] != pos[:-1]])
    tail = np.r_[head[1:], len(pos)] - 1
    at = pos[head]
    place = ((at - first[row[at]]) << SHIFT) | ((at - j[head]) << 8) | (at - j[tail])
    return grams[at], row[at], place


def anchors(docs: DataFrame, symbols, k: int, w: int) -> DataFrame:
    """h, uid, at of every anchor of every document. symbols: from bytes and offsets to values, their rows and the rows' first symbols."""
    assert w <= k and w <= 255

    def run(batches):
        for b in batches:
            uid = b.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, buf, offs in common.text_slices(b.column(1)):
                values, row, first = symbols(buf, offs)
                h, r, place = sampled(values, row, first, k, w)
                if len(h):
                    yield pa.RecordBatch.from_arrays([pa.array(common.i64(h)), pa.array(uid[lo:hi][r]), pa.array(place)], names=["h", "uid", "at"])

    return docs.select("uid", "text").mapInArrow(run, "h long, uid long, at long")


def repeated(docs: DataFrame, symbols, k: int, w: int, name: str) -> tuple[DataFrame, int]:
    """h, uid, at of the anchors that occur more than once, with their number n and another occurrence (ref, ref_at); and the greatest n.

    The reference is the least occurrence, or for itself the greatest. Counts and extremes are combined before they are shuffled, and hot
    anchors are looked up where they lie.
    """
    all_ = common.materialise(anchors(docs, symbols, k, w), f"{name}-anchors")
    twice = common.materialise(all_.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), f"{name}-twice")
    top = twice.agg(F.max("n")).first()[0] or 0
    some = common.materialise(common.lookup(all_, twice, ["h"], "n", all_.count(), ("n",), top), f"{name}-repeated")
    common.discard(all_, twice)
    place = F.struct("uid", F.shiftright("at", SHIFT).alias("pos"))
    ends = some.groupBy("h").agg(F.min(place).alias("lo"), F.max(place).alias("hi"), F.count("*").alias("m"))
    own = (F.col("lo.uid") == F.col("uid")) & (F.col("lo.pos") == F.shiftright("at", SHIFT))
    ref = F.when(own, F.col("hi")).otherwise(F.col("lo"))
    found = common.lookup(some, ends, ["h"], "m", some.count(), ("lo", "hi"), top)
    found = common.materialise(found.select("h", "uid", "at", "n", ref["uid"].alias("ref"), ref["pos"].alias("ref_at")), f"{name}-found")
    common.discard(some)
    return found, top


def factors(found: DataFrame, k: int, length: int, name: str) -> DataFrame:
    """Greedy parse of each document against the reference occurrences: uid, starts and ends of factors of `length` or more, and the anchors
    (open: hash and number) with a window that no such factor holds: the factor boundaries, which are checked by other means.

    A factor runs on while consecutive anchors have the same reference document at the same distance and their k-grams leave no gap.
    """
    lists = found.groupBy("uid").agg(F.collect_list(F.struct("at", "h", "ref", "ref_at", "n")).alias("a"))

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            a = b.column(1)
            offs = a.offsets.to_numpy()
            flat = a.values.slice(offs[0], offs[-1] - offs[0])
            at, h, ref, ref_at, times = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(5))
            doc = np.repeat(np.arange(b.num_rows), np.diff(offs))
            order = np.lexsort((at, doc))
            at, h, ref, ref_at, times = at[order], h[order], ref[order], ref_at[order], times[order]
            pos, jlo, jhi = at >> SHIFT, (at >> SHIFT) - ((at >> 8) & 255), (at >> SHIFT) - (at & 255)
            new = np.ones(len(at), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (ref[1:] != ref[:-1]) | (ref_at[1:] - pos[1:] != ref_at[:-1] - pos[:-1]) | (pos[1:] - pos[:-1] > k)
            head = np.flatnonzero(new)
            tail = np.r_[head[1:], len(at)] - 1
            start, end = pos[head], pos[tail] + k
            of = np.cumsum(new) - 1
            long_ = end - start >= length
            open_ = ~(long_[of] & (jlo >= start[of]) & (jhi + length <= end[of]))
            s, o = np.flatnonzero(long_), np.flatnonzero(open_)
            s_cut, o_cut = (np.searchsorted(x, np.arange(b.num_rows + 1)) for x in (doc[head][s], doc[o]))
            cols = [pa.ListArray.from_arrays(pa.array(c, pa.int32()), pa.array(v)) for c, v in ((s_cut, start[s]), (s_cut, end[s]))]
            opened = pa.StructArray.from_arrays([pa.array(h[o]), pa.array(times[o])], ["h", "n"])
            cols.append(pa.ListArray.from_arrays(pa.array(o_cut, pa.int32()), opened))
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["uid", "starts", "ends", "open"])

    return common.materialise(lists.mapInArrow(run, "uid long, starts array<long>, ends array<long>, open array<struct<h: long, n: long>>"), f"{name}-factors")


def at_boundaries(found: DataFrame, parsed: DataFrame, top: int) -> DataFrame:
    """uid and places (h, at) of all occurrences of the anchors that are open anywhere: an equal window may lie inside a factor elsewhere."""
    wanted = parsed.select(F.explode("open").alias("o")).groupBy(F.col("o.h").alias("h")).agg(F.max("o.n").alias("n"))
    places = common.lookup(found.select("h", "uid", "at"), wanted, ["h"], "n", found.count(), (), top)
    return places.groupBy("uid").agg(F.collect_list(F.struct("h", "at")).alias("places"))


def with_text(docs: DataFrame, lists: DataFrame, how: str = "inner") -> DataFrame:
    return docs.join(lists, "uid", how)
