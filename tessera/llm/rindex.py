"""Substring dedup over bytes by a run-length index.

Every document's UTF-8 bytes are sampled at anchors (100-byte runs, see repeats.py); anchors that occur once exclude the windows they stand
for. Repeats are then factored against their reference occurrences; only windows at the factors' boundaries are left. For these, the text around
each anchor is gathered in blocks; over a block a run-compressed Burrows-Wheeler transform is built. Longest common prefixes with the
neighbours in the whole suffix order are computed at the ends of the transform's runs alone, and streamed along the text from there (inside a run they
fall by one per byte): these are the block's matching statistics against itself. A match of `length` bytes or more is a repeated string.

Contexts that are equal are indexed once with their count. An anchor with more than HOT different contexts (a passage that very many
documents share, each with other surroundings) is no longer one block's work: its windows are counted by 128-bit hashes, combined and
packed before they are shuffled. Both ways are exact up to hash collisions.

Null text: empty. Matches never cross documents. Repeated rows repeat each other's strings. Null doc_ids are kept; extra columns do not
take part; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common, repeats

LENGTH = 200
#: Different contexts of an anchor in one block at most, and of a block on average.
HOT = 256
BLOCK = 2048
#: Tasks that blocks are dealt to at most.
MOST_TASKS = 20_000
#: Windows that a task counts at once, and of a part on average.
FLUSH, PART = 1 << 18, 1 << 16


def byte_symbols(buf: np.ndarray, offs: np.ndarray):
    return common.BYTE[buf], np.repeat(np.arange(len(offs) - 1), np.diff(offs)), offs[:-1]


class RunIndex:
    """A run-compressed Burrows-Wheeler transform of texts joined by separators that match nothing, with matching statistics."""

    def __init__(self, texts: list[bytes]) -> None:
        self.first = np.cumsum([0, *(len(t) + 1 for t in texts)])
        n = int(self.first[-1])
        s = np.zeros(n, np.int64)
        for t, at in zip(texts, self.first, strict=False):
            s[at : at + len(t)] = np.frombuffer(t, np.uint8).astype(np.int64) + 1
        ends = self.first[1:] - 1
        s[ends] = 257 + np.arange(len(ends))
        # Ranks of 1, 2, 4, ... symbols, until no two suffixes are equal: only in the whole order do matches fall by one inside runs.
        ranks, width = [s], 1
        rank = s
        distinct = False
        while not distinct and n:
            nxt = np.full(n, -1, np.int64)
            nxt[: n - width] = rank[width:]
            key = rank * (int(rank.max(initial=0)) + 2) + nxt + 1
            order = np.argsort(key)
            new = np.empty(n, np.int64)
            k = key[order]
            new[order] = np.cumsum(np.r_[True, k[1:] != k[:-1]]) - 1
            rank, width, distinct = new, 2 * width, bool((k[1:] != k[:-1]).all())
            ranks.append(rank)
        self.n, self.ranks = n, ranks
        self.suffixes = np.empty(n, np.int64)
        self.suffixes[rank] = np.arange(n)
        self.bwt = s[self.suffixes - 1]
        self.heads = np.flatnonzero(np.r_[True, self.bwt[1:] != self.bwt[:-1]]) if n else np.zeros(0, np.int64)

    def prefix(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common prefixes of the suffixes at i and j."""
        out = np.zeros(len(i), np.int64)
        i, j = i.copy(), j.copy()
        for level in range(len(self.ranks) - 1, -1, -1):
            r = self.ranks[level]
            ok = (i < self.n) & (j < self.n)
            same = np.zeros(len(i), bool)
            same[ok] = r[i[ok]] == r[j[ok]]
            step = same.astype(np.int64) << level
            out, i, j = out + step, i + step, j + step
        return out

    def statistics(self) -> np.ndarray:
        """For each place, the longest match with any other place, from samples at the ends of runs."""
        best = np.zeros(self.n, np.int64)
        at = np.arange(self.n)
        heads = self.heads[self.heads > 0]
        if len(heads):  # a run's end and the next one's head have each other's prefix
            common_ = self.prefix(self.suffixes[heads], self.suffixes[heads - 1])
            for own in (heads, heads - 1):
                here = self.suffixes[own]
                value = np.full(self.n, -self.n, np.int64)
                value[here] = common_ + here
                best = np.maximum(best, np.maximum.accumulate(value) - at)
        return best


def repeated_starts(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text, which of its windows occur at another place of any text."""
    index = RunIndex(texts)
    hit = index.statistics() >= length
    return [hit[a : a + max(0, len(t) - length + 1)] for t, a in zip(texts, index.first, strict=False)]


def contexts(places: DataFrame, length: int) -> DataFrame:
    """h, uid, j, ctx: around each place, the bytes of the windows that have it as anchor; j is where they start."""

    def run(batches):
        for b in batches:
            lists, texts = b.column(2), b.column(1)
            uid = b.column(0).to_pylist()
            offs = lists.offsets.to_numpy()
            h, at = (lists.values.field(i).to_numpy(zero_copy_only=False) for i in range(2))
            pos = at >> repeats.SHIFT
            lo, hi = pos - ((at >> 8) & 255), pos - (at & 255) + length
            who, out = [], []
            for i in range(b.num_rows):
                raw = texts[i].as_py().encode("utf-8", "surrogatepass")
                for a in range(offs[i], offs[i + 1]):
                    out.append(raw[lo[a] : hi[a]])
                    who.append(uid[i])
            s = slice(offs[0], offs[-1])
            yield pa.RecordBatch.from_arrays([pa.array(h[s]), pa.array(who, pa.int64()), pa.array(lo[s]), pa.array(out, pa.binary())], names=["h", "uid", "j", "ctx"])

    return places.select("uid", "text", "places").mapInArrow(run, "h long, uid long, j long, ctx binary")


def tally(w0: np.ndarray, w1: np.ndarray, n: np.ndarray):
    """The order that brings equal windows together, where each one begins in it, the number of its window, and each window's count."""
    order = np.lexsort((w1, w0))
    a, b = w0[order], w1[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    head = np.flatnonzero(new)
    return order, head, np.cumsum(new) - 1, np.add.reduceat(n[order], head)


def starts_of(h: np.ndarray, cx: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """h, cx, starts: the places j of each context as one list."""
    order = np.lexsort((j, cx, h))
    h, cx, j = h[order], cx[order], j[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (cx[1:] != cx[:-1])
    head = np.flatnonzero(new)
    lists = pa.ListArray.from_arrays(pa.array(np.r_[head, len(h)], pa.int32()), pa.array(j))
    return pa.RecordBatch.from_arrays([pa.array(h[head]), pa.array(cx[head]), lists], names=["h", "cx", "starts"])


#: What a packed row holds of its windows: hashes, anchor, context, place there (-1: no place asks for an answer), and count.
PACKED = ("w0", "w1", "h", "cx", "j", "n")


def by_counts(hot: DataFrame, length: int) -> DataFrame:
    """h, cx, starts: the repeated windows of contexts, by counts of the windows' 128-bit hashes.

    A task settles the windows that repeat among the FLUSH it holds and posts each different one once, packed by part, so a window posts
    at most once for each FLUSH windows, however many contexts share it. A part adds up the counts and answers the places that were
    alone in their task. Parts hold PART windows at most on average, so their number grows with the windows and their size does not.
    """
    total = hot.agg(F.sum(F.greatest(F.length("ctx") - (length - 1), F.lit(0)).cast("long"))).first()[0] or 0
    parts = max(1, -(-total // PART))

    def settled(held: list):
        w0, w1, h, cx, j, n = (np.concatenate(c) for c in zip(*held, strict=True))
        order, head, of, m = tally(w0, w1, n)
        at = order[m[of] > 1]
        rows = [(-1, (w0[:0], w1[:0], h[at], cx[at], j[at], n[:0]))] if len(at) else []
        one = order[head]
        asks = np.where(m > 1, -1, j[one])
        part = (w0[one].view(np.uint64) % np.uint64(parts)).astype(np.int64)
        by = np.argsort(part, kind="stable")
        cols = [c[by] for c in (w0[one], w1[one], h[one], cx[one], asks, np.minimum(m, 2))]
        there, first = np.unique(part[by], return_index=True)
        for p, a, b in zip(there, first, np.r_[first[1:], len(by)], strict=True):
            rows.append((int(p), tuple(c[a:b] for c in cols)))
        data = [pa.array([r[1][i].tobytes() for r in rows], pa.binary()) for i in range(len(PACKED))]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *data], names=["part", *PACKED])

    def windows(batches):
        held, size = [], 0
        for b in batches:
            h, cx, n = (b.column(c).to_numpy() for c in ("h", "cx", "n"))
            for lo, hi, buf, offs in common.text_slices(b.column("ctx").cast(pa.large_binary()).view(pa.large_string())):
                values, row, first = byte_symbols(buf, offs)
                g0, g1 = common.grams_hash(values, length), common.grams_hash(values, length, 0x7F4A)
                j = np.flatnonzero(row[: len(g0)] == row[length - 1 :])
                r = row[j]
                held.append((common.i64(g0[j]), common.i64(g1[j]), h[lo:hi][r], cx[lo:hi][r], j - first[r], n[lo:hi][r]))
                size += len(j)
                if size >= FLUSH:
                    yield settled(held)
                    held, size = [], 0
        if size:
            yield settled(held)

    def local(batches):
        for b in batches:
            for i in range(b.num_rows):
                yield starts_of(*(np.frombuffer(b.column(c)[i].as_py(), np.int64) for c in ("h", "cx", "j")))

    def answers(batches):
        held, part = [], None

        def answer():
            w0, w1, h, cx, j, n = (np.concatenate(c) for c in zip(*held, strict=True))
            order, _, of, m = tally(w0, w1, n)
            at = order[(m[of] > 1) & (j[order] >= 0)]
            if len(at):
                yield starts_of(h[at], cx[at], j[at])

        for b in batches:
            for i in range(b.num_rows):
                p = b.column("part")[i].as_py()
                if p != part and held:
                    yield from answer()
                    held = []
                part = p
                held.append(tuple(np.frombuffer(b.column(c)[i].as_py(), np.int64) for c in PACKED))
        if held:
            yield from answer()

    kind = "h long, cx long, starts array<long>"
    packed = common.materialise(hot.mapInArrow(windows, "part int, " + ", ".join(f"{c} binary" for c in PACKED)), "rindex-hot")
    shared = packed.where("part >= 0").repartition(parts, "part").sortWithinPartitions("part")
    return packed.where("part = -1").select("h", "cx", "j").mapInArrow(local, kind).union(shared.mapInArrow(answers, kind))


def marked(kinds: DataFrame, length: int, top: int) -> DataFrame:
    """h, cx, starts: the repeated windows of each context that occurs once."""
    per = kinds.groupBy("h").agg(F.count("*").alias("per"))
    kinds = common.materialise(common.lookup(kinds, per, ["h"], "per", kinds.count(), ("per",), top), "rindex-kinds")
    n = kinds.where(f"per <= {HOT}").count()
    blocks = max(1, n // BLOCK)

    def index(pdf: pd.DataFrame) -> pd.DataFrame:
        hits = repeated_starts(list(pdf["ctx"]), length)
        return pd.DataFrame({"h": pdf["h"], "cx": pdf["cx"], "starts": [np.flatnonzero(x) for x in hits]})

    cool = kinds.where(f"per between 2 and {HOT} or per = 1 and n = 1").withColumn("block", F.pmod(F.xxhash64("h"), F.lit(blocks)))
    # Dealt explicitly: blocks are small but costly, so they are not to be put together by their bytes.
    by_index = cool.repartition(min(blocks, MOST_TASKS), "block").groupBy("block").applyInPandas(index, "h long, cx long, starts array<long>").where("size(starts) > 0")

    hot = kinds.where(f"per > {HOT}").select("h", "cx", "n", "ctx")
    return by_index.union(by_counts(hot, length))


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary) of every document."""
    common.tune(docs.sparkSession)
    w = (length + 1) // 2
    k = length + 1 - w
    kind = dict(docs.dtypes)["doc_id"]
    docs = common.numbered(docs.select("doc_id", "text"), "rindex-rows").select("uid", "row.doc_id", "row.text")
    found, top = repeats.repeated(docs, byte_symbols, k, w, "rindex")
    parsed = repeats.factors(found, k, length, "rindex")
    places = repeats.with_text(docs, repeats.at_boundaries(found, parsed, top))
    around = common.materialise(contexts(places, length).withColumn("cx", F.xxhash64("ctx")), "rindex-contexts")
    common.discard(found)
    kinds = around.groupBy("h", "cx").agg(F.count("*").alias("n"), F.min("ctx").alias("ctx"))
    kinds = common.materialise(kinds, "rindex-counted")
    part = common.materialise(marked(kinds, length, top), "rindex-marked")
    whole = kinds.where("n > 1").select("h", "cx", F.sequence(F.lit(0).cast("long"), F.length("ctx").cast("long") - length).alias("starts"))
    hits = part.union(whole).groupBy("h", "cx").agg(F.flatten(F.collect_list("starts")).alias("starts")).join(kinds.select("h", "cx", "n"), ["h", "cx"])
    more = common.lookup(around.select("h", "cx", "uid", "j"), hits, ["h", "cx"], "n", around.count(), ("starts",), top).select("uid", F.transform("starts", lambda x: x + F.col("j")).alias("js"))
    more = more.groupBy("uid").agg(F.flatten(F.collect_list("js")).alias("js"))
    spans = parsed.select("uid", "starts", "ends").join(more, "uid", "left")
    joined = repeats.with_text(docs, spans, "left")

    def run(batches):
        for b in batches:
            rows = []
            starts, ends, js = (common.lists_of(b.column(c)) for c in ("starts", "ends", "js"))
            for i, text in enumerate(b.column(1).to_pylist()):
                raw = (text or "").encode("utf-8", "surrogatepass")
                n = len(raw)
                j, s, t = js(i), starts(i), ends(i)
                off = common.cover(n, np.r_[s, j], np.r_[t, j + length]) if len(s) + len(j) else np.zeros(n, bool)
                kept = np.frombuffer(raw, np.uint8)[~off].tobytes()
                runs = int(off[0] + (off[1:] & ~off[:-1]).sum()) if n else 0
                rows.append((n, n - len(kept), runs, hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds_ = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds_, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return joined.select("doc_id", "text", "starts", "ends", "js").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op7_rindex(spark, sf_dir: str) -> DataFrame:
    """What substring dedup over bytes leaves of every document, as a digest."""
    return dedup(common.table(spark, sf_dir, "documents")).drop("kept")
