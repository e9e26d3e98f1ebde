"""Substring dedup by relative Lempel-Ziv parsing over words.

Every document is a block of the reference; the index holds its sampled anchors (18-word runs, see repeats.py). Each document is factored
greedily against the indexed blocks; a factor of at least `length` words is a repeated span. Windows at factor boundaries, which may
continue in another block, are checked by counting the 128-bit hashes of all windows that share an anchor with one there. So each word of a
window of `length` words that starts anywhere else is removed; windows are judged on the input.

Null text: no words. Texts shorter than a window lose nothing. Repeated rows are documents of their own, and so repeat each other's windows.
Null doc_ids are kept; extra columns do not take part; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common, repeats

LENGTH = 35


def word_symbols(buf: np.ndarray, offs: np.ndarray):
    _, _, row, h = common.words_of(buf, offs)
    return common.mix(h), row, np.searchsorted(row, np.arange(len(offs) - 1))


def boundary_windows(places: DataFrame, length: int) -> DataFrame:
    """w0, w1, uid, j of the windows whose anchors are in `places`."""

    def run(batches):
        for b in batches:
            uid, lists = b.column(0).to_numpy(), b.column(2)
            offs_l = lists.offsets.to_numpy()
            at = lists.values.field(1).to_numpy(zero_copy_only=False)
            for lo, hi, buf, offs in common.text_slices(b.column(1)):
                values, _, first = word_symbols(buf, offs)
                g0, g1 = common.grams_hash(values, length), common.grams_hash(values, length, 0x7F4A)
                p = at[offs_l[lo] : offs_l[hi]]
                r = np.repeat(np.arange(hi - lo), np.diff(offs_l[lo : hi + 1]))
                jlo, n = (p >> repeats.SHIFT) - ((p >> 8) & 255), ((p >> 8) & 255) - (p & 255) + 1
                i = np.repeat(np.arange(len(p)), n)
                j = jlo[i] + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
                whole = first[r[i]] + j
                yield pa.RecordBatch.from_arrays([pa.array(common.i64(g0[whole])), pa.array(common.i64(g1[whole])), pa.array(uid[lo:hi][r[i]]), pa.array(j)], names=["w0", "w1", "uid", "j"])

    return places.select("uid", "text", "places").mapInArrow(run, "w0 long, w1 long, uid long, j long")


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept of every document; kept is the text that remains."""
    common.tune(docs.sparkSession)
    w = (length + 1) // 2
    k = length + 1 - w
    kind = dict(docs.dtypes)["doc_id"]
    docs = common.numbered(docs.select("doc_id", "text"), "rlz-rows").select("uid", "row.doc_id", "row.text")
    found, top = repeats.repeated(docs, word_symbols, k, w, "rlz")
    parsed = repeats.factors(found, k, length, "rlz")
    places = repeats.with_text(docs, repeats.at_boundaries(found, parsed, top))
    windows = common.materialise(boundary_windows(places, length), "rlz-windows")
    common.discard(found)
    twice = windows.groupBy("w0", "w1").agg(F.count("*").alias("n")).where("n > 1")
    more = common.lookup(windows, twice, ["w0", "w1"], "n", windows.count(), (), top).groupBy("uid").agg(F.collect_list("j").alias("js"))
    spans = parsed.select("uid", "starts", "ends").join(more, "uid", "left")
    joined = repeats.with_text(docs, spans, "left")

    def run(batches):
        for b in batches:
            total, gone, sha, kept = [], [], [], []
            starts, ends, js = (common.lists_of(b.column(c)) for c in ("starts", "ends", "js"))
            for lo, hi, buf, offs in common.text_slices(b.column(1)):
                ws, we = common.word_bounds(buf, offs)
                cut = np.searchsorted(ws, offs)
                raw = buf.tobytes()
                for i in range(hi - lo):
                    a, e = cut[i], cut[i + 1]
                    n = int(e - a)
                    j, s, t = js(lo + i), starts(lo + i), ends(lo + i)
                    off = common.cover(n, np.r_[s, j], np.r_[t, j + length]) if len(s) + len(j) else np.zeros(n, bool)
                    keep = a + np.flatnonzero(~off)
                    text = b" ".join([raw[x:y] for x, y in zip(ws[keep], we[keep], strict=True)])
                    total.append(n)
                    gone.append(int(off.sum()))
                    sha.append(hashlib.sha256(text).hexdigest())
                    kept.append(text.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return joined.select("doc_id", "text", "starts", "ends", "js").mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept string")


def op5_rlz(spark, sf_dir: str) -> DataFrame:
    """What substring dedup leaves of every document, as a digest."""
    return dedup(common.table(spark, sf_dir, "documents")).drop("kept")
