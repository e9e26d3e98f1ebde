"""Fill-in-middle transformation: a kernel on Arrow's UTF-8 buffers cuts all rows of a slice at once, and turns the output back into texts.

Every byte gets a class from a table; a table over the classes of two adjacent bytes says where a unit starts; its cumulative sums, less their value at a
document's first byte, number the units of each document; one searchsorted finds the cuts of all rows. Texts are taken in slices of bounded bytes, a longer
document alone. Nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tessera.llm import common

#: Marks of prefix, suffix and middle: "<", one ASCII letter, ">". No mark can begin inside another or across its edge, so outputs can be read back.
MARKS = ("<P>", "<S>", "<M>")
FORMS = ("plain", "psm", "spm")
SLICE_BYTES = 1 << 22

#: Class of a byte: 0 inside a code point, 1 white space, 2 any other first byte.
CLASS = np.full(256, 2, np.uint8)
CLASS[0x80:0xC0] = 0
CLASS[common.SPACE] = 1
#: Whether a unit starts at a byte, by the classes of the byte before it and its own. A word takes the white space behind it.
STARTS = {
    "char": np.array([[False, True, True]] * 3),
    "word": np.array([[False, False, False], [False, False, True], [False, False, False]]),
}


def cut_all(buf: np.ndarray, offs: np.ndarray, unit: str = "char"):
    """n, the units of each row, and a function from unit numbers (one a row, at most n) to the bytes where these units start."""
    first, last = offs[:-1], offs[1:]
    mark = np.ones(len(buf), bool)
    kinds = CLASS[buf]
    mark[1:] = STARTS[unit][kinds[:-1], kinds[1:]]
    mark[first[first < last]] = True
    total = np.zeros(len(buf) + 1, np.int32 if len(buf) < 1 << 31 else np.int64)
    np.cumsum(mark, out=total[1:])
    before = total[first].astype(np.int64)
    return total[last] - before, lambda k: np.minimum(np.searchsorted(total[1:], (before + k + 1).astype(total.dtype)), last)


def found(buf: np.ndarray, offs: np.ndarray, mark: str) -> tuple[np.ndarray, np.ndarray]:
    """Place and row of every occurrence of a mark within a row."""
    n = len(buf) - len(mark) + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hit = buf[:n] == ord(mark[0])
    for i, c in enumerate(mark[1:], 1):
        hit &= buf[i : n + i] == ord(c)
    at = np.flatnonzero(hit)
    row = np.searchsorted(offs, at, "right") - 1
    inside = at + len(mark) <= offs[row + 1]
    return at[inside], row[inside]


def joined(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Texts made of pieces [start, end) of the buffer and the marks behind it, one row of the matrices a text."""
    source = np.concatenate([buf, np.frombuffer("".join(MARKS).encode(), np.uint8)])
    s, e = start.ravel(), end.ravel()
    some = np.flatnonzero(e > s)
    out = np.concatenate([source[a:b] for a, b in zip(s[some].tolist(), e[some].tolist(), strict=True)]) if len(some) else source[:0]
    offs = np.zeros(len(start) + 1, np.int64)
    np.cumsum((end - start).sum(axis=1), out=offs[1:])
    kind = (pa.StringArray, np.int32) if offs[-1] < 1 << 31 else (pa.LargeStringArray, np.int64)
    return kind[0].from_buffers(len(start), pa.py_buffer(offs.astype(kind[1])), pa.py_buffer(out))


def transformed(buf: np.ndarray, offs: np.ndarray, h: np.ndarray, rate: int, spm: int, unit: str):
    """n, form, units of prefix and of middle, and the output of each row; h: four numbers a row."""
    n, cut = cut_all(buf, offs, unit)
    one, two = h[0] % (n + 1), h[1] % (n + 1)
    lo, hi = np.minimum(one, two), np.maximum(one, two)
    form = np.where(h[3] % 100 < spm, 2, 1)
    form[(n == 0) | (h[2] % 100 >= rate)] = 0
    for m in MARKS:
        form[found(buf, offs, m)[1]] = 0
    first, last, a, b = offs[:-1], offs[1:], cut(lo), cut(hi)
    mark = [(np.full(len(n), len(buf) + 3 * i), np.full(len(n), len(buf) + 3 * i + 3)) for i in range(3)]
    none = (first, first)
    prefix, middle, suffix = (first, a), (a, b), (b, last)
    by_form = [[(first, last), *[none] * 5], [mark[0], prefix, mark[1], suffix, mark[2], middle], [mark[1], suffix, mark[0], prefix, mark[2], middle]]
    start, end = (np.choose(form[:, None], [np.stack([p[i] for p in pieces], axis=1) for pieces in by_form]) for i in (0, 1))
    return n, form, lo, hi - lo, joined(buf, start, end)


def rebuilt(buf: np.ndarray, offs: np.ndarray, form: np.ndarray) -> pa.Array:
    """The texts that outputs of these forms (0 plain, 1 psm, 2 spm) were made of."""
    first, last = offs[:-1], offs[1:]
    at = []
    for m in MARKS:
        place, row = found(buf, offs, m)
        where = first.copy()
        where[row] = place
        at.append(where)
    p, s, m = at
    none = (first, first)
    by_form = [[(first, last), none, none], [(p + 3, s), (m + 3, last), (s + 3, m)], [(p + 3, m), (m + 3, last), (s + 3, p)]]
    start, end = (np.choose(form[:, None], [np.stack([x[i] for x in pieces], axis=1) for pieces in by_form]) for i in (0, 1))
    return joined(buf, start, end)


def draws(key: Column, seed: str) -> list[Column]:
    """Four unsigned 32-bit numbers of a row: the first digits of the SHA-256 of seed, a colon and the key (null: empty)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def fill_in_middle(docs: DataFrame, seed: str = "1", rate: int = 90, spm: int = 20, unit: str = "char") -> DataFrame:
    """doc_id, n, form, prefix_<unit>s, middle_<unit>s, output of every document: plain, `<P>`prefix`<S>`suffix`<M>`middle, or the suffix first.

    rate: percent of texts that are rearranged, spm: percent of these with the suffix first. A null or empty text is plain and empty, as is one that
    holds a mark. Rows with equal doc_id (null included) draw the same numbers, so repeated rows give repeated results; other columns are not read.
    A text of any length is cut whole.
    """
    common.tune(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        for batch in batches:
            for lo, hi, buf, offs in common.text_slices(batch.column(1), SLICE_BYTES):
                h = [batch.column(i).slice(lo, hi - lo).to_numpy() for i in range(2, 6)]
                n, form, prefix, middle, out = transformed(buf, offs, h, rate, spm, unit)
                plain = form == 0
                cols = [batch.column(0).slice(lo, hi - lo), pa.array(n.astype(np.int64)), pa.array(np.array(FORMS)[form]), pa.array(prefix, pa.int64(), mask=plain), pa.array(middle, pa.int64(), mask=plain), out]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    names = ["doc_id", "n", "form", f"prefix_{unit}s", f"middle_{unit}s", "output"]
    return docs.select("doc_id", "text", *draws(F.col("doc_id"), seed)).mapInArrow(run, f"doc_id {kind}, n long, form string, {names[3]} long, {names[4]} long, output string")


def restore(outputs: DataFrame) -> DataFrame:
    """The columns of fill_in_middle's result and restored, the exact text rebuilt from output and form alone."""
    names = [*outputs.columns, "restored"]

    def run(batches):
        for batch in batches:
            for lo, hi, buf, offs in common.text_slices(batch.column(names.index("output")), SLICE_BYTES):
                part = batch.slice(lo, hi - lo)
                form = part.column(names.index("form")).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([*part.columns, rebuilt(buf, offs, np.where(form == "psm", 1, np.where(form == "spm", 2, 0)))], names=names)

    return outputs.mapInArrow(run, StructType([*outputs.schema.fields, StructField("restored", StringType())]))


def op12_middle(spark, sf_dir: str) -> DataFrame:
    """Every whole text cut and rearranged, and rebuilt."""
    out = restore(fill_in_middle(common.table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
