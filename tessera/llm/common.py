"""What the operators share: scratch tables, Arrow text slices, word hashes, sliding minima, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass takes; a longer document is a pass of its own.
SLICE_BYTES = 1 << 18
#: Rows of an Arrow batch. Texts are large rows, so batches are smaller than Spark's default.
BATCH_ROWS = 1000

_MADE: list[str] = []


def tune(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the cluster's spark.checkpoint.dir. A local session without it (tests) gets one of its own."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not conf:
        conf = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf


def materialise(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Cut the lineage: write the table to the shared folder and read it back. Survives lost executors. keep: release() leaves it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not keep:
        _MADE.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables of materialise() that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.scratch)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
        if t.scratch in _MADE:
            _MADE.remove(t.scratch)


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The scratch tables that are made within, for release()."""
    start, made = len(_MADE), []
    try:
        yield made
    finally:
        made += _MADE[start:]


def release(spark: SparkSession, made: list[str]) -> None:
    """Delete recorded scratch tables; call it when no open DataFrame reads them. Tables of other queries stay."""
    while made:
        name = made.pop()
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        if name in _MADE:
            _MADE.remove(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame, name: str) -> DataFrame:
    """uid and row (a struct of all columns), written and read back: a number for every row, repeated rows included, that no other row has."""
    return materialise(df.select(F.monotonically_increasing_id().alias("uid"), F.struct(*df.columns).alias("row")), name)


#: A key with more than this share of the rows is hot, so there are fewer than 1 / HOT_SHARE hot keys, and these are broadcast.
HOT_SHARE = 0.004


def lookup(left: DataFrame, right: DataFrame, keys: list[str], n: str, total: int, keep: tuple[str, ...], top: int | None = None) -> DataFrame:
    """left joined to right, which has each key once, and in `n` no less than the number of rows of left with it; total: rows of left.

    Rows of hot keys meet a broadcast of at most 1 / HOT_SHARE rows where they lie; all others are dealt by key. top: a bound on n, where one is
    known; if it says that no key is hot, all rows are dealt.
    """
    right = right.select(*keys, n, *(c for c in keep if c != n))
    if top is not None and top <= total * HOT_SHARE:
        return left.join(right, keys).select(*left.columns, *keep)
    hot = F.broadcast(right.where(F.col(n) > total * HOT_SHARE))
    cold = right.where(F.col(n) <= total * HOT_SHARE)
    out = [*left.columns, *keep]
    return left.join(hot, keys).select(*out).union(left.join(hot.select(*keys), keys, "left_anti").join(cold, keys).select(*out))


# --- text as numpy ---------------------------------------------------------------------------------------------------


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of rows of about `limit` bytes: first row, end row, UTF-8 bytes, offsets of the rows in them. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1))
        yield lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def lists_of(column: pa.Array) -> Callable[[int], np.ndarray]:
    """The list of longs of a row, without copies; a null is empty."""
    offs, values = column.offsets.to_numpy(), column.values.to_numpy()
    null = column.is_null().to_numpy(zero_copy_only=False)
    return lambda i: values[:0] if null[i] else values[offs[i] : offs[i + 1]]


_RNG = np.random.default_rng(20240607)
BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE_LOWER = BYTE.copy()
BYTE_LOWER[65:91] = BYTE[97:123]
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** i mod 2 ** 64 for i < n."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        out = np.full(size, base, np.uint64)
        out[0] = 1
        have = _POWERS[base] = np.cumprod(out, dtype=np.uint64)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def runs_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each pair, the same wherever the run stands."""
    n = len(values)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(_P, n), out=total[1:], dtype=np.uint64)
    return mix((total[end] - total[start]) * powers(_PINV, n + 1)[start] + (end - start).astype(np.uint64))


def grams_hash(values: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """runs_hash of every k consecutive values."""
    n = len(values)
    if n < k:
        return np.zeros(0, np.uint64)
    v = values if not salt else mix(values ^ np.uint64(salt))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(v * powers(_P, n), out=total[1:], dtype=np.uint64)
    return mix((total[k:] - total[:-k]) * powers(_PINV, n - k + 1))


def words_of(buf: np.ndarray, offs: np.ndarray, byte_table: np.ndarray = BYTE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words [^ space, tab to carriage return]+ of the rows: start, end, row and hash of each."""
    start, end = word_bounds(buf, offs)
    row = np.searchsorted(offs, start, "right") - 1
    if not len(start):
        return start, end, row, np.zeros(0, np.uint64)
    return start, end, row, runs_hash(byte_table[buf], start, end)


def word_bounds(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~SPACE[buf]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    first = offs[:-1]
    before[first[first < n]] = False
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    last = offs[1:] - 1
    after[last[last >= 0]] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


_POS_BITS = np.uint64(30)
_POS = np.uint64((1 << 30) - 1)


def leftmost_minima(h: np.ndarray, w: int) -> np.ndarray:
    """For each window of w hashes, the place of its smallest one, the leftmost of equals. Depends on the window's content alone."""
    n = len(h)
    if n < w:
        return np.zeros(0, np.int64)
    packed = ((h >> _POS_BITS) << _POS_BITS) | np.arange(n, dtype=np.uint64)
    m = -(-n // w) * w
    x = np.full(m, np.iinfo(np.uint64).max, np.uint64)
    x[:n] = packed
    x = x.reshape(-1, w)
    prefix = np.minimum.accumulate(x, axis=1).ravel()
    suffix = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(suffix[: n - w + 1], prefix[w - 1 : n]) & _POS).astype(np.int64)


def i64(a: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(a).astype(np.uint64, copy=False).view(np.int64)


def cover(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """True where any of the spans [start, end) lies."""
    d = np.bincount(start, minlength=n + 1) - np.bincount(end, minlength=n + 1)
    return np.cumsum(d[:-1]) > 0


# --- components ------------------------------------------------------------------------------------------------------


#: Rounds of components() whose labels one plan joins.
LABELS = 4


def components(edges: DataFrame, name: str = "components", known: DataFrame | None = None) -> DataFrame:
    """(node, component): the smallest node that each node of the edges (a, b) reaches. known: what this gave for earlier edges, which these add to.

    Rounds of contraction: every node goes to the smallest of itself and its neighbours, edges are rewritten and made
    distinct, until none is left; each round at least halves the nodes. Known components are one node each from the start. Minima are combined before they
    are shuffled, so a node with very many edges is no hot spot. Each round is written to the shared folder; the driver sees only counts.
    """
    if known is not None:
        ka, kb = (known.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")) for c in "ab")
        edges = edges.join(ka, "a", "left").join(kb, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    e = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
    labels, open_ = None, 0
    while not e.isEmpty():
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up")).select("node", F.least("node", "up").alias("up")), name)
        if labels is None:
            labels = to.select("node", F.col("up").alias("component"))
        else:
            labels, open_ = relabelled(labels, to), open_ + 1
            if open_ == LABELS:
                labels, open_ = materialise(labels, name), 0
        ua, ub = to.select(F.col("node").alias("a"), F.col("up").alias("ua")), to.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        moved = e.join(ua, "a").join(ub, "b").where("ua <> ub")
        e = materialise(moved.select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct(), name)
    if labels is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component")) if known is None else known
    labels = materialise(labels, name) if open_ else labels
    if known is None:
        return labels
    # The name of a known component is a node of it, so it is labelled by the first part and new nodes by the second.
    out = relabelled(known, labels.withColumnRenamed("component", "up")).union(labels.join(known.select("node"), "node", "left_anti"))
    return materialise(out, name)


def relabelled(labels: DataFrame, to: DataFrame) -> DataFrame:
    up = to.select(F.col("node").alias("component"), "up")
    return labels.join(up, "component", "left").select("node", F.coalesce("up", "component").alias("component"))
