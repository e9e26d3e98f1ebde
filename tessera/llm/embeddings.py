"""Embedding near-dedup by int8 tile products with rigorous error bounds, and exact top-k search by dual trees.

Near-dedup. Vectors of a label are ordered into tiles of TILE by a kd split on their unit vectors, so that a tile is a small ball; pairs of tiles
whose balls are provably too far apart are left out. A pair of tiles multiplies int8 codes (unit vector x is scale * code + error). With
e = |error| of each vector, |x . y - s_x s_y c_x . c_y| <= e_x + e_y + e_x e_y, so pairs below the threshold by more than that are excluded,
and only the rest are recomputed in double precision. Tiles give link counts per vector and a spanning forest of their links, never pairs.

Codes are shipped first; only pairs of tiles that the bounds leave a pair of vectors open ship their vectors. Tiles are cut from buckets, which are
balls too, so far buckets leave out all their pairs of tiles at once.

Vectors that are null, empty, zero or hold null or non-finite components, and rows of null label, link with nothing; vectors of different lengths
never link. Repeated rows are vectors of their own: each gets a row, and they link with one another; component names are the smallest vec_id.
A null vec_id is kept and links with nothing. An empty table gives no rows; other columns do not take part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import common

TILE = 1024
#: Components of a bucket, about, which one task holds and splits.
BUCKET = 1 << 22
#: Parts that a label's buckets are dealt to when they are paired.
SALT = 16


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of equal length as doubles, and which rows are vectors: not null or empty, without null or non-finite components."""
    n = len(column)
    lists = column.cast(pa.list_(pa.float64()))
    lens = np.array(pa.compute.fill_null(pa.compute.list_value_length(lists), 0))
    ok = lens > 0
    dim = int(lens.max(initial=0))
    out = np.full((n, dim), np.nan)
    flat = np.array(lists.flatten().to_numpy(zero_copy_only=False), float)
    at = np.repeat(np.arange(n), lens)
    out[at, np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = flat
    good = np.ones(n, bool)
    good[at[~np.isfinite(flat)]] = False
    return out, ok & good & (lens == dim)


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale and error bound of unit vectors."""
    scale = np.maximum(np.abs(x).max(axis=1), 1e-30) / 127
    code = np.rint(x / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(x - scale[:, None] * code, axis=1) * (1 + 1e-9) + 1e-9
    return code, scale, error


#: Codes, scales and error bounds of the rows of a tile.
Side = tuple[np.ndarray, np.ndarray, np.ndarray]


def candidates(left: Side, right: Side, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows whose cosine may reach the threshold by their codes and error bounds; i < j within one tile."""
    (cx, sx, ex), (cy, sy, ey) = left, right
    # int8 products summed in float32 are exact: below 2 ** 24 up to 1040 components, so longer vectors add chunks.
    product = np.zeros((len(cx), len(cy)))
    for a in range(0, cx.shape[1], 1024):
        product += cx[:, a : a + 1024].astype(np.float32) @ cy[:, a : a + 1024].astype(np.float32).T
    bound = product * sx[:, None] * sy[None, :] + ex[:, None] + ey[None, :] + ex[:, None] * ey[None, :]
    i, j = np.nonzero(bound >= threshold - 1e-9)
    return (i[i < j], j[i < j]) if same else (i, j)


def tile_links(x: np.ndarray, y: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of unit rows of x and y of cosine >= threshold; i < j within one tile."""
    i, j = candidates(quantise(x), quantise(y), threshold, same)
    keep = np.zeros(len(i), bool)
    for a in range(0, len(i), 1 << 16):
        keep[a : a + (1 << 16)] = np.einsum("ij,ij->i", x[i[a : a + (1 << 16)]], y[j[a : a + (1 << 16)]]) >= threshold
    return i[keep], j[keep]


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Indices of the pairs that form a spanning forest of nodes 0 .. n - 1."""
    up, out = list(range(n)), []
    for k, (i, j) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        while up[j] != j:
            up[j] = up[up[j]]
            j = up[j]
        if i != j:
            up[max(i, j)] = min(i, j)
            out.append(k)
    return np.array(out, np.int64)


def split(x: np.ndarray, size: int) -> list[np.ndarray]:
    """Index lists of tiles of at most `size` rows, by halving at the median of the widest component."""
    work, out = [np.arange(len(x))], []
    while work:
        i = work.pop()
        if len(i) <= size:
            out.append(i)
            continue
        d = int(np.argmax(np.ptp(x[i], axis=0)))
        order = i[np.argsort(x[i, d], kind="stable")]
        work += [order[: len(i) // 2], order[len(i) // 2 :]]
    return out


def bucketed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with `bucket`: of about BUCKET components within the keys, of which `dim` is one. Vectors of a sign code stay together as far as it is
    small enough, and small codes share buckets; a code of more is split by row, however many equal vectors it holds."""
    code = sum((F.when(F.get("embedding", F.lit(i)) > 0, 1 << i).otherwise(0) for i in range(12)), F.lit(0))
    rows = rows.withColumn("code", code)
    per = F.greatest(F.lit(256), F.floor(F.lit(BUCKET) / F.col("dim")))
    n = rows.groupBy(*keys, "code").agg(F.count("*").alias("n")).withColumn("per", per)
    few = n.where("n <= per").groupBy(*keys).agg(F.ceil(F.sum("n") / F.max("per")).alias("parts"))
    n = common.materialise(n.join(few, keys, "left").select(*keys, "code", F.when(F.col("n") > F.col("per"), F.ceil(F.col("n") / F.col("per"))).alias("split"), "parts"), "vector-codes")
    n = F.broadcast(n) if n.count() <= 100_000 else n
    small = F.pmod(F.xxhash64("code"), F.col("parts"))
    large = (F.col("code") + 1) * F.lit(1 << 40) + F.pmod(F.xxhash64("uid"), F.col("split"))
    return rows.join(n, [*keys, "code"]).withColumn("bucket", F.when(F.col("split").isNull(), small).otherwise(large)).drop("code", "split", "parts")


def gap(a: str, b: str) -> "F.Column":
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def near(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    spark = vectors.sparkSession
    common.tune(spark)
    base = common.numbered(vectors.select("vec_id", "embedding", "label"), "near-rows").select("uid", "row.*")
    usable = base.where("vec_id is not null and label is not null and size(embedding) > 0").select("uid", "label", F.size("embedding").alias("dim"), F.col("embedding").cast("array<double>").alias("embedding"))
    dealt = bucketed(usable, ["label", "dim"])
    lk, vk = dict(vectors.dtypes)["label"], dict(vectors.dtypes)["vec_id"]

    def tiles(t: pa.Table) -> pa.Table:
        x, ok = matrix(t.column("embedding").combine_chunks())
        norm = np.sqrt((x * x).sum(axis=1))
        ok &= np.isfinite(norm) & (norm > 0)
        big = np.abs(x).max(axis=1, initial=0)
        redo = np.isfinite(x).all(axis=1) & ~ok & (big > 0)  # squares that overflow or vanish
        x[redo] /= big[redo, None]
        norm[redo] = np.linalg.norm(x[redo], axis=1)
        ok |= redo
        at = np.flatnonzero(ok)
        x, ids = x[at] / norm[at, None], t.column("uid").to_numpy()[at]
        order = np.argsort(ids, kind="stable")
        x, ids = x[order], ids[order]
        middle = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
        reach = float(np.linalg.norm(x - middle, axis=1).max(initial=0))
        rows = {c: [] for c in ("label", "dim", "bucket", "middle", "reach", "ids", "unit", "code", "scale", "error", "centre", "radius")}
        for i in split(x, TILE):
            if not len(i):
                continue
            c = x[i].mean(axis=0)
            code, scale, error = quantise(x[i])
            values = (t.column("label")[0].as_py(), x.shape[1], t.column("bucket")[0].as_py(), middle, reach, ids[i], x[i].tobytes(), code.tobytes(), scale.tobytes(), error.tobytes(), c, float(np.linalg.norm(x[i] - c, axis=1).max()))
            for column, value in zip(rows.values(), values, strict=True):
                column.append(value)
        floats, double, data = pa.list_(pa.float64()), pa.float64(), pa.binary()
        kinds = [("dim", pa.int32()), ("bucket", pa.int64()), ("middle", floats), ("reach", double), ("ids", pa.list_(pa.int64())), ("unit", data), ("code", data), ("scale", data), ("error", data), ("centre", floats), ("radius", double)]
        return pa.Table.from_pydict(rows, pa.schema([("label", t.schema.field("label").type), *kinds]))

    form = f"label {lk}, dim int, bucket long, middle array<double>, reach double, ids array<long>, unit binary, code binary, scale binary, error binary, centre array<double>, radius double"
    made = dealt.select("label", "dim", "bucket", "uid", "embedding").groupBy("label", "dim", "bucket").applyInArrow(tiles, form)
    made = common.materialise(made.withColumn("tile", F.monotonically_increasing_id()), "near-tiles")
    far = float(np.sqrt(2 - 2 * threshold)) + 1e-6
    balls = made.select("label", "dim", "bucket", "middle", "reach").dropDuplicates(["label", "dim", "bucket"])
    other = balls.select("label", "dim", F.col("bucket").alias("bucket2"), F.col("middle").alias("middle2"), F.col("reach").alias("reach2"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    meet = balls.withColumn("salt", F.pmod(F.xxhash64("bucket"), F.lit(SALT)).cast("int")).join(other, ["label", "dim", "salt"])
    meet = meet.where("bucket <= bucket2").where(gap("middle", "middle2") <= F.col("reach") + F.col("reach2") + far).select("label", "dim", "bucket", "bucket2")
    meta = made.select("label", "dim", "bucket", "tile", "centre", "radius")
    other = meta.select("label", "dim", *(F.col(c).alias(c + "2") for c in ("bucket", "tile", "centre", "radius")))
    pairs = meet.join(meta, ["label", "dim", "bucket"]).join(other, ["label", "dim", "bucket2"]).where("bucket < bucket2 or tile <= tile2")
    pairs = common.materialise(pairs.where(gap("centre", "centre2") <= F.col("radius") + F.col("radius2") + far).select("dim", "tile", "tile2"), "near-pairs")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), pairs.count() // 64)

    def both(which: DataFrame, *columns: str) -> DataFrame:
        left, right = made.select("tile", *columns), made.select(F.col("tile").alias("tile2"), *(F.col(c).alias(c + "2") for c in columns))
        return which.join(left, "tile").join(right, "tile2").repartition(parts, "tile", "tile2")

    def opened(batches):
        """The pairs of tiles with a pair of vectors that the bounds do not exclude."""
        for b in batches:
            keep = []
            for k in range(b.num_rows):
                dim, same = b.column("dim")[k].as_py(), b.column("tile")[k].as_py() == b.column("tile2")[k].as_py()
                sides = [(np.frombuffer(b.column("code" + s)[k].as_py(), np.int8).reshape(-1, dim), np.frombuffer(b.column("scale" + s)[k].as_py()), np.frombuffer(b.column("error" + s)[k].as_py())) for s in ("", "2")]
                keep.append(bool(len(candidates(*sides, threshold, same)[0])))
            yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(keep, pa.bool_())) for c in ("dim", "tile", "tile2")], names=["dim", "tile", "tile2"])

    def compare(batches):
        for b in batches:
            for k in range(b.num_rows):
                dim, t1, t2, ids, unit, ids2, unit2 = (b.column(c)[k].as_py() for c in ("dim", "tile", "tile2", "ids", "unit", "ids2", "unit2"))
                x, y = np.frombuffer(unit).reshape(-1, dim), np.frombuffer(unit2).reshape(-1, dim)
                ids, ids2, same = np.array(ids), np.array(ids2), t1 == t2
                i, j = tile_links(x, y, threshold, same)
                if not len(i):
                    continue
                n1, n2 = np.bincount(i, minlength=len(ids)), np.bincount(j, minlength=len(ids2))
                who, count = np.r_[ids[n1 > 0], ids2[n2 > 0]], np.r_[n1[n1 > 0], n2[n2 > 0]]
                keep = forest(i, j + (0 if same else len(ids)), len(ids) + (0 if same else len(ids2)))
                a = np.r_[who, ids[i[keep]]]
                c = np.r_[np.full(len(who), -1), ids2[j[keep]]]
                n = np.r_[count, np.zeros(len(keep), np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c), pa.array(n), pa.array(n == 0)], names=["a", "b", "n", "edge"])

    left = common.materialise(both(pairs, "code", "scale", "error").mapInArrow(opened, "dim int, tile long, tile2 long"), "near-open")
    found = common.materialise(both(left, "ids", "unit").mapInArrow(compare, "a long, b long, n long, edge boolean"), "near-links")
    counts = found.where("not edge").groupBy(F.col("a").alias("uid")).agg(F.sum("n").alias("n_links"))
    comp = common.components(found.where("edge").select("a", "b"), "near-components").select(F.col("node").alias("uid"), "component").join(base.select("uid", "vec_id"), "uid")
    comp = common.materialise(comp, "near-named")
    names = comp.groupBy("component").agg(F.min("vec_id").alias("component_id"), F.count("*").alias("n"))
    comp = common.lookup(comp.select("uid", "component"), names, ["component"], "n", comp.count(), ("component_id",))
    out = base.select("uid", "vec_id").join(counts, "uid", "left").join(comp.select("uid", "component_id"), "uid", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").cast(vk).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op6_near(spark, sf_dir: str) -> DataFrame:
    """Links and component of every vector at a cosine of 0.98."""
    return near(common.table(spark, sf_dir, "embeddings"))


# --- exact top-k -----------------------------------------------------------------------------------------------------

#: Rows of a cover tree's block, and queries of a group.
ROWS = 4096
QUERIES = 512
LEAF = 64


class CoverTree:
    """A cover tree over rows: nodes hold a centre, which is a row, and a covering radius; a child's radius is at most half its parent's.

    A leaf holds up to `leaf` rows, or more whose halved balls would be more than a quarter of them: such rows lie apart, and balls tell nothing of
    them. With leaf 1 every row comes to a leaf of its own, so a group's worst score is a single query's there.
    """

    def __init__(self, x: np.ndarray, leaf: int = LEAF) -> None:
        self.x = x
        self.centre: list[np.ndarray] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.rows: list[np.ndarray | None] = []
        self.leaf = leaf
        self.root = self.grow(np.arange(len(x)))

    def grow(self, i: np.ndarray) -> int:
        x = self.x[i]
        c = x[int(np.argmin(((x - x.mean(axis=0)) ** 2).sum(axis=1)))]
        d = np.sqrt(((x - c) ** 2).sum(axis=1))
        me = len(self.centre)
        self.centre.append(c)
        self.radius.append(float(d.max()) * (1 + 1e-12))
        self.children.append([])
        self.rows.append(None)
        if len(i) <= self.leaf or self.radius[me] == 0:
            self.rows[me] = i
            return me
        # Centres more than half the radius apart, until none of the rows is further than that from the nearest.
        picks, near_, of = [int(np.argmin(d))], d**2, np.zeros(len(i), np.int64)
        while near_.max() > (self.radius[me] / 2) ** 2:
            if self.leaf > 1 and len(picks) > len(i) // 4:
                self.rows[me] = i
                return me
            p = int(np.argmax(near_))
            dp = ((x - x[p]) ** 2).sum(axis=1)
            of[dp < near_] = len(picks)
            near_ = np.minimum(near_, dp)
            picks.append(p)
        groups = [i[of == g] for g in range(len(picks)) if (of == g).any()]
        self.children[me] = [self.grow(g) for g in groups]
        return me


class Search:
    """Dual-tree search of the k rows of highest inner product for each query; ties to the smaller id. floor: kth scores known already; what lies
    below need not be found."""

    def __init__(self, queries: np.ndarray, qids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray | None = None) -> None:
        self.q, self.qids, self.x, self.ids, self.k = queries, qids, rows, ids, k
        self.score = np.full((len(queries), k), -np.inf)
        self.floor = np.full(len(queries), -np.inf) if floor is None else floor
        self.who = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.scored = np.zeros(len(queries), np.int64)

    def run(self) -> None:
        self.xt = CoverTree(self.x)
        if self.xt.rows[self.xt.root] is not None:  # rows that lie apart: no ball to prune, one product for all queries
            self.leaf(np.arange(len(self.q)), self.xt.rows[self.xt.root])
            return
        self.qt = CoverTree(self.q, 1)
        # Best pairs first: the worst kth score of each query group rises early.
        import heapq

        heap = [(-np.inf, 0, self.qt.root, self.xt.root)]
        tick = 0
        while heap:
            bound, _, a, b = heapq.heappop(heap)
            if -bound < self.worst(a):
                continue
            if self.qt.rows[a] is not None and self.xt.rows[b] is not None:
                self.leaf(self.qt.rows[a], self.xt.rows[b])
                continue
            split_q = self.qt.rows[a] is None and (self.xt.rows[b] is not None or self.qt.radius[a] >= self.xt.radius[b])
            for a2, b2 in [(c, b) for c in self.qt.children[a]] if split_q else [(a, c) for c in self.xt.children[b]]:
                up = self.bound(a2, b2)
                if up >= self.worst(a2):
                    tick += 1
                    heapq.heappush(heap, (-up, tick, a2, b2))

    def bound(self, a: int, b: int) -> float:
        cq, cx, rq, rx = self.qt.centre[a], self.xt.centre[b], self.qt.radius[a], self.xt.radius[b]
        up = float(cq @ cx) + rq * float(np.linalg.norm(cx)) + rx * float(np.linalg.norm(cq)) + rq * rx
        return up + 1e-9 * abs(up) + 1e-6

    def under(self, a: int) -> np.ndarray:
        if self.qt.rows[a] is not None:
            return self.qt.rows[a]
        return np.concatenate([self.under(c) for c in self.qt.children[a]])

    def worst(self, a: int) -> float:
        """The worst kth score of the queries below a node, from the scores so far."""
        if self.qt.rows[a] is not None:
            return float(np.maximum(self.score[self.qt.rows[a], -1], self.floor[self.qt.rows[a]]).min())
        return min(self.worst(c) for c in self.qt.children[a])

    def leaf(self, qi: np.ndarray, xi: np.ndarray) -> None:
        self.scored[qi] += len(xi)
        s = self.q[qi] @ self.x[xi].T
        s[self.qids[qi][:, None] == self.ids[xi][None, :]] = -np.inf
        best = np.concatenate([self.score[qi], s], axis=1)
        who = np.concatenate([self.who[qi], np.broadcast_to(self.ids[xi], s.shape)], axis=1)
        order = np.lexsort((who, -best), axis=1)[:, : self.k]
        self.score[qi] = np.take_along_axis(best, order, axis=1)
        self.who[qi] = np.take_along_axis(who, order, axis=1)


def as_bytes(x: np.ndarray) -> bytes:
    """Whole numbers as 16-bit integers where they fit, else as doubles."""
    return (x.astype("<i2") if np.abs(x).max(initial=0) < 1 << 15 else x.astype("<f8")).tobytes()


def as_rows(data: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, "<i2" if len(data) == 2 * n * dim else "<f8").reshape(n, dim).astype(float)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score, n_scored: for each query (vec_id divisible by `every`) the rows of highest integer inner product, and how many rows were
    scored to find them.

    Rows and queries are cut into blocks and groups that are small balls. Each group searches the block nearest to it first, which gives its
    queries a kth score each; a block is met by a group only if its ball could reach the worst of these, and only then are their vectors brought together, in one
    dual-tree search. The k best of all blocks are merged.

    Vectors that are null or empty or hold null or non-finite components take no part, nor does a null vec_id. Rows of one vec_id and one
    vector count once; a vec_id with several vectors is a query, and a candidate, with each of them. Rows of a query's own vec_id are no candidates. Components
    so large that sums leave 2 ** 53 are summed with Python's integers, and scores are held to the range of long.
    """
    spark = vectors.sparkSession
    common.tune(spark)
    base = vectors.where("vec_id is not null and size(embedding) > 0").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    base = base.where(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).distinct()
    base = common.numbered(base, "topk-rows").select("uid", "row.vec_id", "row.embedding", F.size("row.embedding").alias("dim"))

    def balls(most: int):
        def cut(t: pa.Table) -> pa.Table:
            x, _ = matrix(t.column("embedding").combine_chunks())
            ids, uid = t.column("vec_id").to_numpy(), t.column("uid").to_numpy()
            order = np.argsort(uid, kind="stable")
            x, ids, uid = np.floor(scale * x[order]), ids[order], uid[order]
            rows = {c: [] for c in ("dim", "ids", "uids", "x", "centre", "radius")}
            for i in split(x, most):
                c = x[i].mean(axis=0)
                for column, value in zip(rows.values(), (x.shape[1], ids[i], uid[i], as_bytes(x[i]), c, float(np.sqrt(((x[i] - c) ** 2).sum(axis=1)).max())), strict=True):
                    column.append(value)
            longs = pa.list_(pa.int64())
            return pa.Table.from_pydict(rows, pa.schema([("dim", pa.int32()), ("ids", longs), ("uids", longs), ("x", pa.binary()), ("centre", pa.list_(pa.float64())), ("radius", pa.float64())]))

        return cut

    def packed(rows: DataFrame, most: int, name: str) -> DataFrame:
        form = "dim int, ids array<long>, uids array<long>, x binary, centre array<double>, radius double"
        made = bucketed(rows, ["dim"]).select("dim", "bucket", "uid", "vec_id", "embedding").groupBy("dim", "bucket").applyInArrow(balls(most), form)
        return common.materialise(made.withColumn("at", F.monotonically_increasing_id()), name)

    blocks = packed(base, ROWS, "topk-blocks")
    groups = packed(base.where(F.col("vec_id") % every == 0), QUERIES, "topk-groups")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    length = lambda a: F.sqrt(dot(a, a))
    left = blocks.select("dim", F.col("at").alias("block"), "centre", "radius", length("centre").alias("long"), F.pmod(F.xxhash64("at"), F.lit(SALT)).cast("int").alias("salt"))
    right = groups.select("dim", F.col("at").alias("g"), F.col("centre").alias("qc"), F.col("radius").alias("qr"), length("centre").alias("ql"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    middle = dot("centre", "qc")
    up = middle + F.col("qr") * F.col("long") + F.col("radius") * F.col("ql") + F.col("qr") * F.col("radius")
    reach = left.join(right, ["dim", "salt"]).select("block", "g", middle.alias("middle"), (up + F.abs(up) * 1e-9 + 1e-6).alias("up"))
    reach = common.materialise(reach, "topk-reach")
    first = reach.groupBy("g").agg(F.max_by("block", F.struct("middle", "block")).alias("block"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    names = ["quid", "query_id", "vec_id", "score", "scored"]

    def search(batches):
        for b in batches:
            for r in range(b.num_rows):
                dim, qids, quids, q, floor, ids, x = (b.column(c)[r].as_py() for c in ("dim", "qids", "quids", "q", "floor", "ids", "x"))
                q, x = as_rows(q, len(qids), dim), as_rows(x, len(ids), dim)
                qids, quids, ids = np.array(qids), np.array(quids), np.array(ids)
                if dim * np.abs(q).max() * np.abs(x).max() < 2.0**53:
                    known = {f["quid"]: float(f["floor"]) for f in floor or ()}
                    s = Search(q, qids, x, ids, k, np.array([known.get(u, -np.inf) for u in quids.tolist()]))
                    s.run()
                    at, col = np.nonzero(np.isfinite(s.score) & (s.score >= s.floor[:, None]))
                    yield pa.RecordBatch.from_arrays([pa.array(quids[at]), pa.array(qids[at]), pa.array(s.who[at, col]), pa.array(s.score[at, col].astype(np.int64)), pa.nulls(len(at), pa.int64())], names=names)
                    yield pa.RecordBatch.from_arrays([pa.array(quids), pa.array(qids), *[pa.nulls(len(quids), pa.int64())] * 2, pa.array(s.scored)], names=names)
                    continue
                big = [[int(v) for v in row] for row in x]
                for quid, qid, row in zip(quids.tolist(), qids.tolist(), q, strict=True):
                    row = [int(v) for v in row]
                    best = sorted((-sum(a * c for a, c in zip(row, y, strict=True)), i) for i, y in zip(ids.tolist(), big, strict=True) if i != qid)[:k]
                    if best:
                        score = [max(-(1 << 63), min((1 << 63) - 1, -s)) for s, _ in best]
                        yield pa.RecordBatch.from_arrays([pa.array([quid] * len(best)), pa.array([qid] * len(best)), pa.array([i for _, i in best]), pa.array(score, pa.int64()), pa.array([len(ids)] + [0] * (len(best) - 1), pa.int64())], names=names)

    def met(pairs: DataFrame) -> DataFrame:
        """pairs: block, g, floor."""
        asks = groups.select(F.col("at").alias("g"), F.col("ids").alias("qids"), F.col("uids").alias("quids"), F.col("x").alias("q"))
        work = pairs.join(asks, "g").join(blocks.select(F.col("at").alias("block"), "dim", "ids", "x"), "block")
        return work.repartition(parts, "block", "g").mapInArrow(search, "quid long, query_id long, vec_id long, score long, scored long")

    kind = "array<struct<quid: long, floor: long>>"
    near_ = common.materialise(met(first.withColumn("floor", F.lit(None).cast(kind))), "topk-first")
    kth = near_.where("vec_id IS NOT NULL").groupBy("quid").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k).select("quid", "floor")
    each = groups.select(F.col("at").alias("g"), F.explode("uids").alias("quid")).join(kth, "quid", "left")
    floors = each.groupBy("g").agg(F.collect_list(F.when(F.col("floor").isNotNull(), F.struct("quid", "floor"))).alias("floor"), F.min("floor").alias("worst"), F.count_if(F.col("floor").isNull()).alias("without"))
    rest = reach.join(floors, "g").where("without > 0 or up >= worst").join(first, ["g", "block"], "left_anti").select("block", "g", "floor")
    found = near_.union(met(rest))
    order = Window.partitionBy("quid").orderBy(F.col("score").desc_nulls_last(), "vec_id")
    found = found.withColumn("n_scored", F.sum("scored").over(Window.partitionBy("quid"))).withColumn("rank", F.row_number().over(order))
    return found.where((F.col("rank") <= k) & F.col("vec_id").isNotNull()).select("query_id", "rank", "vec_id", "score", "n_scored")


def op8_topk(spark, sf_dir: str) -> DataFrame:
    """The five best rows for every query vector."""
    return top_k(common.table(spark, sf_dir, "embeddings")).drop("n_scored")
