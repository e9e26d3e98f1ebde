"""N-gram Jaccard join: a size-aware heavy-light join over sets of word shingles, up to the components of its links.

Texts with equal sets are one node, named by a 64-bit digest of the set; a second digest tells sets of one name apart, and these are named anew until no name
is held by two sets. Nodes with sets of at most `boundary` shingles are light, others heavy.

Light sets: two sets of a and b shingles link when they share o(a, b) = ceil(t (a + b) / (1 + t)); so a light set enumerates, for each
size b that may link, its subsets of exactly o(a, b) shingles, and linked sets meet at one of them.

Heavy sets: sizes are put in bands of ratio 1 / t, so linked sets are in the same or in neighbouring bands. Linked sets of upper band K
differ in at most d_K shingles, so if shingles are dealt by hash to d_K + 1 blocks, they agree on one whole block: an inverted list of a
band's block value holds all sets that may link there. Some blocks are empty, and that two sets agree on those says little: there are
`spare` more blocks than d_K + 1, so a set with no more empty ones than that posts only the others, and still agrees with a linked set on one of
them; a set with more posts them all. Light sets near the boundary also enter these lists.

The boundary is the size at which enumerating subsets starts to cost more than posting blocks, by the histogram of sizes of all documents.

Lists are scanned without emitting their pairs: three nodes of each list are its pivots; every node is verified
against the pivots it shares most lists with; the components of these links are then joined to the lists, nodes outside a list's most frequent component are verified against the nearest
nodes that stand for it, in rounds, and only pairs of one list that lie in
different components are verified: those outside the list's most frequent component against each other, and against that component, once for all lists that share it,
if its ball leaves a link possible. Of these, a pair is dropped when
its parity sketches (bit h of 64 * SKETCH flips for each shingle that hashes to h) differ in more bits than linked sets of their sizes
differ in shingles: the number of differing bits is a lower bound of that. A sketch of fixed width is full for large sets, and then excludes no pair, so these have
wider ones in tiles. Every pair of a list is thus verified, excluded or already
connected, so components are those of all links. A part of
the postings that is far above the average, as one list may hold a third of all nodes, is not read by one task: its postings are rows, whose pivots are
aggregates and found again by key. Verification counts shared shingles of the whole texts.

Nulls and texts without words have no shingles and no links; a null doc_id is never a component's name unless all of it is null. Repeated
rows share node and component. Other columns do not take part. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

#: Sizes above this are never light: their subsets outnumber any list.
LIGHT_MOST = 40
#: Postings that a task packs at once, and of a part on average.
FLUSH, PART = 1 << 19, 1 << 19
#: Shuffle partitions that parts are dealt to at most; a partition takes its parts one after the other.
PARTITIONS = 20_000
#: Pairs of short lists that a task holds at once.
SLICE = 1 << 20
#: 64-bit words of a parity sketch.
SKETCH = 32
#: Bits in which two sketches differ. A sketch is one column, as plans of a column for each word are large.
DIFFER = "aggregate(zip_with(sketch, xsketch, (p, q) -> bit_count(p ^ q)), 0, (t, d) -> t + d)"
#: Words of the folded sketch that long lists carry.
FOLD = 8
#: Sets of more shingles than the first number take a sketch of their own to tiles, as their folded ones are full; beyond the second it has LARGE_SKETCH words.
FULL_FROM, LARGE_FROM, LARGE_SKETCH = 700, 2000, 4 * SKETCH
#: Pairs whose own sketches are compared at once.
CHUNK = 1 << 12
#: Pairs that a task of tiles remembers.
SEEN = 1 << 18
#: Lists of at most so many nodes are pairs at once; longer ones go by pivots.
SHORT = 32
#: Pivots that a node is verified against at first.
PIVOTS = 3
#: Times that nodes outside a list's most frequent component are verified against nodes of it before pairs are scanned.
ROUNDS = 1
#: A main component is met as a whole unless these are more than so many times the pairs of its lists.
WHOLE = 4
#: Nodes of a block of a list; blocks meet blocks, and pairs are made within a task, by sketches.
TILE = 512
#: A part of more than so many times PART postings is split over tasks.
LARGE = 8
#: Bits of a node's first name.
NAME_BITS = 64
#: Cost of verifying a candidate of a list against that of one posting.
VERIFY = 3.0


def shingle_sets(column: pa.Array, k: int):
    """For each row: its number, and its distinct k-word shingles as sorted 64-bit hashes; A-Z count as a-z. One of all words if fewer."""
    for lo, hi, buf, offs in common.text_slices(column):
        start, _, row, h = common.words_of(buf, offs, common.BYTE_LOWER)
        grams = common.grams_hash(h, k)
        first = np.searchsorted(row, np.arange(hi - lo + 1))
        for i in range(hi - lo):
            a, b = int(first[i]), int(first[i + 1])
            if b - a >= k:
                yield lo + i, np.unique(grams[a : b - k + 1])
            elif b > a:
                yield lo + i, common.mix(common.grams_hash(h[a:b], b - a) + np.uint64(b - a))
            else:
                yield lo + i, np.zeros(0, np.uint64)


def digest(s: np.ndarray, salt: int = 0) -> int:
    """A signed 64-bit digest of a set; 0 is kept for the empty one."""
    if not len(s):
        return 0
    tag = np.uint64(0xA5A5 + salt * 0x632BE59BD9B4E019 & (1 << 64) - 1)
    x = int(common.mix(np.array([int(common.mix(s + tag).sum(dtype=np.uint64)) ^ len(s) * 0x2545F491], np.uint64))[0])
    return (x or 1) - (1 << 64) if (x or 1) >= 1 << 63 else (x or 1)


def name_of(s: np.ndarray, shared: frozenset[int], bits: int) -> int:
    """The first of a set's digests that is not among the names known to be shared by unlike sets; of the first one, `bits` bits count."""
    first = digest(s)
    first = first if bits == 64 or not first else (first & (1 << bits) - 1) or 1
    return first if first not in shared else next(d for d in (digest(s, i) for i in itertools.count(2)) if d not in shared)


def parity(s: np.ndarray, words: int = SKETCH) -> np.ndarray:
    """The parity sketch of a set: signed 64-bit words. A wider one, its parts of SKETCH words combined by xor, is the narrower one."""
    bits = np.bincount(((s >> np.uint64(20)) % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def own_sketch(s: np.ndarray) -> bytes | None:
    """The sketch that a set takes to tiles: none where the folded one does."""
    return None if len(s) <= FULL_FROM else parity(s, SKETCH if len(s) <= LARGE_FROM else LARGE_SKETCH).tobytes()


def sketches(own: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The narrow form of each sketch, the wide form of those that have one (else zeros), and which these are."""
    wide = np.array([len(x) == 8 * LARGE_SKETCH for x in own], bool)
    full = np.zeros((len(own), LARGE_SKETCH), np.uint64)
    for i, x in enumerate(own):
        full[i, : len(x) // 8] = np.frombuffer(x, np.uint64)
    narrow = np.bitwise_xor.reduce(full.reshape(len(own), -1, SKETCH), axis=1)
    return narrow, np.where(wide[:, None], full, np.uint64(0)), wide


def least_apart(one: list[bytes], two: list[bytes]) -> np.ndarray:
    """A lower bound of the shingles in which the sets of each pair of sketches differ."""
    (a, wa, la), (b, wb, lb) = sketches(one), sketches(two)
    return np.where(la & lb, np.bitwise_count(wa ^ wb).sum(axis=1, dtype=np.int64), np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64))


def overlap(a: int, b: int, num: int, den: int) -> int:
    """Shingles that sets of a and b must share to link: the least o with den * o >= num * (a + b - o)."""
    return -(-num * (a + b) // (num + den))


def partners(a: int, num: int, den: int) -> range:
    return range(max(1, -(-num * a // den)), den * a // num + 1)


def light_cost(a: int, num: int, den: int) -> int:
    return sum(math.comb(a, o) for b in partners(a, num, den) if (o := overlap(a, b, num, den)) <= a)


class Bands:
    """Bands of sizes of ratio den / num, and the number of blocks of each."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den, self.first, self.known = num, den, [1], {}

    def of(self, n: int) -> int:
        while self.first[-1] <= n:
            self.first.append(max(self.first[-1] + 1, self.den * (self.first[-1] - 1) // self.num + 1))
        return int(np.searchsorted(self.first, n, "right")) - 1

    def blocks(self, band: int) -> tuple[int, int]:
        """Blocks of a band, and how many more they are than linked sets can differ in: so many empty ones may a set leave out."""
        if band not in self.known:
            while len(self.first) <= band + 1:
                self.of(self.first[-1])
            top, low = self.first[band + 1] - 1, self.first[max(0, band - 1)]
            least = (self.den - self.num) * 2 * top // (self.den + self.num) + 1
            spare = 0
            for _ in range(4):  # what a set of the least size leaves empty, and four deviations
                empty = (least + spare) * math.exp(-low / (least + spare))
                spare = math.ceil(empty + 4 * math.sqrt(empty))
            self.known[band] = (least + spare, spare) if spare <= least else (least, 0)
        return self.known[band]


def heavy_cost(n: int, bands: Bands) -> float:
    k = bands.of(n)
    return (bands.blocks(k)[0] + bands.blocks(k + 1)[0]) * (1 + VERIFY / 10)


def boundary(histogram: dict[int, int], num: int, den: int) -> int:
    """The largest size up to which enumerating subsets is cheaper in sum than posting blocks."""
    bands, best, best_saved, saved = Bands(num, den), 0, 0.0, 0.0
    for n in range(1, LIGHT_MOST + 1):
        saved += histogram.get(n, 0) * (heavy_cost(n, bands) - light_cost(n, num, den))
        if saved > best_saved:
            best, best_saved = n, saved
    return best


def signatures(s: np.ndarray, num: int, den: int, light: int, bands: Bands) -> np.ndarray:
    """The keys of the lists that a set enters."""
    n, keys = len(s), []
    if n <= light:
        for b in partners(n, num, den):
            o = overlap(n, b, num, den)
            if b <= light and o <= n:
                c = np.array(list(itertools.combinations(range(n), o)), np.int64).reshape(-1, o)
                tag = np.uint64(min(n, b) * 1_000_003 + max(n, b))
                keys.append(common.mix(common.mix(s)[c].sum(axis=1, dtype=np.uint64) + tag * np.uint64(0x9E3779B1)))
        if n * den < num * (light + 1):
            return np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    return np.concatenate([*keys, block_keys(s, bands)])


def block_keys(s: np.ndarray, bands: Bands, salt: int = 0) -> np.ndarray:
    """The keys of a set's blocks in its band and the next; linked sets share one. salt: another dealing of shingles to blocks."""
    n, keys = len(s), []
    k = bands.of(n)
    values = common.mix(s ^ np.uint64(0x51ED27))
    dealt = common.mix(s + np.uint64(salt)) if salt else s
    for band in (k, k + 1):
        p, spare = bands.blocks(band)
        block = (dealt % np.uint64(p)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(values[order], out=total[1:], dtype=np.uint64)
        cut = np.searchsorted(block[order], np.arange(p + 1))
        sums = total[cut[1:]] - total[cut[:-1]]
        key = common.mix(common.mix(sums + np.uint64(band * 0x10001)) + np.arange(p, dtype=np.uint64))
        full = cut[1:] > cut[:-1]
        keys.append(key[full] if p - int(full.sum()) <= spare else key)
    return np.concatenate(keys)


def nodes_of(docs: DataFrame, k: int, shared: frozenset[int], bits: int) -> DataFrame:
    """doc_id, hash of the text, node, second digest, n_shingles and the parity sketches, sketch and own, of every document; node is 0 without shingles."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        for b in batches:
            (n, d, e), p, own = np.zeros((3, b.num_rows), np.int64), np.zeros((b.num_rows, SKETCH), np.int64), [None] * b.num_rows
            for i, s in shingle_sets(b.column(1), k):
                n[i], d[i], e[i], p[i], own[i] = len(s), name_of(s, shared, bits), digest(s, 1), parity(s), own_sketch(s)
            sketch = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * SKETCH), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(d), pa.array(e), pa.array(n), sketch, pa.array(own, pa.binary())], names=["doc_id", "th", "node", "second", "n_shingles", "sketch", "own"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(run, f"doc_id {kind}, th long, node long, second long, n_shingles long, sketch array<long>, own binary")


def postings(docs: DataFrame, k: int, num: int, den: int, light: int, parts: int, shared: frozenset[int], bits: int) -> DataFrame:
    """part, n, keys, nodes: postings dealt to `parts` parts by key and packed, a row for each part and FLUSH postings of a task."""

    def packed(keys: list, nodes: list, lens: list):
        key, node = np.concatenate(keys), np.repeat(np.array(nodes, np.int64), lens)
        part = (key % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        key, node = (key // np.uint64(parts))[order].astype(np.uint32), node[order]
        there, first = np.unique(part[order], return_index=True)
        cut = np.r_[first, len(key)]
        cols = [[x[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)] for x in (key, node)]
        return pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(np.diff(cut), pa.int64()), *(pa.array(c, pa.binary()) for c in cols)], names=["part", "n", "keys", "nodes"])

    def run(batches):
        bands, keys, nodes, lens, seen, total = Bands(num, den), [], [], [], set(), 0
        for b in batches:
            for _, s in shingle_sets(b.column(0), k):
                if len(s) and (d := name_of(s, shared, bits)) not in seen:
                    seen.add(d)
                    keys.append(signatures(s, num, den, light, bands))
                    nodes.append(d)
                    lens.append(len(keys[-1]))
                    total += lens[-1]
                    if total >= FLUSH:
                        yield packed(keys, nodes, lens)
                        keys, nodes, lens, seen, total = [], [], [], set(), 0
        if total:
            yield packed(keys, nodes, lens)

    return docs.select("text").mapInArrow(run, "part int, n long, keys binary, nodes binary")


PAIR = np.dtype([("a", np.int64), ("b", np.int64)])


def distinct(pairs: np.ndarray) -> np.ndarray:
    order = np.lexsort((pairs["b"], pairs["a"]))
    pairs = pairs[order]
    return pairs[np.r_[True, pairs[1:] != pairs[:-1]]] if len(pairs) else pairs


def scanned(packed: DataFrame, parts: int) -> DataFrame:
    """key, node and pivots p0, p1, p2 of the lists of more than SHORT nodes; and, under key -1, the distinct pairs node, p0 of shorter ones, a
    bounded number for each posting. A part holds PART postings on average; those of more than LARGE times that are left to `split`."""

    def run(batches):
        keys, nodes, part = [], [], None

        def lists(part, keys, nodes):
            key, node = np.concatenate(keys), np.concatenate(nodes)
            order = np.lexsort((node, key))
            key, node = key[order], node[order]
            fresh = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]
            key, node = key[fresh], node[fresh]
            head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[head, len(key)])
            many = np.repeat(size > 1, size)
            key, node, head, size = key[many], node[many], None, size[size > 1]
            if not len(key):
                return
            head = np.cumsum(size) - size
            # Short lists: distinct pairs in slices of at most SLICE pairs, lists of one least node together, so that repeats meet in a slice.
            i = np.flatnonzero((size <= SHORT))
            i = i[np.lexsort((node[head + size - 1][i], node[head][i]))]
            made = np.cumsum(size[i] * (size[i] - 1) // 2)
            for lists_ in np.split(i, np.flatnonzero(np.diff(made // SLICE)) + 1):
                first, n = head[lists_], size[lists_]
                met = [np.zeros(0, PAIR)]
                for gap in range(1, int(n.max(initial=1))):
                    m = np.maximum(n - gap, 0)
                    at = np.repeat(first, m) + np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
                    both = np.empty(len(at), PAIR)
                    both["a"], both["b"] = node[at], node[at + gap]
                    met.append(both)
                met = distinct(np.concatenate(met))
                yield from rows(np.full(len(met), -1), met["a"], met["b"], met["b"], met["b"])
            # Long lists: three pivots, the third by another order.
            long_ = size > SHORT
            low, high = node[head], node[head + size - 1]
            odd = common.mix(node.view(np.uint64))
            third = node[np.flatnonzero(odd == np.repeat(np.minimum.reduceat(odd, head), size))]
            of = np.repeat(np.arange(len(size)), size)
            i = np.flatnonzero(long_[of])
            yield from rows(key.astype(np.int64)[i] * parts + part, node[i], low[of[i]], high[of[i]], third[of[i]])

        def rows(*cols):
            for a in range(0, len(cols[0]), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(c[a : a + (1 << 18)]) for c in cols], names=["key", "node", "p0", "p1", "p2"])

        for b in batches:
            for i in range(b.num_rows):
                p = b.column(0)[i].as_py()
                if p != part and keys:
                    yield from lists(part, keys, nodes)
                    keys, nodes = [], []
                part = p
                keys.append(np.frombuffer(b.column(2)[i].as_py(), np.uint32))
                nodes.append(np.frombuffer(b.column(3)[i].as_py(), np.int64))
        if keys:
            yield from lists(part, keys, nodes)

    return packed.repartition(min(parts, PARTITIONS), "part").sortWithinPartitions("part").mapInArrow(run, "key long, node long, p0 long, p1 long, p2 long")


def split(packed: DataFrame, parts: int) -> DataFrame:
    """What `scanned` gives, by rows: no task reads a whole part or list. Pivots are aggregates, combined before they are shuffled."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                key = np.frombuffer(b.column(2)[i].as_py(), np.uint32).astype(np.int64) * parts + b.column(0)[i].as_py()
                node = np.frombuffer(b.column(3)[i].as_py(), np.int64)
                for a in range(0, len(key), 1 << 18):
                    yield pa.RecordBatch.from_arrays([pa.array(key[a : a + (1 << 18)]), pa.array(node[a : a + (1 << 18)])], names=["key", "node"])

    rows = common.materialise(packed.repartition("part", "nodes").mapInArrow(run, "key long, node long").distinct(), "jaccard-split")
    each = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("p0"), F.max("node").alias("p1"), F.min_by("node", F.xxhash64("node")).alias("p2"))
    each = common.materialise(each.where("n > 1"), "jaccard-split-keys")
    out = common.lookup(rows, each, ["key"], "n", rows.count(), ("n", "p0", "p1", "p2"))
    few = out.where(f"n <= {SHORT}")
    pairs = few.select("key", "node").join(few.select("key", F.col("node").alias("x")), "key").where("node < x").select("node", "x").distinct()
    return out.where(f"n > {SHORT}").select("key", "node", "p0", "p1", "p2").union(pairs.select(F.lit(-1).cast("long"), "node", "x", "x", "x"))


def lists_of(packed: DataFrame, parts: int) -> DataFrame:
    """The lists of all parts, written to the shared folder. Parts of more than LARGE * PART postings are at most 1 / LARGE of the parts, of 4 bytes each."""
    large = common.materialise(packed.groupBy("part").agg(F.sum("n").alias("n")).where(F.col("n") > LARGE * PART).select("part"), "jaccard-large")
    if large.isEmpty():
        return common.materialise(scanned(packed, parts), "jaccard-lists")
    near, far = packed.join(F.broadcast(large), "part", "left_anti"), packed.join(F.broadcast(large), "part", "left_semi")
    return common.materialise(scanned(near, parts).union(split(far, parts)), "jaccard-lists")


def verified(pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets link."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            # A batch often holds many pairs of one node: each distinct text is cut once.
            left, right = b.column(2).dictionary_encode(), b.column(3).dictionary_encode()
            sets = [[s for _, s in shingle_sets(c.dictionary, k)] for c in (left, right)]
            ok = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(left.indices.to_numpy(), right.indices.to_numpy(), strict=True)):
                s, t = sets[0][x], sets[1][y]
                if den * min(len(s), len(t)) >= num * max(len(s), len(t)):
                    o = len(s) + len(t) - len(np.union1d(s, t))
                    ok[i] = den * o >= num * (len(s) + len(t) - o)
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])

    ta, tb = (texts.select(F.col("node").alias(c), F.col("text").alias(f"t{c}")) for c in "ab")
    return pairs.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def texts_of(docs: DataFrame, known: DataFrame, pairs: DataFrame) -> DataFrame:
    """node, text of the nodes of the pairs."""
    return text_of(docs, known, pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct())


def text_of(docs: DataFrame, known: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, text of the nodes: the text of one document of each, found by its doc_id and hash."""
    rep = known.select("node", F.col("doc_id").alias("rep_id"), F.col("th").alias("rep_th")).join(wanted, "node")
    return docs.join(rep, F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.xxhash64("text") == F.col("rep_th"))).groupBy("node").agg(F.min("text").alias("text"))


def in_components(lists: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """key, node, c of the lists, c the node's component of those found; and key, main, rep, size, outside of those of more than one component: the most
    frequent one, a node of it that differs from list to list, the list's nodes, and those outside the most frequent component."""
    named = common.materialise(lists.select("key", "node").join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("c")), "jaccard-named")
    each = named.groupBy("key", "c").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("node", "key"), "node")).alias("r"))
    each = each.groupBy("key").agg(F.max(F.struct("n", "c", F.col("r.node").alias("rep"))).alias("m"), F.min("c").alias("lo"), F.max("c").alias("hi"), F.sum("n").alias("size"))
    return named, common.materialise(each.where("lo < hi").select("key", F.col("m.c").alias("main"), F.col("m.rep").alias("rep"), "size", (F.col("size") - F.col("m.n")).alias("outside")), "jaccard-main")


def outside(lists: DataFrame, found: DataFrame, total: int) -> DataFrame:
    """key, node, c, main, rep of the postings outside their list's most frequent component, and the nodes of the list outside and inside it."""
    named, main = in_components(lists, found)
    out = common.lookup(named, main, ["key"], "size", total, ("main", "rep", "size", "outside")).where("c <> main")
    return common.materialise(out.select("key", "node", "c", "main", "rep", "outside", (F.col("size") - F.col("outside")).alias("inside")), "jaccard-outside")


def left_open(outer: DataFrame, lists: DataFrame, total: int, found: DataFrame, known: DataFrame, short: DataFrame, num: int, den: int) -> DataFrame:
    """(node, x) of lists that lie in two of the components found and that sketches leave possible; outer and total: of the lists, as before the last links.

    Postings outside the main component meet each other in their list. Nodes of the main one are not dealt for each list: a node outside meets the
    component once, and only if the ball around the node that names it leaves a link possible, as differing bits of sketches are a metric. Where a component
    has many more nodes than its lists hold of it, those of the lists are met instead.
    """
    found = found.select("node", F.col("component").alias("c"))
    # c is as before the last links: pairs that these tie are compared again, and no posting is joined for it.
    within = outer.select("key", "node", "c", F.lit(0).cast("long").alias("main"), F.col("outside").alias("size"), "outside", F.lit(True).alias("each"))

    # whole: the component that the main one of a list now belongs to. Its name is one of its nodes, the centre of its ball.
    mains = outer.select("main").distinct().join(found.select(F.col("node").alias("main"), F.col("c").alias("whole")), "main", "left").select("main", F.coalesce("whole", "main").alias("whole"))
    mains = common.materialise(mains.join(known.select(F.col("node").alias("whole"), F.col("sketch").alias("xsketch")), "whole"), "jaccard-mains")
    centre = mains.groupBy("whole").agg(F.first("xsketch").alias("xsketch"))
    members = found.select("node", F.col("c").alias("whole")).union(mains.select("whole", "whole")).distinct().join(mains.select("whole").distinct(), "whole", "left_semi")
    members = common.materialise(members.select("node", "whole"), "jaccard-members")
    balls = members.join(known, "node").join(centre, "whole").groupBy("whole").agg(F.count("*").alias("m"), F.max(F.expr(DIFFER)).alias("radius"), F.min("n").alias("least"), F.max("n").alias("most"))
    balls = common.materialise(mains.join(balls, "whole"), "jaccard-balls")
    near = outer.select("node", "main").distinct().join(balls, "main").join(known, "node").where(f"n * {den} >= least * {num} and most * {den} >= n * {num}")
    near = near.where(f"({DIFFER} - radius) * {num} <= n * {den - num}").select("node", "main", "whole", "m").join(found, "node", "left")
    near = common.materialise(near.select("node", F.coalesce("c", "node").alias("c"), "main", "whole", "m").where("c <> whole"), "jaccard-near")
    touching = outer.drop("c").join(near.select("node", "c", "main", "whole"), ["node", "main"])
    keys = touching.groupBy("key").agg(F.first("whole").alias("whole"), F.count("*").alias("outs"), F.first("inside").alias("inside"), F.first("outside").alias("outside"))
    once = near.select("node", "c", "whole", "m").distinct()
    cost = once.groupBy("whole").agg(F.count("*").alias("outs"), F.first("m").alias("m")).join(keys.groupBy("whole").agg(F.sum(F.col("outs") * F.col("inside")).alias("pairs")), "whole")
    cost = common.materialise(cost.select("whole", "m", "outs", (F.col("outs") * F.col("m") <= WHOLE * F.col("pairs")).alias("by_component")), "jaccard-cost")
    names, each = ("key", "node", "c", "main", "size", "outside", "each"), F.lit(False)

    few = cost.where("by_component")
    outs = once.drop("m").join(few, "whole").select("whole", "node", "c", "whole", "m", "outs", each).toDF(*names)
    ins = members.join(few, "whole").select("whole", "node", "whole", "whole", "m", "outs", each).toDF(*names)
    out = within.union(outs).union(ins)
    if not cost.where("NOT by_component").isEmpty():
        keys = keys.join(cost.where("NOT by_component").select("whole"), "whole").select("key", "whole", "outs", (F.col("inside") + F.col("outside")).alias("size"))
        keys = common.materialise(keys, "jaccard-keys")
        outs = touching.select("key", "node", "c").join(keys, "key").select("key", "node", "c", "whole", "size", "outs", each).toDF(*names)
        ins = common.lookup(lists.select("key", "node"), keys, ["key"], "size", total, ("whole", "size", "outs")).join(found, "node", "left").where("coalesce(c, node) = whole")
        # The same list may also stand in `within`: its tiles of this kind have a key of their own.
        out = out.union(outs.union(ins.select("key", "node", "whole", "whole", "size", "outs", each).toDF(*names)).withColumn("key", F.xxhash64("key")))
    return tiled(out, short, num, den)


def tiled(open_: DataFrame, short: DataFrame, num: int, den: int) -> DataFrame:
    """(node, x), node the lesser, of pairs of lists (key, node, c, main, size, outside) that lie in two components, one of them outside the main one, and that
    the short sketches leave possible. The nodes outside meet the whole list in tiles of TILE by TILE nodes, or those of the main component alone where `each` is
    false, and only pairs that may link leave a tile. Lists of one key by chance only meet in more tiles than they need."""
    words = [f"s{i}" for i in range(FOLD)]
    open_ = open_ if "each" in open_.columns else open_.withColumn("each", F.lit(True))
    # Where a node lies among those of a side, it is dealt to one block; it meets every block of the other side.
    spots = """explode(concat(
        IF(inner OR each, transform(sequence(0, high - 1), t -> struct(t AS i, CAST(pmod(place, wide) AS INT) AS j, false AS out)), array()),
        IF(inner, array(), transform(sequence(0, wide - 1), t -> struct(CAST(pmod(place, high) AS INT) AS i, t AS j, true AS out))))) AS spot"""
    rows = open_.join(short, "node").select(
        "key", "node", "c", "n", "own", *words, (F.col("c") == F.col("main")).alias("inner"), "each", F.xxhash64("node").alias("place"),
        F.ceil(F.col("size") / TILE).cast("int").alias("wide"), F.ceil(F.col("outside") / TILE).cast("int").alias("high"),
    )
    rows = rows.select("key", "node", "c", "n", "own", *words, "inner", F.expr(spots)).select("key", "spot.i", "spot.j", "node", "c", "n", "own", *words, "inner", "spot.out")

    def pairs(node, c, n, sketch, inner, out, own):
        (y,) = np.nonzero(out)
        (x,) = np.nonzero(~out)
        for at in range(0, len(y), TILE):  # a hash may deal a block somewhat more than TILE nodes
            o = y[at : at + TILE]
            ok = (c[x][:, None] != c[o][None, :]) & (inner[x][:, None] | (node[x][:, None] < node[o][None, :]))
            na, nb = n[x][:, None], n[o][None, :]
            ok &= (na * den >= nb * num) & (nb * den >= na * num)
            differ = np.zeros(ok.shape, np.int64)
            for w in range(FOLD):
                differ += np.bitwise_count(sketch[w][x][:, None] ^ sketch[w][o][None, :])
            i, j = np.nonzero(ok & (differ * (num + den) <= (na + nb) * (den - num)))
            both = np.flatnonzero((n[x[i]] > FULL_FROM) & (n[o[j]] > FULL_FROM))
            keep = np.ones(len(i), bool)
            for a in range(0, len(both), CHUNK):
                m = both[a : a + CHUNK]
                p, q = x[i[m]], o[j[m]]
                keep[m] = least_apart([own[v].as_py() for v in p], [own[v].as_py() for v in q]) * (num + den) <= (n[p] + n[q]) * (den - num)
            i, j = i[keep], j[keep]
            if len(i):
                one, two = node[x[i]], node[o[j]]
                met = np.empty(len(i), PAIR)
                met["a"], met["b"] = np.minimum(one, two), np.maximum(one, two)
                yield distinct(met)

    def run(batches):
        held, seen = None, set()  # near sets meet in many lists: a task gives a pair once, as far as SEEN pairs tell

        def tiles(t: pa.Table, last: bool):
            """The pairs of all whole tiles, and the rows of the one that may go on."""
            col = lambda c: t.column(c).to_numpy()
            key, i, j = col("key"), col("i"), col("j")
            heads = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
            ends = np.r_[heads[1:], len(key)]
            whole = len(heads) if last else len(heads) - 1
            node, c, n, inner, out = (col(x) for x in ("node", "c", "n", "inner", "out"))
            sketch, own = [col(w).view(np.uint64) for w in words], t.column("own").chunk(0)
            found = [m for a, b in zip(heads[:whole], ends[:whole], strict=True) for m in pairs(node[a:b], c[a:b], n[a:b], [w[a:b] for w in sketch], inner[a:b], out[a:b], own[a:b])]
            return (distinct(np.concatenate(found)) if found else np.zeros(0, PAIR)), t.slice(int(heads[whole])) if whole < len(heads) else None

        def given(met):
            if len(seen) + len(met) > SEEN:
                seen.clear()
            both = list(zip(met["a"].tolist(), met["b"].tolist(), strict=True))
            met = met[[x not in seen for x in both]] if both else met
            seen.update(both[:SEEN])
            for a in range(0, len(met), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(met["a"][a : a + (1 << 18)]), pa.array(met["b"][a : a + (1 << 18)])], names=["node", "x"])

        for b in batches:
            if b.num_rows:
                t = pa.Table.from_batches([b])
                met, held = tiles((t if held is None else pa.concat_tables([held, t])).combine_chunks(), False)
                yield from given(met)
        if held is not None:
            yield from given(tiles(held.combine_chunks(), True)[0])

    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "node long, x long")


def grouped(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, hash of the text, n_shingles, component_id of every row: components of the links of similarity num / den or more."""
    spark = docs.sparkSession
    common.tune(spark)
    docs = docs.select("doc_id", "text")
    shared = frozenset()
    while True:
        nodes = common.materialise(nodes_of(docs, k, shared, NAME_BITS), "jaccard-nodes")
        known = nodes.where("node <> 0").groupBy("node").agg(
            F.first("doc_id").alias("doc_id"), F.first("th").alias("th"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.first("own").alias("own"), (F.min("second") < F.max("second")).alias("twice")
        )
        known = common.materialise(known, "jaccard-known")
        # Of n sets, about n * n / 2 ** 65 pairs share a name: 70 of 5e10.
        again = frozenset(r[0] for r in known.where("twice").select("node").collect())
        if not again:
            break
        shared |= again
        common.discard(nodes, known)
    with_own, known = known, known.drop("twice", "own")
    sizes = {r[0]: r[1] for r in nodes.groupBy("n_shingles").count().collect()}
    light = boundary(sizes, num, den)
    bands, per = Bands(num, den), {}
    for n, count in sizes.items():
        per[n] = count * (2 if n < 1 else bands.blocks(bands.of(n))[0] + bands.blocks(bands.of(n) + 1)[0])
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(per.values()) // PART))
    packed = common.materialise(postings(docs, k, num, den, light, parts, shared, NAME_BITS), "jaccard-postings")
    cand = lists_of(packed, parts)
    common.discard(packed)
    may_link = f"n * {den} >= nx * {num} and nx * {den} >= n * {num} and {DIFFER} * {num + den} <= (n + nx) * {den - num}"
    fold = [" ^ ".join(f"sketch[{j}]" for j in range(i, SKETCH, FOLD)) for i in range(FOLD)]
    short = with_own.select("node", "n", "own", *(F.expr(e).alias(f"s{i}") for i, e in enumerate(fold)))
    right = known.select(F.col("node").alias("x"), F.col("n").alias("nx"), F.col("sketch").alias("xsketch"))
    lists = cand.where("key <> -1")
    shared = lists.select("node", F.explode(F.array_distinct(F.array("p0", "p1", "p2"))).alias("pivot")).where("node <> pivot").groupBy("node", "pivot").count()
    best = shared.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct("count", "pivot")), asc=False), 1, PIVOTS).alias("m")).select("node", F.explode("m.pivot").alias("x"))
    pairs = best.select(F.least("node", "x").alias("node"), F.greatest("node", "x").alias("x")).union(cand.where("key = -1").select("node", F.col("p0").alias("x"))).distinct()
    pairs = common.materialise(pairs.join(known, "node").join(right, "x").where(may_link).select(F.col("node").alias("a"), F.col("x").alias("b")), "jaccard-pairs")
    found = common.components(verified(pairs, texts_of(docs, known, pairs), k, num, den), "jaccard-components")
    total = lists.count()
    outer = outside(lists, found, total)
    for turn in range(ROUNDS):
        # Nodes outside their list's most frequent component meet a node of it, another in each list; those nearest by sketch are verified.
        outer = outside(lists, found, total) if turn else outer
        met = outer.select(F.least("node", "rep").alias("node"), F.greatest("node", "rep").alias("x"), F.col("node").alias("who")).distinct()
        near = met.join(known, "node").join(right, "x").where(may_link).select("who", F.struct(F.expr(DIFFER).alias("d"), F.col("node").alias("a"), F.col("x").alias("b")).alias("p"))
        near = near.groupBy("who").agg(F.slice(F.sort_array(F.collect_list("p")), 1, PIVOTS).alias("p")).select(F.explode("p").alias("p")).select("p.a", "p.b").distinct()
        near = common.materialise(near, "jaccard-pairs")
        if near.isEmpty():
            break
        found = common.components(verified(near, texts_of(docs, known, near), k, num, den), "jaccard-components", found)
        pairs = pairs.union(near)
    more = left_open(outer, lists, total, found, known, short, num, den)
    more = more.distinct().join(known, "node").join(right, "x").where(may_link)
    more = common.materialise(more.select(F.col("node").alias("a"), F.col("x").alias("b")).join(pairs, ["a", "b"], "left_anti"), "jaccard-pairs")
    comp = common.components(verified(more, texts_of(docs, known, more), k, num, den), "jaccard-components", found)
    member = nodes.select("doc_id", "th", "node", "n_shingles").join(comp, "node", "left").select("doc_id", "th", "n_shingles", F.coalesce("component", "node").alias("c"))
    member = common.materialise(member, "jaccard-member")
    name = member.where("c <> 0").groupBy("c").agg(F.min("doc_id").alias("component_id"))
    return member.join(name, "c", "left").select("doc_id", "th", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def join(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every document: components of the links of similarity num / den or more."""
    return grouped(docs, k, num, den).drop("th")


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents with one kept of each component: the one with the smallest doc_id. A row without doc_id stays, as its identity is unknown.

    A row is its doc_id and text: a doc_id with two texts loses only the one whose own component has another document to keep. Rows that
    repeat a kept doc_id in its component stay.
    """
    found = grouped(docs, k, num, den).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone"), F.col("th").alias("_gone_text")).distinct()
    return docs.join(found, (F.col("doc_id") == F.col("_gone")) & (F.xxhash64("text") == F.col("_gone_text")), "left_anti").select(*docs.columns)


def op2_jaccard(spark, sf_dir: str) -> DataFrame:
    """Shingle count and component of every document at three words and a similarity of 0.9."""
    return join(common.table(spark, sf_dir, "documents"))
