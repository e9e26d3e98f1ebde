"""Best-fit packing by a configuration linear program over the length histogram.

A document is its token ids and an end id; only longer ones than a sequence are cut, into whole sequences but for the first piece, which
takes the rest. The histogram of piece lengths, at most `capacity` numbers, goes to the driver. There the covering program

    min sum x_p  with  sum x_p a_p[l] >= count[l]

over configurations p (multisets of lengths of total at most the capacity) is solved by multiplicative weights: lengths have prices, a
configuration within a stated share of the best for the prices is found by bounded knapsack dynamic programming, and the prices of the lengths it
covers fall, until every length is covered. The solution is scaled to the demand and rounded: configurations filled at least as far as on average
are used their whole numbers of times and once more where their pieces are left. Best fit packs what rounding left. Configurations and the histogram are bounded by the
capacity, not by the data; pieces find their sequence by their rank among the pieces of their length.

Nulls: a null text is the empty text, one piece that holds the end id alone. Repeated rows are packed each; a null doc_id is kept. An
empty table gives no rows. Extra columns do not take part.
"""

from __future__ import annotations

import bisect
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import common

CAPACITY = 2048
#: Pieces that one window ranks, about.
CELL = 10_000
#: Lengths that a round of the program prices: so many of the least covered ones, and so many drawn ones.
LEAST, MORE = 48, 24
#: Free places of the configurations that a stricter rounding keeps, at most.
ROOMS = (64, 16, 4, 0)
#: Words whose ids a worker remembers.
CACHE_WORDS = 300_000
#: White space in a row that goes another way; its splitter stops the process at about a million.
LONG_RUN = 50_000
_LONG_SPACE = re.compile(r"\s{%d}" % LONG_RUN)
_ENCODERS: dict[str, "Encoder"] = {}


class Encoder:
    """Token ids of a byte-level BPE file as tokenizers gives them.

    Such a file splits a text before every space that a non-space follows, so the ids of the pieces between these places, joined, are the
    ids of the text; pieces repeat, so their ids are remembered, those of a text's first piece, which has no space before it, apart. A piece not
    yet met goes through the merges of the same file. A text in which an added token is spelled out goes to tokenizers whole, as does a piece with
    a very long run of white space, which the faster way cannot split.
    """

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letter = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        ranks = {bytes(letter[c] for c in t): i for t, i in self.whole.get_vocab(with_added_tokens=False).items() if all(c in letter for c in t) and t not in self.added}
        self.bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cut = regex.compile(r" (?=\S)").split
        self.firsts: dict[str, bytes] = {}
        self.others: dict[str, bytes] = {}

    def new(self, piece: str, known: dict[str, bytes], key: str) -> bytes:
        if len(piece) >= LONG_RUN and _LONG_SPACE.search(piece):
            return np.array(self.whole.encode(piece, add_special_tokens=False).ids, dtype="<u4").tobytes()
        ids = np.array(self.bpe.encode_ordinary(piece), dtype="<u4").tobytes()
        if len(key) <= 40:
            if len(known) >= CACHE_WORDS:
                known.clear()
            known[key] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        if any(t in text for t in self.added):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        first, *rest = text.split(" ") if "  " not in text and text.isprintable() else self.cut(text)
        get, ids = self.others.get, self.firsts.get(first)
        out = [self.new(first, self.firsts, first) if ids is None else ids]
        for piece in rest:
            ids = get(piece)
            out.append(self.new(" " + piece, self.others, piece) if ids is None else ids)
        return b"".join(out)


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        import public_tokenizers

        encode, end = encoder(public_tokenizers.path(tokenizer)), np.array([end_id], dtype="<u4").tobytes()
        for b in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                ids = encode(text or "") + end
                n = len(ids) // 4
                at, k, size = 0, 0, n % capacity or capacity
                while at < n:
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + size)]))
                    at, k, size = at + size, k + 1, capacity
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_configuration(price: np.ndarray, most: np.ndarray, lengths: np.ndarray, capacity: int, slack: float = 0.03) -> tuple[np.ndarray, float]:
    """A configuration of almost the highest price and that price, by dynamic programming over the exactly filled length; no length more often
    than `most`. Of the fills whose price is within `slack` of the best, the longest.

    An item is one of the lengths taken 1, 2, 4, ... times (binary splitting), so each row of the table is one numpy step.
    """
    value = np.full(capacity + 1, -np.inf)
    value[0] = 0.0
    items, took = [], []
    for i, size in enumerate(lengths.tolist()):
        k, rest = 1, int(min(most[i], capacity // size))
        while rest > 0:
            k = min(k, rest)
            trial = value[: capacity + 1 - size * k] + price[i] * k
            better = trial > value[size * k :]
            np.copyto(value[size * k :], trial, where=better)
            items.append((i, k, size * k))
            took.append(better)
            rest -= k
            k *= 2
    at = int(np.flatnonzero(value >= (1 - slack) * value.max())[-1])
    out, worth = np.zeros(len(lengths), np.int64), float(value[at])
    for (i, k, w), better in zip(reversed(items), reversed(took), strict=True):
        if at >= w and better[at - w]:
            out[i] += k
            at -= w
    return out, worth


#: A configuration: the places of its lengths, how often it takes each, and its uses.
Use = tuple[np.ndarray, np.ndarray, float]


def program(lengths: np.ndarray, demand: np.ndarray, capacity: int, passes: float = 1.0, eps: float = 0.08, rate: float = 1.0, seed: int = 11) -> tuple[list[Use], float, float]:
    """The covering program by multiplicative weights: configurations with uses that cover every demand, their number over the dual bound's
    (1 is the optimum), and the dual bound on the number of sequences.

    A length's weight falls by exp(-rate) for each time that its demand is covered. A round prices the LEAST least covered lengths and MORE
    drawn ones; weights only fall, so the best price seen over all lengths bounds all later ones, and a configuration within `eps` of the bound will do;
    otherwise all lengths are priced and the bound is renewed. The configuration found is used until one of its lengths is covered once more.
    """
    n, rng = len(lengths), np.random.default_rng(seed)
    covered, tie = np.zeros(n), rng.random(n) / 2
    found: dict[bytes, float] = {}
    bound, dual = np.inf, 0.0
    while covered.min() < passes:
        weight = np.exp(-rate * covered)
        bound = min(bound, capacity * weight.max())
        at = np.union1d(np.argpartition(covered + tie, LEAST)[:LEAST], rng.integers(0, n, MORE)) if n > LEAST + MORE else np.arange(n)
        p, worth = best_configuration((lengths * weight)[at], demand[at], lengths[at], capacity)
        if worth < (1 - eps) * bound and len(at) < n:
            at = np.arange(n)
            p, worth = best_configuration(lengths * weight, demand, lengths, capacity)
            bound = worth / (1 - 0.03)
        dual = max(dual, float((demand * lengths * weight).sum()) / bound)
        at, times = at[p > 0], p[p > 0]
        step = float((demand[at] / times).min())
        key = np.stack([at, times]).astype(np.int64).tobytes()
        found[key] = found.get(key, 0.0) + step
        covered[at] += times * step / demand[at]
    uses = [(*np.frombuffer(k, np.int64).reshape(2, -1), x) for k, x in found.items()]
    return uses, sum(x for *_, x in uses) / float(covered.min()) / dual, dual


def rounded(uses: list[Use], lengths: np.ndarray, left: np.ndarray, least: float = 0) -> list[tuple[np.ndarray, int]]:
    """Whole numbers of uses of the configurations that are filled at least as far as the solution is on average, and to `least`; what they place leaves `left`.

    Uses are scaled to the demand and rounded down, and then, the largest rest first, rounded up where all of the configuration is still left.
    """
    fill = [int((lengths[at] * times).sum()) for at, times, _ in uses]
    volume = sum(x * f for (*_, x), f in zip(uses, fill, strict=True))
    scale, mean = float((left * lengths).sum()) / volume, volume / sum(x for *_, x in uses)
    kept = sorted(((at, times, x * scale) for (at, times, x), f in zip(uses, fill, strict=True) if f >= max(least, mean - 1e-6)), key=lambda u: -u[2])
    out, rests = [], []
    for at, times, x in kept:
        n = int(min(np.floor(x), (left[at] // times).min()))
        left[at] -= n * times
        rests.append((x - n, at, times, n))
    for _, at, times, n in sorted(rests, key=lambda r: -r[0]):
        if (left[at] >= times).all():
            left[at] -= times
            n += 1
        if n:
            whole = np.zeros(len(lengths), np.int64)
            whole[at] = times
            out.append((whole, n))
    return out


def solve(lengths: np.ndarray, counts: np.ndarray, capacity: int, seen: dict | None = None) -> list[tuple[np.ndarray, int]]:
    """Configurations with their whole numbers of uses; together they hold every count exactly.

    Pieces of a whole sequence are configurations of their own. The program is solved for all others and rounded; what rounding left goes by best
    fit into the room that the rounded configurations have and into further sequences. seen: takes the pieces that the rounded program
    placed, those it was given, its gap and its bound.
    """
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    left, out = np.where(lengths == capacity, 0, counts), []
    for i in np.flatnonzero((lengths == capacity) & (counts > 0)):
        one = np.zeros(len(lengths), np.int64)
        one[i] = 1
        out.append((one, int(counts[i])))
    some, given = np.flatnonzero(left > 0), int(left.sum())
    if not given:
        return out
    uses, gap, dual = program(lengths[some], left[some], capacity)
    uses = [(some[at], times, x) for at, times, x in uses]
    # Rounding keeps all configurations of average fill or better, or only those that leave little or nothing free; the fewest sequences count, then the
    # most pieces that the program placed. Best fit without the program is the last resort, so it is never undercut.
    best, most = None, 0
    for room in (None, *ROOMS, -1):
        rest = left.copy()
        opened = [] if room == -1 else rounded(uses, lengths, rest, 0 if room is None else capacity - room)
        plan = best_fit(lengths, rest, capacity, opened)
        used = sum(g for _, g in plan)
        if best is None or (used, rest.sum()) < most:
            best, most = plan, (used, rest.sum())
    if seen is not None:
        seen |= {"given": given, "placed": given - int(most[1]), "gap": gap, "bound": dual}
    return out + best


def best_fit(lengths: np.ndarray, counts: np.ndarray, capacity: int, opened: list[tuple[np.ndarray, int]] | None = None) -> list[tuple[np.ndarray, int]]:
    """Best-fit decreasing over a histogram, into the room of the `opened` sequences first; equal sequences are counted together.

    Every open sequence of a kind is filled at once: a group of g equal sequences with free room f takes up to g pieces of a length.
    """
    order = np.argsort(-lengths)
    rooms: dict[int, list[list]] = {}
    free: list[int] = []

    def put(f: int, p: np.ndarray, g: int) -> None:
        if f not in rooms:
            rooms[f] = []
            bisect.insort(free, f)
        rooms[f].append([p, g])

    for p, g in opened or []:
        put(capacity - int((p * lengths).sum()), p, g)
    for i in order:
        size, n = int(lengths[i]), int(counts[i])
        while n > 0:
            at = bisect.bisect_left(free, size)
            if at == len(free):
                per = capacity // size
                g, rest = divmod(n, per)
                for times, groups in ((per, g), (rest, 1)):
                    if times and groups:
                        p = np.zeros(len(lengths), np.int64)
                        p[i] = times
                        put(capacity - times * size, p, groups)
                n = 0
                break
            f = free[at]
            p, g = rooms[f].pop()
            if not rooms[f]:
                del rooms[f]
                free.pop(at)
            used = min(g, n)
            q = p.copy()
            q[i] += 1
            if g > used:
                put(f, p, g - used)
            put(f - size, q, used)
            n -= used
    return [(p, g) for groups in rooms.values() for p, g in groups]


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece; see the module's text."""
    spark = docs.sparkSession
    common.tune(spark)
    cut = common.materialise(pieces(docs, tokenizer, capacity, end_id).withColumn("cell", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(1 << 16)).cast("int")), "pack-pieces")
    # Ranks within a length: cells split a length that many pieces share; a cell's first rank is the sum of the cells before it.
    split = max(1, min(1 << 16, cut.count() // CELL + 1))
    cut = cut.withColumn("cell", F.pmod("cell", F.lit(split)))
    cells = cut.groupBy("length", "cell").count()
    before = cells.withColumn("base", F.sum("count").over(Window.partitionBy("length").orderBy("cell")) - F.col("count")).select(F.col("length").alias("bl"), F.col("cell").alias("bc"), "base")
    histogram = {int(r["length"]): int(r["n"]) for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    lengths = np.array(sorted(histogram), np.int64)
    plan = solve(lengths, np.array([histogram[x] for x in lengths], np.int64), capacity)
    slots, seen, seq = [], np.zeros(len(lengths), np.int64), 0
    for p, uses in plan:
        at = 0
        for i in np.flatnonzero(p):
            slots.append((int(lengths[i]), int(seen[i]), int(seen[i] + p[i] * uses), int(p[i]), seq, at))
            seen[i] += p[i] * uses
            at += int(p[i] * lengths[i])
        seq += uses
    by_length: dict[int, list[tuple[int, ...]]] = {}
    for x, *rest in slots:
        by_length.setdefault(x, []).append(tuple(rest))
    shared = spark.sparkContext.broadcast({x: np.array(v, np.int64).T for x, v in by_length.items()})
    rank = F.row_number().over(Window.partitionBy("length", "cell").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = cut.withColumn("r", rank.cast("long")).join(before, (F.col("length") == F.col("bl")) & (F.col("cell") == F.col("bc"))).withColumn("r", F.col("r") + F.col("base"))

    def place(batches):
        for b in batches:
            length, r = b.column("length").to_numpy(), b.column("r").to_numpy()
            seq_id, offset = np.zeros(len(r), np.int64), np.zeros(len(r), np.int64)
            for x in np.unique(length):
                first, _, per, base, at = shared.value[int(x)]
                m = np.flatnonzero(length == x)
                k = np.searchsorted(first, r[m], "right") - 1
                d = r[m] - first[k]
                seq_id[m], offset[m] = base[k] + d // per[k], at[k] + d % per[k] * x
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(seq_id), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = dict(docs.dtypes)["doc_id"]
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "r").mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op4_packing(spark, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place."""
    return pack(common.table(spark, sf_dir, "documents"))
