"""Consolidation and upsert of postings: exact keys, titles alike within an institution, ordered merging.

A row meets an earlier leader of its canonical id, else of its URL, else the first one of its institution whose title is alike. Leaders are found in
rounds: a row is settled once no earlier open row may be what it meets. Titles are compared by class (institution and title as compared), by way of an
index of their rarest 3-grams; lengths and common letters bound the ratio before it is worked out. Members are merged into leaders by aggregates that
combine before they are shuffled. Where ids alone count, none of this is needed: one grouping merges all.

Only where a merge gives a leader a title that compares otherwise does order reach further: the rows tied to it by id, URL or institution are then replayed
in order, in a stream that holds their leaders alone.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text

#: Labels that end a title. Fixed values.
TITLE_ENDS = r"\b(?:Personal type|Field of expertise|Organisation|Organization|Apply no later than|Apply before|Full-time equivalent|Salary|Read more)\s*:"
_TITLE_ENDS = re.compile(TITLE_ENDS, re.I)
#: Fields of a merge: filled where empty; taken from the row of the higher score; joined as lists; true where any is. Fixed values.
FILLED = ("department", "school", "location", "country", "region", "deadline", "date_posted", "summary", "application_angle")
SCORED = ("fit_category", "fit_score", "role_type", "summary", "application_angle")
LISTS = ("match_reasons", "required_materials", "warnings")
FLAGS = ("is_priority_institution", "is_new_this_run")
#: How the description of a link without one begins, and by how much a title is shorter than one it replaces. Fixed values.
STANDS_IN = "Candidate link extracted from"
SHORTER = 15
#: Letters of a gram; grams are over a-z, 0-9 and space, so there are at most 37 ** GRAM.
GRAM = 3
#: Where classes that share a gram are so many pairs for each class, the first rounds ask the index alone, which settles groups of many like titles at once;
#: then the pairs that are still open are compared. The rows that result are the same.
MANY_PAIRS = 300
INDEX_ROUNDS = 3
#: Classes of an institution that one task compares in their order, where nothing but titles ties its rows; and rows of one that a task folds in their order, where
#: no id or URL of them occurs elsewhere. Institutions of more go by rounds; the rows are the same.
LOCAL_CLASSES = 8192
NEAR_ROWS = 2000
#: Places of a letter in letters_of(); a title that repeats one more often has the rest counted apart.
REPEATS = 16


# --- the rules on single rows, for replays ---------------------------------------------------------------------------------


def normal(value: str | None) -> str:
    """The Python form of text.normalize."""
    value = re.sub(r"https?://(www\.)?", "", (value or "").casefold())
    return re.sub(r"[^a-z0-9]+", " ", value).strip()


def ratio(a: str | None, b: str | None) -> float:
    return SequenceMatcher(None, normal(a), normal(b)).ratio()


@lru_cache(1 << 16)
def letters_of(title: str) -> tuple[int, int]:
    """The letters of a normalized title as bits, the nth of a kind having a bit of its own; and how many found none."""
    bits, seen, rest = 0, Counter(), 0
    for c in title:
        if seen[c] < REPEATS:
            bits |= 1 << (ord(c) - 32) * REPEATS + seen[c]
        else:
            rest += 1
        seen[c] += 1
    return bits, rest


def common_pair(a: str, b: str) -> int:
    """common_letters of one pair."""
    masks: dict[str, int] = {}
    for at, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << at
    w = full = (1 << len(a)) - 1
    for c in b:
        m = masks.get(c, 0)
        w = ((w + (w & m)) | (w & ~m)) & full
    return len(a) - w.bit_count()


@lru_cache(1 << 18)
def close(a: str, b: str, at: float) -> float | None:
    """The ratio of normalized titles, the one to the other, if it is at least `at`; a bound by common letters comes first."""
    if 2 * common_pair(a, b) < at * (len(a) + len(b)) - 1e-9:
        return None
    score = SequenceMatcher(None, a, b).ratio()
    return score if score >= at else None


def alike_at(a: str, b: str, at: float) -> float | None:
    """close(), after bounds that cost next to nothing: lengths and letters."""
    if a == b:
        return 1.0 if at <= 1 else None
    least = at * (len(a) + len(b)) - 1e-9
    if 2 * min(len(a), len(b)) < least:
        return None
    (x, more), (y, rest) = letters_of(a), letters_of(b)
    return None if 2 * ((x & y).bit_count() + min(more, rest)) < least else close(a, b, at)


@lru_cache(1 << 16)
def as_compared(title: str | None) -> str:
    return normal(core_title(title))


@lru_cache(1 << 16)
def place_of(institution: str | None) -> tuple[str, str]:
    """An institution's key, empty where it is missing, and its name as it is compared."""
    name = normal(institution)
    return "" if is_missing(institution) else re.sub(r"^the\s+", "", name), name


def core_title(value: str | None) -> str:
    return _TITLE_ENDS.split(value or "", maxsplit=1)[0].strip(" -,:;")


def is_missing(value: str | None) -> bool:
    return (value or "").strip().casefold() in text.NO_INSTITUTION


def merge(into: dict, row: dict) -> dict:
    """Fold a later posting into an earlier one. Fields that the rows lack are left out."""
    old, new = into.get("title") or "", row.get("title") or ""
    if new.casefold() in old.casefold() and len(new) + SHORTER < len(old):
        into["title"] = new
    if is_missing(into.get("institution")) and not is_missing(row.get("institution")):
        into["institution"] = row["institution"]
    for c in FILLED:
        if c in into:
            into[c] = into[c] or row.get(c) or into[c]
    mine, theirs = into.get("description_text") or "", row.get("description_text") or ""
    if "description_text" in into and (mine.startswith(STANDS_IN) or len(theirs) > len(mine)):
        into["description_text"] = theirs
    if (row.get("fit_score") or 0) > (into.get("fit_score") or 0):
        into.update({c: row.get(c) for c in SCORED if c in into})
    for c in LISTS:
        if c in into:
            into[c] = list(dict.fromkeys([*(into[c] if into[c] is not None else []), *(row[c] if row.get(c) is not None else [])]))
    for c in FLAGS:
        if c in into:
            into[c] = bool(into[c]) or bool(row.get(c))
    return into


class Replay:
    """The greedy leaders of rows that are added in order. `_stored` rows are leaders from the start and are not merged with each other."""

    def __init__(self, title_at: float = 0.9, institution_at: float = 0.9, stored: bool = False):
        self.title_at, self.institution_at, self.stored = title_at, institution_at, stored
        self.leaders, self.by_id, self.by_url, self.by_place = [], {}, {}, {}

    def met(self, row: dict, url: str, place: str) -> dict | None:
        hit = self.by_id.get(row["canonical_id"]) or self.by_url.get(url)
        if hit or not place:
            return hit
        core, name = as_compared(row.get("title")), place_of(row.get("institution"))[1]
        for other in self.by_place.get(place, []):
            if alike_at(core, as_compared(other.get("title")), self.title_at) is not None and alike_at(name, place_of(other.get("institution"))[1], self.institution_at) is not None:
                return other
        return None

    def add(self, row: dict) -> dict | None:
        """The leader that the row is merged into; none if it leads itself."""
        url, place = normal(row.get("application_url")), place_of(row.get("institution"))[0]
        hit = None if self.stored and row.get("_stored") else self.met(row, url, place)
        if hit is not None:
            merge(hit, row)
            if self.stored:
                hit["_hit"] = True
                if "is_new_this_run" in hit:
                    hit["is_new_this_run"] = False
            return hit
        self.leaders.append(row)
        self.by_id[row["canonical_id"]] = row
        if url:
            self.by_url[url] = row
        if place:
            self.by_place.setdefault(place, []).append(row)
        return None


def fold(rows: list[dict], title_at: float = 0.9, institution_at: float = 0.9, stored: bool = False) -> list[dict]:
    """The greedy leaders of rows in their order."""
    replay = Replay(title_at, institution_at, stored)
    for row in rows:
        replay.add(row)
    return replay.leaders


# --- scratch tables --------------------------------------------------------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may do without and gets one of its own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not found:
        import tempfile

        found = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """df written as Parquet and read back, so that nothing before it is worked out twice."""
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """written() in a folder of its own; drop() deletes tables by name."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_dir(spark)}/postings-{uuid.uuid4().hex}"

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        return written(df, self.folder, name)

    def drop(self, names: str) -> None:
        """Delete the tables whose names match, once nothing reads them any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{names}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for found in fs.globStatus(path) or []:
            fs.delete(found.getPath(), True)


# --- titles alike ----------------------------------------------------------------------------------------------------------


def most_edits(n: int, at: float) -> int:
    """Letters that can be taken out or put in between a title of n letters and any whose ratio to it is at least `at`."""
    return math.floor(2 * n * (1 - at) / at + 1e-9)


def grams_meet(at: float) -> bool:
    """Whether titles of that ratio always have a gram in common: the longer one has more grams than the edits between them touch."""
    for n in range(1, 1000):
        odd, even = math.floor((1 - at) * (2 * n - 1) + 1e-9), math.floor((1 - at) * 2 * n + 1e-9) // 2 * 2
        if max(odd, even) and n - GRAM + 1 - GRAM * max(odd, even) < 1:
            return False
    return True


def grams_of(title: str) -> list[tuple[str, int]]:
    """The grams of a title, each with the number of its like before it."""
    seen, out = Counter(), []
    for i in range(len(title) - GRAM + 1):
        g = title[i : i + GRAM]
        out.append((g, seen[g]))
        seen[g] += 1
    return out


def title_index(classes: DataFrame, at: float) -> DataFrame:
    """(class, gram, size) of classes (class, core): the rarest grams of each title, so many that titles alike have one in common."""
    if not grams_meet(at):
        return classes.select("class", F.lit("").alias("gram"), F.length("core").alias("size"))

    def each(batches):
        for pdf in batches:
            yield pd.DataFrame({"gram": [g for title in pdf["core"] for g, _ in grams_of(title)]}, dtype=object)

    counts = classes.select("core").mapInPandas(each, "gram string").groupBy("gram").agg(F.count("*").alias("n"))
    often = classes.sparkSession.sparkContext.broadcast({r["gram"]: r["n"] for r in counts.collect()})

    def rare(batches):
        for pdf in batches:
            out = []
            for c, title in zip(pdf["class"], pdf["core"], strict=True):
                order = sorted(grams_of(title), key=lambda x: (often.value.get(x[0], 0), x))
                out += [(c, f"{g}{i}", len(title)) for g, i in order[: GRAM * most_edits(len(title), at) + 1]]
            yield pd.DataFrame(out, columns=["class", "gram", "size"])

    return classes.select("class", "core").mapInPandas(rare, "class long, gram string, size int")


def common_letters(a: list[str], b: list[str]) -> np.ndarray:
    """The longest common subsequence of each pair of normalized titles, which no matching of blocks exceeds: one bit a letter of a, all pairs at once.

    The bits of a pair of up to 64 letters are one machine word; longer ones are worked out one by one.
    """
    codes = {c: i for i, c in enumerate(" 0123456789abcdefghijklmnopqrstuvwxyz")}
    out = np.zeros(len(a), np.int64)
    small = [i for i in range(len(a)) if len(a[i]) <= 64]
    if small:
        masks = np.zeros((len(small), len(codes) + 1), np.uint64)
        text_b = np.full((len(small), max(len(b[i]) for i in small)), len(codes))
        seen: dict[str, np.ndarray] = {}
        for n, i in enumerate(small):
            if (row := seen.get(a[i])) is None:
                row = seen[a[i]] = np.zeros(len(codes) + 1, np.uint64)
                for at, c in enumerate(a[i]):
                    row[codes[c]] |= np.uint64(1 << at)
            masks[n] = row
            text_b[n, : len(b[i])] = [codes[c] for c in b[i]]
        v, each = np.full(len(small), ~np.uint64(0)), np.arange(len(small))
        for j in range(text_b.shape[1]):
            m = masks[each, text_b[:, j]]
            v = (v + (v & m)) | (v & ~m)
        sizes = np.array([len(a[i]) for i in small])
        part = np.where(sizes == 64, ~np.uint64(0), (np.uint64(1) << (sizes % 64).astype(np.uint64)) - np.uint64(1))
        out[small] = np.bitwise_count(~v & part)
    for i in set(range(len(a))) - set(small):
        masks_i: dict[str, int] = {}
        for at, c in enumerate(a[i]):
            masks_i[c] = masks_i.get(c, 0) | 1 << at
        full = (1 << len(a[i])) - 1
        w = full
        for c in b[i]:
            m = masks_i.get(c, 0)
            w = ((w + (w & m)) | (w & ~m)) & full
        out[i] = len(a[i]) - w.bit_count()
    return out


def alike(pairs: DataFrame, classes: DataFrame, title_at: float, institution_at: float) -> DataFrame:
    """(a, b, score) of the pairs of classes whose titles and institutions are alike, a compared to b, each pair tried both ways; a bound by common letters comes first."""
    one, two = (classes.select(F.col("class").alias(x), F.col("core").alias(f"core_{x}"), F.col("name").alias(f"name_{x}")) for x in "ab")

    def compare(batches):
        for pdf in batches:
            out = []
            sizes = (pdf["core_a"].str.len() + pdf["core_b"].str.len()).to_numpy()
            near_enough = 2 * common_letters(pdf["core_a"].tolist(), pdf["core_b"].tolist()) >= title_at * sizes - 1e-9
            some = pdf.loc[near_enough, ["a", "b", "core_a", "core_b", "name_a", "name_b"]].itertuples(index=False)
            for a, b, ta, tb, ia, ib in (x if way else (x[1], x[0], x[3], x[2], x[5], x[4]) for x in some for way in (True, False)):
                score = SequenceMatcher(None, ta, tb).ratio()
                if score >= title_at and (near := SequenceMatcher(None, ia, ib).ratio()) >= institution_at:
                    out.append((a, b, min(score, near)))
            yield pd.DataFrame(out, columns=["a", "b", "score"])

    return pairs.join(one, "a").join(two, "b").mapInPandas(compare, "a long, b long, score double")


def index_pairs(left: DataFrame, right: DataFrame, at: float) -> DataFrame:
    """(a, b), a the lesser, of unlike classes of one institution that share a gram of the index and have lengths that allow the ratio."""
    a, b = left.select(F.col("class").alias("a"), "place", "gram", F.col("size").alias("sa")), right.select(F.col("class").alias("b"), "place", "gram", F.col("size").alias("sb"))
    near = 2 * F.least("sa", "sb") >= at * (F.col("sa") + F.col("sb")) - 1e-9
    pairs = a.join(b, ["place", "gram"]).where((F.col("a") != F.col("b")) & near)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


# --- leaders ---------------------------------------------------------------------------------------------------------------


def core(title: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(F.coalesce(title, F.lit("")), f"(?i){TITLE_ENDS}", 2), 1), "^[ \\-,:;]+|[ \\-,:;]+$", "")


def key_columns(postings: DataFrame) -> dict[str, Column]:
    """id, url, place, core and name of a posting, as they are compared; empty where the table lacks the column."""
    have = {c: F.col(c) if c in postings.columns else F.lit("") for c in ("title", "institution", "application_url")}
    place = text.institution_key(have["institution"])
    return {
        "id": F.coalesce("canonical_id", F.lit("")), "url": text.normalize(have["application_url"]), "place": place,
        "core": F.when(place != "", text.normalize(core(have["title"]))), "name": F.when(place != "", text.normalize(have["institution"])),
    }


def locally(firsts: DataFrame, title_at: float, institution_at: float) -> DataFrame:
    """(class, to, score) of classes (class, place, core, name, k): the first class of its institution, in the order of k, that leads and is alike; null where it leads
    itself. A task holds the leaders of one institution, of LOCAL_CLASSES at most."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, led = None, []
        for pdf in batches:
            out = []
            for place, c, core_, name in zip(pdf["place"], pdf["class"], pdf["core"], pdf["name"], strict=True):
                if place != at:
                    at, led = place, []
                for other, title, place_name in led:
                    if (score := alike_at(core_, title, title_at)) is not None and (near := alike_at(name, place_name, institution_at)) is not None:
                        out.append((c, other, min(score, near)))
                        break
                else:
                    led.append((c, core_, name))
                    out.append((c, None, None))
            yield pd.DataFrame({"class": [x[0] for x in out], "to": pd.array([x[1] for x in out], dtype="Int64"), "score": pd.Series([x[2] for x in out], dtype="float64")})

    dealt = firsts.repartition("place").sortWithinPartitions("place", "k").select("place", "class", "core", "name")
    return dealt.mapInPandas(run, "class long, to long, score double")


def leaders(keyed: DataFrame, title_at: float, institution_at: float, scratch: Scratch) -> DataFrame:
    """(uid, k, into, reason, score) of every row: the k of its leader, its own where it leads.

    A row is plain where it has no URL and is not stored, and its id occurs in one class alone. Plain rows of a class all meet what the first of them meets, or that
    one itself, so rounds see the first alone. Institutions of plain rows and at most LOCAL_CLASSES classes are compared in order, each by one task, without rounds.
    """
    classes = scratch(keyed.where("place <> ''").groupBy("place", "core", "name").agg(F.min("uid").alias("class")), "classes")
    rows = keyed.join(classes, ["place", "core", "name"], "left").select("uid", "k", "id", "url", "class", "stored")
    if classes.isEmpty():
        return rounds(scratch(rows, "rows"), classes, title_at, institution_at, scratch)
    rows = scratch(rows, "classed")
    tied = (F.col("url") != "") | F.col("stored") | F.col("class").isNull()
    ids = rows.groupBy("id").agg((~F.bool_or(tied) & (F.min("class") == F.max("class"))).alias("plain"))
    rows = scratch(rows.join(ids, "id").withColumn("plain", F.coalesce("plain", F.lit(False))), "rows")
    firsts = scratch(rows.where("plain").groupBy("class").agg(F.min(F.struct("k", "uid", "id")).alias("f")).select("class", "f.*"), "firsts")
    small = classes.join(rows.where("NOT plain").select("class").distinct().withColumn("tied", F.lit(True)), "class", "left").groupBy("place").agg(F.count("*").alias("n"), F.bool_or("tied").alias("tied"))
    small = scratch(small.where((F.col("n") <= LOCAL_CLASSES) & F.col("tied").isNull()).select("place"), "small")
    local = scratch(locally(firsts.join(classes, "class").join(small, "place", "left_semi"), title_at, institution_at), "local")
    to = firsts.select(F.col("class").alias("to"), F.col("k").alias("to_k"))
    fuzzy, own, none = F.lit("fuzzy_title_institution"), F.lit(""), F.lit(None).cast("double")
    done = local.join(to, "to", "left").select("class", F.col("to_k").alias("into"), F.when(F.col("to").isNull(), own).otherwise(fuzzy).alias("reason"), "score")
    done = firsts.join(done, "class").select("class", "k", F.coalesce("into", "k").alias("into"), "reason", "score", F.col("id").alias("first_id"))
    others = firsts.join(local.select("class"), "class", "left_anti").select("uid", "k", "id", F.lit("").alias("url"), "class", F.lit(False).alias("stored"))
    others = scratch(others.union(rows.where("NOT plain").select("uid", "k", "id", "url", "class", "stored")), "others")
    out = []
    if not others.isEmpty():
        found = scratch(rounds(others, classes.join(small, "place", "left_anti"), title_at, institution_at, scratch), "found")
        out.append(found.join(firsts.select("uid"), "uid", "left_anti"))
        done = done.union(firsts.join(found.drop("k"), "uid").select("class", "k", "into", "reason", "score", F.col("id").alias("first_id")))
    done = scratch(done, "done").withColumnRenamed("k", "first_k")
    leads = F.col("reason") == ""
    told = rows.where("plain").join(done, "class").select(
        "uid", "k", "into", F.when(F.col("k") == F.col("first_k"), F.col("reason")).when(leads & (F.col("id") == F.col("first_id")), "canonical_id").otherwise(fuzzy).alias("reason"),
        F.when((F.col("k") == F.col("first_k")) | ~leads, F.col("score")).otherwise(1.0).alias("score"),
    )
    return told.union(out[0]) if out else told


def rounds(rows: DataFrame, classes: DataFrame, title_at: float, institution_at: float, scratch: Scratch) -> DataFrame:
    """leaders() of rows (uid, k, id, url, class, stored) and their classes by rounds.

    k: rows in order; stored: a leader from the start, met by the last of equal URLs. A round settles the open rows that no earlier open row can be met by; the
    first open row of all is one of them. Rows are short: no text but titles takes part.
    """
    index = scratch(title_index(classes, title_at).join(classes.select("class", "place"), "class"), "index")
    lists = index.groupBy("place", "gram").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1))).first()[0]
    wait = INDEX_ROUNDS if lists and lists > MANY_PAIRS * classes.count() else 0
    has_url = not rows.where("url <> ''").isEmpty()
    none = F.lit(None).cast(rows.schema["k"].dataType)
    score = F.lit(None).cast("double")

    def met(open_: DataFrame, new: DataFrame, edges: DataFrame) -> DataFrame:
        """open rows with what they meet among new leaders: by_id, by_url, by_title."""
        i = new.groupBy("id").agg(F.min("k").alias("i"))
        out = open_.join(i, "id", "left").withColumn("by_id", F.least("by_id", "i"))
        if has_url:
            u = new.where("url <> ''").groupBy("url").agg(F.coalesce(F.max(F.when(F.col("stored"), F.col("k"))), F.min("k")).alias("u"))
            out = out.join(u, "url", "left").withColumn("by_url", F.coalesce("by_url", "u"))
        if lists is not None:
            same = new.where("class IS NOT NULL").select(F.col("class").alias("a"), F.struct("k", F.lit(1.0).alias("score")).alias("m"))
            near = edges.join(new.select(F.col("class").alias("b"), "k"), "b").select("a", F.struct("k", "score").alias("m"))
            title = same.union(near).groupBy(F.col("a").alias("class")).agg(F.min("m").alias("m"))
            out = out.join(title, "class", "left").withColumn("by_title", F.least("by_title", "m"))
        return out.select("uid", "k", "id", "url", "class", "by_id", "by_url", "by_title")

    def pairs(mine: DataFrame, others: DataFrame | None) -> DataFrame:
        """Titles alike of the classes of some rows and those of others, or of any row."""
        part = lambda x: index.join(x.select("class").distinct(), "class", "left_semi")
        return alike(index_pairs(part(mine), index if others is None else part(others), title_at), classes, title_at, institution_at)

    new = rows.where("stored")
    settled = [new.select("uid", "k", F.col("k").alias("into"), F.lit("").alias("reason"), score.alias("score"))]
    open_ = rows.where("NOT stored").select("uid", "k", "id", "url", "class", none.alias("by_id"), none.alias("by_url"), F.struct(none.alias("k"), score.alias("score")).alias("by_title"))
    open_ = open_.withColumn("by_title", F.when(F.lit(False), F.col("by_title")))
    edges = None if wait else scratch(pairs(open_, None), "edges")  # titles alike among classes that are still open and all that open rows may yet meet
    if not new.isEmpty():
        open_ = scratch(met(open_, new, pairs(open_, new) if edges is None else edges), "open")
    step = 0
    while True:
        step += 1
        if step > wait and edges is None:
            edges = scratch(pairs(open_, open_), "edges")
        seen = open_.join(open_.groupBy("id").agg(F.min("k").alias("o_id")), "id", "left")
        if has_url:
            seen = seen.join(open_.where("url <> ''").groupBy("url").agg(F.min("k").alias("o_url")), "url", "left")
        if lists is not None:
            first = open_.where("class IS NOT NULL").groupBy("class").agg(F.min("k").alias("o"))
            if edges is None:  # the first open row of any class that shares a gram, alike or not
                least = index.join(first, "class").groupBy("place", "gram").agg(F.min("o").alias("o"))
                near = index.join(first.select("class"), "class", "left_semi").join(least, ["place", "gram"]).select("class", "o")
            else:
                near = edges.join(first.withColumnRenamed("class", "b"), "b").select(F.col("a").alias("class"), "o")
            seen = seen.join(near.union(first).groupBy("class").agg(F.min("o").alias("o_title")), "class", "left")
        for c in {"o_id", "o_url", "o_title"} - set(seen.columns):
            seen = seen.withColumn(c, none)
        k, title = F.col("k"), F.col("by_title.k")
        earlier = lambda c: F.coalesce(F.col(c) < F.col("k"), F.lit(False))
        decided = (
            F.when(earlier("by_id"), F.struct(F.col("by_id").alias("into"), F.lit("canonical_id").alias("reason"), F.lit(1.0).alias("score")))
            .when(earlier("o_id"), None)
            .when(earlier("by_url"), F.struct(F.col("by_url").alias("into"), F.lit("application_url").alias("reason"), F.lit(1.0).alias("score")))
            .when(earlier("o_url"), None)
            .when(earlier("by_title.k") & ~F.coalesce(F.col("o_title") < title, F.lit(False)), F.struct(title.alias("into"), F.lit("fuzzy_title_institution").alias("reason"), F.col("by_title.score").alias("score")))
            .when(earlier("o_title"), None)
            .otherwise(F.struct(k.alias("into"), F.lit("").alias("reason"), score.alias("score")))
        )
        seen = scratch(seen.select("uid", "k", "id", "url", "class", "by_id", "by_url", "by_title", decided.alias("to")), "round")
        settled.append(seen.where("to IS NOT NULL").select("uid", "k", "to.into", "to.reason", "to.score"))
        still, new = seen.where("to IS NULL").drop("to"), seen.where("to.into = k").select("k", "id", "url", "class", F.lit(False).alias("stored"))
        if still.isEmpty():
            break
        open_ = scratch(met(still, new, pairs(still, new) if edges is None else edges), "open")
    out = settled[0]
    for part in settled[1:]:
        out = out.union(part)
    return out


# --- merging ---------------------------------------------------------------------------------------------------------------


def casefold(c: Column) -> Column:
    out = F.lower(F.coalesce(c, F.lit("")))
    for a, b in text.FOLDS.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _tagged(c: str, t: int) -> Column:
    """The items of a list with its number t and their places."""
    return F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x, i: F.struct(F.lit(t).alias("t"), x.alias("v"), i.alias("i")))


def merged(rows: DataFrame, names: list[str], scratch: Scratch, hit: bool = False) -> DataFrame:
    """`_into`, `_n` and the merged fields of each group of rows (_into, _k, names): rows of a group folded in the order of _k.

    All but titles, some summaries and some descriptions are aggregates that combine before the shuffle; a first pass tells which groups need more. hit: a
    group of several rows is no longer new in this run.
    """
    k, have = F.col("_k"), [c for c in names]
    first = lambda c, ok: F.min_by(F.when(ok, F.col(c)), F.when(ok, k))
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    prose = [c for c in ("summary", "application_angle") if c in have]
    scored = [c for c in SCORED if c in have] if "fit_score" in have else []
    aggs = [F.count("*").alias("_n"), F.min_by(F.struct(*have), k).alias("own"), F.min("_k").alias("_own_k")]
    aggs += [first(c, filled(c)).alias(f"first_{c}") for c in FILLED if c in have]
    if "institution" in have:
        aggs.append(first("institution", ~text.missing_institution(F.col("institution"))).alias("place"))
    if scored:
        aggs.append(F.min_by(F.struct(k.alias("k"), *scored), F.struct(-F.coalesce("fit_score", F.lit(0)), k)).alias("best"))
    if "description_text" in have:
        size = F.length(F.coalesce("description_text", F.lit("")))
        aggs += [F.min_by("description_text", F.struct(-size, k)).alias("longest"), F.coalesce(F.bool_or(F.col("description_text").startswith(STANDS_IN)), F.lit(False)).alias("stands_in")]
    if "title" in have:
        aggs += [F.min(F.coalesce("title", F.lit(""))).alias("low"), F.max(F.coalesce("title", F.lit(""))).alias("high")]
    aggs += [F.bool_or(F.coalesce(c, F.lit(False))).alias(f"any_{c}") for c in FLAGS if c in have]
    out = rows.groupBy("_into").agg(*aggs)

    many = F.col("_n") > 1
    value = {c: F.col(f"own.{c}") for c in have}
    for c in FILLED:
        if c in have:
            value[c] = F.coalesce(f"first_{c}", f"own.{c}")
    for c in scored:
        value[c] = F.col(f"best.{c}")
    if "institution" in have:
        value["institution"] = F.coalesce("place", "own.institution")
    if "description_text" in have:
        value["description_text"] = F.when(many, F.col("longest")).otherwise(F.col("own.description_text"))
    for c in FLAGS:
        if c in have:
            value[c] = F.when(many, F.lit(False) if hit and c == "is_new_this_run" else F.col(f"any_{c}")).otherwise(F.col(f"own.{c}"))
    later = {c: F.col("best.k") != F.col("_own_k") for c in prose} if scored else {}
    for c in prose:
        if scored:  # after the best row only later rows fill; that is looked up where the best row has none
            value[c] = F.when(later[c], F.col(f"best.{c}")).otherwise(F.coalesce(f"first_{c}", f"own.{c}"))

    lists = [c for c in LISTS if c in have]
    if lists:
        items = F.concat(*(_tagged(c, t) for t, c in enumerate(lists)))
        each = rows.select("_into", "_k", F.explode(items).alias("x")).groupBy("_into", "x.t", "x.v").agg(F.min(F.struct("_k", "x.i")).alias("at"))
        union = each.groupBy("_into").agg(*(F.transform(F.array_sort(F.collect_list(F.when(F.col("t") == t, F.struct("at", "v")))), lambda x: x["v"]).alias(f"all_{c}") for t, c in enumerate(lists)))
        out = out.join(union, "_into", "left")
        for c in lists:
            value[c] = F.when(many, F.coalesce(f"all_{c}", F.array().cast("array<string>"))).otherwise(F.col(f"own.{c}"))

    asks = {}
    if "title" in have:
        asks["title"] = many & (F.col("low") != F.col("high"))
    if "description_text" in have:
        asks["description_text"] = many & F.col("stands_in")
    for c in later:
        asks[c] = later[c] & (F.coalesce(F.col(f"best.{c}").cast("string"), F.lit("")) == "") & F.col(f"first_{c}").isNotNull()
    if asks:
        out = scratch(out, "merged")
        any_of = out.agg(*(F.coalesce(F.bool_or(ask), F.lit(False)).alias(c) for c, ask in asks.items())).first()
        for c in asks:
            if any_of[c]:
                group = out.where(asks[c])
                if c == "title":
                    found = titles(rows, group)
                elif c == "description_text":
                    found = descriptions(rows, group)
                else:
                    found = rows.join(group.select("_into", F.col("best.k").alias("_best")), "_into").where(filled(c) & (k > F.col("_best"))).groupBy("_into").agg(F.min_by(c, "_k").alias(f"found_{c}"))
                out = scratch(out.join(found, "_into", "left"), "merged")
                value[c] = F.when(asks[c], F.coalesce(f"found_{c}", value[c])).otherwise(value[c])
    return out.select("_into", "_n", *(value[c].alias(c) for c in have))


def titles(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """The title that each group ends with: a later one that lies within the one before and is shorter by more than SHORTER takes its place.

    Only a title's first row counts, and only parts of the leader's title, of which there are few.
    """
    own = groups.select("_into", F.coalesce("own.title", F.lit("")).alias("own_title"))
    each = rows.join(own.select("_into"), "_into", "left_semi").groupBy("_into", F.coalesce("title", F.lit("")).alias("title")).agg(F.min("_k").alias("at"))
    parts = each.join(own, "_into").where((F.length("title") + SHORTER < F.length("own_title")) & F.contains(casefold(F.col("own_title")), casefold(F.col("title"))))
    order = F.transform(F.array_sort(F.collect_list(F.struct("at", "title"))), lambda x: x["title"])
    last = F.aggregate(order, F.first("own_title"), lambda t, x: F.when(F.contains(casefold(t), casefold(x)) & (F.length(x) + SHORTER < F.length(t)), x).otherwise(t))
    return parts.groupBy("_into").agg(last.alias("found_title"))


def descriptions(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """The description each group ends with: a longer one takes the place of the one before, and any takes the place of one that stands in.

    A stand-in that comes late may win, so lengths are folded in order, in a stream of constant state; the text itself is looked up then.
    """
    slim = rows.join(groups.select("_into"), "_into", "left_semi").select("_into", "_k", F.length(F.coalesce("description_text", F.lit(""))).alias("size"), F.coalesce(F.col("description_text").startswith(STANDS_IN), F.lit(False)).alias("poor"), F.col("_k.uid").alias("uid"))
    kind = dict(rows.dtypes)["_into"]
    stored = slim.withColumn("_into", F.to_json(F.struct("_into")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, size, poor, uid = None, 0, False, 0
        for pdf in batches:
            out = []
            for g, s, p, u in zip(pdf["_into"], pdf["size"], pdf["poor"], pdf["uid"], strict=True):
                if g != group:
                    if group is not None:
                        out.append((group, uid))
                    group, size, poor, uid = g, s, p, u
                elif poor or s > size:
                    size, poor, uid = s, p, u
            yield pd.DataFrame(out, columns=["_into", "uid"])
        if group is not None:
            yield pd.DataFrame([(group, uid)], columns=["_into", "uid"])

    chosen = stored.repartition("_into").sortWithinPartitions("_into", "_k").select("_into", "size", "poor", "uid").mapInPandas(run, "_into string, uid long")
    chosen = chosen.select(F.from_json("_into", f"_into {kind}")["_into"].alias("_into"), "uid")
    texts = rows.select(F.col("_k.uid").alias("uid"), "description_text")
    return chosen.join(texts, "uid").select("_into", F.coalesce("description_text", F.lit("")).alias("found_description_text"))


def changed_titles(before: DataFrame, after: DataFrame) -> DataFrame:
    """The k of leaders whose title compares otherwise after the merge than before it, where their institution is known."""
    both = before.select(F.col("k").alias("_into"), "core", "place").join(after.select("_into", "title"), "_into")
    return both.where((F.col("place") != "") & (text.normalize(core(F.col("title"))) != F.col("core"))).select("_into")


# --- replays ---------------------------------------------------------------------------------------------------------------


def with_component(keyed: DataFrame, scratch: Scratch) -> DataFrame:
    """keyed (uid, id, url, place) with the name of its component over these as `component`.

    A row links its first key, its id, to its others. Rounds of contraction take every key to the least of itself and its neighbours and rewrite
    the links, until none is left; each round at least halves the keys, and minima are combined before they are shuffled.
    """
    keyed = keyed.withColumn("_own", F.concat(F.lit("i:"), "id"))
    others = F.filter(F.array(F.when(F.col("url") != "", F.concat(F.lit("u:"), "url")), F.when(F.col("place") != "", F.concat(F.lit("p:"), "place"))), lambda x: x.isNotNull())
    links = scratch(keyed.select(F.col("_own").alias("a"), F.explode(others).alias("b")).distinct(), "links")
    label = links.select(F.col("a").alias("_own")).distinct().withColumn("component", F.col("_own"))
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        to = scratch(both.groupBy("a").agg(F.min("b").alias("up")).select("a", F.least("a", "up").alias("up")), "up")
        label = label.join(to.select(F.col("a").alias("component"), "up"), "component", "left").select("_own", F.coalesce("up", "component").alias("component"))
        label = scratch(label, "labels")
        moved = links.join(to, "a").select(F.col("up").alias("x"), "b").join(to.select(F.col("a").alias("b"), F.col("up").alias("y")), "b").where("x <> y")
        links = scratch(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    return keyed.join(label, "_own", "left").withColumn("component", F.coalesce("component", "_own")).drop("_own")


def folded(rows: DataFrame, schema, title_at: float, institution_at: float, stored: bool, mark: str | None) -> DataFrame:
    """The leaders of each component (component, _k, _stored and the schema's columns), folded in order; memory holds one component's leaders."""
    names = [c for c in schema.names if c != mark]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, replay, done, kinds = None, None, [], []

        def given() -> pa.RecordBatch:
            cols = [pa.array([r.get(c) for r in done], kind) for c, kind in zip(names, kinds, strict=True)]
            if mark:
                cols.append(pa.array([bool(r.get("_hit")) or not r["_stored"] for r in done], pa.bool_()))
            return pa.RecordBatch.from_arrays(cols, names=[*names, *([mark] if mark else [])])

        for b in batches:
            kinds = [b.schema.field(c).type for c in names]
            shown = [*names, "_stored"]
            for component, *values in zip(b.column("component").to_pylist(), *(b.column(c).to_pylist() for c in shown), strict=True):
                if component != at:
                    done += replay.leaders if replay is not None else []
                    at, replay = component, Replay(title_at, institution_at, stored)
                replay.add(dict(zip(shown, values, strict=True)))
            if len(done) >= 1000:
                yield given()
                done = []
        done += replay.leaders if replay is not None else []
        if done:
            yield given()

    dealt = rows.repartition("component").sortWithinPartitions("component", "_k").select("component", "_stored", *names)
    order = [*names, *([mark] if mark else [])]
    return dealt.mapInArrow(run, type(schema)([schema[c] for c in order])).select(*schema.names)


def replayed(rows: DataFrame, schema, title_at: float, institution_at: float, stored: bool, mark: str | None) -> DataFrame:
    """folded() for components in which a merge gave a leader another title."""
    return folded(rows, schema, title_at, institution_at, stored, mark)


def far_homes(keyed: DataFrame, scratch: Scratch) -> DataFrame:
    """home of the homes (keyed: home, id, url) of more than NEAR_ROWS rows, or with an id or URL that occurs in another home. All others are tied to nothing else."""
    out = keyed.groupBy("home").agg(F.count("*").alias("n")).where(F.col("n") > NEAR_ROWS).select("home")
    for c in ("id", "url"):
        split = keyed.where(F.col(c) != "") if c == "url" else keyed
        split = scratch(split.groupBy(c).agg(F.min("home").alias("lo"), F.max("home").alias("hi")).where("lo < hi").select(c), f"split-{c}")
        if not split.isEmpty():
            out = out.union(keyed.join(split, c, "left_semi").select("home"))
    return scratch(out.distinct(), "far")


# --- consolidation and upsert ----------------------------------------------------------------------------------------------


def _numbered(postings: DataFrame, order: str) -> DataFrame:
    """postings with _stored and _k, their order: stored ones first, then by `order`, then as they were read."""
    if "_stored" not in postings.columns:
        postings = postings.withColumn("_stored", F.lit(False))
    return postings.withColumn("_k", F.struct((~F.col("_stored")).alias("new"), F.col(order).alias("ord"), F.monotonically_increasing_id().alias("uid")))


def _homed(rows: DataFrame) -> DataFrame:
    """rows with _url and _home: the institution's key, else the URL, else the id."""
    keys = key_columns(rows)
    home = F.when(keys["place"] != "", F.concat(F.lit("p:"), keys["place"])).when(keys["url"] != "", F.concat(F.lit("u:"), keys["url"])).otherwise(F.concat(F.lit("i:"), keys["id"]))
    return rows.withColumns({"_url": keys["url"], "_home": home})


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("_k.uid").alias("uid"), F.col("_k").alias("k"), *(c.alias(n) for n, c in key_columns(rows).items()), F.col("_stored").alias("stored"))


def duplicates(postings: DataFrame, order: str = "ord", title_at: float = 0.9, institution_at: float = 0.9) -> DataFrame:
    """(ord, leader, reason, score) of every posting: the order of the first posting it would be merged into, null where it leads.

    reason: canonical_id, application_url or fuzzy_title_institution; score: 1, or the lesser ratio of titles and institutions. Titles stay as they came.
    """
    scratch = Scratch(postings.sparkSession)
    rows = scratch(_numbered(postings, order), "postings")
    out = leaders(scratch(_keyed(rows), "keyed"), title_at, institution_at, scratch)
    return out.select(F.col("k.ord").alias("ord"), F.when(F.col("reason") != "", F.col("into.ord")).alias("leader"), F.nullif("reason", F.lit("")).alias("reason"), "score")


def touched(history: DataFrame, new: DataFrame, order: str = "ord") -> DataFrame:
    """The order of the stored rows that new rows may reach: all of a component over ids, URLs and institutions that holds a new row. Reads these columns alone."""
    scratch = Scratch(history.sparkSession)
    key = lambda df: df.select(F.col(order), *(c.alias(n) for n, c in key_columns(df).items()))
    both = scratch(key(history).withColumn("stored", F.lit(True)).unionByName(key(new).withColumn("stored", F.lit(False))), "keys")
    labels = scratch(with_component(both.select(order, "stored", "id", "url", "place"), scratch).select(order, "stored", "component"), "component")
    return labels.where("stored").join(labels.where("NOT stored").select("component").distinct(), "component", "left_semi").select(order)


def _resolve(postings: DataFrame, order: str, title_at: float, institution_at: float, stored: bool, mark: str | None) -> DataFrame:
    names = [c for c in postings.columns if c != "_stored"]
    scratch = Scratch(postings.sparkSession)
    rows = _numbered(postings, order)
    tied = bool({"application_url", "institution"} & set(names))  # whether anything but ids can tie rows
    if tied:
        rows = scratch(_homed(rows), "postings")
        tied = not rows.where("_home NOT LIKE 'i:%'").isEmpty()
    if not tied:
        if "_home" not in rows.columns and {"title", "description_text", "summary", "application_angle"} & set(names):  # these may be read again by their numbers, which one read fixes
            rows = scratch(rows, "postings")
        rows = rows.withColumn("_into", F.coalesce("canonical_id", F.lit("")))
        if mark:
            rows = rows.withColumn(mark, ~F.col("_stored"))
        if not stored:
            return merged(rows, names, scratch).select(*names)
        # With a store only the first rows of ids, stored or new, take part as leaders; a marked row is any that is new or has met a new one.
        seen = rows.groupBy("_into").agg(F.bool_or(~F.col("_stored")).alias("_seen"))
        out = merged(rows, names, scratch, hit=True).join(seen, "_into")
        return out.select(*names, *([F.col("_seen").alias(mark)] if mark else []))
    schema = (postings.drop("_stored").withColumn(mark, F.lit(True)) if mark else postings.drop("_stored")).schema
    # Most homes are small and tied to no other: one shuffle brings each together, and a stream folds it.
    far = far_homes(rows.select(F.col("_home").alias("home"), F.coalesce("canonical_id", F.lit("")).alias("id"), F.col("_url").alias("url")), scratch).withColumnRenamed("home", "_home")
    if far.isEmpty():
        return folded(rows.withColumnRenamed("_home", "component"), schema, title_at, institution_at, stored, mark)
    near = rows.join(far, "_home", "left_anti").withColumnRenamed("_home", "component")
    rest = rows.join(far, "_home", "left_semi").drop("_home", "_url")
    return folded(near, schema, title_at, institution_at, stored, mark).unionByName(_rounds(rest, names, schema, title_at, institution_at, stored, mark, scratch))


def _rounds(rows: DataFrame, names: list[str], schema, title_at: float, institution_at: float, stored: bool, mark: str | None, scratch: Scratch) -> DataFrame:
    """The merged leaders of rows by rounds."""
    rows = scratch(rows, "postings")
    keyed = scratch(_keyed(rows), "keyed")
    into = scratch(leaders(keyed, title_at, institution_at, scratch), "into")
    group = into.where("reason <> ''").select(F.col("into").alias("_into")).distinct()
    members = into.join(group, F.col("into") == F.col("_into"), "left_semi").select("uid", F.col("into").alias("_into"))
    tied = scratch(rows.withColumn("uid", F.col("_k.uid")).join(members, "uid").drop("uid"), "members")
    out = merged(tied, names, scratch, hit=stored)
    alone = rows.join(members, F.col("_k.uid") == F.col("uid"), "left_anti")
    if mark:
        alone, out = alone.withColumn(mark, ~F.col("_stored")), out.withColumn(mark, F.lit(True))
    shown = [*names, *([mark] if mark else [])]
    if "title" in names:
        out = scratch(out, "merged")
        changed = scratch(changed_titles(keyed, out), "changed")
        if not changed.isEmpty():
            part = scratch(with_component(keyed.select("uid", "k", "id", "url", "place"), scratch), "component")
            again = part.join(part.join(changed, F.col("k") == F.col("_into"), "left_semi").select("component").distinct(), "component", "left_semi").select("uid", "k", "component")
            again = scratch(again, "again")
            told = replayed(rows.withColumn("uid", F.col("_k.uid")).join(again.select("uid", "component"), "uid"), schema, title_at, institution_at, stored, mark)
            out = out.join(again, F.col("_into") == F.col("k"), "left_anti").select(*shown).unionByName(told.select(*shown))
            alone = alone.join(again, F.col("_k.uid") == F.col("uid"), "left_anti")
    return alone.select(*shown).unionByName(out.select(*shown))


def consolidate(postings: DataFrame, order: str = "ord", title_at: float = 0.9, institution_at: float = 0.9) -> DataFrame:
    """The leaders of postings, in their order, with the postings that meet them merged in. Columns that postings lack are left out of the merge."""
    return _resolve(postings, order, title_at, institution_at, False, None)


def upsert(history: DataFrame, new: DataFrame, order: str = "ord", title_at: float = 0.9, institution_at: float = 0.9, mark: str | None = None) -> DataFrame:
    """history with new rows merged into it or added; stored rows come first and are never merged with each other. mark: a further column, whether
    a row was added or merged into."""
    both = history.withColumn("_stored", F.lit(True)).unionByName(new.withColumn("_stored", F.lit(False)))
    return _resolve(both, order, title_at, institution_at, True, mark)
