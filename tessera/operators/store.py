"""The stored postings: buckets of Parquet files, and versions that name them.

A run reads and writes only the buckets its rows reach and publishes the next version in one step; a run that dies leaves the last one as it was.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import dedupe, outputs

#: Buckets of a store, and versions that are kept.
BUCKETS, KEEP = 64, 3
#: Columns that an update leaves as stored.
KEPT = ("canonical_id", "date_first_seen", "created_at", "has_been_emailed")
#: What a posting has where its source says nothing. Fixed values.
DEFAULTS = {"role_type": "other", "fit_category": "D", "fit_score": 0, "status": "active", "is_priority_institution": False, "is_new_this_run": True, "has_been_emailed": False}
#: Columns that are null, not empty, where there is nothing.
NULLABLE = ("deadline", "date_posted")
SCHEMA = "ord long, " + ", ".join(f"{c} {'array<string>' if c in outputs.LISTS else 'boolean' if c in outputs.FLAGS else 'int' if c == 'fit_score' else 'string'}" for c in outputs.COLUMNS)


def whole(postings: DataFrame, today: str, now: str) -> DataFrame:
    """postings with all columns of the store: the application URL is the source's, and ids and dates are given, where they are missing."""

    def one(c: str) -> Column:
        value = F.col(c) if c in postings.columns else F.lit(None)
        if c in outputs.LISTS:
            return F.coalesce(value.cast("array<string>"), F.array().cast("array<string>"))
        if c in ("date_first_seen", "date_last_seen", "created_at", "updated_at"):
            return F.coalesce(value.cast("string"), F.lit(today if c.startswith("date") else now))
        if c in DEFAULTS:
            return F.coalesce(value, F.lit(DEFAULTS[c]))
        return value.cast("string") if c in NULLABLE else F.coalesce(value.cast("string"), F.lit(""))

    out = postings.select("ord", *(one(c).alias(c) for c in outputs.COLUMNS))
    out = out.withColumn("application_url", F.when(F.col("application_url") == "", F.col("source_url")).otherwise(F.col("application_url")))
    own = text.canonical_id(F.col("title"), F.col("institution"), F.col("application_url"))
    return out.withColumn("canonical_id", F.when(F.col("canonical_id") == "", own).otherwise(F.col("canonical_id")))


def split_lines(c: Column) -> Column:
    """The lines of a text that are not blank."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), lambda x: F.trim(text.clean_text(x)) != "")


def read_flat(flat: DataFrame) -> DataFrame:
    """Rows as outputs.flat() writes them, read back: lists from lines, flags from 0 and 1, the score a number."""

    def one(c: str) -> Column:
        if c in outputs.LISTS:
            return split_lines(F.col(c))
        if c in outputs.FLAGS:
            return F.coalesce(F.col(c).try_cast("int"), F.lit(0)) != 0
        if c == "fit_score":
            return F.coalesce(F.col(c).try_cast("int"), F.lit(0))
        return F.when(F.col(c) != "", F.col(c)) if c in NULLABLE else F.col(c)

    return flat.select(*(one(c).alias(c) for c in outputs.COLUMNS))


# --- versions: a manifest names, for each bucket, the folder that holds its rows ----------------------------------------------


class Conflict(RuntimeError):
    """Another writer published the version that this one was to be."""


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, path = _fs(spark, f"{folder}/manifests")
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def _read_text(spark: SparkSession, path: str) -> str:
    fs, at = _fs(spark, path)
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def manifest(spark: SparkSession, folder: str) -> dict:
    """The last published version: version, buckets (number to folder), rows_read and rows_written by the run that made it; version -1 if there is none."""
    for name in reversed(_names(spark, folder)):
        if name.endswith(".json") and (found := _read_text(spark, f"{folder}/manifests/{name}")):
            return json.loads(found)
    return {"version": -1, "buckets": {}, "rows_read": 0, "rows_written": 0}


def publish(spark: SparkSession, folder: str, made: dict) -> None:
    """Compare and swap: the version's file is created only if it does not exist, so of two writers that read one version the later one fails."""
    name = f"{folder}/manifests/{made['version']:09d}.json"
    fs, at = _fs(spark, name)
    made = made | {"writer": uuid.uuid4().hex}
    try:
        stream = fs.create(at, False)
    except Py4JJavaError as e:
        raise Conflict(name) from e
    stream.write(bytearray(json.dumps(made).encode()))
    stream.close()
    if json.loads(_read_text(spark, name) or "{}").get("writer") != made["writer"]:
        raise Conflict(name)


def tidy(spark: SparkSession, folder: str, keep: int = KEEP) -> None:
    """Delete manifests but the last `keep`, and the data that these versions do not name and are older than them."""
    names = [n for n in _names(spark, folder) if n.endswith(".json")]
    used, last = set(), names[-keep:]
    for name in last:
        used |= {p.rsplit("/bucket=", 1)[0] for p in json.loads(_read_text(spark, f"{folder}/manifests/{name}") or '{"buckets": {}}')["buckets"].values()}
    for name in names[:-keep]:
        old = json.loads(_read_text(spark, f"{folder}/manifests/{name}") or '{"buckets": {}}')
        for path in {p.rsplit("/bucket=", 1)[0] for p in old["buckets"].values()} - used:
            fs, at = _fs(spark, path)
            fs.delete(at, True)
        fs, at = _fs(spark, f"{folder}/manifests/{name}")
        fs.delete(at, False)


def read(spark: SparkSession, folder: str, buckets: set[str] | None = None) -> DataFrame:
    """The stored postings with their order, or those of some buckets; none where nothing has been stored."""
    paths = sorted(p for b, p in manifest(spark, folder)["buckets"].items() if buckets is None or b in buckets)
    return spark.read.schema(SCHEMA).parquet(*paths) if paths else spark.createDataFrame([], SCHEMA)


def bucket() -> Column:
    """A row's bucket: by its institution, so that rows that may meet lie together, or by its id where it has none."""
    place = text.institution_key(F.col("institution"))
    return F.pmod(F.xxhash64(F.when(place != "", place).otherwise(F.col("canonical_id"))), F.lit(BUCKETS)).cast("string")


def merge_in(postings: DataFrame, folder: str, today: str, now: str, title_at: float = 0.9, institution_at: float = 0.9) -> dict:
    """Publish the next version with postings (with `ord`) merged in, and give its manifest; Conflict if another writer was faster.

    Key columns of all rows are read; whole rows only of buckets with rows that new ones may reach; written are the buckets of rows that changed. Rows added get
    today's dates; rows merged into are last seen today and keep their first dates and whether they have been sent. A run that dies leaves files that no
    version names and stands in no other's way.
    """
    spark, folder = postings.sparkSession, folder.rstrip("/")
    last = manifest(spark, folder)
    old = read(spark, folder)
    top = old.agg(F.max("ord")).first()[0]
    scratch = dedupe.Scratch(spark)
    new = scratch(whole(postings, today, now).withColumn("ord", F.col("ord") + (0 if top is None else top + 1)).select(*old.columns), "new")
    reached = scratch(old.join(dedupe.touched(old, new), "ord", "left_semi").select("ord", bucket().alias("bucket")), "reached")
    near = {r["bucket"] for r in reached.select("bucket").distinct().collect()}
    history = read(spark, folder, near).join(reached.select("ord"), "ord", "left_semi")
    out = dedupe.upsert(history, new, title_at=title_at, institution_at=institution_at, mark="_seen")
    seen = {"date_last_seen": F.when(F.col("_seen"), F.lit(today)).otherwise(F.col("date_last_seen")), "updated_at": F.when(F.col("_seen"), F.lit(now)).otherwise(F.col("updated_at"))}
    out = scratch(out.withColumns(seen).where("_seen").drop("_seen").withColumn("bucket", bucket()), "seen")
    dirty = {r["bucket"] for r in out.select("bucket").union(reached.join(out.select("ord"), "ord", "left_semi").select("bucket")).distinct().collect()}
    stays = read(spark, folder, dirty).join(out.select("ord"), "ord", "left_anti").withColumn("bucket", bucket())
    path = f"{folder}/data/{uuid.uuid4().hex}"
    stays.unionByName(out).repartition("bucket").write.partitionBy("bucket").parquet(path)
    fresh = {r["bucket"]: r["n"] for r in spark.read.parquet(path).groupBy(F.col("bucket").cast("string").alias("bucket")).agg(F.count("*").alias("n")).collect()} if dirty else {}
    buckets = {b: p for b, p in last["buckets"].items() if b not in dirty} | {b: f"{path}/bucket={b}" for b in fresh}
    made = {"version": last["version"] + 1, "buckets": buckets, "rows_read": sum(r["n"] for r in read(spark, folder, near).agg(F.count("*").alias("n")).collect()), "rows_written": sum(fresh.values())}
    publish(spark, folder, made)
    tidy(spark, folder)
    return made


def save(postings: DataFrame, folder: str, today: str, now: str, title_at: float = 0.9, institution_at: float = 0.9, tries: int = 5) -> DataFrame:
    """merge_in(), again from the new last version where another writer was faster; the whole store then, consolidated."""
    for left in range(tries - 1, -1, -1):
        try:
            merge_in(postings, folder, today, now, title_at, institution_at)
            break
        except Conflict:
            if not left:
                raise
    return dedupe.consolidate(read(postings.sparkSession, folder), title_at=title_at, institution_at=institution_at)
