"""Scores by a language model: a client is asked about postings of a good rule score, its answers are checked, and rule scores stay where it fails.

The client is any picklable callable from a request (JSON text) to an answer (a dict); it runs on the executors, once for each request and
run of the plan: write the result before it is used twice, or name a folder of answers.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import dedupe, outputs, scoring

Client = Callable[[str], dict]

#: Weights of the dimensions of an assessment, 0 to 5 each; least scores of the categories; role types and their other names. Fixed values.
DIMENSIONS = dict(zip(("research_topic_fit", "methods_fit", "career_stage_fit", "department_fit", "teaching_fit"), scoring.MODEL_WEIGHTS, strict=True))
CATEGORIES = (("A", 75), ("B", 55), ("C", 35), ("D", 0))
OTHER_NAMES = {"assistant professor": "assistant_professor", "lecturer or senior lecturer": "lecturer_ap_equivalent", "senior lecturer or lecturer": "lecturer_ap_equivalent", "non tenure open rank and title": "open_rank"}
#: Code points of a description that a request holds; score of part-time postings at most.
DESCRIPTION, PART_TIME_MOST = 15_000, 54
LISTS, TEXTS = ("match_reasons", "required_materials", "warnings"), ("summary", "application_angle")
ANSWER = "fit_category string, fit_score int, role_type string, summary string, application_angle string, match_reasons array<string>, required_materials array<string>, warnings array<string>, deadline string, problem string"
STORED = f"key string, {ANSWER}, tokens long"
#: Requests between two writes of the table of answers, about.
ROUND = 1000


def request_of(row: dict, profile: dict) -> str:
    """What a client is asked about a posting."""
    plain = lambda c: None if (v := row.get(c)) is None or v is pd.NA else v
    lines = lambda c: [str(x) for x in (row[c] if row.get(c) is not None else [])]
    job = {c: plain(c) for c in ("title", "institution", "department", "school", "location", "region")}
    job |= {"description": (plain("description_text") or "")[:DESCRIPTION], "deadline": plain("deadline")}
    rules = {"score": int(row["fit_score"] or 0), "role_type": plain("role_type"), "reasons": lines("match_reasons"), "warnings": lines("warnings")}
    return json.dumps({"candidate_profile": profile, "rule_prescreen": rules, "job": job}, ensure_ascii=False)


def role_of(value: object, roles: tuple[str, ...]) -> str:
    raw = str(value).strip()
    words = re.sub(r"[^a-z0-9]+", " ", raw.lower()).strip()
    if raw in roles:
        return raw
    return OTHER_NAMES.get(words) or ("other" if "malformed" in words or words.startswith("unclear") else raw)


def assessed(answer: dict) -> dict:
    """An answer of five dimensions as one of a score and a category."""
    marks = {d: answer[d] for d in DIMENSIONS}
    if bad := [d for d, m in marks.items() if not isinstance(m, int) or not 0 <= m <= 5]:
        raise ValueError(f"{bad[0]} is not from 0 to 5")
    points = sum(w * marks[d] for d, w in DIMENSIONS.items())
    return answer | {"fit_score": points, "fit_category": next(c for c, least in CATEGORIES if points >= least), "match_reasons": answer.get("evidence")}


def checked(answer: dict, roles: tuple[str, ...]) -> dict:
    """The fields of an answer that a posting takes; a ValueError names what is wrong with it."""
    if all(d in answer for d in DIMENSIONS):
        answer = assessed(answer)
    out = {"fit_category": str(answer.get("fit_category", "")).strip(), "fit_score": int(answer.get("fit_score", 0)), "role_type": role_of(answer.get("role_type", ""), roles)}
    if out["fit_category"] not in dict(CATEGORIES):
        raise ValueError(f"category {out['fit_category']!r}")
    if out["role_type"] not in roles:
        raise ValueError(f"role type {out['role_type']!r}")
    if not 0 <= out["fit_score"] <= 100 or not 0 <= float(answer.get("confidence", 0)) <= 1:
        raise ValueError("score or confidence out of range")
    return out | {c: str(answer.get(c, "")) for c in TEXTS} | {c: [str(x) for x in answer.get(c) or []] for c in LISTS} | {"deadline": answer.get("deadline")}


def requests(scored: DataFrame, profile: dict) -> DataFrame:
    """(ord, key, request) of postings: what a client is asked, and its SHA-256."""

    def run(batches):
        for pdf in batches:
            asked = [request_of(row, profile) for row in pdf.to_dict("records")]
            yield pd.DataFrame({"ord": pdf["ord"], "key": [hashlib.sha256(x.encode()).hexdigest() for x in asked], "request": asked})

    return scored.mapInPandas(run, f"ord {dict(scored.dtypes)['ord']}, key string, request string")


def answers_of(asked: DataFrame, client: Client, roles: tuple[str, ...]) -> DataFrame:
    """(key, the answer's fields, problem, tokens) of requests (key, request); tokens: what the client's own count says the request took."""
    fields = [f.split(" ")[0] for f in ANSWER.split(", ")]

    def run(batches):
        used = lambda: int(getattr(client, "usage", {}).get("total_tokens", 0))
        for pdf in batches:
            rows = []
            for key, request in zip(pdf["key"], pdf["request"], strict=True):
                before = used()
                try:
                    got = checked(client(request), roles)
                except Exception as e:  # whatever a client raises costs its posting's answer alone
                    got = {"problem": f"{type(e).__name__}: {e}"}
                rows.append({"key": key} | dict.fromkeys(fields) | got | {"tokens": used() - before})
            yield pd.DataFrame({c: pd.Series([r[c] for r in rows], dtype="Int32" if c == "fit_score" else object) for c in ("key", *fields, "tokens")})

    return asked.select("key", "request").mapInPandas(run, STORED)


def answered(asked: DataFrame, client: Client, roles: tuple[str, ...], folder: str) -> DataFrame:
    """answers_of() with a table of answers in a folder: a request that has one is not asked again. Requests go in rounds of about ROUND, each written
    when it is done, so a run that dies loses one round at most; a task that is lost asks its own few again. Failures are not kept."""
    spark = asked.sparkSession
    scratch = dedupe.Scratch(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    known = spark.createDataFrame([], STORED)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        known = scratch(spark.read.schema(STORED).parquet(folder).dropDuplicates(["key"]).withColumn("tokens", F.lit(0).cast("long")), "known")
    todo = scratch(asked.join(known.select("key"), "key", "left_anti"), "asked")
    rounds = -(-todo.count() // ROUND)
    for i in range(rounds):
        part = todo.where(F.pmod(F.xxhash64("key"), F.lit(rounds)) == i)
        new = scratch(answers_of(part.repartition(max(1, min(ROUND // 10, part.count())), "key"), client, roles), "answers")
        new.where("problem IS NULL").write.mode("append").parquet(folder)
        known = known.unionByName(new)
    return known


def rescore(scored: DataFrame, client: Client | None, profile: dict, roles: tuple[str, ...], least: float = 0.35, folder: str | None = None) -> DataFrame:
    """scored (with rule_score and unique ord) with the client's scores where rule_score is at least `least`, model_problem: why an answer was not taken, and
    model_tokens: what it took. folder: a table of answers, so that no request is asked twice; equal requests are asked once in any case.

    Rule warnings stay before the client's. Part-time postings score PART_TIME_MOST at most and are then C. Without a client, or for a null
    rule_score, rule scores stay. Rows with no answer keep theirs too, so one failure costs one posting.
    """
    fields = [f.split(" ")[0] for f in ANSWER.split(", ")]
    missing = {c: F.lit(None).cast("array<string>" if c in LISTS else "string") for c in (*LISTS, *TEXTS, "deadline") if c not in scored.columns}
    base = scored.withColumns(missing) if missing else scored
    if client is None:
        out = base.withColumns({"model_problem": F.lit(None).cast("string"), "model_tokens": F.lit(0).cast("long")})
    else:
        asked = requests(base.where(F.col("rule_score") >= least), profile)
        if folder:
            asked = dedupe.Scratch(scored.sparkSession)(asked, "requests")
        once = asked.groupBy("key").agg(F.first("request").alias("request"), F.min("ord").alias("_first"))
        got = answers_of(once, client, roles) if not folder else answered(once, client, roles, folder)
        given = asked.select("ord", "key").join(got, "key").join(once.select("key", "_first"), "key").withColumn("tokens", F.when(F.col("ord") == F.col("_first"), F.col("tokens")).otherwise(0))
        given = given.select("ord", F.struct(*fields, "tokens").alias("_m"))
        took = F.col("_m").isNotNull() & F.col("_m.problem").isNull()
        new = {c: F.when(took, F.col(f"_m.{c}")).otherwise(F.col(c)) for c in fields if c not in ("warnings", "deadline", "problem")}
        new["warnings"] = F.when(took, F.array_distinct(F.concat(F.coalesce("warnings", F.array().cast("array<string>")), "_m.warnings"))).otherwise(F.col("warnings"))
        new["deadline"] = F.when(took & (F.coalesce("_m.deadline", F.lit("")) != ""), F.col("_m.deadline")).otherwise(F.col("deadline"))
        out = base.join(given, "ord", "left").withColumns(new).withColumns({"model_problem": F.col("_m.problem"), "model_tokens": F.coalesce("_m.tokens", F.lit(0).cast("long"))}).drop("_m")
    late = outputs.lower_priority() & (F.col("fit_score") > PART_TIME_MOST)
    return out.withColumn("_cut", late).withColumns({"fit_score": F.when(F.col("_cut"), PART_TIME_MOST).otherwise(F.col("fit_score")), "fit_category": F.when(F.col("_cut"), "C").otherwise(F.col("fit_category"))}).drop("_cut")
