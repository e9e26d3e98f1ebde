"""Role classes and weighted scores of postings, as column expressions over normalized text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import dates, geo, text

#: Terms of the decision list. Fixed values; terms with a hyphen or slash never occur in normalized text.
AP = ("assistant professor", "tenure track assistant professor", "tenure-track assistant professor", "ttap")
FELLOWSHIP = ("faculty fellowship", "faculty fellow", "presidential fellow")
TEACHING = ("teaching professor", "teaching track", "lecturer in teaching", "lecturer in discipline", "senior lecturer in discipline", "stipendiary lecturer", "visiting assistant professor")
LECTURER = ("lecturer", "senior lecturer", "lectureship")
POSTDOC = ("postdoc", "post-doctoral", "postdoctoral researcher", "research associate")
OPEN_RANK = ("open rank", "assistant associate full professor", "associate full professor", "faculty positions")
ASSOCIATE = ("associate professor", "assistant/associate professor")
#: Weights of a model's five dimensions, of 0 to 5 each: research, methods, career, department, teaching. Fixed values.
MODEL_WEIGHTS = (7, 5, 3, 3, 2)
#: Weights. Fixed values, all replaceable by settings.
DEFAULTS = {
    "role_weights": {"assistant_professor": 0.30, "tenure_track_assistant_professor": 0.30, "lecturer_ap_equivalent": 0.30, "faculty_fellowship": 0.30, "prestigious_postdoc_fellowship": 0.18, "regular_postdoc": -0.25, "teaching_only": -0.25, "open_rank": 0.30, "associate_professor_eu_tt_equivalent": 0.30, "business_school_adjacent": 0.10, "other": -0.25},
    "high_value_per_hit": 0.06, "max_high_value_bonus": 0.35, "medium_value_per_hit": 0.035, "max_medium_value_bonus": 0.18, "tenure_bonus": 0.06, "priority_institution_bonus": 0.10, "included_region_bonus": 0.08, "excluded_region_penalty": 0.25, "negative_per_hit": 0.10, "max_negative_penalty": 0.35, "part_time_penalty": 0.25, "expired_penalty": 0.30, "lower_priority_score_cap": 54,
}
REGIONS = ("us", "canada", "uk", "eu", "switzerland", "nordics", "australia", "hong_kong", "singapore", "mainland_china", "middle_east")


def any_of(c: Column, terms: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (c.contains(t) for t in terms))


def role_type(title: Column, description: Column, region: Column) -> Column:
    said = text.normalize(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(description, F.lit(""))))
    # Bound once by a lambda: the list tests the text dozens of times, and Catalyst would write it out for each.
    return F.get(F.transform(F.array(F.struct(said.alias("t"), text.normalize(region).alias("r"))), lambda x: role_of(x["t"], x["r"])), F.lit(0))


def role_of(t: Column, r: Column) -> Column:
    """The decision list over normalized text and region."""
    lecturer = any_of(t, LECTURER)
    cases = [
        (any_of(t, POSTDOC) & t.contains("fellow") & any_of(t, ("prestigious", "faculty", "tenure")), "prestigious_postdoc_fellowship"),
        (any_of(t, POSTDOC), "regular_postdoc"),
        (any_of(t, TEACHING), "teaching_only"),
        (lecturer & r.isin("us", "usa", "canada"), "teaching_only"),
        (any_of(t, AP) & t.contains("tenure"), "tenure_track_assistant_professor"),
        (any_of(t, AP), "assistant_professor"),
        (lecturer & r.isin("uk", "eu", "europe"), "lecturer_ap_equivalent"),
        (any_of(t, FELLOWSHIP), "faculty_fellowship"),
        (any_of(t, OPEN_RANK), "open_rank"),
        (any_of(t, ASSOCIATE) & r.isin("eu", "europe", "sweden", "netherlands", "nordics"), "associate_professor_eu_tt_equivalent"),
    ]
    return geo.first_of([(c, F.lit(v)) for c, v in cases], F.lit("other"))


#: So many terms are sought one by one; more of them by an automaton that reads a text once.
FEW_TERMS = 64


def automaton_hits(normalized: Column, keys: list[tuple[str, str]]) -> Column:
    """The terms of (normal form, term) that occur anywhere in the text, overlaps included; one reading of the text, however many terms there are."""

    def seek(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        where: dict[str, list[int]] = {}
        for i, (key, _) in enumerate(keys):
            where.setdefault(key, []).append(i)
        seen = ahocorasick.Automaton()
        for key, places in where.items():
            seen.add_word(key, places)
        seen.make_automaton()
        for texts in batches:
            found = ({id(places): places for _, places in seen.iter(t or "")} for t in texts)
            yield pd.Series([[keys[i][1] for i in sorted(i for places in f.values() for i in places)] for f in found], dtype=object)

    return F.pandas_udf(seek, "array<string>")(normalized)


def keyword_hits(normalized: Column, terms: list[str]) -> Column:
    """The terms, in their order and spelling, whose normal form the text holds."""
    keys = [(plain_key(t), t) for t in terms if plain_key(t)]
    if not keys:
        return F.array().cast("array<string>")
    if len(keys) > FEW_TERMS:
        return automaton_hits(normalized, keys)
    # Bound once by a lambda: written out for each term, the text would be normalized for each.
    given = lambda n: F.filter(F.array(*(F.when(n.contains(k), F.lit(t)) for k, t in keys)), lambda x: x.isNotNull())
    return F.get(F.transform(F.array(normalized), given), F.lit(0))


def category(score: Column) -> Column:
    return F.when(score >= 75, "A").when(score >= 55, "B").when(score >= 35, "C").otherwise("D")


def region_allowed(region: Column, included: tuple[str, ...] = REGIONS) -> Column:
    return F.replace(text.normalize(region), F.lit(" "), F.lit("_")).isin(*included)


def plain_key(name: str) -> str:
    """A configured name as text.normalize() has it."""
    return re.sub(r"[^a-z0-9]+", " ", re.sub(r"https?://(www\.)?", "", name.casefold())).strip()


def priority(institution: Column, names: list[str]) -> Column:
    return text.normalize(institution).isin(*{n for n in names}) if names else F.lit(False)


def model_score(research: Column, methods: Column, career: Column, department: Column, teaching: Column) -> Column:
    """The score of five model dimensions of 0 to 5."""
    return sum(w * c for w, c in zip(MODEL_WEIGHTS, (research, methods, career, department, teaching), strict=True))


def score(postings: DataFrame, keywords: dict[str, list[str]], as_of: str, priority_names: list[str] = (), settings: dict | None = None, included: tuple[str, ...] = REGIONS) -> DataFrame:
    """postings with role_type, rule_score, fit_score, fit_category, match_reasons, warnings, is_priority_institution."""
    s = DEFAULTS | (settings or {})
    col = lambda c: F.coalesce(F.col(c), F.lit(""))
    fields = ("title", "institution", "department", "school", "location", "country", "region", "description_text", "source_name")
    joined = lambda x, *cs: F.array_join(F.filter(F.array(*(x[c] for c in cs)), lambda y: y != ""), " ")
    # Each field is normalized once; texts that are joined by spaces are their normal forms joined. A generator is a wall to Catalyst: none is worked out again.
    once = F.transform(F.array(F.struct(*(text.normalize(F.col(c)).alias(c) for c in fields))), lambda x: F.struct(joined(x, *fields).alias("t"), joined(x, "title", "description_text").alias("said"), x["region"].alias("region")))
    out = postings.select("*", F.explode(once).alias("_n")).withColumns({"_t": F.col("_n.t"), "role_type": role_of(F.col("_n.said"), F.col("_n.region"))}).drop("_n")
    out = out.withColumns({f"_{k}": keyword_hits(F.col("_t"), keywords.get(k, [])) for k in ("high_value", "medium_value", "negative")})
    weights = F.create_map(*(F.lit(x) for kv in s["role_weights"].items() for x in kv))
    w = F.coalesce(F.element_at(weights, F.col("role_type")), F.lit(float(s["role_weights"].get("other", DEFAULTS["role_weights"]["other"]))))
    tenure, part_time, late = F.col("_t").contains("tenure"), F.col("_t").contains("part time"), dates.expired(F.col("deadline"), as_of)
    known = priority(F.col("institution"), [plain_key(n) for n in priority_names])
    allowed = region_allowed(F.col("region"), included)
    hits = lambda k, per, most: F.when(F.size(f"_{k}") > 0, F.least(F.lit(float(s[most])), F.lit(float(s[per])) * F.size(f"_{k}"))).otherwise(0.0)
    total = w + hits("high_value", "high_value_per_hit", "max_high_value_bonus")
    total = total + hits("medium_value", "medium_value_per_hit", "max_medium_value_bonus")
    total = total + F.when(tenure, s["tenure_bonus"]).otherwise(0.0) + F.when(known, s["priority_institution_bonus"]).otherwise(0.0)
    total = total + F.when(allowed, s["included_region_bonus"]).otherwise(-s["excluded_region_penalty"])
    total = total - hits("negative", "negative_per_hit", "max_negative_penalty") - F.when(part_time, s["part_time_penalty"]).otherwise(0.0) - F.when(late, s["expired_penalty"]).otherwise(0.0)
    total = F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))
    first = lambda k: F.array_join(F.slice(f"_{k}", 1, 6), ", ")
    given = lambda *xs: F.filter(F.array(*xs), lambda x: x.isNotNull())
    reasons = given(
        F.when(w >= 0, F.concat(F.lit("Role type is "), F.col("role_type"), F.lit("."))), F.when(F.size("_high_value") > 0, F.concat(F.lit("High-value keywords: "), first("high_value"), F.lit("."))),
        F.when(F.size("_medium_value") > 0, F.concat(F.lit("Related keywords: "), first("medium_value"), F.lit("."))), F.when(tenure, F.lit("Tenure-track language detected.")),
        F.when(known, F.lit("Institution is on the priority watchlist.")), F.when(allowed, F.lit("Region is included by default.")),
    )
    warnings = given(
        F.when(w < 0, F.concat(F.lit("Role type has a negative configured weight: "), F.col("role_type"), F.lit("."))),
        F.when(~allowed, F.concat(F.lit("Region is excluded or not configured: "), F.when(col("region") == "", "unknown").otherwise(col("region")), F.lit("."))),
        F.when(F.size("_negative") > 0, F.concat(F.lit("Negative keywords: "), first("negative"), F.lit("."))), F.when(part_time, F.lit("Part-time role is lower priority.")), F.when(late, F.lit("Deadline appears to have passed.")),
    )
    out = out.withColumn("rule_score", total)
    points = F.rint(F.col("rule_score") * 100).cast("int")
    out = out.withColumn("fit_score", F.when(part_time, F.least(points, F.lit(int(s["lower_priority_score_cap"])))).otherwise(points))
    out = out.withColumns({"fit_category": category(F.col("fit_score")), "match_reasons": reasons, "warnings": warnings, "is_priority_institution": known})
    return out.drop("_t", "_high_value", "_medium_value", "_negative")


#: What ends a title that a page's labels run into, and what begins one before its field. Fixed values.
TITLE_ENDS = ("Personal type:", "Field of expertise:", "Organisation:", "Apply no later")
TITLE_START = r"(?iu)^(?:open rank:?\s*)?(?:tenure[- ]track\s+)?(?:assistant|associate|full|research)\s+professor(?:s)?(?:\s+(?:of|in))?\s*"


def title_focus(title: Column) -> Column:
    """The field that a title names: without its rank, and without labels that run into it."""
    ends = "|".join(re.escape(e) for e in TITLE_ENDS)
    focus = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(title, F.lit("")), f"(?s)(?:{ends}).*$", ""), TITLE_START, ""), F.lit(" -,:;"))
    return F.when(focus == "", "the advertised research area").otherwise(focus)


def with_prose(scored: DataFrame) -> DataFrame:
    """scored with a summary, where it has none, and an application angle."""
    some = lambda *cs: F.coalesce(*(F.when(F.col(c) != "", F.col(c)) for c in cs), F.lit(""))
    summary = F.concat(some("title"), F.lit(" at "), some("institution"), F.lit(", sourced from "), some("source_name"), F.lit("."))
    angle = F.concat(F.lit("Connect your strongest relevant research evidence to the advertised focus on "), title_focus(F.col("title")), F.lit(", and name one credible collaboration or teaching contribution in "), some("department", "school", "institution"), F.lit("."))
    own = F.when(F.col("summary") != "", F.col("summary")) if "summary" in scored.columns else F.lit(None).cast("string")
    return scored.withColumns({"summary": F.coalesce(own, summary), "application_angle": angle})
