"""Units and institutions named in prose, as column expressions; and the filling of postings that lack them.

Patterns run in the JVM with Unicode classes, and with line feeds as the only line ends. Nulls are empty text; without a match the result is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text

#: Patterns. Fixed values; the first two and the third ignore case, the last ones do not.
LABELLED_UNIT = r"\b(Organisation|Organization|Department|School)\s*:\s*(.+?)(?=\s+(?:Apply|Posted|Personal type|Field of expertise|Full[- ]time|Salary)\b|[.;\n]|$)"
UNIT = r"\b((?:Department|School|College|Faculty) of .+?)(?=\s+(?:at|within|invites|seeks|is seeking|Apply|Posted|Read more)\b|[.;\n]|$)"
LABELLED_INSTITUTION = r"\b(?:Institution|Employer|Hiring organization)\s*:\s*(.+?)(?=\s+(?:Location|Department|School|Category|Posted|Type|Salary)\s*:|[.;\n]|$)"
INSTITUTIONS = (
    r"\bat\s+((?:the\s+)?University of (?:[A-Z][\w&'’.-]*\s*){1,6})",
    r"\bat\s+((?:the\s+)?(?:[A-Z][\w&'’.-]*\s+){1,7}University)",
    r"\bat\s+((?:the\s+)?(?:[A-Z][\w&'’.-]*\s+){1,7}Institute of Technology)",
    r"-\s*((?:the\s+)?University of (?:[A-Z][\w&'’.-]*\s*){1,6})$",
    r"-\s*((?:the\s+)?(?:[A-Z][\w&'’.-]*\s+){1,7}University)$",
)


def _first(c: Column, pattern: str, group: int = 1, flags: str = "iuUd") -> Column:
    return F.regexp_extract(F.coalesce(c, F.lit("")), f"(?{flags}){pattern}", group)


def tidy(c: Column) -> Column:
    """White space as single spaces, and no spaces, dashes, commas, semicolons or colons at the ends."""
    return F.trim(text.clean_text(c), F.lit(" -,:;"))


def unit(c: Column) -> Column:
    """The department, school or other unit: a labelled one, with its kind put before it where it lacks that, else one named in a sentence."""
    kind, value = F.lower(_first(c, LABELLED_UNIT, 1)), tidy(_first(c, LABELLED_UNIT, 2))
    bare = lambda k: (kind == k) & ~F.lower(value).startswith(k)
    labelled = F.when(bare("department"), F.concat(F.lit("Department of "), value)).when(bare("school"), F.concat(F.lit("School of "), value)).otherwise(value)
    return F.when(kind != "", labelled).otherwise(tidy(_first(c, UNIT)))


def institution(c: Column) -> Column:
    """The institution: a labelled one, else by the first pattern that finds one."""
    some = lambda x: F.when(x != "", x)
    found = [some(_first(c, LABELLED_INSTITUTION)), *(some(_first(c, p, flags="Ud")) for p in INSTITUTIONS)]
    return tidy(F.coalesce(*found, F.lit("")))


def enrich(postings: DataFrame) -> DataFrame:
    """postings with department or school, where both are empty, and institution, where it says none, filled from title and description."""
    prose = F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("description_text", F.lit("")))
    empty = (F.coalesce("department", F.lit("")) == "") & (F.coalesce("school", F.lit("")) == "")
    out = postings.withColumns({"_unit": F.when(empty, unit(prose)).otherwise(""), "_found": F.when(text.missing_institution(F.col("institution")), institution(prose)).otherwise("")})
    of_department = F.lower("_unit").startswith("department")
    filled = {
        "department": F.when(of_department, F.col("_unit")).otherwise(F.col("department")),
        "school": F.when((F.col("_unit") != "") & ~of_department, F.col("_unit")).otherwise(F.col("school")),
        "institution": F.when(F.col("_found") != "", F.col("_found")).otherwise(F.col("institution")),
    }
    return out.withColumns(filled).drop("_unit", "_found")
