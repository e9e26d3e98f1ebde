"""Built-in postings, for runs without live sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text

ROWS = [
    ("Tenure-Track Assistant Professor of Applied Mathematics", "Northfield University", "Department of Mathematics", "Northfield", "United States", "us", "math", "Tenure-track post in optimization, machine learning, simulation and teaching."),
    ("Lecturer in Statistics", "Eastmoor University", "Department of Statistics", "Eastmoor", "United Kingdom", "uk", "stats", "Lecturer in statistical learning and reproducible research, with teaching."),
    ("Postdoctoral Researcher in Laboratory Chemistry", "Westlake Institute", "Department of Chemistry", "Westlake", "Canada", "canada", "chem", "Laboratory work in experimental chemistry."),
]


def postings(spark: SparkSession) -> DataFrame:
    rows = [(i, title, at, unit, "", place, country, region, "Demo rows", f"https://example.org/{key}", f"https://example.org/{key}/apply", said, None, None) for i, (title, at, unit, place, country, region, key, said) in enumerate(ROWS)]
    names = "ord long, title string, institution string, department string, school string, location string, country string, region string, source_name string, source_url string, application_url string, description_text string, deadline string, date_posted string"
    return spark.createDataFrame(rows, names).withColumn("canonical_id", text.canonical_id(F.col("title"), F.col("institution"), F.col("application_url")))
