"""The corpus pipeline: language ID, n-gram Jaccard join, secret scans, mixing to target weights, best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept: documents without a language go; one document of each
near-duplicate group stays (five-word shingles, similarity 0.8); secrets are replaced by a mark; sources are mixed to their target weights, in rows of
taken text; the last packs the token ids of what is left into sequences of 2048.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import common, jaccard, langid, mixing, packing, secrets


#: Scratch tables of the stages whose rows may still be read; deleted once the next stage has them written.
_MADE: list[str] = []


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; null texts and texts without a letter go. Repeated rows and null doc_ids stay as they are."""
    return langid.accept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of the smallest doc_id; rows without doc_id and texts without words stay."""
    with common.recorded() as made:
        out = jaccard.keep_one(docs, k=5, num=80, den=100)
    _MADE.extend(made)
    return out


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, each reported secret replaced by a mark; null texts stay null."""
    common.release(spark, _MADE)
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of the text that the mix takes, repeats as rows of their own; a null source is a source, a null or empty text gives nothing to take."""
    with common.recorded() as made:
        out = mixing.mixed(docs)
    _MADE.extend(made)
    return out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the token ids of every row, placed in sequences; a null text is empty and gives its end id alone."""
    common.release(spark, _MADE)
    return packing.pack(docs)


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: No SQL: stages learn a model, join sets, and cut token ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents; stages are written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.materialise(docs, f"stage-{i}", keep=True)
    return docs
