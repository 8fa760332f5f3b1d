"""The corpus pipeline: stages applied in order, each to all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents,
the last one the pieces of packed sequences with their token ids. Other columns
of docs go. Null texts stay null up to packing, where they count as empty;
documents with a null id, or one that others have too, stay and are compared as
the operators say. An empty table gives empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm import common, jaccard, langid, packing, pii, suffixarray

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Near duplicates: shingles of five words, Jaccard 0.8 or more.
WORDS = 5
THRESHOLD = (80, 100)


def with_length(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language; those without a letter (or null) go. Where no row has a label to learn from, all with letters stay."""
    docs = docs.select(*COLUMNS)
    model = langid.model_of(docs)
    if not model[0]:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return langid.annotate(docs, model).where(F.col("lang_pred") != langid.UND).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document of the smallest id."""
    return jaccard.one_of_each(docs.select(*COLUMNS), WORDS, THRESHOLD)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less the strings of 50 bytes that a document of a smaller id has."""
    return with_length(suffixarray.clean(docs.select(*COLUMNS)))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data masked."""
    return with_length(pii.redact(docs.select(*COLUMNS)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents packed into sequences: the pieces, each with its token ids."""
    return packing.pack_documents(docs, with_ids=True)


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("PII", mask_personal_data),
    ("packing", pack),
]

#: SQL can't express the language model, the tagger nor the tokenizer; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, since = common.table(spark, sf_dir, "documents"), common.mark()
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.written(docs, f"pipeline-{i}")
            common.sweep(spark, since, docs)
    return docs
