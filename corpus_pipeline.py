"""A training-data pipeline over `documents`: STAGES in order, each written as Parquet and read again.

Every stage works on all rows its predecessor kept and returns the columns of documents (extra
columns are dropped), but the last, which returns packed pieces. Nulls, empty texts, repeated rows
and empty tables are as the operators define them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quaylight.llm.common import DOC_COLUMNS, store, table
from quaylight.llm.decontaminate import clean
from quaylight.llm.jaccard import first_of_each
from quaylight.llm.language import fit, keep_known, training_rows
from quaylight.llm.packing import pack, pieces
from quaylight.llm.secrets import redact


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those far from every centroid, or without letters, go."""
    docs = docs.select(*DOC_COLUMNS)
    return keep_known(docs, fit(training_rows(docs)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard similarity of 0.8 or more)."""
    return first_of_each(docs.select(*DOC_COLUMNS), 5, 80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return clean(docs.select(*DOC_COLUMNS), table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret replaced by a mask."""
    return redact(docs.select(*DOC_COLUMNS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with their place in a window."""
    return pack(store(pieces(docs), "pieces"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("secrets", secrets),
    ("packing", packing),
]

#: The stages are not expressible in SQL (k-means, tokenizer, packing); tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
