"""A training-data pipeline: each stage works on all that the one before it kept.

quality rules -> SimHash near-dedup -> benchmark decontamination -> mixing to target weights -> token files

Each stage but the last takes and gives the columns of documents; others are left out. Nulls, ties, repeated rows and
empty tables are cases of the operators; what they mean for a stage stands in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import decontamination, mixing, near_copies, quality_rules, token_files
from tidewatch.llm.common import dropped, saved, scratch
from tidewatch.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows that quality rules reject, null texts among them, and without frequent lines in the texts of the rest.

    Each row is judged by its own text and source, whatever doc_id it shares; n_chars follows the text.
    """
    docs = _documents(docs)
    left = quality_rules.cleaned(docs)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, similarity 0.8 or more), that with the smallest doc_id.

    Rows of different texts that share a doc_id are judged apart; rows without a doc_id stay only if their group has no
    other; repeated rows are one.
    """
    return near_copies.kept_rows(_documents(docs))


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows whose text shares an overlap with a benchmark item, whatever doc_id they share; null texts stay."""
    return decontamination.decontaminated(_documents(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its fitted rate says, none to a few times; copies are rows of their own.

    Equal rows get equal rates; null texts have the prior's.
    """
    docs = _documents(docs)
    rated = mixing.mixed(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=("text", "lang", "source", "n_chars"))
    return _documents(rated.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))))


def token_index(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all that is left, read back: doc_id, start, n_tokens and ids_crc32, a row for every row."""
    return token_files.token_index(docs, tokenizer_path())


STAGES = [
    ("quality rules", good_documents),
    ("simhash near-dedup", one_of_each_group),
    ("benchmark decontamination", without_benchmarks),
    ("mixing to target weights", mixed),
    ("token files", token_index),
]

#: SQL can express neither fingerprints nor fitted rates nor token ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the scratch folder and read again; what a stage has used goes after it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch() as tables:
            before, docs = docs, saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        dropped(*[t for t in tables if t is not docs], *([before] if hasattr(before, "_scratch_path") else []))
    return STAGES[-1][1](spark, docs, sf_dir)
