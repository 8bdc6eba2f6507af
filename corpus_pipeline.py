"""From raw documents to packed training sequences, in five stages.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept; its result is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents. No stage fails on an empty table;
then none returns a row.

Line dedup comes before the near-duplicate join, as laid down for this pipeline. It takes from near copies the lines that
they share with documents before them, so few whole near copies are left for the join to find: it settles texts that
differ inside their lines. ``op5_jaccard_join`` runs on raw documents and finds near copies there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import jaccard, lines, mixing, packing, quality
from tessera.llm.common import small_batches, stored, table, tokenizer_path
from tessera.llm.queries import MIX, TOKENIZER


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts are scored like others, and rows that repeat an id each by their own text.
    """
    small_batches(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated lines and runs of lines are cut; a document of which nothing is left goes.

    Null and empty texts, and rows with a null id, stay as they are. Rows equal in id and text are one document.
    """
    small_batches(spark)
    return lines.cut_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of documents linked by five-word shingles at a similarity of 0.8 or more one stays.

    Texts without words and rows with a null id link with nothing and stay. Rows that repeat an id stay or go together.
    """
    small_batches(spark)
    return jaccard.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated by their rates, so that languages have their target shares; none is lost.

    Null and empty texts have no tokens and stay at least once. Tokens are counted as words here; packing counts
    vocabulary ids, so shares of packed ids are near the targets but not equal to them.
    """
    small_batches(spark)
    known = mixing.language_labels(docs, table(spark, sf_dir, "labels"))
    return mixing.mixed(docs, known, MIX, high=float("inf"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences of 4096; a null text packs as an empty one."""
    small_batches(spark)
    return packing.pack_documents(docs, tokenizer_path(TOKENIZER))


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing to target weights", mix),
    ("best-fit packing", pack),
]

#: The stages train models, tokenise and iterate, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
