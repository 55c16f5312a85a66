"""From raw documents to packed training sequences: language ID, line dedup, near duplicates, decontamination, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all documents that its predecessor kept. All but the last return the
columns of ``documents``, whatever further columns there are and whatever their names.

In every stage an empty table gives an empty one. Nulls in columns other than text and doc_id change nothing and are carried;
each stage says what it does with a null text, a null doc_id and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crawlframe.llm import decontamination, jaccard_join, language_id, line_templates, packing
from crawlframe.llm.common import save

#: A document whose language gets less than this is rejected. Clean texts of a few words go down to 0.39, so this is below.
LEAST_LANGUAGE_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters (a null or empty text has none), and those of which the network makes no language, go.

    Repeated rows and rows with a null doc_id are each judged by their text. Without a labelled document all go. Languages
    with equal scores: the first by name, which decides nothing here.
    """
    return language_id.keep_identified(docs, LEAST_LANGUAGE_SCORE)


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines whose template recurs go, and with them documents that are nothing else.

    A null text stays; equal texts are treated alike and count as one, so repeated rows stay as often as they came; ids play
    no part. Tokens that are equally frequent are treated alike. Copies of one text, edited ones too, do not make its lines
    recur, so one of its group can stay.
    """
    return line_templates.drop_recurring(docs)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by similarity the one with the least doc_id stays.

    Rows with one doc_id stay or go together, so repeated rows stay; rows with a null doc_id and rows without words stay.
    """
    return jaccard_join.one_of_each(docs)


def drop_contaminated_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    A null text holds none; repeated rows go or stay together; ids play no part. An empty benchmark drops nothing.
    """
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences.

    A null text is its end token; every row is packed, repeated ones too; a null doc_id is carried. Open sequences with equal
    space: the one that came to it last.
    """
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_recurring_lines),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("benchmark_decontamination", drop_contaminated_documents),
    ("best_fit_packing", pack_sequences),
]

#: No SQL can express the network, the template tree and the packing; tests compare with a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
