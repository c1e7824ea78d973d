"""From documents to packed sequences: language ID, toxicity, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs. All but the last keep every
column of documents as it is, whatever other columns there are. Each is fitted to
its own input.

Null and empty texts, and texts without a letter, have no language and go in the
first stage. Rows whose id is null stay in all stages. Repeated rows share one
fate. Very long texts count whole everywhere. Ties: of a group of near duplicates
the smallest doc_id stays. Without a labelled row the models can't be fitted, and
their stages keep all rows. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinframe.llm import language_id, ngram_join, packing, toxicity
from skeinframe.llm.common import durable, read_table


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language the byte network tells; it learns from those with a lang. Without any: all."""
    return language_id.keep_identified(docs, language_id.train(docs))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the weakly supervised classifier does not call toxic; it learns from the labels of the documents that are left. Without labels of both kinds: all."""
    return toxicity.keep_clean(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group linked by five-word sequences at a similarity of 0.8."""
    return ngram_join.one_of_each_group(docs, 5, 80)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left, with their sequences and places."""
    return packing.pack_documents(docs, derive={"ids_crc32": F.crc32("ids")})


STAGES = [("language_id", identified), ("toxicity", not_toxic), ("ngram_jaccard_join", without_near_duplicates), ("best_fit_packing", packed)]

#: SQL can express none of the models; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents: doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
