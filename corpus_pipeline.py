"""From raw documents to packed training sequences, in stages that each stand on their own.

Every stage takes (spark, docs, sf_dir), works on all rows of docs and, but for the last, returns
the columns of docs. docs needs doc_id and text; further columns pass through, whatever their names.
In every stage a null text counts as an empty one, a null doc_id is allowed, repeated rows are judged
alike, texts are whole whatever their length, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelwork.llm import decontamination, packing, pii, quality_rules, simhash
from reelwork.llm.common import stage, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the isolation forest reject go; so do null and empty texts,
    which have no words. Without labels only the base rules reject. No ties: a verdict is a row's own."""
    forest = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.passing(docs, forest)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of SimHash near copies stays: that of the smallest doc_id, rows without
    one last; of rows that tie, the first in the table. Null and empty texts are one group."""
    return simhash.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a benchmark item, up to a fifth of its words substituted, go. Null and
    empty texts hold none; without a benchmark all rows stay. No ties: any item is enough."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities in the texts get surrogates; n_chars, where there is one, follows the new text. Null
    and empty texts stay; equal entities get equal surrogates in all rows, repeated ones included.
    A production run passes a secret key of its own to pii.pseudonymised."""
    out = pii.pseudonymised(docs, pii.DEMO_KEY).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their token ids, sequence and place in it. An empty or null text is a
    piece of the end id alone; repeated rows are packed as often as they occur; bins that tie in free
    space are alike, and the last one opened takes the piece."""
    return packing.packed(docs)


STAGES = [
    ("quality_rules", keep_quality),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("surrogates", replace_personal_data),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other. Each result but the last is written to the shared folder, as
    the next stage reads it more than once."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Isolation forests, hashes and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
