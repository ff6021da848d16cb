"""A training corpus from the documents table, stage by stage.

STAGES names each stage and its function (spark, docs, sf_dir) -> DataFrame. Each works on
what its predecessor wrote. All but the last return the columns of documents, whatever further
columns there are and whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trackweave.llm.common import written
from trackweave.llm.decontaminate import remove_overlaps
from trackweave.llm.line_dedup import drop_near_lines
from trackweave.llm.packing import pack
from trackweave.llm.quality import keep_good
from trackweave.llm.queries import read, tokenizer_file
from trackweave.llm.simhash import drop_near_duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranking predicts to be poor go.

    Null and empty texts are scored like any text; rows without an id stay; rows of one id go or stay together.
    """
    return keep_good(docs, read(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines near an earlier one go, and documents that lose all of theirs.

    Null and empty texts and rows without an id stay as they are; rows with the same id and text are one
    document; of equally near lines the first by id stays.
    """
    return drop_near_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest id: fingerprints of five-word shingles within 4 bits, or shingles with a Jaccard similarity of 0.8 at least.

    Null and wordless texts are one group; rows without an id stay; of rows with one id and text one stays.
    """
    return drop_near_duplicates(docs, size=5, alike=True)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that benchmark items hold are cut out; a document that is nothing else goes.

    Null and empty texts, repeated rows and rows without an id stay as they are.
    """
    return remove_overlaps(docs, read(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full token sequences, along the Hilbert curve. Null and empty texts are an end mark alone; repeated rows are packed each."""
    return pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [("quality", quality), ("line_dedup", lines), ("simhash_near_dedup", near_duplicates), ("decontamination", decontamination), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each result written and read again."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Learned scores and fingerprints can't be written in SQL.
ORACLE_SQL = None
