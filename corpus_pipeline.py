"""The corpus pipeline: toxicity, near duplicates, repeated passages, benchmark leaks, packing.

Each stage is (spark, docs, sf_dir) -> DataFrame over what its predecessor kept; all but
the last return the columns of documents. ``run`` writes every stage's rows to the
shared folder and reads them again, so a lost executor repeats one stage at most.

All stages take any rows: columns beside those of documents are not read, whatever their names; nulls in
any column, null or repeated ids and repeated rows are rows like others; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrove.llm.decontaminate import clean
from kinetrove.llm.jaccard import near_components
from kinetrove.llm.packing import pack_documents
from kinetrove.llm.queries import tokenizer
from kinetrove.llm.substrings import remove_repeats
from kinetrove.llm.tables import stored, table, with_row_id
from kinetrove.llm.toxicity import drop_toxic


#: Stages return these columns of documents; others are dropped, so their names can't clash with a stage's own.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the threshold stay, with all columns.

    Null and empty texts have the score of a text without matches and stay. Repeated rows go or stay together. A score at the
    threshold goes.
    """
    return drop_toxic(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a Jaccard of 0.8 on five-word shingles, the least doc_id stays.

    Where ids are null or repeated, it is the least row number, so one row of a group stays whatever its ids. Of repeated rows one stays.
    Texts without words link with nothing and all stay; texts of fewer than five words link where their words are equal.
    """
    rows = with_row_id(docs, COLUMNS)
    found = near_components(rows, 5, 80)
    keep = found.where("rid = component_rid").select("rid")
    return rows.join(keep, "rid").select(*COLUMNS)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside windows of 35 that occur again go; documents stay, with n_chars of what is left.

    Of a repeated passage every occurrence is removed, as op9 defines it. A null text stays null, a text that loses
    nothing keeps its bytes and its n_chars, and one that loses all is empty. Repeated rows are copies of each other.
    """
    out = remove_repeats(docs, 35, COLUMNS)
    left = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, left).otherwise(F.col("n_chars"))).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, up to its budget of edits, go.

    Null and empty texts hold none and stay, as null and empty items are held by none. Repeated rows go or stay together.
    """
    return clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens.

    A null or empty text has the end id alone; each of repeated rows is packed; a null doc_id stays null.
    """
    return pack_documents(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("substrings", substrings), ("decontamination", decontamination), ("packing", packing)]

#: Tokenizers and learned scores are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
