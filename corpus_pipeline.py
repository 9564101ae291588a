"""A training corpus from raw documents, in five stages.

Each stage reads what the one before it has written, and its decisions take effect: documents that
are found toxic go, of equal and of nearly equal documents one stays, passages that repeat are cut,
and what is left is packed. SQL can't express the trained classifier, so there is no SQL for it.

A null text counts as empty where stages compare or cut, and stays null; of equal texts, and so of all empty and null ones, the
smallest identifier stays; texts without words are near copies of nothing. A null identifier is larger than all others in exact dedup and
takes no part in near dedup, so its row stays. Rows that repeat identifier and text are exact copies. Of near copies the smallest identifier
stays. Columns other than ``doc_id`` and ``text`` pass through, whatever their names. An empty table gives no rows. A very long text is held whole by one task of each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import exact_dedup, near_dedup, packing, suffix_dedup, toxicity
from barloom.llm.common import sweep_before, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, doesn't find toxic. Those without an identifier are scored like others."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    sweep_before(docs)
    return exact_dedup.survivors(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    sweep_before(docs)
    return near_dedup.survivors(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    sweep_before(docs)
    return suffix_dedup.trimmed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    sweep_before(docs)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("packing", pack),
]
#: The first stage's classifier is trained in numpy, which SQL can't express; tests hold run() against the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for the documents of ``sf_dir``. Each stage removes the tables of earlier ones that it doesn't read."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
