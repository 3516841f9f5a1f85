"""Corpus pipeline: raw documents to packed training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm import forest, mixture, pack, templates, toxicity
from skyledger.llm.common import read, tokenizer_file
from skyledger.session import cut_lineage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5. Null and empty texts get the base rate, so they stay where toxic texts are the minority."""
    score = toxicity.scorer(*toxicity.train(docs, read(spark, sf_dir, "labels")))
    return docs.filter(score(F.col("text")) < 0.5)


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of recurring templates. A document may be left without text."""
    return templates.cleaned(docs).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates; documents without words stay."""
    return forest.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix at weights 3, 1, 2 and 150 % of all words: a row per document and pass with the words taken."""
    return mixture.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences. A document that the mix repeats is packed once per repeat (``row`` tells them apart)."""
    return pack.pack(docs, tokenizer_file("byte_bpe_50k.json"))[0]


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_recurring_lines),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut_lineage(docs)
    return docs


#: Fitted scores, signatures and hashed draws have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None
