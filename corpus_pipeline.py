"""From raw documents to token ids: five of the corpus operators in turn, each on what its predecessor kept.

In every stage a null text counts as the empty one, repeated rows are rows of their own (but for near-dedup, which keeps one
of them), an empty table gives an empty one, and columns beyond doc_id, text, lang and source, whatever their names, pass
as they are up to the last stage. Stages take the documents' text from the column that this session's case rule finds.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from addrspark.llm.bpe import bpe_encode, read_ranks
from addrspark.llm.common import discard, staged, table
from addrspark.llm.decontaminate import decontaminate
from addrspark.llm.quality_rules import drop_failing
from addrspark.llm.simhash import drop_near_duplicates
from addrspark.llm.toxicity import tag_toxicity


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule of the current policy. Null and empty texts fail: they have too few words."""
    return drop_failing(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold; the chain is fitted to the labelled ones among docs.

    With no labels of one kind among them every document stays, and so do null texts, which give no evidence.
    """
    return tag_toxicity(docs, table(spark, sf_dir, "labels"), docs.columns, drop=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that with the smallest doc_id, and of those that share it the one of the least text hash.

    Null, empty and wordless texts are one group. Rows with a null doc_id stay.
    """
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs; null texts, and all texts beside an empty benchmark, stay."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), docs.columns, mode="documents")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every whole text, with their number and digests; none for a null text."""
    return bpe_encode(docs, read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN, ["doc_id", "lang", "source"], ids=True)


STAGES = [("quality_rules", quality_rules), ("toxicity", toxicity), ("simhash_near_dedup", near_dedup), ("benchmark_decontamination", decontamination), ("byte_bpe", tokens)]

#: SQL cannot express the toxicity and tokenizer stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage; of the others nothing is left once the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(*before)
        before = [docs]
    return docs
