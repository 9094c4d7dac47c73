"""From raw documents to packed sequences: quality, toxicity, near duplicates, mix, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as
Parquet and read again as the next one's ``docs``. All but the last return the columns of
``documents``, and any others that come with them; each works on all rows that the one
before kept. An empty table passes every stage as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vecspark.llm import jaccard, mixing, packing, quality, toxicity
from vecspark.llm.common import materialise, table

#: Tokens come from a library, so SQL cannot express the last stage; tests hold every stage against a brute-force version.
ORACLE_SQL = None

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
#: What near-duplicate stages take unless told otherwise: five words and 80 percent.
SHINGLE_WORDS = 5
SIMILAR_PERCENT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or whose host fails the host rules, go.

    Null and empty texts have no words and go; a null source is a host of its own; very long
    texts are measured whole; repeated rows and ids are judged row by row.
    """
    return quality.reject(docs)


def toxic_segments(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the model is fitted on the labelled ones among ``docs``.

    Null and empty texts have no evidence and stay; very long texts are scanned whole;
    repeated rows score alike; null ids and labels are not learnt from.
    """
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def similar_sets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest id.

    Texts without words and rows of null id all stay; of rows that repeat id and text one
    stays, another text of an id is judged on its own; very long texts are compared whole.
    """
    return jaccard.keep_one(docs, SHINGLE_WORDS, SIMILAR_PERCENT, 100)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as the mix takes it, three times at most.

    Null text has no words; null source is a source, last in order, and one without words is
    not taken; repeated rows and ids draw alike; a null id draws as the empty one.
    """
    return mixing.mix(docs)


def concat_and_cut(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences.

    Null and empty texts have the end id only; repeated and null ids are packed row by row;
    very long texts span many sequences; other columns are ignored.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path(TOKENIZER), END_ID)


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxic_segments),
    ("n-gram Jaccard join", similar_sets),
    ("mixing sources to target weights", mix_sources),
    ("packing", concat_and_cut),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the pieces of the last one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
