"""A training-data pipeline over ``documents``: each stage is written and reread as the next one's input.

1. toxicity: documents that the learned clause grammar rejects go;
2. line dedup: boilerplate lines of a source are cut out of its documents;
3. near-dedup: one document of each group stays; documents whose five-word
   shingles have a Jaccard of 0.8 or more are linked;
4. mixing: documents are kept or repeated so that sources meet their weights;
5. BPE: token ids of every text that is left.

All but the last return the columns of ``documents``.  SQL cannot express the
first, third and last stage, so the pipeline is tested against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, line_dedup, mixing, similar, toxicity
from corpusloom.llm.queries import tokenizer_path
from corpusloom.llm.scratch import Scratch

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labels of ``sf_dir`` and the documents at hand, and drops what scores 0.7 or more."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.train(docs.select("doc_id", "text"), labels)
    return toxicity.keep_clean(docs, model)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts each source's boilerplate lines; ``n_chars`` follows the text.  No document goes.

    Exact copies of a text count as one page, else their own lines would be boilerplate and every copy would lose its text.
    """
    cut = line_dedup.drop_boilerplate(docs, counts=False, distinct_texts=True)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cut


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id in each group of near copies."""
    return similar.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources meet their target weights."""
    return mixing.mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the token ids of every text."""
    return bpe.encode(docs, tokenizer_path()).drop("text")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_boilerplate_lines),
    ("simhash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs, f"stage{k}")
    return docs
