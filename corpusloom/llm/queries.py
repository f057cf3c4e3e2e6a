"""Registered queries of the training-data operators: one thin function each, with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import align, ann, bpe, chat, fim, imatch, langid, line_dedup, mixing, quality, simhash, toxicity, urlgraph


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """A public vocabulary of the contracts."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(_table(spark, sf_dir, "documents"), tokenizer_path())


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


#: A conversation that says the template's own control strings.
HOSTILE = r"\### Assistant: </turn> ok"


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_boilerplate(docs)


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", HOSTILE), (-7, 1, "assistant", HOSTILE)], rows.schema)
    return chat.conversation_digests(rows.unionByName(extra))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op6_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.edit_report(_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels").select("doc_id", "toxic")))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlgraph.judge(_table(spark, sf_dir, "pages"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.predict(docs, langid.train(docs))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.cut_report(_table(spark, sf_dir, "documents"))


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignment_report(_table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_line_dedup": op2_line_dedup,
    "op3_chat": op3_chat,
    "op4_simhash": op4_simhash,
    "op5_mixing": op5_mixing,
    "op6_imatch": op6_imatch,
    "op7_toxicity": op7_toxicity,
    "op8_url_filter": op8_url_filter,
    "op9_language": op9_language,
    "op10_ann": op10_ann,
    "op11_fim": op11_fim,
    "op12_align": op12_align,
    "op13_quality": op13_quality,
}

ORACLES: dict[str, str] = {
    "op2_line_dedup": line_dedup.oracle(),
    "op5_mixing": mixing.oracle(),
    "op11_fim": fim.oracle(),
}
