"""The registered queries of the thirteen operators: whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import annuli, bm25, bpe, chat, collocations, language_id, licenses, mil_quality, mixing, pieces, quality_rules, simhash, warc
from vellum.session import read_table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def piece_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    return bpe.digests(documents, bpe.build_lexicon(documents, tokenizer_path()))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(read_table(spark, sf_dir, "documents"))


def op3_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    model = mil_quality.train(documents, read_table(spark, sf_dir, "labels"))
    found = mil_quality.classify(documents, model)
    return found.select("doc_id", (language_id.remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(licenses.scan(read_table(spark, sf_dir, "documents")))


def op5_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    return bm25.search(bm25.build_index(documents), bm25.query_terms(documents.where(F.col("doc_id") % 100 == 0)))


def op6_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.summary(warc.archive(spark, read_table(spark, sf_dir, "pages"), payloads=False))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "\\### Assistant: </turn> ok"
    added = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], turns.schema)
    log = chat.events_of_turns(turns.unionByName(added))
    return chat.digests(chat.render(chat.messages(log)))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read_table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    found = language_id.classify(documents, language_id.train(documents))
    return found.select("doc_id", (language_id.remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(read_table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annuli.summary(read_table(spark, sf_dir, "embeddings"))


def op12_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(read_table(spark, sf_dir, "documents"), pieces.prepare(spark, piece_model_path()))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_bpe_codec": op1_bpe_codec,
    "op2_simhash_dedup": op2_simhash_dedup,
    "op3_mil_quality": op3_mil_quality,
    "op4_license_scan": op4_license_scan,
    "op5_bm25_topk": op5_bm25_topk,
    "op6_warc_roundtrip": op6_warc_roundtrip,
    "op7_chat_format": op7_chat_format,
    "op8_quality_rules": op8_quality_rules,
    "op9_language_id": op9_language_id,
    "op10_source_mix": op10_source_mix,
    "op11_vector_codes": op11_vector_codes,
    "op12_sentencepiece_codec": op12_sentencepiece_codec,
    "op13_collocations": op13_collocations,
}
ORACLE_SQL: dict[str, str] = {
    "op2_simhash_dedup": simhash.oracle_sql(),
    "op4_license_scan": licenses.oracle_sql(),
    "op5_bm25_topk": bm25.ORACLE_SQL,
    "op6_warc_roundtrip": warc.ORACLE_SQL,
    "op7_chat_format": chat.ORACLE_SQL,
    "op8_quality_rules": quality_rules.oracle_sql(),
    "op10_source_mix": mixing.ORACLE_SQL,
    "op11_vector_codes": annuli.oracle_sql(),
    "op13_collocations": collocations.ORACLE_SQL,
}
