"""From raw documents to token ids, in five stages over the `documents` table.

Each stage takes (spark, docs, sf_dir), returns a DataFrame, and works on every row that the stage before
it kept: language identification drops rows without a determined language, quality rules drop rows under
weak supervision, SimHash keeps one row of each class of near-duplicates, mixing repeats or drops rows to
the sources' target weights, and BPE encodes what is left. All but the last return the columns of documents.

Language identification drops texts without a letter and texts that no learned language explains (over 7 bits a
byte of the shortest code length; prose takes 2 to 3.5).

Defined results: null, empty and blank texts go in the first stage; a very long text is a row like any other; of
rows that repeat an id each is judged by its own text, and null ids take part in every stage; of equal rows, and of
other members of one near-duplicate class, one stays (smallest id, then smallest row hash); repetitions that the mix
makes are encoded each; an empty table gives an empty result; extra columns travel to the last stage and end there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vellum.llm import bpe, language_id, mixing, quality_rules, simhash
from vellum.llm.queries import tokenizer_path
from vellum.session import drop_path, read_table, shared_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep(docs, language_id.train(docs))


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mix(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, bpe.build_lexicon(docs, tokenizer_path()))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("quality_rules", judge_quality),
    ("simhash_dedup", drop_near_duplicates),
    ("source_mix", mix_sources),
    ("bpe_encode", encode_tokens),
]

#: Learned models, 64-bit hashes and the tokenizer have no equal in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again by the next; what no stage needs any more goes."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = shared_path(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                drop_path(spark, before)
            before = path
    return docs
