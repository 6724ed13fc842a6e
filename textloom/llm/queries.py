"""The queries of the training-data operators: thin uses of the operators on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Vocabulary used by the byte-level BPE query; every executor has the package that holds it.
BPE_FILE = "byte_bpe_50k.tiktoken"
#: Vocabularies whose tokens are aligned.
BYTE_FILE, PIECE_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Shards that the corpus is dealt to.
SHARDS = 64


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    out = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return out.select(*columns) if columns else out


def op1_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm import context_mixing

    return context_mixing.scores(table(spark, sf_dir, "documents"))


def op2_permutation_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm import sharding

    return sharding.place(table(spark, sf_dir, "documents", "doc_id"), "doc_id", sharding.names(SHARDS))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm import toxicity

    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from textloom.llm import byte_bpe

    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm import decontaminate as d

    hits = d.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", "n_words", "n_hit", "n_items", d.digest(F.col("items")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op6_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm import quality_cnn

    return quality_cnn.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm import quality_rules

    out = quality_rules.verdicts(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm import html_extract

    return html_extract.extract(table(spark, sf_dir, "pages"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm import jaccard_join

    return jaccard_join.classes(table(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm import chat_format as c

    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    records = c.from_rows(rows.unionByName(extra))
    return c.digests(c.format_turns(c.canonical(records, "record")))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from textloom.llm import token_alignment

    return token_alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_FILE), public_tokenizers.path(PIECE_FILE))


def op12_simhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm import simhash_join

    return simhash_join.classes(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm import conversation_repair as c

    return c.repair(c.damage(table(spark, sf_dir, "conversations")), copies=F.col("copies"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_context_mixing, op2_permutation_shards, op3_toxicity, op4_byte_bpe, op5_decontaminate, op6_quality_cnn, op7_quality_rules, op8_html_extract, op9_jaccard_join, op10_chat_format, op11_token_alignment, op12_simhash_join, op13_conversation_repair)
}

def _oracle_sql() -> dict[str, str]:
    from textloom.llm import chat_format, conversation_repair, decontaminate, jaccard_join, sharding

    return {
        "op2_permutation_shards": sharding.oracle_sql(sharding.names(SHARDS)),
        "op5_decontaminate": decontaminate.oracle_sql(),
        "op9_jaccard_join": jaccard_join.oracle_sql(),
        "op10_chat_format": chat_format.oracle_sql(),
        "op13_conversation_repair": conversation_repair.oracle_sql(),
    }


ORACLE_SQL: dict[str, str] = _oracle_sql()
