"""A tokenizer file's vocabulary as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_FILE = "model struct<vocab:string>, added_tokens array<struct<id:int,content:string,special:boolean>>, decoder string, pre_tokenizer string"


def byte_of_character() -> dict[str, int]:
    """The usual byte-level alphabet: printable Latin-1 characters stand for their byte, U+0100 and up for the other bytes in order."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


def _bytes(token: Column, byte_level: Column) -> Column:
    table = F.create_map(*[F.lit(x) for c, b in byte_of_character().items() for x in (c, f"{b:02X}")])
    decoded = F.unhex(F.array_join(F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.element_at(table, c)), ""))
    fallback = F.unhex(F.regexp_extract(token, r"^<0x([0-9A-Fa-f]{2})>$", 1))
    plain = F.encode(F.replace(token, F.lit("▁"), F.lit(" ")), "UTF-8")
    return F.when(byte_level, decoded).when(F.length(fallback) == 1, fallback).otherwise(plain)


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(term, token, bytes, surface, added, special): the entries of a tokenizer's JSON file by id.

    Vocabularies by token and by place are read, and added tokens, which win where an id is in both.  ``token`` is the entry as it is
    written, ``bytes`` what it stands for (a byte-level entry decoded, <0xHH> a byte, U+2581 a space), and ``surface`` those as text, invalid
    UTF-8 replaced.  The file is one row; it has a tokenizer's entries and no more.
    """
    text = spark.read.text(path, wholetext=True)
    file = text.select(F.from_json("value", _FILE).alias("f")).select("f.*")
    byte_level = F.coalesce(F.col("decoder").contains('"ByteLevel"') | F.col("pre_tokenizer").contains('"ByteLevel"'), F.lit(False))
    whole = file.select(F.col("model.vocab").alias("vocab"), "added_tokens", byte_level.alias("byte_level"))
    by_token = whole.where(F.ltrim("vocab").startswith("{")).select("byte_level", F.explode(F.from_json("vocab", "map<string,int>")).alias("token", "term"))
    by_place = whole.where(F.ltrim("vocab").startswith("[")).select("byte_level", F.posexplode(F.from_json("vocab", "array<array<string>>")).alias("term", "x")).select("byte_level", F.get("x", F.lit(0)).alias("token"), "term")
    own = by_token.union(by_place).select("term", "token", _bytes(F.col("token"), F.col("byte_level")).alias("bytes"), F.lit(False).alias("added"), F.lit(False).alias("special"))
    more = whole.select(F.explode("added_tokens").alias("a")).select("a.id", "a.content", F.encode("a.content", "UTF-8"), F.lit(True), F.coalesce("a.special", F.lit(False)))
    both = own.union(more).groupBy("term").agg(F.max_by(F.struct("token", "bytes", "added", "special"), "added").alias("e"))
    return both.select("term", "e.token", "e.bytes", F.make_valid_utf8(F.col("e.bytes").cast("string")).alias("surface"), "e.added", "e.special")


def named(terms: DataFrame, entries: DataFrame, term: str = "term") -> DataFrame:
    """``terms`` with ``token`` and ``surface``; null for an id that the vocabulary lacks.  A vocabulary's ids and texts are small, and Spark measures whether they are broadcast."""
    return terms.join(entries.select(F.col("term").alias(term), "token", "surface"), term, "left")
