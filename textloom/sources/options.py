"""The settings that shape a job, read once into a typed object."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from textloom.functions import config
from textloom.operators.batching import Budget


@dataclass(frozen=True)
class Options:
    """What a user of the service sets in the environment, as far as it concerns the data; defaults are those of the service."""

    models: tuple[Row, ...] = ()
    rerankers: tuple[Row, ...] = ()
    sparse_models: tuple[Row, ...] = ()
    default_model: str | None = None
    batching: bool = False
    batch_items: int = 32
    rerank_batch_items: int = 128
    batch_tokens: int = 16_384
    longest: int = 256
    length_ratio: float = 0.0
    sub_batch_ratio: float = 2.0
    wait_seconds: float = 0.01
    queue: int = 256
    truncate: bool = True
    cache_entries: int = 10_000
    token_cache_entries: int = 0
    most_inputs: int = 32
    most_documents: int = 32
    #: settings that were given and aren't read
    unread: tuple[str, ...] = field(default=())

    def budget(self, padded: bool = True, rerank: bool = False) -> Budget:
        return Budget(self.batch_tokens, self.rerank_batch_items if rerank else self.batch_items, self.longest, padded, self.length_ratio)


# Names of the settings.
NAMES = (
    "EMBED_MODELS RERANKER_MODELS SPLADE_MODELS EMBED_DEFAULT_MODEL BATCHING_ENABLED BATCH_MAX RERANKER_BATCH_MAX BATCH_MAX_TOKENS BATCH_MAX_SEQ BATCH_LENGTH_RATIO_THRESHOLD "
    "EMBED_SUBBATCH_RATIO BATCH_WAIT_MS MAX_QUEUE_SIZE AUTO_TRUNCATE CACHE_MAX_ENTRIES TOKEN_CACHE_MAX_ENTRIES EMBED_MAX_INPUT_ARRAY RERANK_MAX_INPUT_DOCS"
).split()


def columns(of: Mapping[str, Column]) -> dict[str, Column]:
    """The options as columns of settings' texts (null: unset), so that many jobs' settings may be read as a table."""
    specs = lambda name, spec: F.transform(config.listed(of[name]), spec)
    items = config.zero_or_more(of["BATCH_MAX"], 32)
    models = specs("EMBED_MODELS", config.embed_spec)
    return {
        "models": models,
        "rerankers": specs("RERANKER_MODELS", config.reranker_spec),
        "sparse_models": specs("SPLADE_MODELS", config.sparse_spec),
        "default_model": F.coalesce(of["EMBED_DEFAULT_MODEL"], F.get(models, F.lit(0))["name"]),
        "batching": config.strict_bool(of["BATCHING_ENABLED"]),
        "batch_items": items,
        "rerank_batch_items": F.coalesce(config.whole(of["RERANKER_BATCH_MAX"]), items * 4),
        "batch_tokens": config.positive_or(of["BATCH_MAX_TOKENS"], 16_384),
        "longest": config.positive_or(of["BATCH_MAX_SEQ"], 256),
        "length_ratio": config.ratio_threshold(of["BATCH_LENGTH_RATIO_THRESHOLD"], strict=True),
        "sub_batch_ratio": config.ratio_or(of["EMBED_SUBBATCH_RATIO"]),
        "wait_seconds": config.zero_or_more(of["BATCH_WAIT_MS"], 10) / 1000,
        "queue": config.zero_or_more(of["MAX_QUEUE_SIZE"], 256),
        "truncate": F.coalesce(F.lower(of["AUTO_TRUNCATE"]) != "false", F.lit(True)),
        "cache_entries": config.zero_or_more(of["CACHE_MAX_ENTRIES"], 10_000),
        "token_cache_entries": config.zero_or_more(of["TOKEN_CACHE_MAX_ENTRIES"], 0),
        "most_inputs": config.positive_or(of["EMBED_MAX_INPUT_ARRAY"], 32),
        "most_documents": config.positive_or(of["RERANK_MAX_INPUT_DOCS"], 32),
    }


def options_table(settings: DataFrame, key: str, name: str = "name", value: str = "value") -> DataFrame:
    """(key, options ..) of a table of settings (key, name, value), a row for each key; the last of equal names in text order counts."""
    wide = settings.groupBy(key).pivot(name, NAMES).agg(F.max(value))
    return wide.select(key, *[c.alias(k) for k, c in columns({n: F.col(n) for n in NAMES}).items()])


def options(spark: SparkSession, settings: Mapping[str, str] | None = None) -> Options:
    """The options of ``settings``, or else of the environment.  A model that isn't well described, and a length ratio that is none, are errors."""
    given = dict(os.environ if settings is None else settings)
    row = spark.range(1).select(*[c.alias(k) for k, c in columns({n: F.lit(given.get(n)).cast("string") for n in NAMES}).items()]).first().asDict()
    for kind in ("models", "rerankers", "sparse_models"):
        wrong = [k for k, m in enumerate(row[kind]) if not m["valid"]]
        if wrong:
            raise ValueError(f"{kind}: entry {wrong[0] + 1} isn't well described")
        row[kind] = tuple(row[kind])
    return Options(**row, unread=() if settings is None else tuple(sorted(given.keys() - set(NAMES))))
