"""Requests as rows: normalising unions, ordered gates, outcomes.

A request that fails several gates gets the outcome of the first, so the gates are one
CASE in order; a gate is a condition on columns, so Catalyst evaluates all of them
in one pass before any model runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textloom.functions import classify
from textloom.functions.config import metrics_port
from textloom.functions.text import blank

MAX_INPUTS = 32
#: Settings that requests may leave out.
TOP_K, MIN_WEIGHT = 256, 0.0


def listed(record: Column, path: str) -> Column:
    """A string or a list of strings as a list.  The list is tried first: a list also reads as a string."""
    return F.coalesce(F.try_variant_get(record, f"$.{path}", "array<string>"), F.when(F.try_variant_get(record, f"$.{path}", "string").isNotNull(), F.array(F.try_variant_get(record, f"$.{path}", "string"))))


def documents(record: Column, path: str = "documents") -> Column:
    """A list whose members are strings or objects with a text, as strings."""
    return F.transform(F.try_variant_get(record, f"$.{path}", "array<variant>"), lambda d: F.coalesce(F.try_variant_get(d, "$.text", "string"), F.try_variant_get(d, "$", "string")))


def parsed(rows: DataFrame, json_col: str, kind: str, default_model: str | None = None) -> DataFrame:
    """``rows`` with the columns of an embed, rerank or sparse request; fields left out have their defaults.

    ``valid`` is false for text that's no JSON object or has values outside the enumerations.
    """
    r = F.col("__r")
    text = lambda p: F.try_variant_get(r, f"$.{p}", "string")
    out = rows.withColumn("__r", F.try_parse_json(F.col(json_col))).withColumn("model", F.coalesce(text("model"), F.lit(default_model)))
    ok = F.coalesce(F.schema_of_variant(r).startswith("OBJECT"), F.lit(False))
    if kind == "embed":
        columns = {"input": listed(r, "input"), "encoding_format": F.coalesce(text("encoding_format"), F.lit("float")), "input_type": F.coalesce(text("input_type"), F.lit("document"))}
        ok = ok & F.coalesce(text("encoding_format"), F.lit("float")).isin("float", "base64") & F.coalesce(text("input_type"), F.lit("document")).isin("document", "query")
    elif kind == "rerank":
        columns = {"query": text("query"), "documents": documents(r), "top_n": F.try_variant_get(r, "$.top_n", "int"), "return_documents": F.coalesce(F.try_variant_get(r, "$.return_documents", "boolean"), F.lit(False)), "normalize": text("normalize")}
        ok = ok & F.coalesce(text("normalize"), F.lit("sigmoid")).isin("none", "sigmoid")
    elif kind == "sparse":
        columns = {"input": listed(r, "input"), "top_k": F.coalesce(F.try_variant_get(r, "$.top_k", "int"), F.lit(TOP_K)), "min_weight": F.coalesce(F.try_variant_get(r, "$.min_weight", "double"), F.lit(MIN_WEIGHT))}
    else:
        raise ValueError(f"no such kind of request: {kind}")
    return out.withColumns(columns).withColumn("valid", ok).drop("__r")


def embed_outcome(inputs: Column, known_model: Column, shutdown: Column, cap: int = MAX_INPUTS) -> Column:
    n = F.coalesce(F.size(inputs), F.lit(0))
    return F.when(shutdown, "shutdown").when(n <= 0, "empty_input").when(n > cap, "input_array_too_large").when(~known_model, "unknown_model").otherwise("ok")


def rerank_outcome(query: Column, docs: Column, model_outcome: Column, shutdown: Column, busy: Column, cap: int = MAX_INPUTS) -> Column:
    n = F.coalesce(F.size(docs), F.lit(0))
    return F.when(busy, "semaphore").when(shutdown, "shutdown").when(F.coalesce(blank(query), F.lit(True)), "blank_query").when(n <= 0, "no_documents").when(n > cap, "documents_too_many").when(model_outcome != "ok", model_outcome).otherwise("ok")


def sparse_outcome(inputs: Column, model_outcome: Column, shutdown: Column) -> Column:
    """There's no cap on the size of sparse requests."""
    return F.when(shutdown, "shutdown").when(F.coalesce(F.size(inputs), F.lit(0)) <= 0, "empty_input").when(F.exists(inputs, blank), "blank_input").when(model_outcome != "ok", model_outcome).otherwise("ok")


def status(outcome: Column) -> Column:
    """Struct of status, error type and seconds to wait of a gate's outcome."""
    group = F.when(outcome.isin("ok", "shutdown", "semaphore", "queue_full", "respawning", "batcher_down", "failed"), outcome).otherwise("invalid")
    return F.struct(*[classify.status_of(group, k).alias(n) for k, n in ((1, "status"), (2, "type"), (3, "retry_after"))])


def resolved_kinds(requests: DataFrame, models: DataFrame, model_col: str = "model", kind_col: str = "kind") -> DataFrame:
    """Requests of any kinds with ``resolved_model`` and ``model_outcome``.

    A named model must exist among its kind's; without a name there must be exactly one of the kind.
    ``models`` (name, kind) is the configuration: one scan of the requests meets it by (kind, name) and its counts by kind, and it is
    sent to all executors if it has no more than 100,000 rows.
    """
    own = models.select(F.col("kind").alias("__kind"), F.col("name").alias("__name")).distinct()
    total = models.groupBy(F.col("kind").alias("__of")).agg(F.count(F.lit(1)).alias("__n"), F.min("name").alias("__only"))
    if own.limit(100_001).count() <= 100_000:
        own, total = F.broadcast(own), F.broadcast(total)
    kind, named = F.col(kind_col), F.col(model_col).isNotNull()
    out = requests.join(own, (F.col(model_col) == F.col("__name")) & (kind == F.col("__kind")), "left").join(total, kind == F.col("__of"), "left")
    n = F.coalesce("__n", F.lit(0))
    outcome = F.when(named & F.col("__name").isNotNull(), "ok").when(named, "unknown_model").when(n == 1, "ok").when(n == 0, "no_model").otherwise("model_required")
    return out.withColumns({"model_outcome": outcome, "resolved_model": F.when(outcome == "ok", F.when(named, F.col("__name")).otherwise(F.col("__only")))}).drop("__kind", "__of", "__n", "__only", "__name")


def resolved(requests: DataFrame, models: DataFrame, kind: str, model_col: str = "model") -> DataFrame:
    """``resolved_kinds`` of requests that are all of one kind."""
    return resolved_kinds(requests.withColumn("__asked", F.lit(kind)), models, model_col, "__asked").drop("__asked")


def counted(asked: DataFrame, answered: DataFrame, key: str, n: str, m: str) -> DataFrame:
    """``asked`` (key, n) with ``m`` of ``answered`` and ``error``: null where both counts are equal, else what is wrong.  No answer counts as 0."""
    got = F.coalesce(m, F.lit(0))
    wrong = F.format_string("%s: expected %d results, got %d", F.col(key).cast("string"), F.col(n).cast("long"), got.cast("long"))
    return asked.join(answered, key, "left").withColumn("error", F.when(F.col(n) != got, wrong))


def checked(asked: DataFrame, answered: DataFrame, key: str, n: str, m: str) -> DataFrame:
    """``counted`` without ``error``: a request whose results are fewer or more fails the job, with its key and both counts."""
    out = counted(asked, answered, key, n, m)
    # the check guards a column that stays, so it isn't pruned
    return out.withColumn(n, F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).cast(asked.schema[n].dataType)).otherwise(F.col(n))).drop("error")


def kind_checked(asked: DataFrame, models: DataFrame, model_col: str = "model", kind_col: str = "kind") -> DataFrame:
    """``asked`` with ``worker_kind`` and ``mismatch``: the error of a request whose kind isn't its model's; null where it fits or the model is unknown.

    ``models`` (name, kind) is the configuration, a handful of rows.
    """
    own = models.select(F.col("name").alias(model_col), F.col("kind").alias("worker_kind"))
    out = asked.join(own, model_col, "left")
    return out.withColumn("mismatch", F.when(F.col(kind_col) != F.col("worker_kind"), F.concat(F.lit("kind mismatch: "), F.col("worker_kind"), F.lit(" worker got "), F.col(kind_col))))


def numbered_workers(models: DataFrame, order: str, base: int) -> DataFrame:
    """``models`` (name, kind, ..) with ``index`` (embed, then rerank, then splade, each in order) and the metrics ``port``.

    The configuration is a handful of rows, so one task numbers them.
    """
    from pyspark.sql import Window

    rank = F.array_position(F.array(*map(F.lit, classify.KINDS)), F.col("kind"))
    index = (F.row_number().over(Window.orderBy(rank, order)) - 1).cast("int")
    return models.withColumn("index", index).withColumn("port", metrics_port(F.lit(base), F.col("index")))


def response(index: Column, vector: Column, b64: Column, encoding_format: Column) -> Column:
    return F.struct(F.lit("embedding").alias("object"), index.alias("index"), F.when(encoding_format == "float", vector).alias("embedding"), F.when(encoding_format == "base64", b64).alias("embedding_b64"))
