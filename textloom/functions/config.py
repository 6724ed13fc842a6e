"""Parsers of settings as columns: each gives the value, a default, or an error flag.

Settings are texts; white space around numbers is ignored, as is anything that isn't wholly a number.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Defaults of positive whole-number settings.
POSITIVE_DEFAULTS = {"batch_max_tokens": 16384, "batch_max_seq": 256, "session_pool": 1, "max_input_array": 32, "max_input_docs": 32, "probe_timeout_ms": 2000}
#: Defaults of settings of which 0 has a meaning.
ZERO_DEFAULTS = {"cache_max_entries": 10_000, "token_cache_max_entries": 0}
#: Bytes of each unit.
UNITS = {"": 1, "B": 1, "K": 1024, "KIB": 1024, "M": 1024**2, "MIB": 1024**2, "G": 1024**3, "GIB": 1024**3}
DEFAULT_GRAPH = "model_quantized.onnx"


def whole(text: Column) -> Column:
    """A whole number, or null."""
    t = F.trim(text)
    return F.when(t.rlike("^[+]?[0-9]+$"), t.try_cast("bigint"))


def positive_or(text: Column, default: int) -> Column:
    n = whole(text)
    return F.when(n > 0, n).otherwise(F.lit(default)).cast("long")


def zero_or_more(text: Column, default: int) -> Column:
    return F.coalesce(whole(text), F.lit(default)).cast("long")


def model_env_key(name: Column) -> Column:
    return F.upper(F.replace(name, F.lit("-"), F.lit("_")))


def listed(text: Column) -> Column:
    """Parts between commas, trimmed, without blanks."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def warm_up_sizes(text: Column, default: list[int]) -> Column:
    """Positive numbers in order, each once; the default where none is there."""
    got = F.array_distinct(F.filter(F.transform(listed(text), whole), lambda x: x > 0))
    return F.when(F.size(got) > 0, got).otherwise(F.array(*[F.lit(x).cast("long") for x in default]))


def warm_up_length(text: Column) -> Column:
    """Null for 'max', otherwise a positive number or 128."""
    return F.when(F.lower(F.trim(text)) == "max", F.lit(None).cast("long")).otherwise(positive_or(text, 128))


def strict_bool(text: Column) -> Column:
    return F.coalesce(F.lower(text).isin("true", "1"), F.lit(False))


def lenient_bool(text: Column) -> Column:
    """True unless it says no."""
    return ~F.coalesce(F.trim(text).isin("false", "0"), F.lit(False))


def spinning(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin("1", "true", "yes"), F.lit(False))


def byte_count(text: Column, strict: bool = False) -> Column:
    """Bytes of a number with a unit; what has none is null, or fails if ``strict``.  Unset stays null."""
    t = F.upper(F.rtrim(text))
    number, unit = F.regexp_extract(t, "^([0-9]+)\\s*([A-Z]*)$", 1), F.regexp_extract(t, "^([0-9]+)\\s*([A-Z]*)$", 2)
    size = F.lit(None).cast("long")
    for name, n in UNITS.items():
        size = F.when(unit == name, F.lit(n).cast("long")).otherwise(size)
    return _checked(F.when(number != "", number.try_cast("bigint") * size), text, "size", strict)


def _checked(value: Column, text: Column, what: str, strict: bool) -> Column:
    if not strict:
        return value
    return F.when(text.isNotNull() & value.isNull(), F.raise_error(F.concat(F.lit(f"not a {what}: "), text)).cast("double")).otherwise(value)


def ratio_or(text: Column, default: float = 2.0) -> Column:
    """A finite number from 0, or the default."""
    x = F.trim(text).try_cast("double")
    return F.when((x >= 0) & ~F.isnan(x) & (x < F.lit(float("inf"))), x).otherwise(F.lit(default))


def ratio_threshold(text: Column, strict: bool = False) -> Column:
    """A finite number from 0; 0 (off) where unset; anything else is null, or fails if ``strict``."""
    x = F.trim(text).try_cast("double")
    value = F.when(text.isNull(), F.lit(0.0)).when((x >= 0) & ~F.isnan(x) & (x < F.lit(float("inf"))), x)
    return _checked(value, text, "length ratio", strict)


def window_is_inert(window: Column, timeout: Column) -> Column:
    """A freshness window shorter than the probe's timeout never suppresses anything."""
    return window < timeout


def optimisation_level(text: Column) -> Column:
    n = whole(text)
    return F.when(n.between(0, 2), n).otherwise(F.lit(3)).cast("int")


def seconds_or(text: Column, default: float) -> Column:
    x = F.trim(text).try_cast("double")
    return F.when((x > 0) & ~F.isnan(x) & (x < F.lit(float("inf"))), x).otherwise(F.lit(default))


def millis_or_off(text: Column, default: int) -> Column:
    """Whole milliseconds; null is off: the setting 0, or a default of 0 where it is unset or no number."""
    n = F.coalesce(whole(text), F.lit(default).cast("long"))
    return F.when(n > 0, n)


def overlay(own: Column, common: Column, default: Column) -> Column:
    """A model's own setting, else the common one, else the default; 0 and what isn't a number count as unset."""
    n = [F.when(whole(x) > 0, whole(x)) for x in (own, common)]
    return F.coalesce(*n, default.cast("long"))


def waiter_cap(own: Column, common: Column, pool: Column) -> Column:
    return overlay(own, common, F.greatest(F.lit(16), pool * 8))


def semaphore_cap(env: Column, pool: Column, threads: Column) -> Column:
    """Null is unlimited (the setting 0); unset is derived from pool and threads."""
    n = whole(env)
    return F.when(n == 0, F.lit(None).cast("long")).otherwise(F.coalesce(n, F.greatest(F.lit(16), pool * threads * 8)).cast("long"))


def metrics_port(base: Column, index: Column) -> Column:
    """Base plus index, null beyond 65535."""
    port = base + index
    return F.when(port <= 65_535, port).cast("int")


def shrinks_arena(forced: Column, memory_pattern: Column) -> Column:
    return F.coalesce(forced, ~memory_pattern)


def backoff(failures: Column, start: float = 2.0, most: float = 60.0) -> Column:
    """Doubling from ``start``, up to ``most``."""
    return F.least(F.lit(start) * F.pow(F.lit(2.0), F.least(failures, F.lit(30))), F.lit(most))


def _flag(text: Column) -> Column:
    """True, false, or null for anything but true, false, 1 and 0."""
    return F.when(text.isin("true", "1"), F.lit(True)).when(text.isin("false", "0"), F.lit(False))


def embed_spec(text: Column) -> Column:
    """name:dir:dim:max_len:pad_id:has_token_types[:file] as a struct with valid."""
    p = F.split(F.trim(text), ":")
    part = lambda i: F.get(p, F.lit(i))
    file = F.when(F.size(p) == 7, F.trim(part(6))).otherwise(F.lit(DEFAULT_GRAPH))
    numbers = [whole(part(i)) for i in (2, 3, 4)]
    valid = F.size(p).isin(6, 7) & numbers[0].isNotNull() & numbers[1].isNotNull() & numbers[2].isNotNull() & _flag(part(5)).isNotNull() & (file != "") & ~file.rlike(r"[/\\]") & (file != "..")
    return F.struct(part(0).alias("name"), part(1).alias("dir"), numbers[0].alias("dim"), numbers[1].alias("max_len"), numbers[2].alias("pad_id"), _flag(part(5)).alias("has_token_types"), file.alias("file"), F.coalesce(valid, F.lit(False)).alias("valid"))


def reranker_spec(text: Column) -> Column:
    """name:dir:max_len:padded as a struct with valid."""
    p = F.split(F.trim(text), ":")
    part = lambda i: F.get(p, F.lit(i))
    valid = (F.size(p) == 4) & whole(part(2)).isNotNull() & _flag(part(3)).isNotNull()
    return F.struct(part(0).alias("name"), part(1).alias("dir"), whole(part(2)).alias("max_len"), _flag(part(3)).alias("padded"), F.coalesce(valid, F.lit(False)).alias("valid"))


def sparse_spec(text: Column) -> Column:
    """name:dir:max_len as a struct with valid."""
    p = F.split(F.trim(text), ":")
    part = lambda i: F.get(p, F.lit(i))
    valid = (F.size(p) == 3) & whole(part(2)).isNotNull()
    return F.struct(part(0).alias("name"), part(1).alias("dir"), whole(part(2)).alias("max_len"), F.coalesce(valid, F.lit(False)).alias("valid"))


def scenarios(text: Column) -> Column:
    """'CxI,...' as (concurrency, iterations)."""
    def pair(x: Column) -> Column:
        p = F.split(F.lower(x), "x")
        return F.struct(whole(F.get(p, F.lit(0))).alias("concurrency"), whole(F.get(p, F.lit(1))).alias("iterations"))

    return F.transform(listed(text), pair)


def cached_graph_path(base: Column, mtime_ns: Column) -> Column:
    return F.concat_ws(".", base, mtime_ns.cast("string"), F.lit("optimized.onnx"))


def cache_decision(enabled: Column, mtime_ns: Column, there: Column) -> Column:
    return F.when(~enabled | mtime_ns.isNull(), "no_cache").when(there, "hit").otherwise("miss")
