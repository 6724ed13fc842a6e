"""Classification of messages and outcomes, first match wins; and parsers of log lines."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: What a worker's message contains, and its class, in order.
WORKER_ERRORS = (
    ("queue overflow", "queue_overflow"),
    ("semaphore closed", "semaphore_closed"),
    ("saturated", "worker_saturated"),
    ("arena", "arena_oom"),
    ("oom", "arena_oom"),
    ("kind mismatch", "kind_mismatch"),
    ("tokeniz", "tokenize"),
)
#: Both stand in a message of a full arena.
ARENA_WORDS = ("Available memory of", "smaller than requested")
#: Outcome, status, error type, seconds to wait.
STATUSES = (
    ("ok", 200, None, None), ("shutdown", 503, "rate_limited", 5), ("semaphore", 429, "rate_limited", 1), ("invalid", 400, "invalid_request_error", None),
    ("queue_full", 429, "rate_limited", 1), ("respawning", 503, "worker_unavailable", 5), ("batcher_down", 503, "server_error", None), ("failed", 500, "server_error", None),
)
#: What dispatching to a worker ends in.
DISPATCH = {"timeout": (503, 5, "worker_unavailable"), "no_worker": (500, None, "server_error"), "ipc": (500, None, "server_error")}
KINDS = ("embed", "rerank", "splade")


def worker_error(message: Column) -> Column:
    low = F.lower(message)
    out = F.lit("other")
    for part, name in reversed(WORKER_ERRORS):
        out = F.when(F.contains(low, F.lit(part)), name).otherwise(out)
    return out


def runtime_error(message: Column) -> Column:
    return F.when(F.contains(message, F.lit(ARENA_WORDS[0])) & F.contains(message, F.lit(ARENA_WORDS[1])), "arena_oom").otherwise("other")


def extended_bin(line: Column) -> Column:
    """Bin number of an arena-extension message, null in other lines."""
    return F.when(F.contains(line, F.lit("Extending BFCArena")), F.nullif(F.regexp_extract(line, "bin_num:([0-9]+)", 1), F.lit("")).cast("int"))


def resident_bytes(status: Column) -> Column:
    """Bytes on the VmRSS line of a process status, null without one."""
    kb = F.regexp_extract(status, "(?m)^VmRSS:\\s+([0-9]+)", 1)
    return F.when(kb != "", kb.try_cast("bigint") * 1024)


def status_of(outcome: Column, field: int) -> Column:
    """1 status, 2 error type, 3 seconds to wait of an outcome."""
    out = F.lit(None).cast("string" if field == 2 else "int")
    for row in STATUSES:
        out = F.when(outcome == row[0], F.lit(row[field])).otherwise(out)
    return out


def dispatch_status(error: Column, field: int) -> Column:
    out = F.lit(None).cast("string" if field == 2 else "int")
    for name, row in DISPATCH.items():
        out = F.when(error == name, F.lit(row[field])).otherwise(out)
    return out


def readiness(shutdown: Column, failed: Column, elapsed: Column, limit: Column) -> Column:
    """What a probe tells: shutdown, timeout, error or ok."""
    return F.when(shutdown, "shutdown").when(elapsed >= limit, "timeout").when(failed, "error").otherwise("ok")


def kind_name(i: Column) -> Column:
    """Name of a worker's kind by its number; null beyond them."""
    return F.get(F.array(*map(F.lit, KINDS)), i)


def unsupported(name: Column, prefixes: list[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | F.startswith(name, F.lit(p))
    return out


def error_body(message: Column, kind: Column) -> Column:
    return F.struct(message.alias("message"), kind.alias("type"))
