"""Queries of what surrounds the models: usage, caches, queues, workers, replies and settings, over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom.functions import classify, config, numeric, text
from textloom.operators import batching, dense, encoders, metrics, requests, sparse
from textloom.plans.catalog import _BATCHES, _BUDGETS, _IDS, _STREAM, _WORDS, PLACES, _packed, _packed_sql, _read, _round, _sql_values, _values, query
from textloom.sources import readers

#: Documents of one request.
_ASK = 32
_LONGEST = 512


def _request(name: str = "doc_id"):
    return F.floor(F.col(name) / _ASK)


# ------------------------------------------------------------------ texts, caches and usage


@query(f"""
    WITH p AS (SELECT doc_id // {_ASK} AS request, sha256(text) AS sha, row_number() OVER (PARTITION BY doc_id // {_ASK} ORDER BY doc_id) - 1 AS pos FROM documents)
    SELECT request, sha, string_agg(pos::VARCHAR, ' ' ORDER BY pos) AS positions FROM p GROUP BY 1, 2
""")
def request_positions(spark, d):
    """Where each distinct text of a request of 32 stands."""
    asked = _read(spark, d, "documents").groupBy(_request().alias("request")).agg(F.array_sort(F.collect_list(F.struct("doc_id", "text"))).alias("x"))
    asked = asked.select("request", F.transform("x", lambda r: r["text"]).alias("texts"))
    return dense.request_positions(asked, "request", "texts").select("request", "sha", F.array_join("positions", " ").alias("positions"))


@query(f"""
    WITH d AS (SELECT doc_id, doc_id // {_ASK} AS request, sha256(text) AS sha, least(len({_WORDS.format(t='text')}) + 2, {_LONGEST})::BIGINT AS n FROM documents),
         warm AS (SELECT DISTINCT sha FROM d WHERE doc_id % 3 = 0 OR request % 5 = 0), m AS (SELECT DISTINCT request, sha, n FROM d WHERE sha NOT IN (SELECT sha FROM warm))
    SELECT r.request, coalesce(sum(n), 0)::BIGINT AS tokens FROM (SELECT DISTINCT request FROM d) r LEFT JOIN m ON r.request = m.request GROUP BY 1
""")
def exact_usage(spark, d):
    """Tokens of each request's texts that aren't cached, each distinct text once; requests that the cache answers cost nothing."""
    docs = _read(spark, d, "documents").select("doc_id", _request().alias("request"), "text", F.least(F.size(text.words(F.col("text"))) + 2, F.lit(_LONGEST)).cast("long").alias("n"))
    warm = docs.where((F.col("doc_id") % 3 == 0) | (F.col("request") % 5 == 0)).select(text.text_hash(F.col("text")).alias("sha"))
    return dense.exact_usage(docs, warm, "request", "n")


_PAIR_IDS = f"list_concat([1], list_concat({_IDS.format(t='query')}, list_concat([2], list_concat({_IDS.format(t='text')}, [2]))))"


@query(f"""
    WITH p AS (SELECT b.conv_id, b.turn, a.text AS query, b.text, sha256(a.text || chr(0) || b.text) AS sha FROM conversations a JOIN conversations b USING (conv_id) WHERE a.turn = 0 AND b.turn > 0),
         warm AS (SELECT DISTINCT sha FROM p WHERE conv_id % 3 = 0), i AS (SELECT p.*, {_PAIR_IDS} AS ids, w.sha IS NOT NULL AS cached FROM p LEFT JOIN warm w ON p.sha = w.sha)
    SELECT conv_id, string_agg(CASE WHEN cached THEN 'c' ELSE 'n' END, '' ORDER BY turn) AS sources, md5(string_agg(array_to_string(ids, ' '), ';' ORDER BY turn)) AS digest FROM i GROUP BY 1
""")
def token_splice(spark, d):
    """Token ids of a conversation's pairs, in order: every third conversation's are cached, and so are equal pairs elsewhere."""
    rows = _read(spark, d, "conversations", "conv_id", "turn", "text")
    first = rows.where("turn = 0").select("conv_id", F.col("text").alias("query"))
    pairs = rows.where("turn > 0").join(first, "conv_id").withColumn("sha", text.pair_hash(F.col("query"), F.col("text")))
    start, end = F.array(F.lit(text.START)), F.array(F.lit(text.END))

    def compute(items: DataFrame) -> DataFrame:
        return items.withColumn("ids", F.concat(start, text.token_ids(F.col("query")), end, text.token_ids(F.col("text")), end))

    cache = compute(pairs.where(F.col("conv_id") % 3 == 0).dropDuplicates(["sha"])).select("sha", "ids")
    out = dense.spliced(pairs, cache, compute)
    listed = out.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "cached", F.array_join("ids", " ").alias("ids")))).alias("p"))
    source = F.array_join(F.transform("p", lambda x: F.when(x["cached"], "c").otherwise("n")), "")
    return listed.select("conv_id", source.alias("sources"), F.md5(F.array_join(F.transform("p", lambda x: x["ids"]), ";")).alias("digest"))


@query(f"""
    WITH n AS (SELECT doc_id, source, least(len({_WORDS.format(t='text')}), {_LONGEST})::BIGINT AS n FROM documents)
    SELECT source, count(*) FILTER (doc_id % 9 = 0) AS cancelled, count(*) FILTER (doc_id % 9 <> 0) AS admitted, coalesce(sum(n) FILTER (doc_id % 9 <> 0), 0)::BIGINT AS real_tokens FROM n GROUP BY 1
""")
def cancelled_items(spark, d):
    """Every ninth requester has left; the others' real tokens, clipped at the model's length."""
    docs = _read(spark, d, "documents").select("doc_id", "source", F.least(F.size(text.words(F.col("text"))), F.lit(_LONGEST)).cast("long").alias("n"))
    gone = F.col("doc_id") % 9 == 0
    kept = batching.admitted(docs, gone).groupBy("source").agg(F.count(F.lit(1)).alias("admitted"), F.sum("n").alias("real_tokens"))
    total = docs.groupBy("source").agg(F.count(F.lit(1)).alias("all"))
    n = F.coalesce("admitted", F.lit(0))
    return total.join(kept, "source", "left").select("source", (F.col("all") - n).alias("cancelled"), n.alias("admitted"), F.coalesce("real_tokens", F.lit(0)).alias("real_tokens"))


# ------------------------------------------------------------------ vectors and weights

_POOL_DIMS = 4
_SLOTS = 8


@query(f"""
    WITH l AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings),
         t AS (SELECT vec_id, k // {_POOL_DIMS} AS tok, k % {_POOL_DIMS} AS dim, v, CASE WHEN (k // {_POOL_DIMS}) % 3 <> vec_id % 3 AND vec_id % 7 <> 0 THEN 1 ELSE 0 END AS m FROM l),
         p AS (SELECT vec_id, dim, sum(v * m) / greatest(sum(m), 1) AS mean FROM t GROUP BY 1, 2), n AS (SELECT vec_id, sqrt(sum(mean * mean)) AS size FROM p GROUP BY 1)
    SELECT p.vec_id, dim::INT AS dim, round(CASE WHEN size > 0 THEN mean / size ELSE mean END, {PLACES}) + 0.0 AS value FROM p JOIN n ON p.vec_id = n.vec_id
""")
def masked_mean_pool(spark, d):
    """Each vector as a sequence of tokens of four places, some of which are padding; every seventh has no real token."""
    rows = _read(spark, d, "embeddings", "vec_id", "embedding")
    count = F.floor(F.size("embedding") / _POOL_DIMS).cast("int")
    tokens = F.transform(F.sequence(F.lit(0), count - 1), lambda t: F.slice("embedding", t * _POOL_DIMS + 1, F.lit(_POOL_DIMS)))
    mask = F.transform(F.sequence(F.lit(0), count - 1), lambda t: ((t % 3 != F.col("vec_id") % 3) & (F.col("vec_id") % 7 != 0)).cast("int"))
    pooled = rows.select("vec_id", F.posexplode(numeric.masked_mean(tokens, mask, _POOL_DIMS)).alias("dim", "value"))
    return pooled.select("vec_id", "dim", (_round("value") + F.lit(0.0)).alias("value"))


@query(f"""
    WITH l AS (SELECT vec_id, unnest(embedding)::DOUBLE * 10 AS v, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings)
    SELECT vec_id, (k % {_SLOTS})::INT AS term, round(max(CASE WHEN v > 0 AND (k // {_SLOTS}) % 4 <> 3 THEN ln(1.0 + v) ELSE 0.0 END), {PLACES}) AS weight FROM l GROUP BY 1, 2
""")
def sparse_max_pool(spark, d):
    """Each vector as the logits of a sequence over eight terms; every fourth place is padding."""
    rows = _read(spark, d, "embeddings", "vec_id", "embedding")
    count = F.floor(F.size("embedding") / _SLOTS).cast("int")
    logits = F.transform(F.sequence(F.lit(0), count - 1), lambda t: F.transform(F.slice("embedding", t * _SLOTS + 1, F.lit(_SLOTS)), lambda x: x.cast("double") * 10))
    mask = F.transform(F.sequence(F.lit(0), count - 1), lambda t: (t % 4 != 3).cast("int"))
    return rows.select("vec_id", F.posexplode(sparse.row_max_pooled(logits, mask)).alias("term", "weight")).select("vec_id", "term", _round("weight").alias("weight"))


@query(f"""
    WITH w AS (SELECT DISTINCT unnest({_WORDS.format(t='text')}) AS word FROM documents), v AS (SELECT (3 + ('0x' || substr(md5(word), 1, 7))::BIGINT % 30519)::INT AS term, min(word) AS token FROM w GROUP BY 1),
         t AS (SELECT doc_id, unnest({_IDS.format(t='text')}) AS term FROM documents), c AS (SELECT doc_id, term, ln(1.0 + count(*)) AS weight FROM t GROUP BY 1, 2),
         r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term)::INT AS rank FROM c)
    SELECT doc_id, rank, r.term, token FROM r LEFT JOIN v ON r.term = v.term WHERE rank <= 3
""")
def sparse_tokens(spark, d):
    """The tokens of each text's three heaviest terms, by a vocabulary that can't have more rows than it has ids."""
    docs = _read(spark, d, "documents", "doc_id", "text")
    vocabulary = docs.select(F.explode(F.array_distinct(text.words(F.col("text")))).alias("token")).groupBy(text.word_id(F.col("token")).alias("term")).agg(F.min("token").alias("token"))
    top = docs.select("doc_id", F.posexplode(encoders.HashEncoder().sparse(F.col("text"), 3)).alias("at", "t"))
    ranked = top.select("doc_id", (F.col("at") + 1).alias("rank"), F.col("t.term").alias("term"))
    return ranked.join(F.broadcast(vocabulary), "term", "left").select("doc_id", "rank", "term", "token")


# ------------------------------------------------------------------ requests

_DOCS = "string_agg(text, chr(1) ORDER BY turn) FILTER (turn > 0)"


@query(f"""
    WITH r AS (SELECT conv_id, min(CASE WHEN turn = 0 THEN text END) AS query, count(*) FILTER (turn > 0) AS n, coalesce({_DOCS}, '') AS docs FROM conversations GROUP BY 1)
    SELECT conv_id, CASE WHEN conv_id % 5 <> 0 THEN 'ranker' END AS model, sha256(query) AS query_sha, n::INT AS n, sha256(docs) AS documents_sha, CASE WHEN conv_id % 4 > 0 THEN conv_id % 4 END::INT AS top_n,
           conv_id % 2 = 0 AS return_documents, CASE conv_id % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'sigmoid' WHEN 2 THEN 'softmax' END AS normalize, conv_id % 4 <> 2 AS valid FROM r WHERE query IS NOT NULL
""")
def rerank_requests(spark, d):
    """Conversations as JSON rerank requests: documents are strings and objects in turn, fields are left out, a calibration isn't known."""
    rows = _read(spark, d, "conversations", "conv_id", "turn", "text")
    asked = rows.groupBy("conv_id").agg(F.min(F.when(F.col("turn") == 0, F.col("text"))).alias("query"), F.array_sort(F.collect_list(F.when(F.col("turn") > 0, F.struct("turn", "text")))).alias("later")).where("query IS NOT NULL")
    plain = lambda t: F.regexp_replace(F.to_json(F.array(t)), r"^\[|\]$", "")
    docs = F.transform("later", lambda x: F.when(x["turn"] % 2 == 0, F.to_json(F.struct(x["text"].alias("text")))).otherwise(plain(x["text"])))
    i = F.col("conv_id") % 4
    fields = [
        F.concat(F.lit('"query":'), plain(F.col("query"))), F.concat(F.lit('"documents":['), F.array_join(docs, ","), F.lit("]")),
        F.when(i > 0, F.concat(F.lit('"top_n":'), i.cast("string"))), F.when(F.col("conv_id") % 2 == 0, F.lit('"return_documents":true')),
        F.when(F.col("conv_id") % 5 != 0, F.lit('"model":"ranker"')), F.when(i < 3, F.concat(F.lit('"normalize":"'), F.element_at(F.array(F.lit("none"), F.lit("sigmoid"), F.lit("softmax")), F.least(i + 1, F.lit(3)).cast("int")), F.lit('"'))),
    ]
    out = requests.parsed(asked.select("conv_id", F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")).alias("json")), "json", "rerank")
    return out.select("conv_id", "model", F.sha2("query", 256).alias("query_sha"), F.size("documents").alias("n"), F.sha2(F.array_join("documents", "\x01"), 256).alias("documents_sha"), "top_n", "return_documents", "normalize", "valid")


@query("""
    SELECT conv_id, turn, sha256(text) AS input_sha, CASE WHEN turn % 2 = 0 THEN turn * 3 ELSE 256 END::INT AS top_k, CASE WHEN conv_id % 2 = 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS min_weight, true AS valid FROM conversations
""")
def sparse_requests(spark, d):
    """Turns as JSON sparse requests: a text or a list, with limits or the defaults."""
    rows = _read(spark, d, "conversations", "conv_id", "turn", "text")
    listed = F.to_json(F.array("text"))
    value = F.when(F.col("turn") % 3 == 0, listed).otherwise(F.regexp_replace(listed, r"^\[|\]$", ""))
    fields = [F.concat(F.lit('"input":'), value), F.when(F.col("turn") % 2 == 0, F.concat(F.lit('"top_k":'), (F.col("turn") * 3).cast("string"))), F.when(F.col("conv_id") % 2 == 0, F.lit('"min_weight":0.5'))]
    out = requests.parsed(rows.select("conv_id", "turn", F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")).alias("json")), "json", "sparse")
    return out.select("conv_id", "turn", F.sha2(F.get("input", F.lit(0)), 256).alias("input_sha"), "top_k", "min_weight", "valid")


_WORKERS = [("e5", "embed"), ("ranker", "rerank"), ("splade", "splade")]
_KIND = "CASE conv_id % 3 WHEN 0 THEN 'embed' WHEN 1 THEN 'rerank' ELSE 'splade' END"
_MODEL = "CASE turn % 4 WHEN 0 THEN 'e5' WHEN 1 THEN 'ranker' WHEN 2 THEN 'splade' ELSE 'nope' END"


@query(f"""
    WITH a AS (SELECT conv_id, turn, {_KIND} AS kind, {_MODEL} AS model FROM conversations)
    SELECT conv_id, turn, a.kind, a.model, m.kind AS worker_kind, CASE WHEN a.kind <> m.kind THEN 'kind mismatch: ' || m.kind || ' worker got ' || a.kind END AS mismatch
    FROM a LEFT JOIN (SELECT * FROM {_sql_values(_WORKERS, 'name, kind')}) m ON a.model = m.name
""")
def kind_mismatch(spark, d):
    """Requests that reach a worker of another kind."""
    asked = _read(spark, d, "conversations").select("conv_id", "turn", classify.kind_name((F.col("conv_id") % 3).cast("int")).alias("kind"), F.coalesce(F.get(F.array(F.lit("e5"), F.lit("ranker"), F.lit("splade")), (F.col("turn") % 4).cast("int")), F.lit("nope")).alias("model"))
    out = requests.kind_checked(asked, _values(spark, _WORKERS, "name string, kind string"))
    return out.select("conv_id", "turn", "kind", "model", "worker_kind", "mismatch")


# ------------------------------------------------------------------ queues and workers

_PERMITS, _WAITERS = 3, 2
_ARRIVES = "SELECT event_id, user_id, value > 5 AS arrives, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events"


def _arrivals(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "events").select("event_id", "user_id", "ts", (F.col("value") > 5).alias("arrives"))


@query(f"""
    WITH RECURSIVE e AS ({_ARRIVES}),
    r(user_id, event_id, rn, used, limited, after) AS (
        SELECT user_id, event_id, rn, 0, false, CASE WHEN arrives THEN 1 ELSE 0 END FROM e WHERE rn = 1
        UNION ALL
        SELECT e.user_id, e.event_id, e.rn, r.after, coalesce(e.arrives, false) AND r.after >= {_PERMITS}, CASE WHEN NOT coalesce(e.arrives, false) THEN greatest(0, r.after - 1) WHEN r.after >= {_PERMITS} THEN r.after ELSE r.after + 1 END
        FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)
    SELECT event_id, used::INT AS in_use, limited FROM r
""")
def rerank_permits(spark, d):
    """Three permits for each user: large values ask for one, small ones give one back."""
    return batching.permits(_arrivals(spark, d), ["user_id"], ["ts", "event_id"], "arrives", _PERMITS).select("event_id", "in_use", "limited")


@query(f"""
    WITH RECURSIVE e AS ({_ARRIVES}),
    r(user_id, event_id, rn, outcome, running, waiting) AS (
        SELECT user_id, event_id, 0::BIGINT, '', 0, 0 FROM e WHERE rn = 1
        UNION ALL
        SELECT e.user_id, e.event_id, e.rn, o.outcome, r.running + CASE WHEN o.outcome = 'runs' THEN 1 WHEN o.outcome = 'finished' AND r.waiting = 0 THEN -1 ELSE 0 END,
               r.waiting + CASE WHEN o.outcome = 'waits' THEN 1 WHEN o.outcome = 'finished' AND r.waiting > 0 THEN -1 ELSE 0 END
        FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1,
             LATERAL (SELECT CASE WHEN e.arrives AND r.waiting >= {_WAITERS} THEN 'refused' WHEN e.arrives AND r.running < {_PERMITS} THEN 'runs' WHEN e.arrives THEN 'waits' WHEN r.running = 0 THEN 'idle' ELSE 'finished' END AS outcome) o)
    SELECT event_id, outcome, running::INT AS running, waiting::INT AS waiting FROM r WHERE rn > 0
""")
def waiter_queue(spark, d):
    """A worker for each user, of three permits and two places to wait."""
    return batching.waiters(_arrivals(spark, d), ["user_id"], ["ts", "event_id"], "arrives", _PERMITS, _WAITERS).select("event_id", "outcome", "running", "waiting")


@query("""
    WITH m AS (SELECT n_name AS name, n_nationkey, n_nationkey % 3 AS k FROM nation), i AS (SELECT *, (row_number() OVER (ORDER BY k, n_nationkey) - 1)::INT AS index FROM m)
    SELECT name, CASE k WHEN 0 THEN 'embed' WHEN 1 THEN 'rerank' ELSE 'splade' END AS kind, index, CASE WHEN 65520 + index <= 65535 THEN 65520 + index END::INT AS port FROM i
""")
def worker_index(spark, d):
    """Nations as a configuration of workers of three kinds."""
    models = _read(spark, d, "nation").select(F.col("n_name").alias("name"), classify.kind_name((F.col("n_nationkey") % 3).cast("int")).alias("kind"), "n_nationkey")
    return requests.numbered_workers(models, "n_nationkey", 65_520).select("name", "kind", "index", "port")


@query(_packed_sql(_BUDGETS["pack_padded"]) + _BATCHES + """
    SELECT p.source, p.arrival, doc_id, CASE WHEN p.batch % 5 = 0 THEN 'embed task panicked' WHEN p.batch % 7 = 0 THEN 'embed_fn returned ' || (items - 1) || ' vectors for ' || items || ' texts' END AS error
    FROM p JOIN b ON p.source = b.source AND p.arrival = b.arrival AND p.batch = b.batch
""")
def error_fan_out(spark, d):
    """Some batches fail, some give one vector too few: all their items learn it."""
    items = _packed(spark, d, "pack_padded")
    sizes = batching.batches(items, _STREAM)
    replies = sizes.select(*_STREAM, "batch", F.when(F.col("batch") % 7 == 0, F.col("items") - 1).otherwise(F.col("items")).alias("results"), F.when(F.col("batch") % 5 == 0, "embed task panicked").alias("failure"))
    return batching.delivered(items, replies, _STREAM).select(*_STREAM, "doc_id", "error")


@query("""
    SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 'shutdown' WHEN value >= 20 THEN 'timeout' WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS readiness,
           CASE WHEN event_type = 'error' THEN 'probe ' || event_id || ' failed' END AS message, CASE WHEN event_type = 'error' THEN 'server_error' END AS type, 'rrk_' || lower(hex(event_id * 1000003)) AS request_id FROM events
""")
def probe_outcomes(spark, d):
    """Events as readiness probes, with the error's body and the id that the caller sees."""
    rows = _read(spark, d, "events", "event_id", "event_type", "value")
    failed = F.col("event_type") == "error"
    label = classify.readiness(F.col("event_id") % 50 == 0, failed, F.coalesce("value", F.lit(0.0)), F.lit(20.0))
    body = F.when(failed, classify.error_body(F.concat(F.lit("probe "), F.col("event_id").cast("string"), F.lit(" failed")), F.lit("server_error")))
    return rows.select("event_id", label.alias("readiness"), body["message"].alias("message"), body["type"].alias("type"), text.opaque_id(F.col("event_id") * 1_000_003).alias("request_id"))


# ------------------------------------------------------------------ settings

_SETTING = "CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN '0' WHEN 2 THEN ' ' || event_id || ' ' WHEN 3 THEN 'x' WHEN 4 THEN value::VARCHAR ELSE 'max' END"


def _settings(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    s = F.when(i % 6 == 1, "0").when(i % 6 == 2, F.concat(F.lit(" "), i.cast("string"), F.lit(" "))).when(i % 6 == 3, "x").when(i % 6 == 4, F.col("value").cast("string")).when(i % 6 == 5, "max")
    return _read(spark, d, "events", "event_id", "event_type", "value").withColumn("s", s)


_WHOLE = "CASE WHEN regexp_matches(trim(s), '^[+]?[0-9]+$') THEN try_cast(trim(s) AS BIGINT) END"


@query(f"""
    WITH t AS (SELECT event_id, event_type, {_SETTING} AS s FROM events)
    SELECT event_id, CASE WHEN coalesce({_WHOLE}, 250) > 0 THEN coalesce({_WHOLE}, 250) END::BIGINT AS millis, CASE WHEN coalesce({_WHOLE}, 0) > 0 THEN {_WHOLE} END::BIGINT AS millis_off,
           CASE WHEN try_cast(trim(s) AS DOUBLE) > 0 THEN try_cast(trim(s) AS DOUBLE) ELSE 30.0 END AS seconds, CASE WHEN s IS NULL THEN 0.0 WHEN try_cast(trim(s) AS DOUBLE) >= 0 THEN try_cast(trim(s) AS DOUBLE) END AS ratio,
           CASE WHEN lower(trim(s)) = 'max' THEN NULL WHEN {_WHOLE} > 0 THEN {_WHOLE} ELSE 128 END::BIGINT AS warm_up_length, coalesce(CASE WHEN event_type = 'error' THEN true WHEN event_type = 'click' THEN false END, event_id % 2 <> 0) AS shrinks FROM t
""")
def duration_settings(spark, d):
    s = F.col("s")
    forced = F.when(F.col("event_type") == "error", True).when(F.col("event_type") == "click", False)
    return _settings(spark, d).select(
        "event_id", config.millis_or_off(s, 250).alias("millis"), config.millis_or_off(s, 0).alias("millis_off"), config.seconds_or(s, 30.0).alias("seconds"), config.ratio_threshold(s).alias("ratio"),
        config.warm_up_length(s).alias("warm_up_length"), config.shrinks_arena(forced, F.col("event_id") % 2 == 0).alias("shrinks"),
    )


@query("""
    WITH t AS (SELECT event_id, ' ' || event_id % 7 || 'x' || event_id % 11 || ' , ,' || event_type || ',8X20' AS s FROM events),
         l AS (SELECT event_id, list_filter(list_transform(string_split(s, ','), lambda x: trim(x)), lambda x: x <> '') AS p FROM t)
    SELECT event_id, array_to_string(p, '|') AS parts, array_to_string(list_transform(p, lambda x: coalesce(try_cast(string_split(lower(x), 'x')[1] AS BIGINT)::VARCHAR, '-') || '*' || coalesce(try_cast(string_split(lower(x), 'x')[2] AS BIGINT)::VARCHAR, '-')), '|') AS scenarios,
           '/g/' || event_id || '.' || (event_id * 1000) || '.optimized.onnx' AS graph, CASE WHEN event_id % 5 = 0 THEN 'no_cache' WHEN event_id % 2 = 0 THEN 'hit' ELSE 'miss' END AS decision FROM l
""")
def list_settings(spark, d):
    """Lists, bench scenarios, and where an optimised graph is kept."""
    i = F.col("event_id")
    s = F.concat(F.lit(" "), (i % 7).cast("string"), F.lit("x"), (i % 11).cast("string"), F.lit(" , ,"), F.col("event_type"), F.lit(",8X20"))
    dash = lambda x: F.coalesce(x.cast("string"), F.lit("-"))
    scenarios = F.transform(config.scenarios(s), lambda p: F.concat(dash(p["concurrency"]), F.lit("*"), dash(p["iterations"])))
    return _read(spark, d, "events", "event_id", "event_type").select(
        "event_id", F.array_join(config.listed(s), "|").alias("parts"), F.array_join(scenarios, "|").alias("scenarios"), config.cached_graph_path(F.concat(F.lit("/g/"), i.cast("string")), i * 1000).alias("graph"),
        config.cache_decision(i % 5 != 0, i * 1000, i % 2 == 0).alias("decision"),
    )


# ------------------------------------------------------------------ telemetry

_SERIES = [(name, f"{b:g}", b, k + 1.0) for k, (name, bounds) in enumerate(metrics.LADDERS.items()) for b in bounds] + [(name, "+Inf", None, k + 1.0) for k, name in enumerate(metrics.LADDERS)]


@query(f"""
    SELECT series, le, count(*) FILTER (value IS NOT NULL AND (bound IS NULL OR value * scale * scale <= bound)) AS count FROM events, {_sql_values(_SERIES, 'series, le, bound, scale')} GROUP BY 1, 2
""")
def metric_ladders(spark, d):
    """Every series' buckets, over the events' values on scales of their own."""
    rows = _read(spark, d, "events", "value")
    scaled = [F.struct(F.lit(name).alias("series"), (F.col("value") * (k + 1.0) * (k + 1.0)).alias("v")) for k, name in enumerate(metrics.LADDERS)]
    return metrics.histograms(rows.select(F.explode(F.array(*scaled)).alias("s")).select("s.*"), "series", "v", metrics.LADDERS).select("series", "le", "count")


@query("SELECT '| ' || event_type || ' | ' || count(*) || ' | ' || max(event_id) || ' |' AS line FROM events GROUP BY event_type")
def bench_table(spark, d):
    """Events by type as the lines of a report."""
    rows = _read(spark, d, "events", "event_id", "event_type").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last"))
    return readers.bench_lines(rows, ["event_type", "n", "last"])


# ------------------------------------------------------------------ the same parsers and gates over whole tables


@query("""
    SELECT conv_id, turn, CASE WHEN conv_id % 3 > 0 THEN 'e5' END AS model, CASE turn % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END::INT AS n, CASE WHEN turn % 3 < 2 THEN sha256(text) END AS first_sha,
           CASE conv_id % 4 WHEN 0 THEN 'base64' WHEN 1 THEN 'hex' ELSE 'float' END AS encoding_format, CASE WHEN conv_id % 5 = 0 THEN 'query' ELSE 'document' END AS input_type, conv_id % 4 <> 1 AS valid FROM conversations
""")
def embed_requests(spark, d):
    """Turns as JSON embedding requests: a text, a list of two or an empty list; one format isn't known."""
    rows = _read(spark, d, "conversations", "conv_id", "turn", "text")
    one = F.regexp_replace(F.to_json(F.array("text")), r"^\[|\]$", "")
    value = F.when(F.col("turn") % 3 == 0, one).when(F.col("turn") % 3 == 1, F.concat(F.lit("["), one, F.lit(',"x"]'))).otherwise("[]")
    i = F.col("conv_id")
    fields = [F.concat(F.lit('"input":'), value), F.when(i % 4 == 0, F.lit('"encoding_format":"base64"')).when(i % 4 == 1, F.lit('"encoding_format":"hex"')), F.when(i % 5 == 0, F.lit('"input_type":"query"')), F.when(i % 3 > 0, F.lit('"model":"e5"'))]
    out = requests.parsed(rows.select("conv_id", "turn", F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")).alias("json")), "json", "embed")
    return out.select("conv_id", "turn", "model", F.size("input").alias("n"), F.sha2(F.get("input", F.lit(0)), 256).alias("first_sha"), "encoding_format", "input_type", "valid")


@query(f"""
    WITH a AS (SELECT conv_id, turn, {_KIND} AS kind, CASE turn % 5 WHEN 0 THEN NULL WHEN 1 THEN 'e5' WHEN 2 THEN 'jina' WHEN 3 THEN 'ranker' ELSE 'nope' END AS model FROM conversations),
         m AS (SELECT * FROM {_sql_values([("e5", "embed"), ("jina", "embed"), ("ranker", "rerank")], 'name, kind')}), k AS (SELECT kind, count(*) AS n, min(name) AS lone FROM m GROUP BY 1)
    SELECT conv_id, turn, a.kind, CASE WHEN a.model IS NOT NULL AND m.name IS NOT NULL THEN 'ok' WHEN a.model IS NOT NULL THEN 'unknown_model' WHEN k.n = 1 THEN 'ok' WHEN coalesce(k.n, 0) = 0 THEN 'no_model' ELSE 'model_required' END AS model_outcome,
           CASE WHEN a.model IS NOT NULL THEN m.name WHEN k.n = 1 THEN k.lone END AS resolved_model
    FROM a LEFT JOIN m ON a.model = m.name AND a.kind = m.kind LEFT JOIN k ON a.kind = k.kind
""")
def request_models(spark, d):
    """The model of every turn as a request, named or not, of each kind."""
    models = _values(spark, [("e5", "embed"), ("jina", "embed"), ("ranker", "rerank")], "name string, kind string")
    named = F.get(F.array(F.lit(None).cast("string"), F.lit("e5"), F.lit("jina"), F.lit("ranker"), F.lit("nope")), (F.col("turn") % 5).cast("int"))
    asked = _read(spark, d, "conversations").select("conv_id", "turn", classify.kind_name((F.col("conv_id") % 3).cast("int")).alias("kind"), named.alias("model"))
    return requests.resolved_kinds(asked, models).select("conv_id", "turn", "kind", "model_outcome", "resolved_model")


@query(r"""
    WITH p AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN repeat(' ', (conv_id % 3)::INT) || chr(160) WHEN turn % 7 = 6 THEN '' ELSE text END AS x, CASE WHEN conv_id % 6 = 0 THEN 'unknown_model' ELSE 'ok' END AS model FROM conversations)
    SELECT conv_id, turn, CASE WHEN conv_id % 19 = 0 THEN 'shutdown' WHEN regexp_matches(x, '^[\s\p{Z}]*$') THEN 'blank_input' ELSE model END AS outcome FROM p
""")
def sparse_turn_gates(spark, d):
    """Every turn as a sparse request; some are white space of one kind or another."""
    i, t = F.col("conv_id"), F.col("turn")
    blank = F.concat(F.repeat(F.lit(" "), (i % 3).cast("int")), F.lit("\u00a0"))
    x = F.when(t % 4 == 3, blank).when(t % 7 == 6, F.lit("")).otherwise(F.col("text"))
    model = F.when(i % 6 == 0, "unknown_model").otherwise("ok")
    return _read(spark, d, "conversations").select("conv_id", "turn", requests.sparse_outcome(F.array(F.lit("text"), x), model, i % 19 == 0).alias("outcome"))


_UNIT = "CASE event_id % 9 WHEN 0 THEN '' WHEN 1 THEN 'B' WHEN 2 THEN 'k' WHEN 3 THEN 'KiB' WHEN 4 THEN ' M' WHEN 5 THEN 'MIB' WHEN 6 THEN 'g' WHEN 7 THEN 'GiB' ELSE 'T' END"


@query(f"""
    SELECT event_id, event_id * CASE event_id % 9 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 1024 WHEN 3 THEN 1024 WHEN 4 THEN 1048576 WHEN 5 THEN 1048576 WHEN 6 THEN 1073741824 WHEN 7 THEN 1073741824 END::BIGINT AS bytes,
           CASE WHEN event_id % 4 = 0 AND event_id % 3 = 0 THEN '1 8' WHEN event_id % 4 = 0 THEN (event_id % 3)::VARCHAR WHEN event_id % 3 = 0 THEN (event_id % 4)::VARCHAR WHEN event_id % 4 = event_id % 3 THEN (event_id % 4)::VARCHAR ELSE (event_id % 4) || ' ' || (event_id % 3) END AS sizes,
           coalesce(event_type = 'error', false) AS strict, event_type NOT IN ('view', 'click') AS lenient, least(2.0 * 2.0 ** least(event_id, 30), 60.0) AS backoff, upper(event_type) || '_' || event_id AS env_key
    FROM events
""")
def event_settings(spark, d):
    """Sizes with units, lists of warm-up sizes, flags, delays and keys, made from every event."""
    i, kind = F.col("event_id"), F.col("event_type")
    unit = F.get(F.array(*map(F.lit, ("", "B", "k", "KiB", " M", "MIB", "g", "GiB", "T"))), (i % 9).cast("int"))
    sizes = F.concat((i % 4).cast("string"), F.lit(",nope, "), (i % 3).cast("string"), F.lit(","), (i % 4).cast("string"))
    strict = F.when(kind == "error", "TRUE").otherwise("yes")
    lenient = F.when(kind == "view", " false ").when(kind == "click", "0").otherwise("no")
    return _read(spark, d, "events", "event_id", "event_type").select(
        "event_id", config.byte_count(F.concat(i.cast("string"), unit)).alias("bytes"), F.array_join(config.warm_up_sizes(sizes, [1, 8]), " ").alias("sizes"), config.strict_bool(strict).alias("strict"),
        config.lenient_bool(lenient).alias("lenient"), config.backoff(i).alias("backoff"), config.model_env_key(F.concat(kind, F.lit("-"), i.cast("string"))).alias("env_key"),
    )


@query("""
    SELECT event_id, CASE event_type WHEN 'error' THEN 'queue_overflow' WHEN 'click' THEN 'arena_oom' WHEN 'view' THEN 'kind_mismatch' WHEN 'purchase' THEN 'tokenize' ELSE 'other' END AS worker,
           CASE WHEN event_type = 'click' AND event_id % 2 = 0 THEN 'arena_oom' ELSE 'other' END AS runtime, CASE WHEN event_type = 'click' AND event_id % 2 = 1 THEN event_id % 20 END::INT AS bin_num FROM events
""")
def event_messages(spark, d):
    """The class of the message that each event would have logged."""
    i, kind = F.col("event_id"), F.col("event_type")
    oom = F.when(i % 2 == 0, F.concat(F.lit("arena: Available memory of "), i.cast("string"), F.lit(" is smaller than requested"))).otherwise(F.concat(F.lit("Extending BFCArena for Cpu. bin_num:"), (i % 20).cast("string"), F.lit(" (requested)")))
    said = F.when(kind == "error", "worker Queue Overflow").when(kind == "click", oom).when(kind == "view", "Kind mismatch: embed").when(kind == "purchase", "Tokenizer failed").otherwise(F.concat(F.lit("event "), i.cast("string")))
    return _read(spark, d, "events", "event_id", "event_type").select("event_id", classify.worker_error(said).alias("worker"), classify.runtime_error(said).alias("runtime"), classify.extended_bin(said).alias("bin_num"))


@query("""
    WITH s AS (SELECT p_partkey, 'm' || p_partkey AS name, p_size::BIGINT AS dim, (p_partkey % 4096)::BIGINT AS max_len, p_partkey % 6 AS k FROM part)
    SELECT p_partkey, name, CASE WHEN k <> 1 THEN dim END AS dim, CASE WHEN k <> 2 THEN max_len END AS max_len, CASE WHEN k = 3 THEN 'model.onnx' WHEN k = 4 THEN '../x.onnx' ELSE 'model_quantized.onnx' END AS file, k IN (0, 3) AS valid FROM s
""")
def part_specs(spark, d):
    """Parts as specifications of models, in one of six layouts of which two are right."""
    k, n = F.col("p_partkey") % 6, F.col("p_partkey").cast("string")
    dim, longest = F.col("p_size").cast("string"), (F.col("p_partkey") % 4096).cast("string")
    head = F.concat(F.lit("m"), n, F.lit(":/m/x:"))
    full = F.concat(head, dim, F.lit(":"), longest, F.lit(":0:true"))
    spec = F.when(k == 0, full).when(k == 1, F.concat(head, F.lit("wide:"), longest, F.lit(":0:true"))).when(k == 2, F.concat(head, dim)).when(k == 3, F.concat(full, F.lit(":model.onnx"))).when(k == 4, F.concat(full, F.lit(":../x.onnx"))).otherwise(F.concat(head, dim, F.lit(":"), longest, F.lit(":0:maybe")))
    s = config.embed_spec(spec)
    return _read(spark, d, "part", "p_partkey", "p_size").select("p_partkey", *[s[c].alias(c) for c in ("name", "dim", "max_len", "file", "valid")])
