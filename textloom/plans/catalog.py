"""Every query by name, and DuckDB SQL that gives the same rows.

A query is a thin use of the operators over whole tables; ``@query`` registers it with its SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textloom.functions import classify, config, numeric, text
from textloom.operators import batching, dense, encoders, metrics, requests, rerank, sparse

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Positions that floating results are rounded to, here and in the SQL.
PLACES = 6


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    out = spark.read.parquet(f"{d}/{name}.parquet")
    return out.select(*columns) if columns else out


def _round(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, PLACES)


def _values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _sql_values(rows: list[tuple], names: str) -> str:
    def cell(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).lower()
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)

    return "(VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") AS t({names})"


_WORDS = "list_filter(regexp_split_to_array({t}, '[ \\t\\r\\n]+'), lambda x: x <> '')"
_IDS = "list_transform(" + _WORDS + ", lambda w: (3 + ('0x' || substr(md5(w), 1, 7))::BIGINT % 30519)::INT)"
_SIGMOID = "1.0 / (1.0 + exp(-CASE WHEN isnan({x}) THEN {x} ELSE greatest(-50.0, least(50.0, {x})) END))"
#: Documents of one arrival window: a source's are packed and dispatched a window at a time, so that no task has all of them.
_ARRIVALS = 256
_LENS = f"SELECT source, doc_id // {_ARRIVALS} AS arrival, doc_id, len({_WORDS.format(t='text')})::BIGINT AS len FROM documents"

# ------------------------------------------------------------------ ranking

N_QUERIES, TOP = 5, 10
_LOGITS = f"""
    SELECT q.vec_id AS query_id, d.vec_id, list_dot_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]) * 8 AS logit
    FROM embeddings q, embeddings d WHERE q.vec_id < {N_QUERIES}
"""


def _logits(spark: SparkSession, d: str) -> DataFrame:
    """Logits of every vector for each of the query vectors: a stated query set, sent to all executors."""
    corpus = _read(spark, d, "embeddings", "vec_id", "embedding")
    asked = corpus.where(F.col("vec_id") < N_QUERIES).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return corpus.crossJoin(F.broadcast(asked)).select("query_id", "vec_id", (numeric.dot(F.col("q"), F.col("embedding")) * 8).alias("logit"))


@query(f"""
    SELECT query_id, vec_id, rank, round(relevance_score, {PLACES}) AS relevance_score FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance_score DESC, vec_id)::INT AS rank
        FROM (SELECT *, {_SIGMOID.format(x='logit')} AS relevance_score FROM ({_LOGITS})))
    WHERE rank <= {TOP}
""")
def rerank_topk(spark, d):
    out = rerank.results(_logits(spark, d), ["query_id"], "logit", "vec_id", TOP)
    return out.select("query_id", "vec_id", "rank", _round("relevance_score").alias("relevance_score"))


_TOP_N = [(0, None), (1, 0), (2, 3), (3, 1_000_000), (4, 1)]


@query(f"""
    SELECT query_id, vec_id, rank FROM (
        SELECT l.query_id, vec_id, top_n, row_number() OVER (PARTITION BY l.query_id ORDER BY logit DESC, vec_id)::INT AS rank
        FROM ({_LOGITS}) l JOIN {_sql_values(_TOP_N, 'query_id, top_n')} ON l.query_id = t.query_id)
    WHERE rank <= coalesce(top_n, 2147483647)
""")
def rerank_top_n_variants(spark, d):
    asked = _values(spark, _TOP_N, "query_id long, top_n int")
    scored = _logits(spark, d).join(F.broadcast(asked), "query_id")
    return rerank.ranked(scored, ["query_id"], "logit", "vec_id", F.col("top_n")).select("query_id", "vec_id", "rank")


@query(f"""
    SELECT query_id, vec_id, round(logit * k, {PLACES}) AS raw, round({_SIGMOID.format(x='(logit * k)')}, {PLACES}) AS probability
    FROM ({_LOGITS}), (VALUES (1.0), (100.0), (-100.0)) AS s(k)
""")
def rerank_raw_vs_sigmoid(spark, d):
    scaled = _logits(spark, d).select("query_id", "vec_id", F.explode(F.array(F.lit(1.0), F.lit(100.0), F.lit(-100.0))).alias("k"), "logit")
    x = F.col("logit") * F.col("k")
    return scaled.select("query_id", "vec_id", _round(numeric.calibrated(x, F.lit("none"))).alias("raw"), _round(numeric.calibrated(x, F.lit("sigmoid"))).alias("probability"))


@query(f"""
    WITH d AS (SELECT doc_id, source, text, list_distinct({_IDS.format(t='text')}) AS ids FROM documents),
         q AS (SELECT 'src' || item_id AS source, list_distinct({_IDS.format(t='text')}) AS ids FROM benchmark),
         s AS (SELECT d.source, doc_id, text, len(list_intersect(q.ids, d.ids)) / greatest(len(q.ids), 1)::DOUBLE * 8.0 - 4.0 AS logit FROM d JOIN q ON d.source = q.source),
         r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY logit DESC, doc_id)::INT AS rank FROM s)
    SELECT source, doc_id, rank, round({_SIGMOID.format(x='logit')}, {PLACES}) AS relevance_score,
           CASE WHEN length(source) % 2 = 0 THEN sha256(text) END AS document_sha
    FROM r WHERE rank <= 5
""")
def rerank_echo_documents(spark, d):
    """A request for each source: a benchmark item as the query, its documents, the five best echoed on request."""
    encoder = encoders.HashEncoder()
    asked = _read(spark, d, "benchmark").select(F.concat(F.lit("src"), F.col("item_id").cast("string")).alias("source"), F.col("text").alias("query"))
    pairs = _read(spark, d, "documents", "doc_id", "source", "text").join(asked, "source").withColumn("logit", encoder.pair(F.col("query"), F.col("text")))
    best = rerank.results(pairs.drop("text", "query"), ["source"], "logit", "doc_id", 5)
    # texts meet the few ids that are returned, and don't go through the ranking
    best = best.join(_read(spark, d, "documents", "doc_id", "text"), "doc_id")
    echo = rerank.echoed(F.col("text"), F.char_length("source") % 2 == 0)
    return best.select("source", "doc_id", "rank", _round("relevance_score").alias("relevance_score"), F.sha2(echo["text"], 256).alias("document_sha"))


@query("SELECT lang, sha256(text) AS sha, count(*) AS copies, min(doc_id) AS first_pos FROM documents GROUP BY 1, 2")
def dedup_positions(spark, d):
    return dense.positions(_read(spark, d, "documents", "lang", "text", "doc_id"), ["lang"], "text", "doc_id")


@query("""
    WITH warm AS (SELECT DISTINCT sha256(text) AS sha FROM documents WHERE doc_id % 2 = 0),
         d AS (SELECT source, sha256(text) AS sha FROM documents)
    SELECT source, count(*) FILTER (w.sha IS NOT NULL) AS hits, count(*) FILTER (w.sha IS NULL) AS misses,
           count(DISTINCT CASE WHEN w.sha IS NULL THEN d.sha END) AS pending
    FROM d LEFT JOIN warm w ON d.sha = w.sha GROUP BY source
""")
def cache_partition(spark, d):
    """Every other document's text is in the cache already."""
    docs = _read(spark, d, "documents", "doc_id", "source", "text")
    warm = docs.where(F.col("doc_id") % 2 == 0).select(text.text_hash(F.col("text")).alias("sha"))
    split = dense.partition(docs, warm)
    return split.groupBy("source").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.count_distinct(F.when(~F.col("hit"), F.col("sha"))).alias("pending"))


_DIMS, _LONGEST = 4, 32
_HASHED = f"list_concat([1], list_concat({_IDS.format(t='text')}[1:{_LONGEST - 2}], [2]))"
_COMPONENT = "(('0x' || substr(md5(t::VARCHAR || ':{k}'), 1, 6))::BIGINT::DOUBLE / 8388608.0 - 1.0)"
_POOLED = ", ".join(f"list_sum(list_transform(ids, lambda t: {_COMPONENT.format(k=k)})) / len(ids) AS v{k}" for k in range(_DIMS))


def _scattered_sql(ids: str) -> str:
    return f"""
        WITH i AS (SELECT doc_id, {ids} AS ids FROM documents), p AS (SELECT doc_id, {_POOLED} FROM i),
             n AS (SELECT *, sqrt({' + '.join(f'v{k} * v{k}' for k in range(_DIMS))}) AS size FROM p)
        SELECT doc_id, {', '.join(f'round(v{k} / size, {PLACES}) AS v{k}' for k in range(_DIMS))} FROM n
    """


@query(_scattered_sql(_HASHED))
def scatter_vectors(spark, d):
    """``scatter_vectors_whole`` of texts clipped at ``_LONGEST`` tokens."""
    return _scattered(spark, d, _LONGEST)


@query(_scattered_sql(f"list_concat([1], list_concat({_IDS.format(t='text')}, [2]))"))
def scatter_vectors_whole(spark, d):
    """Each distinct text is encoded once, from all its tokens, and its vector goes to all documents with it; half of them come from the cache."""
    return _scattered(spark, d, (1 << 31) - 1)


def _scattered(spark: SparkSession, d: str, longest: int) -> DataFrame:
    encoder = encoders.HashEncoder(_DIMS, longest)
    docs = _read(spark, d, "documents", "doc_id", "text")
    warm = docs.where(F.col("doc_id") % 2 == 0).select(text.text_hash(F.col("text")).alias("sha"), "text").dropDuplicates(["sha"]).select("sha", encoder.dense(F.col("text")).alias("embedding"))
    out = dense.embed(docs, encoder.dense, warm)
    return out.select("doc_id", *[_round(F.get("embedding", F.lit(k))).alias(f"v{k}") for k in range(_DIMS)])


# ------------------------------------------------------------------ tokens and hashes


@query("""
    SELECT source, sum(greatest(ceil(length(text) / 4.0), 1)::BIGINT)::BIGINT AS total, max(greatest(ceil(length(text) / 4.0), 1)::BIGINT)::BIGINT AS longest
    FROM (SELECT source, text FROM documents UNION ALL SELECT 'conversations', text FROM conversations) GROUP BY 1
""")
def token_estimate(spark, d):
    both = _read(spark, d, "documents", "source", "text").union(_read(spark, d, "conversations").select(F.lit("conversations"), "text"))
    return both.select("source", text.estimated_tokens(F.col("text")).alias("n")).groupBy("source").agg(F.sum("n").alias("total"), F.max("n").alias("longest"))


@query(f"""
    WITH i AS (SELECT doc_id, {_IDS.format(t='text')} AS ids FROM documents)
    SELECT doc_id, len(ids)::INT AS n, least(len(ids), 128)::INT AS kept, len(ids) > 128 AS clipped,
           coalesce(list_sum(ids[1:128]), 0)::BIGINT AS id_sum, md5(array_to_string(ids[1:128], ' ')) AS digest FROM i
""")
def token_ids_clip(spark, d):
    ids = _read(spark, d, "documents").select("doc_id", text.token_ids(F.col("text")).alias("ids")).withColumn("c", text.clip(F.col("ids"), 128))
    return ids.select("doc_id", F.size("ids").alias("n"), F.size("c").alias("kept"), (F.size("ids") > F.size("c")).alias("clipped"), F.aggregate("c", F.lit(0).cast("long"), lambda s, x: s + x).alias("id_sum"), F.md5(F.array_join("c", " ")).alias("digest"))


@query(f"""
    WITH l AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
         m AS (SELECT label, pos, avg(v) AS mean FROM l GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(mean * mean)) AS size FROM m GROUP BY 1)
    SELECT m.label, pos::INT AS pos, round(CASE WHEN size > 0 THEN mean / size ELSE mean END, {PLACES}) AS value FROM m JOIN n ON m.label = n.label
""")
def mean_pool_l2(spark, d):
    return dense.mean_pooled(_read(spark, d, "embeddings", "label", "embedding"), "label", "embedding").select("label", "pos", _round("value").alias("value"))


@query(f"""
    WITH c AS (SELECT label, list_cosine_similarity(embedding::DOUBLE[], list_transform(embedding, lambda x: round(x::DOUBLE, 2))) AS cosine,
                      list_max(list_transform(embedding, lambda x: abs(x::DOUBLE - round(x::DOUBLE, 2)))) AS diff FROM embeddings)
    SELECT label, round(min(cosine), {PLACES}) AS worst_cosine, round(max(diff), {PLACES}) AS worst_diff, count(*) FILTER (cosine < 0.9995)::BIGINT AS failures FROM c GROUP BY label
""")
def cosine_gate(spark, d):
    """Each vector against its rounded twin, joined by row, as an equivalence gate does."""
    rows = _read(spark, d, "embeddings", "vec_id", "label", "embedding")
    twin = rows.select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 2)).alias("other"))
    both = rows.join(twin, "vec_id")
    diff = F.array_max(F.zip_with("embedding", "other", lambda a, b: F.abs(a.cast("double") - b)))
    c = both.select("label", numeric.cosine(F.col("embedding"), F.col("other")).alias("cosine"), diff.alias("diff"))
    return c.groupBy("label").agg(_round(F.min("cosine")).alias("worst_cosine"), _round(F.max("diff")).alias("worst_diff"), F.count_if(F.col("cosine") < 0.9995).alias("failures"))


_TOP_TERMS = f"""
    WITH t AS (SELECT doc_id, unnest({_IDS.format(t='text')}) AS term FROM documents), w AS (SELECT doc_id, term, ln(1.0 + count(*)) AS weight FROM t GROUP BY 1, 2),
         r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term)::INT AS rank FROM w WHERE weight > 0.7)
"""


def _top_terms(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, rank, term, weight): the eight heaviest terms of each text; a text's words are counted where they are read, and its distinct terms are shuffled."""
    terms = _read(spark, d, "documents", "doc_id", "text").select("doc_id", F.explode(text.token_ids(F.col("text"))).alias("term"))
    weights = terms.groupBy("doc_id", "term").agg(F.log(F.lit(1.0) + F.count(F.lit(1))).alias("weight"))
    return sparse.top_terms(weights, "doc_id", 8, 0.7)


def _top_pairs(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, p): those as one array a text, in order."""
    rows = _top_terms(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", "term", "weight"))).alias("p"))
    return rows.select("doc_id", F.transform("p", lambda x: F.struct(x["term"].alias("term"), x["weight"].alias("weight"))).alias("p"))


@query(_TOP_TERMS + f"SELECT doc_id, rank, term, round(weight, {PLACES}) AS weight FROM r WHERE rank <= 8")
def sparse_topk(spark, d):
    return _top_terms(spark, d).select("doc_id", "rank", "term", _round("weight").alias("weight"))


@query(_TOP_TERMS + f"""SELECT doc_id, string_agg(term::VARCHAR, ' ' ORDER BY rank) AS indices, round(sum(weight), {PLACES}) AS weight_sum, count(*)::INT AS n
    FROM r WHERE rank <= 8 GROUP BY doc_id""")
def sparse_unzip(spark, d):
    out = sparse.unzipped(_top_pairs(spark, d), "doc_id", "p")
    return out.select("doc_id", F.array_join("indices", " ").alias("indices"), _round(F.aggregate("values", F.lit(0.0), lambda s, x: s + x)).alias("weight_sum"), F.size("values").alias("n"))


@query(_TOP_TERMS + """, p AS (SELECT doc_id, term, weight, row_number() OVER (PARTITION BY doc_id ORDER BY rank) AS k FROM r WHERE rank <= 8 AND weight > 1.2)
    SELECT doc_id, string_agg(term::VARCHAR, ' ' ORDER BY k) AS indices FROM p WHERE k <= 3 GROUP BY doc_id""")
def sparse_retruncate(spark, d):
    """The first three of the returned pairs that are over a higher threshold."""
    kept = _top_pairs(spark, d).withColumn("p", sparse.truncated(F.col("p"), F.lit(3), F.lit(1.2))).where(F.size("p") > 0)
    return kept.select("doc_id", F.array_join(F.transform("p", lambda x: x["term"]), " ").alias("indices"))


@query("""
    WITH p AS (SELECT conv_id, turn, role, text, lead(text) OVER w AS answer, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT conv_id, turn, sha256(text || chr(0) || answer) AS pair_sha FROM p WHERE role = 'user' AND next_role = 'assistant'
""")
def pair_hash(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = _read(spark, d, "conversations").withColumns({"answer": F.lead("text").over(w), "next_role": F.lead("role").over(w)})
    return rows.where((F.col("role") == "user") & (F.col("next_role") == "assistant")).select("conv_id", "turn", text.pair_hash(F.col("text"), F.col("answer")).alias("pair_sha"))


@query("""SELECT doc_id, sha256(text) AS sha, CASE WHEN doc_id % 2 = 0 THEN 'm:query' ELSE 'm' END AS cache_key FROM documents""")
def text_hash(spark, d):
    kind = F.when(F.col("doc_id") % 2 == 0, "query").otherwise("document")
    return _read(spark, d, "documents").select("doc_id", text.text_hash(F.col("text")).alias("sha"), text.cache_key(F.lit("m"), kind).alias("cache_key"))


@query("""
    WITH p AS (SELECT conv_id, sha256(a.text || chr(0) || b.text) AS sha FROM conversations a JOIN conversations b USING (conv_id) WHERE a.turn = 0 AND b.turn > 0),
         warm AS (SELECT DISTINCT sha FROM p WHERE conv_id % 3 = 0)
    SELECT conv_id, count(*) AS pairs, count(*) FILTER (warm.sha IS NOT NULL) AS hits FROM p LEFT JOIN warm ON p.sha = warm.sha GROUP BY conv_id
""")
def token_cache(spark, d):
    """Pairs of a conversation's first turn with each later one; the pairs of every third conversation are cached."""
    rows = _read(spark, d, "conversations", "conv_id", "turn", "text")
    first = rows.where("turn = 0").select("conv_id", F.col("text").alias("query"))
    pairs = rows.where("turn > 0").join(first, "conv_id").select("conv_id", text.pair_hash(F.col("query"), F.col("text")).alias("sha"))
    warm = pairs.where(F.col("conv_id") % 3 == 0).select("sha").distinct().withColumn("hit", F.lit(True))
    return pairs.join(warm, "sha", "left").groupBy("conv_id").agg(F.count(F.lit(1)).alias("pairs"), F.count("hit").alias("hits"))


# ------------------------------------------------------------------ batch planning

_REQUEST = 32


@query(f"""
    WITH RECURSIVE l AS ({_LENS}), q AS (SELECT *, (row_number() OVER (PARTITION BY source, arrival ORDER BY doc_id) - 1) // {_REQUEST} AS request FROM l),
    o AS (SELECT source, arrival, request, doc_id, greatest(len, 1) AS n, row_number() OVER (PARTITION BY source, arrival, request ORDER BY len DESC, doc_id) AS rn FROM q),
    r(source, arrival, request, doc_id, rn, grp, widest) AS (
        SELECT source, arrival, request, doc_id, rn, 0, n FROM o WHERE rn = 1
        UNION ALL
        SELECT o.source, o.arrival, o.request, o.doc_id, o.rn, CASE WHEN r.widest > 2 * o.n THEN grp + 1 ELSE grp END, CASE WHEN r.widest > 2 * o.n THEN o.n ELSE r.widest END
        FROM r JOIN o ON o.source = r.source AND o.arrival = r.arrival AND o.request = r.request AND o.rn = r.rn + 1)
    SELECT source, doc_id, grp::INT AS group_no FROM r
""")
def subbatch_plan(spark, d):
    """Requests of up to 32 documents of a source's arrival window; each is split into groups of like length."""
    from pyspark.sql import Window

    lens = _lengths(spark, d)
    numbered = lens.withColumn("request", F.floor((F.row_number().over(Window.partitionBy("source", "arrival").orderBy("doc_id")) - 1) / _REQUEST))
    asked = numbered.groupBy("source", "arrival", "request").agg(F.array_sort(F.collect_list(F.struct("doc_id", "len"))).alias("x"))
    plan = asked.select("source", "x", F.explode(batching.sub_batches(F.transform("x", lambda i: i["len"]), F.lit(2.0))).alias("g"))
    return plan.select("source", F.get("x", F.col("g.pos"))["doc_id"].alias("doc_id"), F.col("g.group").alias("group_no"))


def _arrival() -> Column:
    return F.floor(F.col("doc_id") / _ARRIVALS).alias("arrival")


def _lengths(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "documents").select("source", _arrival(), "doc_id", F.size(text.words(F.col("text"))).cast("long").alias("len"))


_BUDGETS = {
    "pack_padded": batching.Budget(4_096, 8, 1_000),
    "pack_ragged": batching.Budget(4_096, 32, 1_000, padded=False),
    "pack_ratio": batching.Budget(8_192, 16, 2_000, length_ratio=1.5),
}


def _packed_sql(b: batching.Budget, lens: str = _LENS) -> str:
    load = "greatest(r.mx, d.len) * (r.items + 1)" if b.padded else "r.total + d.len"
    now = "r.mx * r.items" if b.padded else "r.total"
    ratio = f" OR (r.mx > 0 AND d.len > r.mx * {b.length_ratio})" if b.padded and b.length_ratio > 0 else ""
    return f"""
        WITH RECURSIVE d AS (SELECT *, row_number() OVER (PARTITION BY source, arrival ORDER BY doc_id) AS rn FROM ({lens})),
        r(source, arrival, doc_id, rn, len, batch, head, carried, items, mx, total) AS (
            SELECT source, arrival, doc_id, rn, len, 1, true, false, 1::BIGINT, len, len FROM d WHERE rn = 1
            UNION ALL
            SELECT d.source, d.arrival, d.doc_id, d.rn, d.len, CASE WHEN f.refused THEN r.batch + 1 ELSE r.batch END, f.refused, f.refused AND NOT f.saturated,
                   CASE WHEN f.refused THEN 1 ELSE r.items + 1 END, CASE WHEN f.refused THEN d.len ELSE greatest(r.mx, d.len) END, CASE WHEN f.refused THEN d.len ELSE r.total + d.len END
            FROM r JOIN d ON d.source = r.source AND d.arrival = r.arrival AND d.rn = r.rn + 1,
                 LATERAL (SELECT greatest(r.mx, d.len) > {b.longest}{ratio} OR r.items + 1 > {b.items} OR {load} >= {b.tokens} AS refused,
                                 r.items >= {b.items} OR {now} >= {b.tokens} AS saturated) f),
        p AS (SELECT source, arrival, doc_id, len, batch, head, carried,
                     CASE WHEN head AND 1 > {b.items} THEN 'exceeds_batch_max_items' WHEN head AND len >= {b.tokens} THEN 'exceeds_max_batch_tokens' WHEN head AND len > {b.longest} THEN 'solo_seq_overflow' END AS reason FROM r)
    """


_STREAM = ["source", "arrival"]


def _packed(spark: SparkSession, d: str, name: str) -> DataFrame:
    return batching.packed(_lengths(spark, d), _STREAM, ["doc_id"], _BUDGETS[name])


def _pack_query(name: str) -> None:
    def f(spark: SparkSession, d: str) -> DataFrame:
        return _packed(spark, d, name).select("source", "arrival", "doc_id", "batch", "head", "carried", "reason")

    f.__name__ = name
    query(_packed_sql(_BUDGETS[name]) + "SELECT source, arrival, doc_id, batch::INT AS batch, head, carried, reason FROM p")(f)


for _name in _BUDGETS:
    _pack_query(_name)

_BATCHES = ", b AS (SELECT source, arrival, batch, count(*) AS items, max(len) AS mx, sum(len)::BIGINT AS total FROM p GROUP BY 1, 2, 3)"
_WIDTH = "(CASE WHEN mx <= 1 THEN 1 ELSE least(1024, (2 ** length(bin(mx - 1)))::BIGINT) END)::BIGINT"


@query(_packed_sql(_BUDGETS["pack_padded"]) + _BATCHES + f"""
    SELECT source, count(*) AS batches, round(avg(CASE WHEN mx * items = 0 THEN 0 ELSE greatest(0, least(1, (mx * items - total)::DOUBLE / (mx * items))) END), {PLACES}) AS waste,
           round(avg(CASE WHEN {_WIDTH} * items = 0 THEN 0 ELSE greatest(0, least(1, ({_WIDTH} * items - total)::DOUBLE / ({_WIDTH} * items))) END), {PLACES}) AS rounded_waste
    FROM b GROUP BY source
""")
def padding_waste(spark, d):
    """Share of padding of each batch: by the longest item, and by the width rounded up."""
    b = batching.batches(_packed(spark, d, "pack_padded"), _STREAM)
    area = F.col("max_len") * F.col("items")
    rounded = numeric.rounded_width(F.col("max_len"), F.lit(1024).cast("long")) * F.col("items")
    return b.groupBy("source").agg(F.count(F.lit(1)).alias("batches"), _round(F.avg(numeric.waste(area, F.col("total")))).alias("waste"), _round(F.avg(numeric.waste(rounded, F.col("total")))).alias("rounded_waste"))


@query(_packed_sql(_BUDGETS["pack_padded"]) + _BATCHES + "SELECT source, arrival, batch::INT AS batch, items::DOUBLE * 12 * mx * mx * 4 AS scratch_bytes, items * mx AS token_budget FROM b")
def attention_scratch(spark, d):
    b = batching.batches(_packed(spark, d, "pack_padded"), _STREAM)
    return b.select(*_STREAM, "batch", numeric.attention_bytes(F.col("items"), numeric.heads_of(F.lit("stand-in")), F.col("max_len")).alias("scratch_bytes"), (F.col("items") * F.col("max_len")).alias("token_budget"))


@query(_packed_sql(_BUDGETS["pack_ragged"]) + _BATCHES + """
    SELECT CASE WHEN items < 1 OR items > 16 THEN '32+' WHEN items <= 1 THEN '1' WHEN items <= 2 THEN '2' WHEN items <= 4 THEN '4' WHEN items <= 8 THEN '8' ELSE '16' END AS batch_size_bucket,
           CASE WHEN mx <= 64 THEN '64' WHEN mx <= 128 THEN '128' WHEN mx <= 256 THEN '256' WHEN mx <= 384 THEN '384' ELSE '512+' END AS seq_len_bucket, count(*) AS total
    FROM b GROUP BY 1, 2
""")
def batch_dimensions(spark, d):
    b = batching.batches(_packed(spark, d, "pack_ragged"), _STREAM)
    labelled = b.select(numeric.batch_bucket(F.col("items")).alias("batch_size_bucket"), numeric.width_bucket(F.col("max_len")).alias("seq_len_bucket"))
    return metrics.counter(labelled, ["batch_size_bucket", "seq_len_bucket"])


@query(_packed_sql(_BUDGETS["pack_ratio"]) + "SELECT source, count(*) FILTER (carried) AS carries, count(*) FILTER (reason IS NOT NULL) AS oversize, count(*) FILTER (head) AS batches FROM p GROUP BY source")
def carry_counts(spark, d):
    return _packed(spark, d, "pack_ratio").groupBy("source").agg(F.count_if("carried").alias("carries"), F.count("reason").alias("oversize"), F.count_if("head").alias("batches"))


_PAD_WIDTH = 12


@query(f"""
    WITH i AS (SELECT doc_id, ({_IDS.format(t='text')})[1:{_PAD_WIDTH}] AS ids FROM documents)
    SELECT doc_id, array_to_string(list_concat(ids, list_transform(range({_PAD_WIDTH} - len(ids)), lambda x: 0)), ' ') AS ids,
           array_to_string(list_transform(range({_PAD_WIDTH}), lambda j: CASE WHEN j < len(ids) THEN 1 ELSE 0 END), ' ') AS mask, len(ids)::INT AS ones FROM i
""")
def pad_mask(spark, d):
    ids = _read(spark, d, "documents").select("doc_id", text.clip(text.token_ids(F.col("text")), _PAD_WIDTH).alias("ids"))
    filled = ids.select("doc_id", text.padded(F.col("ids"), F.lit(_PAD_WIDTH)).alias("p"), text.mask(F.col("ids"), F.lit(_PAD_WIDTH)).alias("m"))
    return filled.select("doc_id", F.array_join("p", " ").alias("ids"), F.array_join("m", " ").alias("mask"), text.leading_ones(F.col("m")).alias("ones"))


@query(_packed_sql(_BUDGETS["pack_padded"]) + f""", i AS (SELECT doc_id, {_IDS.format(t='text')} AS ids FROM documents), w AS (SELECT source, arrival, batch, max(len) AS width FROM p GROUP BY 1, 2, 3)
    SELECT p.source, p.arrival, p.doc_id, p.batch::INT AS batch, width::INT AS width, array_to_string(list_concat(ids, list_transform(range(width - len(ids)), lambda x: 0)), ' ') AS ids,
           array_to_string(list_transform(range(width), lambda j: CASE WHEN j < len(ids) THEN 1 ELSE 0 END), ' ') AS mask, len(ids)::INT AS ones
    FROM p JOIN i ON p.doc_id = i.doc_id JOIN w ON p.source = w.source AND p.arrival = w.arrival AND p.batch = w.batch
""")
def pad_mask_whole(spark, d):
    """All tokens of each document, padded to the longest of its batch."""
    ids = _read(spark, d, "documents").select("source", _arrival(), "doc_id", text.token_ids(F.col("text")).alias("ids"))
    placed = ids.join(_packed(spark, d, "pack_padded").select(*_STREAM, "doc_id", "batch"), [*_STREAM, "doc_id"])
    widths = placed.groupBy(*_STREAM, "batch").agg(F.max(F.size("ids")).alias("width"))
    filled = placed.join(widths, [*_STREAM, "batch"]).select(*_STREAM, "doc_id", "batch", "width", text.padded(F.col("ids"), F.col("width")).alias("p"), text.mask(F.col("ids"), F.col("width")).alias("m"))
    return filled.select(*_STREAM, "doc_id", "batch", "width", F.array_join("p", " ").alias("ids"), F.array_join("m", " ").alias("mask"), text.leading_ones(F.col("m")).alias("ones"))


@query(f"SELECT source, doc_id, ((row_number() OVER (PARTITION BY source, doc_id // {_ARRIVALS} ORDER BY doc_id) - 1) % 3)::INT AS slot FROM documents")
def round_robin(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("source", _arrival()).orderBy("doc_id")
    return _read(spark, d, "documents").select("source", "doc_id", F.pmod(F.row_number().over(w) - 1, F.lit(3)).alias("slot"))


# ------------------------------------------------------------------ requests

_MODELS = [("e5", "embed"), ("jina", "embed"), ("ranker", "rerank")]
_ASKED = [(1, "ranker", "rerank"), (2, None, "rerank"), (3, "nope", "rerank"), (4, None, "embed"), (5, "jina", "embed"), (6, None, "splade"), (7, "x", "splade")]


@query(f"""
    SELECT id, t.kind, CASE WHEN t.model IS NOT NULL AND m.name IS NOT NULL THEN 'ok' WHEN t.model IS NOT NULL THEN 'unknown_model' WHEN n = 1 THEN 'ok' WHEN n = 0 THEN 'no_model' ELSE 'model_required' END AS model_outcome,
           CASE WHEN t.model IS NOT NULL THEN m.name WHEN n = 1 THEN lone END AS resolved_model
    FROM {_sql_values(_ASKED, 'id, model, kind')} LEFT JOIN (SELECT * FROM {_sql_values(_MODELS, 'name, kind')}) m ON t.model = m.name AND t.kind = m.kind,
         LATERAL (SELECT count(*) AS n, min(name) AS lone FROM {_sql_values(_MODELS, 'name, kind').replace('AS t', 'AS c')} WHERE c.kind = t.kind)
""")
def model_resolution(spark, d):
    models, asked = _values(spark, _MODELS, "name string, kind string"), _values(spark, _ASKED, "id int, model string, kind string")
    parts = [requests.resolved(asked.where(F.col("kind") == k), models, k) for k in classify.KINDS[:0] + ("embed", "rerank", "splade")]
    out = parts[0].union(parts[1]).union(parts[2])
    return out.select("id", "kind", "model_outcome", "resolved_model")


_GATE_CASE = """CASE WHEN conv_id % 17 = 0 THEN 'shutdown' WHEN n <= 0 THEN 'empty_input' WHEN n > 8 THEN 'input_array_too_large' WHEN conv_id % 11 = 0 THEN 'unknown_model' ELSE 'ok' END"""


@query(f"""
    WITH g AS (SELECT conv_id, count(*) FILTER (role = 'user') AS n FROM conversations GROUP BY conv_id), o AS (SELECT conv_id, n, {_GATE_CASE} AS outcome FROM g)
    SELECT conv_id, n::INT AS n, outcome, CASE outcome WHEN 'ok' THEN 200 WHEN 'shutdown' THEN 503 ELSE 400 END::INT AS status,
           CASE outcome WHEN 'ok' THEN NULL WHEN 'shutdown' THEN 'rate_limited' ELSE 'invalid_request_error' END AS type, CASE outcome WHEN 'shutdown' THEN 5 END::INT AS retry_after FROM o
""")
def request_gates(spark, d):
    """A conversation's user turns as one embedding request."""
    asked = _read(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.when(F.col("role") == "user", F.col("text"))).alias("input"))
    outcome = requests.embed_outcome(F.col("input"), F.col("conv_id") % 11 != 0, F.col("conv_id") % 17 == 0, cap=8)
    out = asked.withColumn("outcome", outcome)
    s = requests.status(F.col("outcome"))
    return out.select("conv_id", F.size("input").alias("n"), "outcome", s["status"].alias("status"), s["type"].alias("type"), s["retry_after"].alias("retry_after"))


@query(r"""
    WITH r AS (SELECT conv_id, min(CASE WHEN turn = 0 THEN text END) AS query, count(*) FILTER (turn > 0) AS n FROM conversations GROUP BY conv_id)
    SELECT conv_id, n::INT AS n, CASE WHEN conv_id % 13 = 0 THEN 'semaphore' WHEN conv_id % 17 = 0 THEN 'shutdown' WHEN query IS NULL OR regexp_matches(query, '^[\s\p{Z}]*$') THEN 'blank_query' WHEN n = 0 THEN 'no_documents'
        WHEN n > 6 THEN 'documents_too_many' WHEN conv_id % 11 = 0 THEN 'unknown_model' ELSE 'ok' END AS outcome FROM r
""")
def rerank_gates(spark, d):
    rows = _read(spark, d, "conversations")
    asked = rows.groupBy("conv_id").agg(F.min(F.when(F.col("turn") == 0, F.col("text"))).alias("query"), F.collect_list(F.when(F.col("turn") > 0, F.col("text"))).alias("docs"))
    model = F.when(F.col("conv_id") % 11 == 0, "unknown_model").otherwise("ok")
    outcome = requests.rerank_outcome(F.col("query"), F.col("docs"), model, F.col("conv_id") % 17 == 0, F.col("conv_id") % 13 == 0, cap=6)
    return asked.select("conv_id", F.size("docs").alias("n"), outcome.alias("outcome"))


_BLANKS = [(1, "", "ok"), (2, "  \t\n", "ok"), (3, "\u00a0", "ok"), (4, "\u3000 \u00a0", "ok"), (5, "\u200b", "ok"), (6, " a ", "ok"), (7, "a", "unknown_model")]


@query(rf"""SELECT id, CASE WHEN regexp_matches(x, '^[\s\p{{Z}}]*$') THEN 'blank_input' WHEN model <> 'ok' THEN model ELSE 'ok' END AS outcome FROM {_sql_values(_BLANKS, 'id, x, model')}""")
def sparse_gates(spark, d):
    asked = _values(spark, _BLANKS, "id int, x string, model string")
    return asked.select("id", requests.sparse_outcome(F.array(F.lit("text"), F.col("x")), F.col("model"), F.lit(False)).alias("outcome"))


_JSON = [
    (1, '{"input": "single"}', 1, "float", "document", True), (2, '{"input": ["a", "b", "c"]}', 3, "float", "document", True),
    (3, '{"input": "hello world", "model": "e5", "input_type": "query"}', 1, "float", "query", True), (4, '{"input": [], "encoding_format": "base64"}', 0, "base64", "document", True),
    (5, '{"input": ["x"], "encoding_format": "hex"}', 1, "hex", "document", False), (6, "not json", None, "float", "document", False),
]


@query(f"SELECT id, n::INT AS n, f AS encoding_format, t AS input_type, ok AS valid FROM {_sql_values([(i, n, f, t, ok) for i, _, n, f, t, ok in _JSON], 'id, n, f, t, ok')}")
def request_parse(spark, d):
    rows = _values(spark, [(i, j) for i, j, *_ in _JSON], "id int, json string")
    out = requests.parsed(rows, "json", "embed")
    return out.select("id", F.when(F.col("input").isNotNull(), F.size("input")).alias("n"), "encoding_format", "input_type", "valid")


# ------------------------------------------------------------------ settings and messages

_SPECS = [
    (1, "e5:/m/e5:1024:512:1:false"), (2, "jina:/m/j:768:8192:0:1:model.onnx"), (3, "bad:/m:x:512:0:true"), (4, "few:/m:8"), (5, "p:/m:8:16:0:true:../x.onnx"), (6, " trim:/m:8:16:0:0 "),
]
_SPEC_OUT = [(1, "e5", 1024, 512, "model_quantized.onnx", True), (2, "jina", 768, 8192, "model.onnx", True), (3, "bad", None, 512, "model_quantized.onnx", False), (4, "few", 8, None, "model_quantized.onnx", False), (5, "p", 8, 16, "../x.onnx", False), (6, "trim", 8, 16, "model_quantized.onnx", True)]


@query(f"SELECT id, name, dim::BIGINT AS dim, max_len::BIGINT AS max_len, file, valid FROM {_sql_values(_SPEC_OUT, 'id, name, dim, max_len, file, valid')}")
def spec_parse(spark, d):
    s = config.embed_spec(F.col("spec"))
    return _values(spark, _SPECS, "id int, spec string").select("id", *[s[c].alias(c) for c in ("name", "dim", "max_len", "file", "valid")])


_NUMBERS = [(1, "5"), (2, "0"), (3, " 7 "), (4, "x"), (5, ""), (6, None), (7, "-3"), (8, "2.5")]
_INT = "CASE WHEN regexp_matches(trim(s), '^[+]?[0-9]+$') THEN try_cast(trim(s) AS BIGINT) END"


@query(f"""
    SELECT id, CASE WHEN {_INT} > 0 THEN {_INT} ELSE 16384 END::BIGINT AS positive, coalesce({_INT}, 10000)::BIGINT AS zero_ok, CASE WHEN {_INT} BETWEEN 0 AND 2 THEN {_INT} ELSE 3 END::INT AS level,
           CASE WHEN try_cast(trim(s) AS DOUBLE) >= 0 THEN try_cast(trim(s) AS DOUBLE) ELSE 2.0 END AS ratio,
           coalesce(CASE WHEN {_INT} > 0 THEN {_INT} END, 16)::BIGINT AS overlaid
    FROM {_sql_values(_NUMBERS, 'id, s')}
""")
def number_settings(spark, d):
    s = F.col("s")
    return _values(spark, _NUMBERS, "id int, s string").select(
        "id", config.positive_or(s, config.POSITIVE_DEFAULTS["batch_max_tokens"]).alias("positive"), config.zero_or_more(s, config.ZERO_DEFAULTS["cache_max_entries"]).alias("zero_ok"),
        config.optimisation_level(s).alias("level"), config.ratio_or(s).alias("ratio"), config.waiter_cap(s, F.lit(None).cast("string"), F.lit(2)).alias("overlaid"),
    )


_SIZES = [(1, "1,5", "1 5"), (2, "3,5,3", "3 5"), (3, "0,1,5", "1 5"), (4, "1,nope,5", "1 5"), (5, "garbage", "1 8"), (6, None, "1 8")]


@query(f"SELECT id, sizes FROM {_sql_values([(i, o) for i, _, o in _SIZES], 'id, sizes')}")
def warmup_sizes(spark, d):
    rows = _values(spark, [(i, s) for i, s, _ in _SIZES], "id int, s string")
    return rows.select("id", F.array_join(config.warm_up_sizes(F.col("s"), [1, 8]), " ").alias("sizes"))


_BYTES = [(1, "5", 5), (2, "1K", 1024), (3, "2MiB", 2 << 20), (4, "3g", 3 << 30), (5, "1 KiB", 1024), (6, "x", None), (7, "1T", None), (8, "12B", 12)]


@query(f"SELECT id, bytes::BIGINT AS bytes FROM {_sql_values([(i, b) for i, _, b in _BYTES], 'id, bytes')}")
def bytes_suffix(spark, d):
    return _values(spark, [(i, s) for i, s, _ in _BYTES], "id int, s string").select("id", config.byte_count(F.col("s")).alias("bytes"))


_FLAGS = [(1, "true"), (2, "1"), (3, "TRUE"), (4, "false"), (5, "0"), (6, "typo"), (7, None), (8, "")]


@query(f"""SELECT id, coalesce(lower(s) IN ('true', '1'), false) AS multi, NOT coalesce(trim(s) IN ('false', '0'), false) AS pattern, coalesce(lower(trim(s)) IN ('1', 'true', 'yes'), false) AS spin,
    upper(replace('jina-v' || id, '-', '_')) AS env_key FROM {_sql_values(_FLAGS, 'id, s')}""")
def flag_settings(spark, d):
    s = F.col("s")
    return _values(spark, _FLAGS, "id int, s string").select("id", config.strict_bool(s).alias("multi"), config.lenient_bool(s).alias("pattern"), config.spinning(s).alias("spin"), config.model_env_key(F.concat(F.lit("jina-v"), F.col("id").cast("string"))).alias("env_key"))


@query("""
    SELECT id::INT AS id, least(2.0 * 2.0 ** least(id, 30), 60.0) AS backoff, CASE WHEN 65530 + id <= 65535 THEN 65530 + id END::INT AS port, greatest(16, id * 2 * 8)::BIGINT AS semaphore, (id * 10 < 30) AS inert FROM range(10) t(id)
""")
def worker_settings(spark, d):
    i = F.col("id").cast("int")
    return spark.range(10).select(i.alias("id"), config.backoff(i).alias("backoff"), config.metrics_port(F.lit(65_530), i).alias("port"), config.semaphore_cap(F.lit(None).cast("string"), i, F.lit(2)).alias("semaphore"), config.window_is_inert(i * 10, F.lit(30)).alias("inert"))


_MESSAGES = [
    "Queue Overflow at worker", "semaphore closed", "worker SATURATED", "BFCArena failed", "process OOM", "kind mismatch: embed", "Tokenizer failed", "boom", "queue overflow, arena",
    "Available memory of 10 is smaller than requested bytes of 20", "Extending BFCArena for Cpu. bin_num:14 (requested) num_bytes: 5", "Extending BFCArena bin_num:", "bin_num:3",
]
_MESSAGE_ROWS = list(enumerate(_MESSAGES))


@query(f"""
    SELECT id, CASE WHEN contains(l, 'queue overflow') THEN 'queue_overflow' WHEN contains(l, 'semaphore closed') THEN 'semaphore_closed' WHEN contains(l, 'saturated') THEN 'worker_saturated'
        WHEN contains(l, 'arena') OR contains(l, 'oom') THEN 'arena_oom' WHEN contains(l, 'kind mismatch') THEN 'kind_mismatch' WHEN contains(l, 'tokeniz') THEN 'tokenize' ELSE 'other' END AS worker,
        CASE WHEN contains(m, 'Available memory of') AND contains(m, 'smaller than requested') THEN 'arena_oom' ELSE 'other' END AS runtime,
        CASE WHEN contains(m, 'Extending BFCArena') THEN try_cast(nullif(regexp_extract(m, 'bin_num:([0-9]+)', 1), '') AS INT) END AS bin_num
    FROM (SELECT id, m, lower(m) AS l FROM {_sql_values(_MESSAGE_ROWS, 'id, m')})
""")
def classify_errors(spark, d):
    m = F.col("m")
    return _values(spark, _MESSAGE_ROWS, "id int, m string").select("id", classify.worker_error(m).alias("worker"), classify.runtime_error(m).alias("runtime"), classify.extended_bin(m).alias("bin_num"))


@query(r"""
    SELECT event_id, try_cast(nullif(regexp_extract('Name: x' || chr(10) || 'VmRSS:' || chr(9) || event_id || ' kB' || chr(10), 'VmRSS:\s+([0-9]+)', 1), '') AS BIGINT) * 1024 AS rss_bytes FROM events
""")
def resident_memory(spark, d):
    status = F.concat(F.lit("Name: x\nVmRSS:\t"), F.col("event_id").cast("string"), F.lit(" kB\n"))
    return _read(spark, d, "events").select("event_id", classify.resident_bytes(status).alias("rss_bytes"))


# ------------------------------------------------------------------ telemetry

_LADDER = metrics.ladder("embed_batch_wait_ms")
_LE = [(f"{b:g}", b) for b in _LADDER] + [("+Inf", None)]


@query(f"""
    SELECT event_type, le, count(*) FILTER (bound IS NULL OR value <= bound) AS count, count(value) AS n, round(sum(value), 2) AS sum
    FROM events, {_sql_values(_LE, 'le, bound')} GROUP BY 1, 2
""")
def metric_histogram(spark, d):
    out = metrics.histogram(_read(spark, d, "events", "event_type", "value"), ["event_type"], "value", _LADDER)
    return out.select("event_type", "le", "count", "n", F.round("sum", 2).alias("sum"))


@query("SELECT event_type, user_id % 7 AS shard, count(*) AS total FROM events GROUP BY 1, 2")
def metric_counter(spark, d):
    return metrics.counter(_read(spark, d, "events").select("event_type", (F.col("user_id") % 7).alias("shard")), ["event_type", "shard"])


@query("SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2")
def metric_gauge(spark, d):
    return metrics.gauge(_read(spark, d, "events", "user_id", "event_type", "value", "ts", "event_id"), ["user_id", "event_type"], "value", ["ts", "event_id"])


@query("""
    SELECT 'embed_requests_total{event_type="' || event_type || '",shard="' || (user_id % 7) || '"} ' || count(*) AS value FROM events GROUP BY event_type, user_id % 7
""")
def metric_exposition(spark, d):
    return metrics.exposition(metric_counter(spark, d), F.lit("embed_requests_total"), ["event_type", "shard"], F.col("total"))


@query("""
    SELECT event_id, (sum(CASE WHEN user_id % 2 = 0 THEN 1 ELSE -1 END) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS running FROM events
""")
def in_flight(spark, d):
    """Even users enter, odd ones leave."""
    rows = _read(spark, d, "events").select("event_id", "event_type", "ts", F.when(F.col("user_id") % 2 == 0, 1).otherwise(-1).cast("long").alias("delta"))
    return metrics.running_total(rows, ["event_type"], ["ts", "event_id"], "delta", F.date_trunc("hour", "ts")).select("event_id", "running")


@query(f"""
    WITH v AS (SELECT event_type, list_sort(list(value)) AS x FROM events WHERE value IS NOT NULL GROUP BY 1)
    SELECT event_type, len(x)::BIGINT AS n, round(list_avg(x), {PLACES}) AS mean, x[len(x)] AS worst, x[greatest(0, least(len(x) - 1, floor(len(x) * 0.5)::BIGINT)) + 1] AS p50,
           x[greatest(0, least(len(x) - 1, floor(len(x) * 0.9)::BIGINT)) + 1] AS p90, x[greatest(0, least(len(x) - 1, floor(len(x) * 0.99)::BIGINT)) + 1] AS p99 FROM v
""")
def latency_summary(spark, d):
    out = metrics.latency_summary(_read(spark, d, "events", "event_type", "value"), ["event_type"], "value")
    return out.select("event_type", "n", _round("mean").alias("mean"), "worst", "p50", "p90", "p99")


_QUEUE = 20


@query(f"""
    WITH RECURSIVE e AS (SELECT event_id, user_id, value > 5 AS arrives, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    r(user_id, event_id, rn, depth, rejected, after) AS (
        SELECT user_id, event_id, rn, 0, false, CASE WHEN arrives THEN 1 ELSE 0 END FROM e WHERE rn = 1
        UNION ALL
        SELECT e.user_id, e.event_id, e.rn, r.after, e.arrives AND r.after >= {_QUEUE * 8 // 10}, CASE WHEN NOT e.arrives THEN greatest(0, r.after - 1) WHEN r.after >= {_QUEUE * 8 // 10} THEN r.after ELSE r.after + 1 END
        FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)
    SELECT event_id, depth::INT AS depth, rejected FROM r
""")
def queue_backpressure(spark, d):
    """A queue for each user: large values arrive, small ones are served."""
    rows = _read(spark, d, "events").select("event_id", "user_id", "ts", (F.col("value") > 5).alias("arrives"))
    return batching.backpressure(rows, ["user_id"], ["ts", "event_id"], "arrives", _QUEUE).select("event_id", "depth", "rejected")


_PROBE = "CASE WHEN event_type = 'view' THEN 'ok' WHEN event_type = 'purchase' THEN 'success' WHEN event_type = 'signup' THEN 'none' WHEN event_type = 'error' THEN 'error' ELSE 'timeout' END"


@query(f"""
    WITH RECURSIVE e AS (SELECT event_id, user_id, epoch(ts) AS secs, {_PROBE} AS result, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    r(user_id, event_id, rn, label, shown, last, fails) AS (
        SELECT user_id, event_id, rn, result, CASE WHEN result IN ('error', 'timeout') THEN 1 ELSE 0 END, CASE WHEN result IN ('ok', 'success') THEN secs END, CASE WHEN result IN ('error', 'timeout') THEN 1 ELSE 0 END FROM e WHERE rn = 1
        UNION ALL
        SELECT e.user_id, e.event_id, e.rn,
               CASE WHEN e.result IN ('ok', 'success', 'none') THEN e.result WHEN s.held THEN 'suppressed' WHEN r.fails + 1 >= 3 THEN 'kill' ELSE e.result END,
               CASE WHEN e.result IN ('ok', 'success', 'none') OR s.held THEN 0 ELSE r.fails + 1 END,
               CASE WHEN e.result IN ('ok', 'success') THEN e.secs ELSE r.last END,
               CASE WHEN e.result IN ('ok', 'success', 'none') OR s.held OR r.fails + 1 >= 3 THEN 0 ELSE r.fails + 1 END
        FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1, LATERAL (SELECT r.last IS NOT NULL AND e.secs - r.last < 20000 AS held) s)
    SELECT event_id, label, shown::INT AS failures FROM r
""")
def heartbeat_fsm(spark, d):
    """Each user's events as probes of a worker."""
    kind = F.col("event_type")
    result = F.when(kind == "view", "ok").when(kind == "purchase", "success").when(kind == "signup", "none").when(kind == "error", "error").otherwise("timeout")
    rows = _read(spark, d, "events").select("event_id", "user_id", "ts", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), result.alias("result"))
    return batching.heartbeats(rows, ["user_id"], ["ts", "event_id"], window=20_000.0).select("event_id", "label", "failures")


@query("""
    WITH RECURSIVE e AS (SELECT event_id, user_id, CASE WHEN event_type = 'error' THEN 'spawn_fail' WHEN event_type = 'view' THEN 'spawn_ok' ELSE 'exit' END AS event, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    r(user_id, event_id, rn, delay) AS (
        SELECT user_id, event_id, rn, CASE WHEN event = 'spawn_fail' THEN 4.0::DOUBLE ELSE 2.0::DOUBLE END FROM e WHERE rn = 1
        UNION ALL
        SELECT e.user_id, e.event_id, e.rn, CASE e.event WHEN 'spawn_fail' THEN least(2 * r.delay, 60.0) WHEN 'spawn_ok' THEN 2.0 ELSE r.delay END FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)
    SELECT event_id, delay FROM r
""")
def backoff(spark, d):
    kind = F.col("event_type")
    rows = _read(spark, d, "events").select("event_id", "user_id", "ts", F.when(kind == "error", "spawn_fail").when(kind == "view", "spawn_ok").otherwise("exit").alias("event"))
    return batching.respawns(rows, ["user_id"], ["ts", "event_id"]).select("event_id", "delay")


@query("""
    WITH u AS (SELECT sha256(user_id::VARCHAR) AS sha, event_id AS last_used, value FROM events), l AS (SELECT sha, max(last_used) AS last_used, arg_max(value, last_used) AS value FROM u GROUP BY 1)
    SELECT * FROM l ORDER BY last_used DESC, sha LIMIT 100
""")
def lru_trim(spark, d):
    """The hundred keys used last."""
    used = _read(spark, d, "events").select(text.text_hash(F.col("user_id").cast("string")).alias("sha"), F.col("event_id").alias("last_used"), "value")
    return dense.updated_cache(used.where(F.col("last_used") % 2 == 0), used.where(F.col("last_used") % 2 == 1), 100).select("sha", "last_used", "value")


# ------------------------------------------------------------------ tables of numbers

_SLOPE = "CASE WHEN head < 8 THEN 2.0 ** (-(head + 1)) ELSE 2.0 ** (-((head - 8) * 2 + 1) * 0.5) END"


@query(f"SELECT head::INT AS head, round({_SLOPE}, 9) AS slope FROM range(12) t(head)")
def alibi_slopes(spark, d):
    return numeric.alibi_slopes(spark, 12).select("head", F.round("slope", 9).alias("slope"))


@query(f"SELECT head::INT AS head, i::INT AS i, j::INT AS j, round(-({_SLOPE}) * abs(i - j), 9) + 0.0 AS bias FROM range(12) t(head), range(16) a(i), range(16) b(j)")
def alibi_bias(spark, d):
    return numeric.alibi_bias(spark, 12, 16).select("head", "i", "j", (F.round("bias", 9) + F.lit(0.0)).alias("bias"))


@query()
def base64_vectors(spark, d):
    return _read(spark, d, "embeddings").select("vec_id", numeric.base64_floats(F.col("embedding")).alias("embedding_b64"))


# ------------------------------------------------------------------ small joins and differences

_FILES = [("model_quantized_static.onnx",), ("model_quantized_static_b1.onnx",), ("model_quantized_static_b4.onnx",), ("model_quantized_static_b8.onnx",), ("model_quantized_static_b0.onnx",), ("model_quantized.onnx",)]


@query(_packed_sql(_BUDGETS["pack_padded"]) + _BATCHES + """
    SELECT CASE items WHEN 1 THEN 'model_quantized_static_b1.onnx' WHEN 4 THEN 'model_quantized_static_b4.onnx' WHEN 8 THEN 'model_quantized_static_b8.onnx' ELSE 'dynamic' END AS route, count(*) AS total FROM b GROUP BY 1
""")
def static_shape_route(spark, d):
    """Batches go to the graph of exactly their size where there is one."""
    from textloom.sources import readers

    shapes = readers.static_shapes(_values(spark, _FILES, "name string"))
    return metrics.counter(readers.routed(batching.batches(_packed(spark, d, "pack_padded"), _STREAM), shapes), ["route"])


@query(_packed_sql(_BUDGETS["pack_padded"]) + "SELECT source, arrival, batch::INT AS batch, string_agg(len::VARCHAR, ' ' ORDER BY doc_id) AS lens, count(*) AS n FROM p GROUP BY 1, 2, 3")
def batch_split(spark, d):
    """What a batch gives, handed back in the order of its items; as many results as items."""
    back = batching.split_back(_packed(spark, d, "pack_padded"), _STREAM, "batch", "doc_id", "len")
    return back.select(*_STREAM, "batch", F.array_join("len", " ").alias("lens"), F.size("len").cast("long").alias("n"))


_ENV = [("RERANKER_SESSION_POOL_SIZE_A",), ("SPLADE_SESSION_POOL_SIZE_B",), ("EMBED_BATCH_MAX_SEQ_E5",), ("EMBED_BATCH_MAX_SEQ_NOPE",), ("PATH",)]
_POOL_PREFIXES = ["RERANKER_SESSION_POOL_SIZE_", "SPLADE_SESSION_POOL_SIZE_"]


@query(f"""
    SELECT name, starts_with(name, '{_POOL_PREFIXES[0]}') OR starts_with(name, '{_POOL_PREFIXES[1]}') AS unsupported,
           starts_with(name, 'EMBED_BATCH_MAX_SEQ_') AND replace(name, 'EMBED_BATCH_MAX_SEQ_', '') NOT IN ('E5', 'JINA') AS unknown_model FROM {_sql_values(_ENV, 'name')}
""")
def env_difference(spark, d):
    """Settings of kinds that have none, and of models that aren't configured."""
    models = _values(spark, _MODELS, "name string, kind string").where("kind = 'embed'").select(config.model_env_key(F.col("name")).alias("key")).withColumn("known", F.lit(True))
    env = _values(spark, _ENV, "name string").withColumn("key", F.regexp_extract("name", "^EMBED_BATCH_MAX_SEQ_(.+)$", 1))
    out = env.join(F.broadcast(models), "key", "left")
    return out.select("name", classify.unsupported(F.col("name"), _POOL_PREFIXES).alias("unsupported"), ((F.col("key") != "") & F.col("known").isNull()).alias("unknown_model"))


_PAIR_SPECS = [(1, "r:/m:512:true"), (2, "r:/m:512"), (3, "s:/m:x"), (4, "s:/m:64"), (5, "r:/m:8:maybe"), (6, "")]


@query(r"""
    SELECT id, p[1] AS name, len(p) = 4 AND regexp_matches(p[3], '^[0-9]+$') AND coalesce(p[4] IN ('true', '1', 'false', '0'), false) AS reranker, len(p) = 3 AND coalesce(regexp_matches(p[3], '^[0-9]+$'), false) AS sparse
    FROM (SELECT id, string_split(s, ':') AS p FROM """ + _sql_values(_PAIR_SPECS, "id, s") + ")")
def pair_specs(spark, d):
    s = F.col("s")
    return _values(spark, _PAIR_SPECS, "id int, s string").select("id", config.reranker_spec(s)["name"].alias("name"), config.reranker_spec(s)["valid"].alias("reranker"), config.sparse_spec(s)["valid"].alias("sparse"))


@query("""
    WITH q AS (SELECT conv_id, count(*) AS asked FROM conversations WHERE role = 'user' GROUP BY 1), a AS (SELECT conv_id, count(*) AS answered FROM conversations WHERE role = 'assistant' GROUP BY 1)
    SELECT q.conv_id, asked, coalesce(answered, 0) AS answered, asked = coalesce(answered, 0) AS complete FROM q LEFT JOIN a ON q.conv_id = a.conv_id
""")
def response_correlation(spark, d):
    """Requests against responses by id; a request whose responses are fewer or more is not complete."""
    rows = _read(spark, d, "conversations", "conv_id", "role")
    asked = rows.where("role = 'user'").groupBy("conv_id").agg(F.count(F.lit(1)).alias("asked"))
    answered = rows.where("role = 'assistant'").groupBy("conv_id").agg(F.count(F.lit(1)).alias("answered"))
    n = F.coalesce("answered", F.lit(0))
    return requests.counted(asked, answered, "conv_id", "asked", "answered").select("conv_id", "asked", n.alias("answered"), F.col("error").isNull().alias("complete"))


_DISPATCH = [(1, "timeout"), (2, "no_worker"), (3, "ipc"), (4, "other")]


@query(f"""SELECT id, CASE error WHEN 'timeout' THEN 503 WHEN 'no_worker' THEN 500 WHEN 'ipc' THEN 500 END::INT AS status, CASE error WHEN 'timeout' THEN 5 END::INT AS retry_after,
    CASE error WHEN 'timeout' THEN 'worker_unavailable' WHEN 'no_worker' THEN 'server_error' WHEN 'ipc' THEN 'server_error' END AS type FROM {_sql_values(_DISPATCH, 'id, error')}""")
def dispatch_errors(spark, d):
    e = F.col("error")
    return _values(spark, _DISPATCH, "id int, error string").select("id", classify.dispatch_status(e, 0).alias("status"), classify.dispatch_status(e, 1).alias("retry_after"), classify.dispatch_status(e, 2).alias("type"))


@query("SELECT vec_id, 'embedding' AS object, (vec_id % 4)::INT AS index, CASE WHEN vec_id % 2 = 0 THEN len(embedding) END::INT AS dims, vec_id % 2 = 1 AS has_b64 FROM embeddings")
def response_projection(spark, d):
    """One entry a vector: numbers or base64, as the request's format says."""
    rows = _read(spark, d, "embeddings", "vec_id", "embedding").withColumns({"i": (F.col("vec_id") % 4).cast("int"), "format": F.when(F.col("vec_id") % 2 == 0, "float").otherwise("base64")})
    r = requests.response(F.col("i"), F.col("embedding"), numeric.base64_floats(F.col("embedding")), F.col("format"))
    out = rows.select("vec_id", r.alias("r"))
    return out.select("vec_id", F.col("r.object").alias("object"), F.col("r.index").alias("index"), F.when(F.col("r.embedding").isNotNull(), F.size("r.embedding")).alias("dims"), F.col("r.embedding_b64").isNotNull().alias("has_b64"))


from textloom.plans import scale, serving  # noqa: E402, F401 - they register their queries
