"""Queries over whole keys, however large: batches and sub-batches of a whole source, sketches and caches kept by batches."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom.functions import text
from textloom.operators import balance, frequency, graph, packing, sparse
from textloom.operators.ordering import shared_dir, stored
from textloom.plans.catalog import _ARRIVALS, _BUDGETS, _IDS, _LENS, PLACES, _lengths, _packed_sql, _read, query
from textloom.sources import vocabulary
from textloom.streaming.vector_log import VectorLog

#: Lengths of a whole source's documents, which arrive in one window.
_WHOLE = _LENS.replace(f"doc_id // {_ARRIVALS}", "0")


# ------------------------------------------------------------------ batches


def _pack_query(name: str) -> None:
    def f(spark: SparkSession, d: str) -> DataFrame:
        rows = _lengths(spark, d).drop("arrival")
        return packing.packed(rows, ["source"], ["doc_id"], _BUDGETS[name]).select("source", "doc_id", "batch", "head", "carried", "reason")

    f.__name__ = f"{name}_whole"
    f.__doc__ = f"``{name}`` with a source's documents as one stream, without windows of arrival."
    query(_packed_sql(_BUDGETS[name], _WHOLE).replace("d AS (SELECT *", "d AS MATERIALIZED (SELECT *") + "SELECT source, doc_id, batch::BIGINT AS batch, head, carried, reason FROM p")(f)


for _name in _BUDGETS:
    _pack_query(_name)


@query(f"""
    WITH RECURSIVE o AS MATERIALIZED (SELECT source, doc_id, greatest(len, 1) AS n, row_number() OVER (PARTITION BY source ORDER BY len DESC, doc_id) AS rn FROM ({_WHOLE})),
    r(source, doc_id, rn, grp, widest) AS (
        SELECT source, doc_id, rn, 0, n FROM o WHERE rn = 1
        UNION ALL
        SELECT o.source, o.doc_id, o.rn, CASE WHEN r.widest > 2 * o.n THEN grp + 1 ELSE grp END, CASE WHEN r.widest > 2 * o.n THEN o.n ELSE r.widest END
        FROM r JOIN o ON o.source = r.source AND o.rn = r.rn + 1)
    SELECT source, doc_id, grp::INT AS group_no FROM r
""")
def subbatch_plan_whole(spark, d):
    """All documents of a source as one request, split into groups of like length."""
    return packing.length_groups(_lengths(spark, d).drop("arrival"), ["source"], ratio=2.0, group="group_no").select("source", "doc_id", "group_no")


# ------------------------------------------------------------------ caches

_ITEM, _WIDTH = "user_id::VARCHAR || ':' || event_type", 1_024
_DAY = "datediff('day', DATE '2020-01-01', ts::DATE)"
_CELL = "(('0x' || substr(md5(k::VARCHAR || ':' || item), 1, 12))::BIGINT % " + str(_WIDTH) + ")"


def _accesses(spark: SparkSession, d: str) -> DataFrame:
    day = F.datediff(F.col("ts"), F.lit("2020-01-01").cast("date"))
    return _read(spark, d, "events", "user_id", "event_type", "ts").select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("item"), day.cast("long").alias("day"))


@query(f"""
    WITH a AS (SELECT {_ITEM} AS item, {_DAY} AS day FROM events), n AS (SELECT item, max(day) OVER () - day AS age FROM a),
         e AS (SELECT item, sum(pow(2.0, -age)) AS exact FROM n GROUP BY item),
         s AS (SELECT k, {_CELL} AS cell, sum(pow(2.0, -age)) AS count FROM n, range(4) AS r(k) GROUP BY 1, 2)
    SELECT e.item, round(min(exact), 6) AS exact, round(min(count), 6) AS estimate
    FROM e, range(4) AS r(k) JOIN s USING (k) WHERE s.cell = {_CELL} GROUP BY e.item
""")
def frequency_sketch(spark, d):
    """How often each user did what, halved every day: exact, and as a sketch of 4 x 1,024 cells merged from the days' own sketches tells it."""
    rows = _accesses(spark, d)
    last = rows.agg(F.max("day").alias("last"))
    days = rows.crossJoin(F.broadcast(last)).withColumn("age", F.col("last") - F.col("day"))
    exact = days.groupBy("item", "age").agg(F.count(F.lit(1)).alias("n")).groupBy("item").agg(F.sum(F.col("n") / F.pow(F.lit(2.0), F.col("age"))).alias("exact"))
    own = frequency.sketch(days, "item", ["age"], width=_WIDTH)
    counts = own.groupBy("row", "cell").agg(F.sum(F.col("count") / F.pow(F.lit(2.0), F.col("age"))).alias("count"))
    out = frequency.estimates(exact, counts, "item", width=_WIDTH)
    return out.select("item", F.round("exact", 6).alias("exact"), F.round("estimate", 6).alias("estimate"))


#: Entries of the cache of ``cache_admission``.
_ENTRIES = 200


@query()
def cache_admission(spark, d):
    """(week, item, outcome): a cache of 200 entries that admits what is asked for more often than what would go, by a sketch halved every week."""
    rows = _accesses(spark, d).withColumn("last_used", F.col("day")).withColumn("week", F.floor(F.col("day") / 7))
    first, last = rows.agg(F.min("week"), F.max("week")).first()
    cache, counts, told = rows.select(F.col("item"), "last_used").limit(0), None, []
    for week in range(first, last + 1) if first is not None else []:
        asked = rows.where(F.col("week") == week)
        now = frequency.sketch(asked, "item")
        counts = stored(now if counts is None else frequency.merged(frequency.aged(counts), now))
        cache, outcomes = frequency.admitted(cache, asked, counts, _ENTRIES, "item")
        told.append(outcomes.select(F.lit(week).cast("long").alias("week"), "item", "outcome"))
    return reduce(DataFrame.union, told) if told else rows.limit(0).select("week", "item", F.lit("").alias("outcome"))


#: Keys that the cache of ``vector_log`` holds at the end.
_KEPT = 400


@query(f"""
    WITH t AS (SELECT sha256(text) AS sha, doc_id, doc_id % 3 AS batch FROM documents),
         l AS (SELECT sha, max_by(doc_id, batch * 10000000000 + doc_id) AS last_used FROM t GROUP BY sha),
         k AS (SELECT * FROM l WHERE sha NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 10 = 7))
    SELECT sha, last_used FROM k ORDER BY last_used DESC, sha LIMIT {_KEPT}
""")
def vector_log(spark, d):
    """A cache of texts' hashes after three batches of documents, a batch of deletions and a trim: what each batch touches is written anew."""
    log = VectorLog(spark, f"{shared_dir(spark)}/log-{uuid.uuid4().hex}", "sha string, last_used long", buckets=16, most=2)
    docs = _read(spark, d, "documents", "doc_id", "text").select("doc_id", text.text_hash(F.col("text")).alias("sha"), F.col("doc_id").alias("last_used"))
    for k in range(3):
        log.update(docs.where(F.col("doc_id") % 3 == k).select("sha", "last_used"), k)
    log.update(docs.where(F.col("doc_id") % 10 == 7).select("sha", "last_used", F.lit(True).alias("deleted")), 3)
    log.trim(_KEPT, 4)
    return log.snapshot()


# ------------------------------------------------------------------ tokens

#: Places of a pair.
_PAIR = 64
_CUT = f"CASE WHEN a + b <= {_PAIR - 3} THEN %s WHEN a > b THEN %s ELSE %s END"
_LESS = f"CASE WHEN least(a, b) * 2 <= {_PAIR - 3} THEN least(a, b) ELSE {(_PAIR - 3) // 2} END"


@query(f"""
    WITH p AS (SELECT f.conv_id, l.turn, {_IDS.format(t='f.text')} AS q, {_IDS.format(t='l.text')} AS d FROM conversations f JOIN conversations l USING (conv_id) WHERE f.turn = 0 AND l.turn > 0),
         n AS (SELECT *, len(q)::INT AS a, len(d)::INT AS b FROM p),
         k AS (SELECT *, {_CUT % ('a', f'{_PAIR - 3} - ({_LESS})', _LESS)} AS x, {_CUT % ('b', _LESS, f'{_PAIR - 3} - ({_LESS})')} AS y FROM n)
    SELECT conv_id, turn, x::INT AS query, y::INT AS document, (x + y + 3)::INT AS n,
           md5(array_to_string(list_concat([1], list_concat(q[1:x], list_concat([2], list_concat(d[1:y], [2])))), ' ')) AS digest, (y + 1)::INT AS second FROM k
""")
def pair_tokens(spark, d):
    """A conversation's first turn with each later one as the ids of a pair in 64 places, the longer one cut first."""
    rows = _read(spark, d, "conversations", "conv_id", "turn", "text")
    first = rows.where("turn = 0").select("conv_id", text.token_ids(F.col("text")).alias("q"))
    pairs = rows.where("turn > 0").join(first, "conv_id").select("conv_id", "turn", text.pair_ids(F.col("q"), text.token_ids(F.col("text")), _PAIR).alias("p"))
    ones = F.aggregate("p.segments", F.lit(0), lambda s, x: s + x)
    return pairs.select("conv_id", "turn", "p.query", "p.document", F.size("p.ids").alias("n"), F.md5(F.array_join("p.ids", " ")).alias("digest"), ones.alias("second"))


@query()
def sparse_vocabulary(spark, d):
    """(term, documents, token, surface): in how many documents a term is among the eight heaviest, named by a tokenizer file's entries."""
    import public_tokenizers

    rows = _read(spark, d, "documents", "doc_id", "text").select("doc_id", F.explode(text.token_ids(F.col("text"))).alias("term"))
    top = sparse.top_terms(rows.groupBy("doc_id", "term").agg(F.log(F.lit(1.0) + F.count(F.lit(1))).alias("weight")), "doc_id", 8, 0.7)
    used = top.groupBy("term").agg(F.count(F.lit(1)).alias("documents"))
    return vocabulary.named(used, vocabulary.vocabulary(spark, public_tokenizers.path("byte_bpe_50k.json"))).select("term", "documents", "token", "surface")


#: Tasks that ``token_balance`` deals to.
_PARTS = 16


@query(f"""
    WITH l AS (SELECT doc_id, greatest(len, 1) AS n FROM ({_LENS})), c AS (SELECT n, count(*) * n AS own FROM l GROUP BY n),
         b AS (SELECT n, own, (sum(own) OVER (ORDER BY n))::BIGINT - own AS before, (sum(own) OVER ())::BIGINT AS total FROM c),
         p AS (SELECT l.n, least(((before + own * (('0x' || substr(md5(doc_id::VARCHAR), 1, 5))::BIGINT) // 1048576) * {_PARTS}) // total, {_PARTS - 1})::INT AS part FROM l JOIN b ON l.n = b.n)
    SELECT part, count(*) AS items, sum(n)::BIGINT AS tokens, min(n) AS narrowest, max(n) AS widest, round(1 - sum(n) / (count(*) * max(n))::DOUBLE, {PLACES}) AS waste FROM p GROUP BY part
""")
def token_balance(spark, d):
    """Documents in 16 parts of about equal tokens in order of length: what each part has, and its padding if it were one batch."""
    rows = balance.token_parts(_lengths(spark, d).withColumn("n", F.greatest("len", F.lit(1))), "len", F.col("doc_id"), _PARTS)
    whole = rows.groupBy("part").agg(F.count(F.lit(1)).alias("items"), F.sum("n").alias("tokens"), F.min("n").alias("narrowest"), F.max("n").alias("widest"))
    return whole.withColumn("waste", F.round(1 - F.col("tokens") / (F.col("items") * F.col("widest")), PLACES))


# ------------------------------------------------------------------ links


@query()
def page_walk(spark, d):
    """(page_id, depth): in how many steps a page is reached from the first one, where two pages with a link of one target are a step apart."""
    rows = _read(spark, d, "pages", "page_id", "html")
    links = rows.select(F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("page"), F.explode(F.regexp_extract_all("html", F.lit(r'<a [^>]*href="([^"]*)"'))).alias("target"))
    there = links.select(F.col("page").alias("src"), F.concat(F.lit("link:"), "target").alias("dst"))
    first = rows.agg(F.min("page_id").alias("id")).select(F.concat(F.lit("page:"), F.col("id").cast("string")).alias("node"))
    found = graph.reached(there.union(there.select("dst", "src")), first).where(F.col("node").startswith("page:"))
    return found.select(F.substring("node", 6, 20).cast("long").alias("page_id"), (F.col("depth") / 2).cast("int").alias("depth"))
