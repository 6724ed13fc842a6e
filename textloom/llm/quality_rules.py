"""Quality rules: text statistics, base limits, and robust multivariate outliers.

Only DataFrame functions: ``statistics`` computes counts inside each row, ``fit``
estimates a minimum-covariance-determinant location and scatter for every (language,
source) by concentration steps, and ``verdicts`` rejects rows whose transformed
statistic vector has too large a Mahalanobis distance.

A concentration step is one aggregation: sums of the vectors and their products by group and
bucket of log distance.  Running counts of the buckets give the group's half-sample, and the
sums of its buckets the mean and covariance.  Rows combine on the map side, so a source with a third
of all rows is no larger a task than others, and buckets are the same however rows are dealt.
Steps go on for each group until the determinant falls no more (by ``SETTLED``, relatively), from two starts (the
coordinates' medians with the least deviations, and the mean and covariance of all rows), and the lower one is taken.

Estimates are regularised in one way at every size: a group's location, scatter and scale are
pooled with those of its language as if that had ``PRIOR_ROWS`` rows of the group, and a
language's likewise with those of all rows.  A hot source's own rows decide, a source of one row is
judged much as its language.

Defined results: a null text counts as empty (no words, so it fails the base rules); null
languages and sources are groups of their own; very long texts are counted whole; equal
rows get equal results; an empty table gives an empty table; columns named like ours are
neither read nor lost, since everything is computed into one struct column under a free name.
"""

from __future__ import annotations

from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame, functions as F

from textloom.llm._text import free_name, stored

#: Characters counted as symbols, capital letters, and what makes a word.
SYMBOLS = "[#*$%&|<>]"
UPPER = "[A-Z]"
WORD = "[^ \\t\\n\\x0B\\f\\r]"

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Share of a group's rows whose covariance determinant is made small.
SUBSET = 0.5
#: Squared distance: the 0.99999 quantile of chi-square with 5 degrees of freedom.
CUTOFF = 30.86
#: The median of chi-square with 5 degrees of freedom, to which a half-sample's distances are scaled.
MEDIAN = 4.351
#: Less fall of the determinant's logarithm than this ends a group's steps.
SETTLED = 1e-4
#: Rows that a wider group's estimate counts for in a narrower one's.
PRIOR_ROWS = 100
#: Statistic vector: name and the least standard deviation that a group may have in it.
VECTOR = (("log_word_chars", 0.15), ("log_symbols", 0.05), ("upper", 0.05), ("dup_lines", 0.08), ("repeats", 0.08))
#: Buckets of the distance histogram for each e-fold.
BUCKETS = 32


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _count(chars: str, text: Column) -> Column:
    return F.char_length(text) - F.char_length(F.regexp_replace(text, chars, ""))


def statistics(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, n_lines (long)."""
    text = F.coalesce(text, F.lit(""))

    def repeated(words: Column) -> Column:
        """Words in 3-word windows that stand twice or more in the text."""
        windows = F.slice(
            F.transform(words, lambda x, i: F.struct(F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("at"))),
            1, F.greatest(F.size(words) - 2, F.lit(0)),
        )

        def covered(starts: Column) -> Column:
            reach = F.transform(starts, lambda s, i: F.least(F.lit(3), F.coalesce(F.get(starts, i + 1) - s, F.lit(3))))
            return F.aggregate(reach, F.lit(0), lambda n, x: n + x)

        def again(sorted_windows: Column) -> Column:
            twice = F.filter(sorted_windows, lambda w, i: (w["h"] == F.get(sorted_windows, i - 1)["h"]) | (w["h"] == F.get(sorted_windows, i + 1)["h"]))
            return _let(F.sort_array(F.transform(twice, lambda w: w["at"])), covered)

        return F.coalesce(_let(F.sort_array(windows), again), F.lit(0))

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    counted = _let(F.filter(F.split(text, "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != ""), lambda w: F.struct(F.size(w).alias("n"), F.char_length(F.array_join(w, "")).alias("c"), repeated(w).alias("r")))
    dups = _let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))
    return _let(F.struct(counted.alias("w"), dups.alias("l")), lambda s: F.struct(
        s["w"]["n"].cast("long").alias("n_words"),
        s["w"]["c"].cast("long").alias("word_chars"),
        _count(SYMBOLS, text).cast("long").alias("n_symbols"),
        (s["l"]["n"] - s["l"]["d"]).cast("long").alias("n_dup_lines"),
        s["w"]["r"].cast("long").alias("n_repeat_words"),
        _count(UPPER, text).cast("long").alias("n_upper"),
        s["l"]["n"].cast("long").alias("n_lines"),
    ))


def base_failed(s: Column) -> Column:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])


def vector(s: Column) -> list[Column]:
    """The transformed statistics, in the order of VECTOR."""
    words, chars = F.greatest(s["n_words"], F.lit(1)), F.greatest(s["word_chars"], F.lit(1))
    return [
        F.log(chars / words),
        F.log1p(s["n_symbols"] / words),
        s["n_upper"] / chars,
        s["n_dup_lines"] / F.greatest(s["n_lines"], F.lit(1)),
        s["n_repeat_words"] / words,
    ]


def _cholesky(a: dict[tuple[int, int], Column], d: int) -> list[tuple[str, Column]]:
    """Named columns of the lower factor of a covariance whose entries are columns ``c_i_j``; each uses those before it."""
    out = []
    for i in range(d):
        for j in range(i + 1):
            rest = reduce(lambda x, k: x - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}"), range(j), a[i, j])
            out.append((f"l_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(VECTOR[i][1] ** 2 / 4))) if i == j else rest / F.col(f"l_{j}_{j}")))
    return out


def distance(x: list[Column], m: Column) -> Column:
    """Squared Mahalanobis distance to a model struct (m_i, l_i_j, scale), by forward substitution."""

    def solve(i: int, y: Column | None) -> Column:
        if i == len(x):
            return F.aggregate(y, F.lit(0.0), lambda t, v: t + v * v) / m["scale"]
        rest = x[i] - m[f"m_{i}"]
        for k in range(i):
            rest = rest - m[f"l_{i}_{k}"] * F.get(y, F.lit(k))
        z = rest / m[f"l_{i}_{i}"]
        return _let(F.array(z) if y is None else F.concat(y, F.array(z)), lambda v: solve(i + 1, v))

    return solve(0, None)


def _names(d: int) -> list[str]:
    """Means and covariances."""
    return [f"m_{i}" for i in range(d)] + [f"c_{i}_{j}" for i in range(d) for j in range(i + 1)]


def _model(moments: DataFrame, d: int) -> DataFrame:
    """``moments`` with a model struct (scale 1) and the log of the determinant; no group may deviate less than VECTOR says."""
    cov = {(i, j): F.coalesce(F.col(f"c_{i}_{j}"), F.lit(0.0)) + F.lit(VECTOR[i][1] ** 2 if i == j else 0.0) for i in range(d) for j in range(i + 1)}
    factor = _cholesky(cov, d)
    out = moments
    for name, column in factor:
        out = out.withColumn(name, column)
    names = [f"m_{i}" for i in range(d)] + [n for n, _ in factor]
    volume = reduce(lambda x, y: x + y, [F.log(F.col(f"l_{i}_{i}")) for i in range(d)])
    return out.select(*moments.columns, F.struct(*[F.col(n).alias(n) for n in names], F.lit(1.0).alias("scale")).alias("m"), (2 * volume).alias("volume"))


#: Models are broadcast up to so many groups; beyond, joins with them shuffle, and adaptive execution splits hot groups.
MOST_GROUPS = 100_000


def _join(rows: DataFrame, models: DataFrame, small: bool, by: tuple[str, ...] = ("g",)) -> DataFrame:
    """Rows with their group's models; ``small`` if these are at most MOST_GROUPS."""
    return rows.join(F.broadcast(models) if small else models, list(by))


def _moments(rows: DataFrame, d: int) -> DataFrame:
    aggs = [F.avg(f"x_{i}").alias(f"m_{i}") for i in range(d)] + [F.covar_pop(f"x_{i}", f"x_{j}").alias(f"c_{i}_{j}") for i in range(d) for j in range(i + 1)]
    return rows.groupBy("g").agg(*aggs)


def _half_samples(rows: DataFrame, d: int, by: tuple[str, ...]) -> DataFrame:
    """Moments of each group's rows in the least buckets that hold SUBSET of them, of rows (by, b, x_0 ..)."""
    from pyspark.sql import Window

    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    sums = [F.sum(f"x_{i}").alias(f"s_{i}") for i in range(d)] + [F.sum(F.col(f"x_{i}") * F.col(f"x_{j}")).alias(f"p_{i}_{j}") for i, j in pairs]
    buckets = rows.groupBy(*by, "b").agg(F.count(F.lit(1)).alias("n"), *sums)
    w = Window.partitionBy(*by)
    upto = F.sum("n").over(w.orderBy("b").rowsBetween(Window.unboundedPreceding, 0))
    within = buckets.withColumns({"upto": upto, "all": F.sum("n").over(w)}).where(F.col("upto") - F.col("n") < SUBSET * F.col("all"))
    names = [f"s_{i}" for i in range(d)] + [f"p_{i}_{j}" for i, j in pairs]
    total = within.groupBy(*by).agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names])
    mean = [F.col(f"s_{i}") / F.col("n") for i in range(d)]
    return total.select(*by, *[mean[i].alias(f"m_{i}") for i in range(d)], *[(F.col(f"p_{i}_{j}") / F.col("n") - mean[i] * mean[j]).alias(f"c_{i}_{j}") for i, j in pairs])


def _limits(rows: DataFrame, share: float) -> DataFrame:
    """For each group the least histogram bucket of log distance with ``share`` of the rows at or below it."""
    from pyspark.sql import Window

    counts = rows.groupBy("g", "b").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("g")
    running = counts.withColumn("upto", F.sum("n").over(w.orderBy("b").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(w))
    return running.where(F.col("upto") >= share * F.col("all")).groupBy("g").agg(F.min("b").alias("limit"))


def _bucket(distance2: Column) -> Column:
    """At most some 1,400 buckets: distances from 1e-9 to 1e9 and what lies outside."""
    return F.floor(F.log(F.greatest(F.least(distance2, F.lit(1e9)), F.lit(1e-9))) * BUCKETS).cast("int")


def _levels() -> list[Column]:
    """Keys of a row's groups: language and source, language, all rows."""
    return [F.to_json(F.struct(*map(F.col, k)), {"ignoreNullFields": "false"}) for k in (("lang", "source"), ("lang",), ())]


def concentrate(rows: DataFrame, d: int) -> DataFrame:
    """(g, moments): the half-samples of least determinant that the starts lead to, of rows (g, x_0 .. x_{d-1})."""
    x, by, names = [F.col(f"x_{i}") for i in range(d)], ("g", "start"), _names(d)
    medians = rows.groupBy("g").agg(*[F.percentile_approx(f"x_{i}", F.lit(0.5), F.lit(1000)).alias(f"m_{i}") for i in range(d)])
    middle = medians.select("g", F.lit(0).alias("start"), *[F.col(n) if n[0] == "m" else F.lit(0.0).alias(n) for n in names])
    now = stored(_model(middle.union(_moments(rows, d).select("g", F.lit(1).alias("start"), *names)), d).withColumn("before", F.lit(None).cast("double")))
    left, done = now.count(), []
    small = left <= MOST_GROUPS
    while left:
        near = _join(rows, now.select(*by, "m"), small).withColumn("b", _bucket(distance(x, F.col("m"))))
        fresh = _model(_half_samples(near, d, by), d)
        # the starts are no half-samples: their determinants are no bound, and every group takes a step
        old = now.select(*by, "before", *[F.col(n).alias(f"old_{n}") for n in names])
        both = stored(_join(fresh, old, small, by).withColumn("falls", F.col("before").isNull() | (F.col("volume") < F.col("before") - SETTLED)))
        done.append(both.where(~F.col("falls")).select(*by, F.col("before").alias("volume"), *[F.col(f"old_{n}").alias(n) for n in names]))
        now = both.where("falls").select(*by, *names, "m", "volume", F.col("volume").alias("before"))
        left = now.count()
    if not done:
        return rows.limit(0).select("g", *[F.lit(0.0).alias(n) for n in names])
    least = reduce(DataFrame.union, done).groupBy("g").agg(F.min_by(F.struct(*names), F.struct("volume", "start")).alias("best"))
    return least.select("g", "best.*")


def _pooled(own: DataFrame, wider: DataFrame, d: int, prior_rows: float) -> DataFrame:
    """Moments of ``own`` (g, up, n, ..) pooled with those of the wider group ``up``, which counts for ``prior_rows`` rows."""
    side = wider.select(F.col("g").alias("up"), *[F.col(n).alias(f"w_{n}") for n in _names(d)])
    share = F.col("n") / (F.col("n") + F.lit(float(prior_rows)))
    mean = [share * F.col(f"m_{i}") + (1 - share) * F.col(f"w_m_{i}") for i in range(d)]
    apart = [F.col(f"m_{i}") - F.col(f"w_m_{i}") for i in range(d)]
    cov = [share * F.col(f"c_{i}_{j}") + (1 - share) * F.col(f"w_c_{i}_{j}") + share * (1 - share) * apart[i] * apart[j] for i in range(d) for j in range(i + 1)]
    return own.join(side, "up").select("g", "up", "n", *[c.alias(n) for n, c in zip(_names(d), mean + cov, strict=True)])


def fit(vectors: DataFrame, prior_rows: float = PRIOR_ROWS) -> DataFrame:
    """Models ``(g, m)`` of each language and source, from rows of (lang, source, x_0 .. x_{d-1})."""
    d = len(VECTOR)
    keys, x = _levels(), [F.col(f"x_{i}") for i in range(d)]
    rows = stored(vectors.select(F.explode(F.array(*keys)).alias("g"), *x))
    sizes = [vectors.groupBy("lang", "source"), vectors.groupBy("lang"), vectors.groupBy()]
    found = stored(concentrate(rows, d))
    own = [size.agg(F.count(F.lit(1)).alias("n")).select(keys[k].alias("g"), keys[min(k + 1, 2)].alias("up"), "n").join(found, "g") for k, size in enumerate(sizes)]
    top = own[2].where("n > 0")
    lang = _pooled(own[1], top, d, prior_rows)
    source = _pooled(own[0], lang, d, prior_rows)
    levels = [level.select("*", F.lit(k).alias("level")) for k, level in enumerate((source, lang, top))]
    models = stored(_model(reduce(DataFrame.union, levels), d).select("g", "up", "n", "level", "m"))
    small = models.count() <= MOST_GROUPS
    median = _limits(_join(rows, models.select("g", "m"), small).withColumn("b", _bucket(distance(x, F.col("m")))), 0.5)
    # a half-sample's distances are too large for all rows by a factor, which is pooled like the moments, in logarithms
    log_scale = F.greatest((F.col("limit") + 0.5) / BUCKETS - float(log(MEDIAN)), F.lit(0.0))
    scaled = stored(models.join(median, "g").select("g", "up", "n", "level", "m", log_scale.alias("s")))
    share = F.col("n") / (F.col("n") + F.lit(float(prior_rows)))
    wide = scaled.where("level = 2").select(F.col("g").alias("up"), F.col("s").alias("s0"))
    by_lang = scaled.where("level = 1").join(wide, "up").select(F.col("g").alias("up"), (share * F.col("s") + (1 - share) * F.col("s0")).alias("s1"))
    narrow = scaled.where("level = 0").join(by_lang, "up")
    return stored(narrow.select("g", F.col("m").withField("scale", F.exp(share * F.col("s") + (1 - share) * F.col("s1"))).alias("m")))


def with_verdicts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", out_col: str = "__rules", prior_rows: float = PRIOR_ROWS, cutoff: float = CUTOFF) -> DataFrame:
    """``docs`` with a struct column of the statistics, base_failed, distance (null where base_failed) and kept."""
    # counting costs more than writing: rows go to the shared folder with their statistics, which are then read for fitting and again for the verdicts
    counted = stored(docs.withColumn(out_col, statistics(F.col(text_col))))
    s = F.col(out_col)
    vectors = counted.where(~base_failed(s)).select(F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), *[v.alias(f"x_{i}") for i, v in enumerate(vector(s))])
    return _judged(counted, fit(vectors, prior_rows), F.col(lang_col), F.col(source_col), out_col, cutoff)


def _judged(counted: DataFrame, models: DataFrame, lang: Column, source: Column, out_col: str, cutoff: float) -> DataFrame:
    """Each row that passes the base rules has a model, of its language and source."""
    s = F.col(out_col)
    group, model = (free_name(counted, f"{out_col}_{c}") for c in "gm")
    key = F.when(~base_failed(s), F.to_json(F.struct(lang.cast("string").alias("lang"), source.cast("string").alias("source")), {"ignoreNullFields": "false"}))
    side = models.select(F.col("g").alias(group), F.col("m").alias(model))
    out = counted.join(F.broadcast(side) if models.count() <= MOST_GROUPS else side, key == F.col(group), "left")
    d2 = F.when(~base_failed(s), _let(F.array(*vector(s)), lambda x: _let(F.col(model), lambda m: distance([F.get(x, F.lit(i)) for i in range(len(VECTOR))], m))))
    judged = s.withField("base_failed", base_failed(s)).withField("distance", d2).withField("kept", ~base_failed(s) & (F.coalesce(d2, F.lit(0.0)) <= cutoff))
    return out.withColumn(out_col, judged).drop(group, model)


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", prior_rows: float = PRIOR_ROWS, cutoff: float = CUTOFF) -> DataFrame:
    """id, the statistics, base_failed, distance and kept of each document.

    The statistics are counted once, into a table without the texts.
    """
    base = stored(docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), statistics(F.col(text_col)).alias("s")))
    s = F.col("s")
    vectors = base.where(~base_failed(s)).select("lang", "source", *[v.alias(f"x_{i}") for i, v in enumerate(vector(s))])
    judged = _judged(base, fit(vectors, prior_rows), F.col("lang"), F.col("source"), "s", cutoff)
    return judged.select(F.col("id").alias(id_col), "s.*")


def apply(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns."""
    name = free_name(docs, "__rules")
    return with_verdicts(docs, out_col=name, **options).where(F.col(name)["kept"]).drop(name)
