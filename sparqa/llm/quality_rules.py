"""Quality rules: base word rules, then robust multivariate outliers per language and source.

Native: DataFrame functions only. Every text yields a vector of four
transformed statistics. For each group (language and source) the minimum
covariance determinant estimate of location and scatter is found by
concentration steps: distances under the present estimate, the share ``H`` of
rows nearest to the centre, mean and covariance of those rows, again. Texts
whose squared Mahalanobis distance passes the chi-square quantile of ``LEVEL``
are rejected. Steps are repeated until the estimates settle.

Group sums are ordinary partial aggregations and the quantile of the distances
is read from counts in a fixed number of bins, so a group with a third of all
rows costs no task more than the others and nothing is collected.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparqa.functions.text import let

from .common import saved, split_words

#: Base rules: fewest words, and most words (percent) inside repeated five-word windows.
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
#: Symbols counted by ``n_symbols``, a character that separates words, and one that doesn't.
SYMBOLS_RE = "[#*$%&|<>]"
BLANK_RE = "[\\x20\\x09-\\x0D]"
NO_BLANK_RE = "[^\\x20\\x09-\\x0D]"
#: Words added to every text before means are taken; short texts vary less then.
PRIOR_WORDS = 20
PRIOR_WORD_CHARS = 5.0
#: Smallest standard deviation of each coordinate (mean word length, symbols, repeated lines, repeated words).
FLOORS = (0.04, 0.04, 0.04, 0.08)
#: Share of a group that a concentration step keeps; steps go on until no entry moves by SETTLED, STEPS of them at most.
H = 0.75
STEPS = 20
SETTLED = 1e-3
#: Share of a normal law that is kept.
LEVEL = 0.999
#: Groups with fewer rows use their language's estimate, then that of all rows.
MIN_GROUP = 50
#: Bins of the counts from which medians and quantiles are read.
BINS = 4096

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_DIMS = range(len(FLOORS))
_X = [f"x{i}" for i in _DIMS]
_LOWER = [(i, j) for i in _DIMS for j in range(i + 1)]


def _all(values) -> Column:
    return reduce(lambda a, b: a + b, values)


def _repeat_words(words: Column) -> Column:
    """Words covered by the five-word windows that occur twice or more in the text."""
    hashes = F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - (WINDOW - 1), F.lit(0))),
        lambda w, i: F.xxhash64(w, *(F.get(words, i + k) for k in range(1, WINDOW))))

    def covered(h: Column) -> Column:
        order = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            again = F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))
                             | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
            return F.sort_array(F.transform(again, lambda x: x["i"]))

        return F.aggregate(
            let(order, starts),
            F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("bigint").alias("n")),
            lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")),
            lambda a: a["n"])

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint"))
               .otherwise(covered(h)))


def text_statistics(text: Column) -> Column:
    """A struct of the five base statistics of a text (null counts as empty)."""
    full = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(full, "\n"), lambda x: F.rlike(x, F.lit(NO_BLANK_RE)))
    count = lambda pattern: F.regexp_count(full, F.lit(pattern)).cast("bigint")
    return F.struct(
        let(split_words(full), lambda w: F.struct(F.size(w).cast("bigint").alias("n"), _repeat_words(w).alias("r"))).alias("w"),
        (F.length(full).cast("bigint") - count(BLANK_RE)).alias("word_chars"),
        count(SYMBOLS_RE).alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint")).alias("n_dup_lines"))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` plus one struct column ``_q``: the statistics, ``base_failed`` and the vector ``x0``..``x3``.

    ``inline`` of a one-element array stores the struct, so filters on it don't
    split the text again.
    """
    one = docs.select("*", F.inline(F.array(F.struct(text_statistics(F.col("text")).alias("_s")))))
    s = F.col("_s")
    n, r = s["w"]["n"], s["w"]["r"]
    weight = (n + PRIOR_WORDS).cast("double")
    x = [F.log((s["word_chars"] + PRIOR_WORDS * PRIOR_WORD_CHARS) / weight),
         *(F.sqrt(c / weight) for c in (s["n_symbols"], s["n_dup_lines"], r))]
    return one.withColumn("_q", F.struct(
        n.alias("n_words"), s["word_chars"].alias("word_chars"), s["n_symbols"].alias("n_symbols"),
        s["n_dup_lines"].alias("n_dup_lines"), r.alias("n_repeat_words"), base_failed(n, r).alias("base_failed"),
        *(c.alias(f"x{i}") for i, c in enumerate(x)))).drop("_s")


def _join(rows: DataFrame, groups: DataFrame) -> DataFrame:
    g = groups.withColumnsRenamed({"level": "r_level", "g_lang": "r_lang", "g_source": "r_source"})
    on = (F.col("level") == F.col("r_level")) & F.col("g_lang").eqNullSafe(F.col("r_lang")) \
        & F.col("g_source").eqNullSafe(F.col("r_source"))
    return rows.join(g, on).drop("r_level", "r_lang", "r_source")


_KEYS = ("level", "g_lang", "g_source")


def _cut(counts: DataFrame, share: float, keys=_KEYS) -> DataFrame:
    """The first bin of each group by which ``share`` of its rows are counted."""
    w = Window.partitionBy(*keys).orderBy("bin")
    upto = counts.withColumn("seen", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
    return upto.where(F.col("seen") >= share * F.col("total")).groupBy(*keys).agg(F.min("bin").alias("cut"))


def _distance2() -> Column:
    """Squared Mahalanobis distance by forward substitution in the Cholesky factor ``l_ij``."""
    y: list[Column] = []
    for i in _DIMS:
        rest = _all([F.lit(0.0), *(F.col(f"l{i}{j}") * y[j] for j in range(i))])
        y.append((F.col(f"x{i}") - F.col(f"m{i}") - rest) / F.col(f"l{i}{i}"))
    return _all([v * v for v in y])


def _start(rows: DataFrame) -> DataFrame:
    """Medians of the coordinates, with the floors as deviations."""
    long = rows.select(*_KEYS, F.posexplode(F.array(*_X)).alias("dim", "x"))
    binned = long.withColumn("bin", F.floor(F.col("x") * 256).cast("long")).groupBy(*_KEYS, "dim", "bin").agg(F.count("*").alias("n"))
    cut = _cut(binned, 0.5, (*_KEYS, "dim"))
    factor = [(F.lit(FLOORS[i]) if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i, j in _LOWER]
    mid = cut.groupBy(*_KEYS).agg(*(F.max(F.when(F.col("dim") == i, (F.col("cut") + 0.5) / 256)).alias(f"m{i}") for i in _DIMS))
    return mid.select(*_KEYS, *(f"m{i}" for i in _DIMS), *factor)


def _law(p: int, x: float) -> float:
    """Chi-square distribution function for even ``p``."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(p // 2))


def _quantile(p: int, h: float) -> float:
    lo, hi = 0.0, 100.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _law(p, mid) < h else (lo, mid)
    return lo


def _consistency(p: int, h: float) -> float:
    """Factor that makes the covariance of the nearest share ``h`` of a normal law unbiased (even ``p``)."""
    return h / _law(p + 2, _quantile(p, h))


#: Largest squared distance of a kept text: 18.47.
MAX_DISTANCE2 = _quantile(len(FLOORS), LEVEL)


def _step(rows: DataFrame, groups: DataFrame, last: bool) -> DataFrame:
    """One concentration step: distances, nearest share, mean and covariance of it."""
    scale = BINS / 24.0  # bins even in log2(1 + d2), up to 2^24
    near = _join(rows, groups).withColumn("bin", F.least(F.floor(F.log2(1 + _distance2()) * scale), F.lit(BINS)).cast("long")) \
        .select(*_KEYS, *_X, "bin")
    cut = _cut(near.groupBy(*_KEYS, "bin").agg(F.count("*").alias("n")), H)
    kept = _join(near, cut).where(F.col("bin") <= F.col("cut"))
    sums = kept.groupBy(*_KEYS).agg(
        F.count("*").alias("n"), *(F.avg(x).alias(f"m{i}") for i, x in enumerate(_X)),
        *(F.avg(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i, j in _LOWER))
    by = _consistency(len(FLOORS), H) if last else 1.0
    for i, j in _LOWER:
        cov = F.greatest(F.col(f"s{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}"), F.lit(0.0)) if i == j else F.col(f"s{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")
        sums = sums.withColumn(f"c{i}{j}", by * cov + (FLOORS[i] ** 2 if i == j else 0.0))
    for i, j in _LOWER:  # Cholesky factor; the floors keep the matrix positive definite
        rest = F.col(f"c{i}{j}") - _all([F.lit(0.0), *(F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j))])
        sums = sums.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(FLOORS[i] ** 2))) if i == j else rest / F.col(f"l{j}{j}"))
    return sums.select(*_KEYS, *(f"m{i}" for i in _DIMS), *(f"l{i}{j}" for i, j in _LOWER))


def _moved(before: DataFrame, after: DataFrame) -> float:
    """The largest change of an entry of any group's estimate."""
    names = [*(f"m{i}" for i in _DIMS), *(f"l{i}{j}" for i, j in _LOWER)]
    met = _join(after, before.withColumnsRenamed({c: f"_{c}" for c in names}))
    return met.agg(F.max(F.greatest(*(F.abs(F.col(c) - F.col(f"_{c}")) for c in names)))).first()[0] or 0.0


def estimates(vectors: DataFrame) -> DataFrame:
    """One row per (lang, source) of ``vectors`` (lang, source, base_failed, x0..x3) with ``m_i`` and ``l_ij``.

    Only texts that pass the base rules are measured. Nulls in ``lang`` or
    ``source`` form groups of their own.
    """
    ok = vectors.where(~F.col("base_failed"))
    none = F.lit(None).cast("string")
    level = lambda k, a, b: F.struct(F.lit(k).alias("level"), a.alias("g_lang"), b.alias("g_source"))
    lang, source = F.col("lang").cast("string"), F.col("source").cast("string")
    rows = ok.select(F.explode(F.array(level(0, lang, source), level(1, lang, none), level(2, none, none))).alias("g"), *_X) \
        .select("g.*", *_X)
    groups = saved(_start(rows), "mcd-start")
    for k in range(STEPS - 1):
        before, groups = groups, saved(_step(rows, groups, False), f"mcd-{k}")
        if _moved(before, groups) < SETTLED:
            break
    groups = saved(_step(rows, groups, True), "mcd-last")
    n = rows.groupBy(*_KEYS).agg(F.count("*").alias("n_group"))
    sized = _join(groups, n)
    best = [f"m{i}" for i in _DIMS] + [f"l{i}{j}" for i, j in _LOWER]
    pack = F.struct(*best)
    seen = vectors.select(lang.alias("lang"), source.alias("source")).distinct()
    own = sized.where("level = 0").select(F.col("g_lang").alias("a"), F.col("g_source").alias("b"), F.col("n_group").alias("n0"), pack.alias("p0"))
    of_lang = sized.where("level = 1").select(F.col("g_lang").alias("c"), F.col("n_group").alias("n1"), pack.alias("p1"))
    whole = sized.where("level = 2").select(pack.alias("p2"), F.lit(1).alias("k2"))
    got = seen.join(own, F.col("lang").eqNullSafe(F.col("a")) & F.col("source").eqNullSafe(F.col("b")), "left") \
        .join(of_lang, F.col("lang").eqNullSafe(F.col("c")), "left") \
        .withColumn("k", F.lit(1)).join(whole, F.col("k") == F.col("k2"), "left")
    used = F.when(F.col("n0") >= MIN_GROUP, F.col("p0")).when(F.col("n1") >= MIN_GROUP, F.col("p1")).otherwise(F.col("p2"))
    return got.select("lang", "source", used.alias("p")).select("lang", "source", "p.*")


def _verdicts(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` (with lang, source, base_failed, x_i) plus ``kept``."""
    g = groups.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    met = rows.join(g, F.col("lang").cast("string").eqNullSafe(F.col("_lang")) & F.col("source").cast("string").eqNullSafe(F.col("_source")), "left")
    return met.withColumn("kept", ~F.col("base_failed") & F.coalesce(_distance2() <= MAX_DISTANCE2, F.lit(False)))


def quality_report(docs: DataFrame) -> DataFrame:
    """doc_id, the five statistics, ``base_failed`` and ``kept`` for every row of ``docs``.

    A null or empty text has no words and fails the base rules. Repeated rows
    are judged alike, each with a row of its own; an empty table gives no rows.
    Other columns of ``docs`` are not looked at, whatever their names.
    """
    vectors = saved(with_statistics(docs.select("doc_id", "text", "lang", "source"))
                    .select("doc_id", "lang", "source", "_q.*"), "quality")
    return _verdicts(vectors, saved(estimates(vectors), "mcd")).select("doc_id", *STATS, "base_failed", "kept")


def drop_outliers(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``quality_report`` keeps, with their own columns.

    The statistics are worked out a second time beside the texts; the estimates
    are small, so no text is shuffled.
    """
    vectors = saved(with_statistics(docs.select("text", "lang", "source")).select("lang", "source", "_q.*"), "quality")
    groups = saved(estimates(vectors), "mcd")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), "text", "lang", "source")
    judged = _verdicts(with_statistics(whole).select("_row", "lang", "source", "_q.*"), groups)
    return judged.where("kept").select("_row.*")
