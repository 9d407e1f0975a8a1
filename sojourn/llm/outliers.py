"""Quality rules: plain bounds, and robust multivariate outliers among the texts of one language and source.

1. Counts of every whole text are Spark columns; two bounds on them are the base rules.
2. A text that passes them has a vector of transformed statistics. For each language and source the minimum-covariance-determinant
   estimate of its centre and spread is found: from two robust starts, the share ``KEEP`` of the vectors nearest to the centre gives
   the next centre and covariance, until no determinant falls any more, and the start with the smaller determinant counts. The covariance is the data's own; only
   a variance that is smaller than that of ``SPREADS`` is raised to it.
3. A text whose Mahalanobis distance from that centre is beyond a far quantile of the normal model goes.

Every step is a grouped sum or an approximate quantile, both of which are merged from partial results, so a source that holds a
third of all texts takes no task longer. A language and source with fewer than ``LEAST_ROWS`` passing texts uses the estimate
of its language, and a language with so few that of all texts; if those are too few as well, only the base rules apply.

Nulls: a null text has no words and fails the base rules, as an empty one does; a null language or source is a value like any other. Rows with equal or
null ``doc_id`` are judged each for itself, very long texts are counted whole, an empty table gives no rows. Columns other than ``doc_id``, ``text``, ``lang`` and ``source`` are not read.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sojourn.llm import statistics
from sojourn.llm.scratch import written

KEEP = 0.75
# Rounds at most, and the fall of a determinant's logarithm that asks for another one.
STEPS = 10
FALL = 1e-3
# Files of a table with one row for each group; it is small, and in few files seen to be so, so joins with it need no shuffle.
FILES = 4
LEAST_ROWS = 100
# Share of normal vectors that lie within the cutoff. Of 0.99 to this one, each further nine loses fewer good texts among the labelled ones of sf0.1
# outside the held-out fold, and all find the same junk.
WITHIN = 1 - 1e-6
# Statistics and the least spread that each has: about what one repeated line, one repeated passage or one more sign makes in a short
# text, so that one that is nearly always zero rejects nothing by a single occurrence.
SPREADS = {"log_words": 0.05, "word_length": 0.05, "symbols": 0.03, "dup_lines": 0.1, "repeats": 0.1, "upper": 0.03}
NAMES = list(SPREADS)
# Scales of the second start; they are in no covariance.
START_SCALES = (0.8, 0.5, 0.08, 0.15, 0.15, 0.08)

# Base rules.
LEAST_WORDS = 50
MOST_REPEATED = 50


def repeated_words(words: Column, n: Column) -> Column:
    """Words that lie in windows of three words that occur twice or more; ``words`` must be a column of the frame."""
    window = lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2])
    every = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(window(i).alias("h"), i.alias("i")))
    return F.when(n >= 3, F.sort_array(every))


def with_counts(docs: DataFrame) -> DataFrame:
    """Adds the counts and ``base_failed``."""
    text = F.col("text")
    lines = statistics.lines_with_words(text)
    found = docs.withColumns({"_words": statistics.words(text), "_lines": lines}).withColumn("_n", F.size("_words"))
    found = found.withColumn("_windows", repeated_words(F.col("_words"), F.col("_n")))
    # Neighbours in the order of windows that are equal, and the places of both.
    pair = F.zip_with(
        "_windows", F.slice("_windows", F.lit(2), F.size("_windows")), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))
    )
    found = found.withColumn("_pairs", F.filter(pair, lambda x: x.isNotNull()))
    found = found.withColumn("_at", F.sort_array(F.array_distinct(F.flatten("_pairs"))))
    # A window adds three words, or as many as lie before the next one.
    adds = F.zip_with("_at", F.slice("_at", F.lit(2), F.greatest(F.size("_at"), F.lit(1))), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    counted = found.withColumns(
        {
            "n_words": F.col("_n").cast("long"),
            "word_chars": statistics.word_chars(text),
            "n_symbols": statistics.symbols(text),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.coalesce(F.aggregate(adds, F.lit(0), lambda s, x: s + x), F.lit(0)).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_upper": statistics.left_of(text, r"[^\p{Lu}]+"),
        }
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return counted.withColumn("base_failed", failed).drop("text", "_words", "_lines", "_n", "_windows", "_pairs", "_at")


def vector() -> dict[str, Column]:
    """The transformed statistics."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    lines = F.greatest(F.col("n_lines"), F.lit(1)).cast("double")
    return {
        "log_words": F.log1p(F.col("n_words").cast("double")),
        "word_length": F.col("word_chars") / words,
        "symbols": F.sqrt(F.col("n_symbols") / chars),
        "dup_lines": F.sqrt(F.col("n_dup_lines") / lines),
        "repeats": F.sqrt(F.col("n_repeat_words") / words),
        "upper": F.sqrt(F.col("n_upper") / chars),
    }


def chi_square_share(x: float, half: int) -> float:
    """Share of a chi-square variable with 2 x half degrees of freedom up to x."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** j / math.factorial(j) for j in range(half))


def chi_square_quantile(share: float, half: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_share(mid, half) < share else (low, mid)
    return high


def keys() -> list[Column]:
    """Names of the groups that a text belongs to, narrowest first."""
    part = lambda c: F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(c).cast("string")))
    lang = F.concat(F.lit("1"), part("lang"))
    return [F.concat(F.lit("0"), part("lang"), F.lit("\n"), part("source")), lang, F.lit("2")]


def _entry(name: str, i: int, j: int) -> str:
    return f"{name}_{i}_{j}"


def whitened(groups: DataFrame) -> DataFrame:
    """Adds the inverse ``w`` of the Cholesky factor of each group's covariance ``s``, and the logarithm of its determinant."""
    size = len(NAMES)
    col = F.col
    for i in range(size):
        for j in range(i + 1):
            rest = reduce(lambda a, k: a - col(_entry("l", i, k)) * col(_entry("l", j, k)), range(j), col(_entry("s", i, j)))
            value = F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / col(_entry("l", j, j))
            groups = groups.withColumn(_entry("l", i, j), value)
    for i in range(size):
        for j in range(i + 1):
            if i == j:
                value = 1 / col(_entry("l", i, i))
            else:
                total = reduce(lambda a, k: a + col(_entry("l", i, k)) * col(_entry("w", k, j)), range(j, i), F.lit(0.0))
                value = -total / col(_entry("l", i, i))
            groups = groups.withColumn(_entry("w", i, j), value)
    log_det = reduce(lambda a, i: a + F.log(col(_entry("l", i, i))), range(size), F.lit(0.0))
    factors = [_entry("l", i, j) for i in range(size) for j in range(i + 1)]
    return groups.withColumn("log_det", log_det).drop(*factors)


def distance() -> Column:
    """Squared Mahalanobis distance by a group's centre ``m`` and whitening ``w``."""
    size = len(NAMES)
    parts = [
        reduce(lambda a, j: a + F.col(_entry("w", i, j)) * (F.col(NAMES[j]) - F.col(f"m_{j}")), range(i + 1), F.lit(0.0))
        for i in range(size)
    ]
    return reduce(lambda a, b: a + b * b, parts, F.lit(0.0))


def _per_group(groups: DataFrame, name: str) -> DataFrame:
    return written(groups.coalesce(FILES), name)


def estimates(rows: DataFrame) -> DataFrame:
    """Centre and whitening of every group: ``key, n``, ``m_*``, ``w_*``. The rows have ``key`` and the statistics."""
    size = len(NAMES)
    middles = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(x, 0.5).alias(f"m_{i}") for i, x in enumerate(NAMES)])
    middles = _per_group(middles.filter(F.col("n") >= LEAST_ROWS), "medians")
    away = rows.join(middles, "key").groupBy("key", "n", *[f"m_{i}" for i in range(size)])
    spread = away.agg(*[F.percentile_approx(F.abs(F.col(x) - F.col(f"m_{i}")), 0.5).alias(f"d_{i}") for i, x in enumerate(NAMES)])
    spread = _per_group(spread, "spreads")
    # Two starts: distances by the medians and their spreads, and by fixed scales.
    floor = list(SPREADS.values())
    first = {_entry("w", i, j): F.lit(0.0) for i in range(size) for j in range(i)}
    by_spread = {_entry("w", i, i): 1 / F.greatest(1.4826 * F.col(f"d_{i}"), F.lit(floor[i])) for i in range(size)}
    by_floor = {_entry("w", i, i): F.lit(1 / START_SCALES[i]) for i in range(size)}
    drop = [f"d_{i}" for i in range(size)]
    groups = spread.withColumns({**first, **by_spread, "start": F.lit(0)}).drop(*drop)
    groups = groups.unionByName(spread.withColumns({**first, **by_floor, "start": F.lit(1)}).drop(*drop))
    groups = _per_group(groups.withColumn("log_det", F.lit(math.inf)), "starts")
    half = size // 2
    grown = KEEP / chi_square_share(chi_square_quantile(KEEP, half), half + 1)
    for _ in range(STEPS):
        near = rows.join(groups.drop("log_det"), "key").withColumn("d2", distance())
        limits = _per_group(near.groupBy("key", "start").agg(F.percentile_approx("d2", KEEP).alias("limit")), "limits")
        inside = near.join(limits, ["key", "start"]).filter(F.col("d2") <= F.col("limit"))
        # Sums are taken about the last centre, which keeps their digits.
        gap = [F.col(x) - F.col(f"m_{i}") for i, x in enumerate(NAMES)]
        sums = {f"a_{i}": F.avg(gap[i]) for i in range(size)}
        sums |= {_entry("b", i, j): F.avg(gap[i] * gap[j]) for i in range(size) for j in range(i + 1)}
        found = inside.groupBy("key", "n", "start", *[f"m_{i}" for i in range(size)]).agg(*[v.alias(k) for k, v in sums.items()])
        covariance = {
            _entry("s", i, j): (F.col(_entry("b", i, j)) - F.col(f"a_{i}") * F.col(f"a_{j}")) * grown
            for i in range(size)
            for j in range(i + 1)
        }
        covariance |= {_entry("s", i, i): F.greatest(covariance[_entry("s", i, i)], F.lit(floor[i] ** 2)) for i in range(size)}
        centre = {f"m_{i}": F.col(f"m_{i}") + F.col(f"a_{i}") for i in range(size)}
        moved = found.withColumns(covariance).withColumns(centre).drop(*sums)
        # The last estimate stands where the next one is no smaller.
        tried = whitened(moved).drop(*covariance).withColumn("next", F.lit(True))
        both = tried.unionByName(groups.withColumn("next", F.lit(False)))
        names = [c for c in groups.columns if c not in ("key", "start")]
        least = F.min_by(F.struct(*names), F.struct("log_det", F.col("next"))).alias("one")
        old = F.max(F.when(~F.col("next"), F.col("log_det"))).alias("old")
        kept = both.groupBy("key", "start").agg(least, old).select("key", "start", "one.*", "old")
        groups = _per_group(kept, "estimates")
        fell = groups.agg(F.max(F.col("old") - F.col("log_det"))).first()[0]
        groups = groups.drop("old")
        if fell is None or not fell > FALL:
            break
    best = groups.groupBy("key").agg(F.min(F.struct("log_det", "start")).alias("best"))
    same = ["key", "start"]
    return groups.join(best.select("key", "best.start"), same).drop("start", "log_det")


def judged(docs: DataFrame) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``kept`` and the squared ``distance`` that decided (null where none did)."""
    plain = docs.select("doc_id", F.col("text").cast("string").alias("text"), "lang", "source")
    counted = with_counts(plain).withColumns(vector()).withColumn("_keys", F.array(*keys())).drop("lang", "source")
    counted = written(counted, "text-counts")
    passed = counted.filter("not base_failed").select(F.explode("_keys").alias("key"), *NAMES)
    groups = _per_group(estimates(passed), "groups-estimated")
    # The narrowest group with enough rows.
    out = counted
    for level in range(3):
        wanted = (F.col("_keys")[level] == F.col("key")) & ~F.col("base_failed")
        if level:
            wanted = wanted & F.col("_d0" if level == 1 else "_d1").isNull()
        out = out.join(groups, wanted, "left").withColumn(f"_d{level}", distance())
        out = out.drop("key", "n", *[f"m_{i}" for i in range(len(NAMES))], *[_entry("w", i, j) for i in range(len(NAMES)) for j in range(i + 1)])
        if level == 1:
            out = out.withColumn("_d1", F.coalesce("_d0", "_d1"))
    found = F.coalesce("_d1", "_d2")
    cutoff = chi_square_quantile(WITHIN, len(NAMES) // 2)
    kept = ~F.col("base_failed") & F.coalesce(found <= cutoff, F.lit(True))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select("doc_id", *counts, "base_failed", kept.alias("kept"), found.alias("distance"))
