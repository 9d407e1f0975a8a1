"""Quality scores by a sparse ensemble of rules over statistics of a text.

1. Statistics of every whole text are Spark columns.
2. A random forest of shallow trees is fitted on the statistics of a bounded sample of labelled texts. Every path from a root to a
   node is a rule: a conjunction of bounds on statistics.
3. Lasso logistic regression on the rules' truth values gives most of them weight zero. Reweighted least squares solve it: a step is one pass
   over the sample, and its lasso is solved on the sums of that pass, so a fit takes tens of jobs and not one for each step of a gradient.
4. The rules that are left are compiled into one column expression, so scoring is a projection of the scan.

Nulls and empty texts have statistics of zero and are scored by them. Columns other than ``doc_id`` and ``text`` are not read, and
labels only of rows outside the held-out fold. Rows with equal or null ``doc_id`` are scored each for itself, very long texts are read whole, an
empty table gives no rows, and one without both labels a constant score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sojourn.llm import statistics
from sojourn.llm.labelled import SAMPLE_ROWS, held_out, labelled_texts
from sojourn.llm.scratch import written

NAMES = (
    "log_words", "word_length", "longest_word", "distinct_words", "distinct_lines", "words_per_line", "symbols", "upper_case", "calls",
    "digits", "stops",
)
TREES = 24
DEPTH = 4
SEED = 7
# Strength of the lasso.
LASSO = 2e-3
# Passes over the sample at most, and the change of what is minimised at which they end. No text weighs less than the least.
PASSES = 30
SETTLED = 1e-7
LEAST_WEIGHT = 1e-5

Rule = tuple[tuple[int, float, float], ...]


def once(made: Column, use: Callable[[Column], Column]) -> Column:
    """``use(made)`` with ``made`` evaluated once a row, however often it is used. As the variable of a function it stays one expression where
    the optimizer moves the whole into a filter, which would copy a column that is made in a step before to each of its uses."""
    return F.get(F.transform(F.array(made), use), F.lit(0))


def parts_of(text: Column) -> Column:
    """What the statistics are made of."""
    return F.struct(
        statistics.words(text).alias("words"),
        F.split(statistics.filled(text), "\n", -1).alias("lines"),
        statistics.word_chars(text).alias("word_chars"),
        statistics.symbols(text).alias("symbols"),
        statistics.left_of(text, r"[^\p{Lu}]+").alias("upper"),
        statistics.left_of(text, r"[^!?]+").alias("calls"),
        statistics.left_of(text, r"[^0-9]+").alias("digits"),
        statistics.left_of(text, r"[^.,;:]+").alias("stops"),
    )


def statistics_of(parts: Column) -> dict[str, Column]:
    """Statistics by name."""
    words, lines = parts["words"], parts["lines"]
    n = F.size(words).cast("double")
    chars = F.greatest(parts["word_chars"], F.lit(1)).cast("double")
    some = F.greatest(n, F.lit(1.0))
    return {
        "log_words": F.log1p(n),
        "word_length": parts["word_chars"] / some,
        "longest_word": F.log1p(F.coalesce(F.array_max(F.transform(words, F.length)), F.lit(0)).cast("double")),
        "distinct_words": F.size(F.array_distinct(words)) / some,
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
        "words_per_line": F.log1p(n / F.size(lines)),
        "symbols": parts["symbols"] / chars,
        "upper_case": parts["upper"] / chars,
        "calls": parts["calls"] / some,
        "digits": parts["digits"] / chars,
        "stops": parts["stops"] / some,
    }


def vector(parts: Column) -> Column:
    found = statistics_of(parts)
    return F.array(*[found[name] for name in NAMES])


def with_statistics(docs: DataFrame) -> DataFrame:
    """Replaces ``text`` by ``_stats``, an array of doubles in the order of ``NAMES``."""
    return docs.withColumn("_stats", once(parts_of(F.col("text")), vector)).drop("text")


def rules_of(tree: str) -> list[Rule]:
    """The paths to all nodes but the root of a printed tree, as (statistic, above, up to) bounds."""
    found, path = [], []
    for line in tree.splitlines():
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-\d.eE]+)\)", line)
        if not m:
            continue
        depth = len(m[1])
        while path and path[-1][0] >= depth:
            path.pop()
        path.append((depth, int(m[2]), m[3], float(m[4])))
        bounds: dict[int, tuple[float, float]] = {}
        for _, feature, sign, value in path:
            low, high = bounds.get(feature, (-math.inf, math.inf))
            bounds[feature] = (low, min(high, value)) if sign == "<=" else (max(low, value), high)
        found.append(tuple((k, *v) for k, v in sorted(bounds.items())))
    return found


def holds(rule: Rule, stats: Column) -> Column:
    """Whether a text's statistics fulfil a rule."""
    tests = []
    for feature, low, high in rule:
        value = stats[feature]
        if low > -math.inf:
            tests.append(value > low)
        if high < math.inf:
            tests.append(value <= high)
    out = tests[0]
    for test in tests[1:]:
        out = out & test
    return out


@dataclass(frozen=True)
class Model:
    rules: tuple[tuple[Rule, float], ...]
    intercept: float

    def column(self, stats: Column) -> Column:
        def sum_of(found: Column) -> Column:
            z = F.lit(self.intercept)
            for rule, weight in self.rules:
                z = z + F.when(holds(rule, found), F.lit(weight)).otherwise(F.lit(0.0))
            return z

        return 1 / (1 + F.exp(-once(stats, sum_of)))

    def lines(self) -> list[str]:
        """The rules as text, heaviest first."""
        out = []
        for rule, weight in sorted(self.rules, key=lambda x: -abs(x[1])):
            tests = [f"{low:.4g} < {NAMES[k]} <= {high:.4g}" for k, low, high in rule]
            out.append(f"{weight:+.3f}  {' and '.join(tests)}")
        return out


def lasso_logistic(data: DataFrame, share: float) -> tuple[np.ndarray, float]:
    """Weights and intercept of lasso logistic regression of ``label`` on ``features``, from the share of positive labels on."""
    weights, intercept = np.zeros(1), math.log(share / (1 - share))
    seen = data.withColumn("z", F.lit(intercept))
    passes = []
    while True:
        z, p = F.col("z"), 1 / (1 + F.exp(-F.col("z")))
        pulled = seen.withColumn("weight", F.greatest(p * (1 - p), F.lit(LEAST_WEIGHT))).withColumn("pull", z + (F.col("label") - p) / F.col("weight"))
        loss = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - z * F.col("label")
        lost, weight = pulled.agg(F.avg(loss), F.avg("weight")).first()
        passes.append((lost + LASSO * float(np.abs(weights).sum()), weights, intercept))
        if len(passes) > PASSES or len(passes) > 1 and abs(passes[-1][0] - passes[-2][0]) < SETTLED:
            return min(passes, key=lambda x: x[0])[1:]
        # Least squares divide by the sum of weights, logistic loss by the number of rows.
        lasso = LinearRegression(
            labelCol="pull", weightCol="weight", predictionCol="z", solver="normal", regParam=LASSO / weight, elasticNetParam=1.0, standardization=False,
            maxIter=2000, tol=1e-10,
        )
        fitted = lasso.fit(pulled.drop("z"))
        weights, intercept = fitted.coefficients.toArray(), float(fitted.intercept)
        seen = fitted.transform(data)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> Model:
    """The ensemble of at most ``rows`` labelled texts; without both labels among them, their share alone."""
    sample = with_statistics(labelled_texts(docs, labels, label, rows))
    # The forest depends on the order of rows, which is so the same in every run.
    sorted_rows = sample.repartition(4, "doc_id").sortWithinPartitions("doc_id", "_stats")
    some = written(sorted_rows.select("label", "_stats"), "labelled-statistics")
    n, positive = some.agg(F.count("label"), F.sum("label")).first()
    if not n or not positive or positive == n:
        share = ((positive or 0) + 0.5) / (n + 1)
        return Model((), math.log(share / (1 - share)))
    data = some.select(F.col("label").cast("double").alias("label"), "_stats", array_to_vector("_stats").alias("features")).coalesce(4)
    # Both labels count alike for the trees, so that the rarer one gets paths of its own.
    share = positive / n
    weighted = data.withColumn("weight", F.when(F.col("label") > 0, F.lit(0.5 / share)).otherwise(F.lit(0.5 / (1 - share))))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, maxBins=64, weightCol="weight", featureSubsetStrategy="onethird")
    trees = forest.fit(weighted).trees
    rules = sorted({rule for tree in trees for rule in rules_of(tree.toDebugString)})
    if not rules:
        return Model((), math.log(share / (1 - share)))
    truth = F.array(*[holds(rule, F.col("_stats")).cast("double") for rule in rules])
    ruled = written(data.select("label", truth.alias("_truth")), "rule-values").select("label", array_to_vector("_truth").alias("features"))
    weights, intercept = lasso_logistic(ruled.coalesce(4), share)
    return Model(tuple((r, w) for r, w in zip(rules, weights.tolist(), strict=True) if abs(w) > 1e-6), intercept)


def score(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = with_statistics(texts).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.column(F.col("_stats")).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= least).cast("int"))


def accepted(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """The documents that score ``least`` or more, with all their columns."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    whole = docs.toDF(*names)
    at = next(i for i, c in enumerate(docs.columns) if c.lower() == "text")
    rated = with_statistics(whole.withColumn("text", F.col(names[at])))
    return rated.filter(model.column(F.col("_stats")) >= least).select(*names).toDF(*docs.columns)
