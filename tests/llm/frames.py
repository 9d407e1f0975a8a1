"""Small frames with the cases that every operator must take."""

import random

from pyspark.sql import functions as F

LONG = " ".join(random.Random(5).choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(i % 97) for i in range(30_000))
BIG = 2**62 + 1

# Nulls, empty and very long texts, repeated rows, one id with two texts, large ids.
EDGE = [
    (1, "One two three, four five six seven."),
    (1, "One two three, four five six seven."),
    (2, ""),
    (3, None),
    (None, "One two three, four five six seven."),
    (None, None),
    (4, LONG),
    (5, LONG + " end"),
    (6, "x" * 5000),
    (7, "\n\n \t\n"),
    (BIG, "Ünïcödé ﬁ 漢字 🙂🙂 it's we'll  x y"),
    (8, "a"),
    (8, "b c"),
]
# Names that operators use themselves.
CLASHING = ("score", "key", "row", "block", "label", "n", "t", "_words", "_key", "_part", "path", "line", "n_chars", "Component_Id")


def edge(spark):
    rows = spark.createDataFrame(EDGE, "doc_id long, text string")
    rows = rows.withColumns({name: F.lit(i) for i, name in enumerate(CLASHING)})
    return rows.withColumns({"lang": F.when(F.col("doc_id") != 4, F.lit("en")), "source": F.when(F.col("doc_id") != 5, F.lit("s"))})


def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")
