"""Document fingerprints: threshold-scaled sketches of word shingles.

A text's sketch holds the hash of every shingle of five words that lies in the lowest ``1 / SCALE`` of all hashes. So the sketch grows
with the text, sketches of parts merge by union, and a short text is compared with a long one by the share of its own hashes that
the long one has. A text with words of which no hash lies there keeps its lowest hash; fewer than five words are one
shingle as a whole. Equal texts have equal sketches.

Nulls: a null text is an empty one and has an empty sketch. Two empty sketches are alike, an empty one and another are not. Very long texts are sketched whole.
Rows without ``doc_id`` come last, rows with one id in the order of their texts' hashes; repeated rows are documents of their own; an empty table gives no rows.
Columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sojourn.llm import statistics
from sojourn.llm.scratch import written

SHINGLE = 5
SCALE = 4
# Parts of the order of documents for each partition of a shuffle.
PARTS = 8
LOWEST = -(2**63)


def with_sketch(frame: DataFrame, text: str, name: str, size: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """Adds the sorted hashes of a text column."""
    words, every = f"_{name}_words", f"_{name}_every"
    found = frame.withColumn(words, statistics.words(F.col(text)))
    w = F.col(words)
    window = lambda i: F.xxhash64(*[w[i + k] for k in range(size)])
    shingles = F.transform(F.sequence(F.lit(0), F.size(w) - size), window)
    few = F.when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<long>"))
    found = found.withColumn(every, F.when(F.size(w) >= size, shingles).otherwise(few))
    low = F.filter(every, lambda h: h < F.lit(LOWEST + 2**64 // scale))
    kept = F.when(F.exists(every, lambda h: h < F.lit(LOWEST + 2**64 // scale)), low)
    kept = kept.otherwise(F.filter(F.array(F.array_min(every)), lambda h: h.isNotNull()))
    return found.withColumn(name, F.sort_array(F.array_distinct(kept))).drop(words, every)


def fingerprint(sketch: Column) -> Column:
    """The sketch as a string: sixteen hexadecimal digits for each hash."""
    return F.lower(F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of shared shingles among all shingles of two texts."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union == 0, F.lit(1.0)).otherwise(shared / union)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the shorter text's shingles that the other has."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, (F.size(a) == F.size(b)).cast("double")).otherwise(F.size(F.array_intersect(a, b)) / least)


def merged(rows: DataFrame, keys: list[str], sketch: str = "sketch", scale: int = SCALE) -> DataFrame:
    """Sketches of larger texts from those of their parts: hashes of each key, once each. A key's lowest hash stands in only where none of its
    parts has one in the kept range."""
    hashes = rows.select(*keys, F.explode(sketch).alias("h")).distinct()
    low = F.lit(LOWEST + 2**64 // scale)
    names = [f"_of_{k}" for k in keys]
    lowest = hashes.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]).agg(F.min("h").alias("_least"))
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)]
    # The lowest hash stands in only where it is the only one.
    kept = hashes.join(lowest, same).filter((F.col("h") < low) | ((F.col("h") == F.col("_least")) & (F.col("_least") >= low)))
    return kept.select(*keys, "h")


def parts_of(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows with a part number in descending order of ``doc_id``, and for each part the first row of the next.

    The bounds come from approximate quantiles of the ids, ``PARTS`` for each partition of the session's shuffles, so parts are about
    equal, partitions get many of them, and a row needs one look at its own id.
    """
    spark = docs.sparkSession
    n = PARTS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n)).first()[0]
    bounds = sorted(set(bounds or []))
    # Binary search for the number of bounds below or at an id.
    array = F.array(*[F.lit(x).cast("long") for x in bounds]) if bounds else F.array().cast("array<long>")
    steps = [2**k for k in reversed(range(max(1, len(bounds)).bit_length()))]
    at = F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda a, s: F.when((a + s <= len(bounds)) & (F.get(F.col("_bounds"), a + s - 1) <= F.col("doc_id")), a + s).otherwise(a),
    )
    part = F.when(F.col("doc_id").isNull(), F.lit(1)).otherwise(-at)
    parted = docs.withColumn("_bounds", array).withColumn("_part", part).drop("_bounds")
    first = parted.groupBy("_part").agg(F.max(F.struct("doc_id", "_hash")).alias("_first"))
    first = written(first, "first-rows")
    # One row for each part.
    order = Window.orderBy("_part")
    last = F.max("_part").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    before = first.withColumn("_before", F.coalesce(F.lag("_part").over(order), last))
    return parted, before.select("_part", "_before", "_first.doc_id", "_first._hash")


def with_next(docs: DataFrame) -> DataFrame:
    """Adds ``sketch``, and ``next_text`` and ``next_sketch`` of the next document in descending order of ``doc_id``; the last one's is the first.

    Texts are dealt out by part first, and sketched where they are then, once each.
    """
    parted, first = parts_of(docs)
    # A part ends with the first row of the next one; the list of first rows has one row for each part.
    same = (parted["_part"] == first["_part"]) & parted["doc_id"].eqNullSafe(first["doc_id"]) & (parted["_hash"] == first["_hash"])
    guests = parted.join(F.broadcast(first), same).select(F.col("_before").alias("_part"), parted["doc_id"], "text", parted["_hash"])
    guests = guests.dropDuplicates(["_part"]).withColumn("_guest", F.lit(True))
    rows = parted.select("_part", "doc_id", "text", "_hash").withColumn("_guest", F.lit(False)).unionByName(guests)
    rows = with_sketch(rows.repartition("_part"), "text", "sketch")
    order = Window.partitionBy("_part").orderBy("_guest", F.col("doc_id").desc_nulls_last(), F.col("_hash").desc())
    found = rows.withColumns({"next_text": F.lead("text").over(order), "next_sketch": F.lead("sketch").over(order)})
    return found.filter(~F.col("_guest")).drop("_guest", "_part", "_hash")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of the text whose latter half is the next document's beginning:
    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, contained_edited``."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), statistics.filled(F.col("text")).alias("text"))
    rows = with_next(plain.withColumn("_hash", F.xxhash64("text")))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", edited)
    rows = with_sketch(rows.drop("text", "next_text"), "edited", "edited_sketch")
    a, b = F.col("sketch"), F.col("edited_sketch")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(a).alias("fingerprint"),
        fingerprint(b).alias("edited_fingerprint"),
        likeness(a, b).alias("near_edited"),
        likeness(a, F.col("next_sketch")).alias("near_next"),
        containment(a, b).alias("contained_edited"),
    )
