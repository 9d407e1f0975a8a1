"""Tours as nested documents.

A list with no natural bound is cut into parts of consecutive positions, and each part is one row. The
first row of a tour (part 0) carries the tour itself. A tour with no more images than one part (all but the
extreme ones) is exactly one row, and a tour that holds a third of all images is many rows made by many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sojourn.functions.numbering import RUN_ROWS, dealt_by_range
from sojourn.tables import Tables

PART_SIZE = 1000


def ordered_images(t: Tables, *, part_size: int = PART_SIZE) -> DataFrame:
    """The images of each tour by display order and id, in parts of ``part_size`` positions.

    One range sort brings the images into order. Those of a tour that lie in one task are runs; a run begins where
    the tour's runs before it end, and gives each part the slice that falls into it.
    """
    order = F.coalesce("display_order", F.lit(0)).alias("display_order")
    images = t.tour_images.select("tour_id", "id", "image_url", "is_main", order)
    dealt = dealt_by_range(images, ["tour_id", "display_order", "id"])
    at = F.struct("_task", F.floor(F.col("_row") / RUN_ROWS).alias("chunk")).alias("_at")
    payload = F.struct("display_order", "id", "image_url", "is_main")
    runs = dealt.groupBy("tour_id", at).agg(F.sort_array(F.collect_list(payload)).alias("_run"))
    before = Window.partitionBy("tour_id").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    n = F.size("_run")
    begun = runs.withColumn("_from", F.coalesce(F.sum(n).over(before), F.lit(0)))
    numbers = F.sequence(F.floor(F.col("_from") / part_size), F.floor((F.col("_from") + n - 1) / part_size))
    pieces = begun.withColumn("part", F.explode(numbers))
    first = F.greatest(F.lit(0), F.col("part") * part_size - F.col("_from")).cast("int")
    length = F.least(n, ((F.col("part") + 1) * part_size - F.col("_from")).cast("int")) - first
    pieces = pieces.select("tour_id", "part", F.struct("_at", F.slice("_run", first + 1, length).alias("images")).alias("_piece"))
    whole = F.flatten(F.transform(F.sort_array(F.collect_list("_piece")), lambda p: p["images"]))
    return pieces.groupBy("tour_id", "part").agg(whole.alias("images"))


def _named(t: Tables, link: str, key: str, dimension: str, columns: list[str], name: str) -> DataFrame:
    """Linked dimension rows of each tour. A link occurs once, so a list is at most as long as the
    dimension table."""
    rows = getattr(t, link).join(getattr(t, dimension).select(F.col("id").alias(key), *columns), key)
    return rows.groupBy(F.col("tour_id").alias(f"_{name}_tour")).agg(
        F.sort_array(F.collect_list(F.struct(columns[0], F.col(key).alias("id"), *columns[1:]))).alias(name)
    )


def tour_document(t: Tables, *, part_size: int = PART_SIZE) -> DataFrame:
    """Tour with creator, ordered images, amenities and categories as nested arrays."""
    tours = t.tours.select(
        "id", "title", "slug", "location", "price", "discount_price", "start_date", "end_date", "capacity",
        "status", "created_by",
    )
    creators = t.users.select(F.col("id").alias("_creator"), F.col("name").alias("created_by_name"))
    heads = (
        tours.join(creators, F.col("_creator") == F.col("created_by"), "left")
        .join(
            _named(t, "tour_amenities", "amenity_id", "amenities", ["name", "icon", "description"], "amenities"),
            F.col("_amenities_tour") == F.col("id"), "left",
        )
        .join(
            _named(t, "tour_categories", "category_id", "categories", ["name", "icon", "color"], "categories"),
            F.col("_categories_tour") == F.col("id"), "left",
        )
        .drop("_creator", "_amenities_tour", "_categories_tour")
    )
    images = ordered_images(t, part_size=part_size)
    is_first = F.col("part") == 0
    first = images.filter(is_first).select(F.col("tour_id").alias("_tour"), "images")
    more = images.filter(~is_first).join(tours.select(F.col("id").alias("tour_id")), "tour_id", "left_semi")
    return (
        heads.join(first, F.col("_tour") == F.col("id"), "left")
        .drop("_tour")
        .withColumn("part", F.lit(0).cast("long"))
        .unionByName(more.withColumnRenamed("tour_id", "id"), allowMissingColumns=True)
    )


def flatten(documents: DataFrame) -> DataFrame:
    """Documents with each list as text, for flat files."""
    return documents.select(
        "id", "part", "title", "created_by_name",
        F.size(F.coalesce("images", F.array())).alias("image_count"),
        F.array_join(F.col("images.image_url"), " ").alias("images"),
        F.array_join(F.col("amenities.name"), ", ").alias("amenities"),
        F.array_join(F.col("categories.name"), ", ").alias("categories"),
        F.array_join(F.col("categories.color"), ", ").alias("colors"),
    )
