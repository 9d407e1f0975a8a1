"""Rows every new installation starts with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.tables import Tables

# First amenities (name, icon).
AMENITIES = [
    ("Tents", "tent"),
    ("Bonfire", "fire"),
    ("Showers", "shower"),
    ("Meals Included", "utensils"),
    ("Transport", "bus"),
    ("Guide", "person-hiking"),
    ("First Aid", "medkit"),
    ("WiFi", "wifi"),
]

# First categories (name, description).
CATEGORIES = [
    ("Camping", "Overnight outdoor camping experiences"),
    ("Hiking", "Guided hiking and trekking tours"),
    ("Picnic", "Day picnic and outdoor dining"),
    ("Wellness Retreat", "Health and wellness focused retreats"),
    ("Adventure", "Adventure and outdoor activities"),
    ("Cultural", "Cultural and heritage tours"),
]


def _missing(table: DataFrame, seeds: DataFrame) -> DataFrame:
    new = seeds.join(table.select("name"), "name", "left_anti").withColumn("id", F.col("name"))
    return table.unionByName(new, allowMissingColumns=True)


def seed_dimensions(t: Tables) -> Tables:
    """Amenities and categories with the seed rows whose name is not there yet."""
    amenities = t.spark.createDataFrame(AMENITIES, "name string, icon string")
    categories = t.spark.createDataFrame(CATEGORIES, "name string, description string")
    return t.replace(
        amenities=_missing(t.amenities, amenities), categories=_missing(t.categories, categories)
    )
