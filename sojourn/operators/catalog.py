"""Catalogue search, lists and pages of tours.

A page is cut before images, creators or counts are joined, so those joins touch only the
page. The page size bounds every broadcast here.
"""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sojourn.functions import dates
from sojourn.functions.money import effective_price, saving, saving_percent
from sojourn.functions.numbering import first_rows
from sojourn.functions.skew import join_hot
from sojourn.functions.text import contains_any
from sojourn.operators.revenue import confirmed, zero_if_null
from sojourn.schemas import BOOKABLE
from sojourn.tables import Tables

CARD = (
    "id", "title", "slug", "short_description", "location", "price", "discount_price", "start_date",
    "end_date", "duration_days", "capacity", "booked_count", "status", "featured",
)


def newest_first() -> list[Column]:
    return [F.desc("created_at"), F.desc("id")]


def featured_first() -> list[Column]:
    """Featured before the rest, then newest, with the id as last key."""
    return [F.desc("featured"), *newest_first()]


def paginate(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """One page of a total order. The order must end in a unique key."""
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def page_after(df: DataFrame, time_column: str, last_time, last_id: int, size: int) -> DataFrame:
    """The page that follows a known last row (newest first). Its cost does not grow with the
    page number, and the time bound is pushed to the scan."""
    after = (F.col(time_column) < dates.ts(last_time)) | (
        (F.col(time_column) == dates.ts(last_time)) & (F.col("id") < last_id)
    )
    # The redundant bound alone is a plain comparison, which Parquet statistics can use.
    bounded = df.filter(F.col(time_column) <= dates.ts(last_time)).filter(after)
    return bounded.orderBy(F.desc(time_column), F.desc("id")).limit(size)


def with_totals(page: DataFrame, matched: DataFrame, size: int) -> DataFrame:
    """Add the number of matching rows and of pages to each row of a page."""
    total = matched.agg(F.count(F.lit(1))).scalar()
    return page.withColumn("total", total).withColumn("pages", F.ceil(F.col("total") / F.lit(size)))


def bookable() -> Column:
    return F.col("status").isin(*BOOKABLE)


def main_images(t: Tables) -> DataFrame:
    """The main image of each tour; the lowest display order, then id, when there are several."""
    first = F.min(F.struct("display_order", "id", "image_url")).alias("first")
    return (
        t.tour_images.filter("is_main")
        .groupBy("tour_id")
        .agg(first)
        .select("tour_id", F.col("first.image_url").alias("main_image"))
    )


def add_image(t: Tables, page: DataFrame, key: str = "id", name: str = "main_image") -> DataFrame:
    """Main image of the tours of one page; only their images are read past the filter."""
    wanted = page.select(F.col(key).alias("tour_id")).distinct()
    images = main_images(t.replace(tour_images=t.tour_images.join(F.broadcast(wanted), "tour_id", "left_semi")))
    images = images.select(F.col("tour_id").alias("_tour"), F.col("main_image").alias(name))
    return page.join(F.broadcast(images), F.col("_tour") == F.col(key), "left").drop("_tour")


def in_category(t: Tables, tours: DataFrame, name: str | None = None, category_id: str | None = None) -> DataFrame:
    """Tours with at least one matching category, each once."""
    links = t.tour_categories
    if category_id is not None:
        links = links.filter(F.col("category_id") == category_id)
    if name is not None:
        named = t.categories.filter(F.col("name").ilike(f"%{name}%")).select(F.col("id").alias("category_id"))
        links = links.join(named, "category_id", "left_semi")
    return tours.join(links, F.col("id") == F.col("tour_id"), "left_semi")


def semi_category_filter(t: Tables, *, category: str) -> DataFrame:
    return in_category(t, t.tours.select("id", "title", "status"), name=category)


def _filtered(
    t: Tables,
    *,
    search: str | None = None,
    category: str | None = None,
    category_id: str | None = None,
    price_min: float | None = None,
    price_max: float | None = None,
    either_price: bool = False,
    date: date | None = None,
    location: str | None = None,
    status: str | None = None,
    featured: bool | None = None,
) -> DataFrame:
    """Tours under the given filters only. ``either_price`` tests discount or list price instead
    of the effective price."""
    tours = t.tours
    if status is not None:
        tours = tours.filter(F.col("status") == status)
    if featured:
        tours = tours.filter("featured")
    if search:
        tours = tours.filter(contains_any(search, "title", "short_description", "location"))
    if location:
        tours = tours.filter(contains_any(location, "location"))
    if date is not None:
        tours = tours.filter(F.col("start_date") >= dates.day(date))
    for bound, test in ((price_min, "ge"), (price_max, "le")):
        if bound is None:
            continue
        amount = F.lit(Decimal(str(bound)))

        def holds(price: Column) -> Column:
            return price >= amount if test == "ge" else price <= amount

        if either_price:
            tours = tours.filter(holds(F.col("discount_price")) | holds(F.col("price")))
        else:
            tours = tours.filter(holds(effective_price()))
    if category or category_id is not None:
        tours = in_category(t, tours, name=category, category_id=category_id)
    return tours


def browse_tours(
    t: Tables,
    *,
    search: str | None = None,
    category: str | None = None,
    price_min: float | None = None,
    price_max: float | None = None,
    date: date | None = None,
    location: str | None = None,
    page: int = 1,
    limit: int = 12,
) -> DataFrame:
    """A page of bookable tours, featured first, then newest, with total and page count."""
    matched = _filtered(
        t, search=search, category=category, price_min=price_min, price_max=price_max, date=date, location=location
    ).filter(bookable())
    cards = paginate(matched.select(*CARD, "created_at"), featured_first(), page, limit)
    return with_totals(add_image(t, cards), matched, limit).orderBy(*featured_first()).drop("created_at")


def filter_tours_or_price(t: Tables, *, page: int = 1, limit: int = 12, **filters) -> DataFrame:
    """The variant with optional status and featured, category by id and the either-price test."""
    matched = _filtered(t, either_price=True, **filters).select(*CARD, "created_at")
    return add_image(t, paginate(matched, featured_first(), page, limit)).orderBy(*featured_first())


def count_tours(
    t: Tables,
    *,
    status: str | None = None,
    featured: bool | None = None,
    category_id: str | None = None,
    location: str | None = None,
) -> DataFrame:
    """Number of tours; price, date and search are not among its filters."""
    matched = _filtered(t, status=status, featured=featured, category_id=category_id, location=location)
    return matched.agg(F.count(F.lit(1)).alias("total"))


def search_tours(
    t: Tables,
    *,
    q: str | None = None,
    location: str | None = None,
    category: str | None = None,
    date: date | None = None,
    min_price: float | None = None,
    max_price: float | None = None,
    limit: int = 20,
) -> DataFrame:
    """The newest distinct bookable tours. A category test only asks for one match, so it is a semi
    join and no tour is ever doubled."""
    matched = _filtered(
        t, search=q, location=location, category=category, date=date, price_min=min_price,
        price_max=max_price, either_price=True,
    ).filter(bookable())
    found = matched.select(*CARD, "created_at").orderBy(*newest_first()).limit(limit)
    return add_image(t, found).orderBy(*newest_first())


def tours_by_category_name(t: Tables, *, category: str, page: int = 1, limit: int = 12) -> DataFrame:
    """Bookable tours once per matching category, with the count of such rows."""
    named = t.categories.filter(F.col("name").ilike(f"%{category}%")).select(
        F.col("id").alias("category_id"), F.col("name").alias("category"), F.col("description").alias("category_info")
    )
    links = t.tour_categories.join(named, "category_id")
    rows = (
        t.tours.filter(bookable())
        .select(*CARD, "created_at")
        .join(links, F.col("id") == F.col("tour_id"))
        .drop("tour_id")
    )
    order = [*newest_first(), F.asc("category_id")]
    return with_totals(add_image(t, paginate(rows, order, page, limit)), rows, limit).orderBy(*order)


def tours_by_category_id(t: Tables, *, category_id: str, page: int = 1, limit: int = 12) -> DataFrame:
    rows = in_category(t, t.tours.filter(bookable()), category_id=category_id).select(*CARD, "created_at")
    return add_image(t, paginate(rows, newest_first(), page, limit)).orderBy(*newest_first())


def api_tours(
    t: Tables,
    *,
    status: str | None = None,
    featured: bool | None = None,
    category: str | None = None,
    limit: int = 20,
    offset: int = 0,
) -> DataFrame:
    """Tours of any status by limit and offset, with the number of matches."""
    matched = _filtered(t, status=status, featured=featured, category=category)
    cards = matched.select(*CARD, "created_at").orderBy(*newest_first()).offset(offset).limit(limit)
    total = matched.agg(F.count(F.lit(1))).scalar()
    return add_image(t, cards).withColumn("total", total).orderBy(*newest_first())


def featured_tours(t: Tables, *, limit: int = 6) -> DataFrame:
    """Newest featured bookable tours with main image and one category (the first by name)."""
    rows = t.tours.filter(F.col("featured") & bookable()).select(*CARD, "created_at")
    shown = rows.orderBy(*newest_first()).limit(limit)
    wanted = F.broadcast(shown.select(F.col("id").alias("tour_id")))
    tags = (
        t.tour_categories.join(wanted, "tour_id", "left_semi")
        .join(t.categories.select(F.col("id").alias("category_id"), "name"), "category_id")
        .groupBy("tour_id")
        .agg(F.min("name").alias("primary_tag"))
    )
    return (
        add_image(t, shown)
        .join(F.broadcast(tags), F.col("id") == F.col("tour_id"), "left")
        .drop("tour_id")
        .orderBy(*newest_first())
    )


def admin_tours(t: Tables, *, status: str | None = None, page: int = 1, limit: int = 15) -> DataFrame:
    """A page of tours with creator, confirmed bookings and main image."""
    matched = _filtered(t, status=status)
    cards = paginate(
        matched.select("id", "title", "status", "price", "capacity", "created_by", "created_at"),
        newest_first(), page, limit,
    )
    creators = t.users.select(F.col("id").alias("creator"), F.col("name").alias("created_by_name"))
    wanted = F.broadcast(cards.select(F.col("id").alias("tour_id")))
    counts = (
        confirmed(t).join(wanted, "tour_id", "left_semi").groupBy("tour_id").agg(F.count(F.lit(1)).alias("n"))
    )
    rows = (
        add_image(t, cards)
        .join(creators, F.col("creator") == F.col("created_by"), "left")
        .join(F.broadcast(counts), F.col("tour_id") == F.col("id"), "left")
        .withColumn("confirmed_bookings", F.coalesce("n", F.lit(0)))
        .drop("creator", "tour_id", "n")
    )
    return with_totals(rows, matched, limit).orderBy(*newest_first())


def scalar_count_subquery(t: Tables) -> DataFrame:
    """Confirmed bookings of every tour."""
    counts = confirmed(t).groupBy("tour_id").agg(F.count(F.lit(1)).alias("confirmed_bookings"))
    return (
        t.tours.select("id", "title")
        .join(counts, F.col("id") == F.col("tour_id"), "left")
        .select("id", "title", zero_if_null("confirmed_bookings"))
    )


def first_child_scalar(t: Tables) -> DataFrame:
    """Every tour with its main image and first category."""
    tags = (
        t.tour_categories.join(t.categories.select(F.col("id").alias("category_id"), "name"), "category_id")
        .groupBy(F.col("tour_id").alias("tagged"))
        .agg(F.min("name").alias("primary_tag"))
    )
    return (
        t.tours.select("id", "title")
        .join(main_images(t), F.col("id") == F.col("tour_id"), "left")
        .join(tags, F.col("id") == F.col("tagged"), "left")
        .select("id", "title", "main_image", "primary_tag")
    )


def similar_tours(t: Tables, *, limit: int = 4) -> DataFrame:
    """For every tour the newest other bookable tours that share a category with it.

    The order is the same in every category, so only the ``limit + 1`` newest tours of a category
    can be among the answers (one of them may be the tour itself). No pairs within a category
    are formed beyond those.
    """
    offered = t.tours.filter(bookable()).select(
        F.col("id").alias("similar_id"), F.col("title").alias("similar_title"), "created_at"
    )
    order = [F.desc("created_at"), F.desc("similar_id")]
    links = t.tour_categories
    heads = first_rows(
        links.join(offered, F.col("tour_id") == F.col("similar_id")).drop("tour_id"),
        ["category_id"], order, limit + 1, "_at",
    ).drop("_at")
    # A category's heads are one list, so a link stays one row; what is a sort over all of a hot category's rows otherwise
    # is done in the short list of one tour, whose rows are dealt out by tour first.
    newest = F.struct("created_at", "similar_id", "similar_title")
    lists = heads.groupBy("category_id").agg(F.collect_list(newest).alias("_heads"))
    by_tour = join_hot(links, lists, ["category_id"]).select("tour_id", "_heads").repartition("tour_id").groupBy("tour_id")
    met = by_tour.agg(F.array_distinct(F.flatten(F.collect_list("_heads"))).alias("_met"))
    others = F.filter("_met", lambda x: x["similar_id"] != F.col("tour_id"))
    first = met.select("tour_id", F.posexplode(F.slice(F.sort_array(others, asc=False), 1, limit)).alias("_at", "_tour"))
    return first.select("tour_id", "_tour.similar_id", "_tour.similar_title", (F.col("_at") + 1).alias("rank"))


def category_names(t: Tables, tours: DataFrame) -> DataFrame:
    """Each tour with the sorted list of its category names, ``General`` when it has none. A tour
    has each category at most once, so a list is no longer than the category table."""
    names = (
        t.tour_categories.join(t.categories.select(F.col("id").alias("category_id"), "name"), "category_id")
        .groupBy("tour_id")
        .agg(F.sort_array(F.collect_set("name")).alias("names"))
    )
    joined = tours.join(names, F.col("id") == F.col("tour_id"), "left").drop("tour_id")
    return joined.withColumn("names", F.coalesce("names", F.array(F.lit("General"))))


def tour_categories_string(t: Tables) -> DataFrame:
    tours = t.tours.filter(bookable()).select(
        "id", "title", "location", "price", "start_date", "duration_days", "short_description", "slug", "capacity"
    )
    return category_names(t, tours).withColumn("category", F.array_join("names", ", ")).drop("names")


def featured_filter(t: Tables, *, tag: str = "All") -> DataFrame:
    """Featured bookable tours whose categories or title contain the tag."""
    rows = category_names(t, t.tours.filter(F.col("featured") & bookable()).select("id", "title", "location"))
    if tag != "All":
        rows = rows.filter(F.array_contains("names", tag) | F.col("title").contains(tag))
    return rows.withColumn("categories", F.array_join("names", ", ")).drop("names")


def lookup_list(t: Tables, table: str, label: str = "name", limit: int | None = None) -> DataFrame:
    """A dimension ordered by its label."""
    rows = getattr(t, table).select(F.col("id").cast("string").alias("id"), F.col(label).alias("label"))
    rows = rows.orderBy("label", "id")
    return rows if limit is None else rows.limit(limit)


def lookup_lists(t: Tables) -> DataFrame:
    """The lists of the forms: categories, the first six of them, amenities and tours. One order holds for all of them:
    by the list's number, label and id."""
    lists = [
        ("categories", lookup_list(t, "categories")),
        ("home_categories", lookup_list(t, "categories", limit=6)),
        ("amenities", lookup_list(t, "amenities")),
        ("tours", lookup_list(t, "tours", "title")),
    ]
    stacked = None
    for number, (name, rows) in enumerate(lists):
        rows = rows.withColumns({"list": F.lit(name), "list_number": F.lit(number)})
        stacked = rows if stacked is None else stacked.unionByName(rows)
    return stacked.orderBy("list_number", "label", "id")


def knowledge_base_list(t: Tables) -> DataFrame:
    """All facts, newest first (conversation and turn stand in for the time)."""
    return t.bot_knowledge.select("conv_id", "turn", "question", "answer").orderBy(
        F.desc("conv_id"), F.desc("turn")
    )


def price_projections(t: Tables, *, people: int = 2) -> DataFrame:
    """Effective price, saving, saving percent and the total for a party."""
    effective = effective_price()
    return t.tours.select(
        "id", "price", "discount_price",
        effective.alias("effective_price"),
        saving().alias("saving"),
        saving_percent().alias("saving_percent"),
        (effective * people).cast("decimal(18,2)").alias("order_total"),
    )


def tour_with_creator(t: Tables) -> DataFrame:
    creators = t.users.select(F.col("id").alias("creator"), F.col("name").alias("created_by_name"))
    return (
        t.tours.select("id", "title", "slug", "location", "price", "status", "created_by")
        .join(creators, F.col("creator") == F.col("created_by"), "left")
        .drop("creator")
    )


def membership_check(t: Tables) -> DataFrame:
    """Every (user, tour) pair that was ever booked, with a flag for being a favourite."""
    pairs = t.bookings.select("user_id", "tour_id").distinct()
    liked = t.favorites.select("user_id", "tour_id", F.lit(True).alias("liked"))
    return pairs.join(liked, ["user_id", "tour_id"], "left").select(
        "user_id", "tour_id", F.coalesce("liked", F.lit(False)).alias("is_favorite")
    )
