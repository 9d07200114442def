"""Master records every star holds: regions, categories and the product catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from martlight.functions.money import PRICE
from martlight.schema import column_types
from martlight.sources.star import Star

# Master regions (name, code, country).
REGIONS = (
    ("North America", "NA", "United States"),
    ("Europe", "EU", "Germany"),
    ("Asia-Pacific", "APAC", "Singapore"),
    ("Latin America", "LATAM", "Brazil"),
    ("Middle East & Africa", "MEA", "United Arab Emirates"),
)
# Names of the master categories. The descriptions are our own.
CATEGORIES = (
    ("Electronics", "Screens, sound, storage and what connects them"),
    ("Furniture", "Desks, seats and shelves for work and home"),
    ("Office Supplies", "Paper, pens and everything else a desk uses up"),
    ("Apparel", "Clothes for work days and days off"),
    ("Footwear", "Shoes for the office, the road and the trail"),
    ("Home & Kitchen", "Cookware, small machines and linen"),
)
# Our own sample catalogue: code, name, category, price, cost.
CATALOGUE = (
    ("ML-EL-01", "Portable Projector", "Electronics", 449.0, 268.0),
    ("ML-EL-02", "Desk Speaker Pair", "Electronics", 129.5, 71.0),
    ("ML-EL-03", "Travel Router", "Electronics", 74.0, 38.5),
    ("ML-EL-04", "Solid State Drive 2 TB", "Electronics", 158.0, 104.0),
    ("ML-EL-05", "Drawing Tablet", "Electronics", 312.0, 187.0),
    ("ML-EL-06", "Conference Camera", "Electronics", 236.0, 133.0),
    ("ML-FU-01", "Folding Desk", "Furniture", 284.0, 161.0),
    ("ML-FU-02", "Oak Bookcase", "Furniture", 419.0, 251.0),
    ("ML-FU-03", "Reading Chair", "Furniture", 532.0, 322.0),
    ("ML-FU-04", "Stool", "Furniture", 88.0, 41.0),
    ("ML-FU-05", "Filing Cabinet", "Furniture", 176.0, 97.0),
    ("ML-FU-06", "Standing Lamp", "Furniture", 117.0, 54.0),
    ("ML-OS-01", "Copy Paper, Five Reams", "Office Supplies", 31.5, 17.0),
    ("ML-OS-02", "Gel Pens, Box of 24", "Office Supplies", 22.0, 8.0),
    ("ML-OS-03", "Label Printer", "Office Supplies", 134.0, 79.0),
    ("ML-OS-04", "Wall Calendar", "Office Supplies", 14.5, 4.5),
    ("ML-OS-05", "Whiteboard", "Office Supplies", 92.0, 47.0),
    ("ML-OS-06", "Archive Boxes, Set of 10", "Office Supplies", 38.0, 19.0),
    ("ML-AP-01", "Merino Cardigan", "Apparel", 119.0, 52.0),
    ("ML-AP-02", "Linen Shirt", "Apparel", 67.0, 26.0),
    ("ML-AP-03", "Rain Coat", "Apparel", 164.0, 81.0),
    ("ML-AP-04", "Work Trousers", "Apparel", 93.0, 40.0),
    ("ML-AP-05", "Wool Scarf", "Apparel", 44.0, 16.0),
    ("ML-FW-01", "Leather Brogues", "Footwear", 188.0, 89.0),
    ("ML-FW-02", "Canvas Sneakers", "Footwear", 62.0, 24.0),
    ("ML-FW-03", "Hiking Boots", "Footwear", 214.0, 109.0),
    ("ML-FW-04", "Running Shoes", "Footwear", 136.0, 61.0),
    ("ML-FW-05", "House Slippers", "Footwear", 29.0, 9.5),
    ("ML-HK-01", "Cast Iron Pan", "Home & Kitchen", 58.0, 27.0),
    ("ML-HK-02", "Electric Kettle", "Home & Kitchen", 71.0, 36.0),
    ("ML-HK-03", "Hand Blender", "Home & Kitchen", 83.5, 42.0),
    ("ML-HK-04", "Knife Set", "Home & Kitchen", 142.0, 74.0),
    ("ML-HK-05", "Bread Maker", "Home & Kitchen", 197.0, 118.0),
    ("ML-HK-06", "Bed Linen Set", "Home & Kitchen", 105.0, 49.0),
)


def products() -> list[tuple[str, str, str, float, float]]:
    """(code, name, category, price, cost) in catalogue order."""
    return list(CATALOGUE)


def literal_rows(spark: SparkSession, names: tuple[str, ...], rows) -> DataFrame:
    """A short constant table, with its position, as plan literals."""
    entries = [
        F.struct(F.lit(i).alias("position"), *[F.lit(v).alias(n) for n, v in zip(names, row)])
        for i, row in enumerate(rows)
    ]
    return spark.range(1).select(F.inline(F.array(*entries)))


def with_missing(existing: DataFrame, master: DataFrame, name: str, key: str,
                 missing_only: bool = False) -> DataFrame:
    """Add the master rows whose name is not there yet, with the next free ids.

    The master list has at most a few dozen rows: it is the broadcast side, and the existing table
    is only filtered to the names in the list.
    """
    id_column = column_types(name)[0][0]
    known = existing.join(F.broadcast(master.select(key)), key, "left_semi").select(key)
    largest = existing.agg(F.coalesce(F.max(id_column), F.lit(0)).alias("largest"))
    missing = master.join(known, key, "left_anti").withColumn(
        id_column,
        largest.scalar() + F.row_number().over(Window.orderBy("position")),
    )
    columns = column_types(name)
    rows = missing.select(*[
        (F.col(c) if c in missing.columns else F.lit(None)).cast(kind).alias(c)
        for c, kind in columns
    ])
    if missing_only:
        return rows
    return existing.select(*[F.col(c).cast(kind).alias(c) for c, kind in columns]).unionByName(rows)


def master_regions(spark: SparkSession) -> DataFrame:
    return literal_rows(spark, ("region_name", "code", "country"), REGIONS)


def master_categories(spark: SparkSession) -> DataFrame:
    return literal_rows(spark, ("category_name", "description"), CATEGORIES)


def master_products(spark: SparkSession, categories: DataFrame) -> DataFrame:
    names = ("product_code", "product_name", "category_name", "unit_price", "cost_price")
    catalogue = literal_rows(spark, names, products())
    wanted = categories.where(F.col("category_name").isin(*[c[0] for c in CATEGORIES]))
    # One id per category name, so at most as many rows as there are master categories.
    ids = wanted.groupBy("category_name").agg(F.min("category_id").alias("category_id"))
    return catalogue.join(F.broadcast(ids), "category_name").select(
        "position", "product_code", "product_name", "category_id",
        F.col("unit_price").cast(PRICE).alias("unit_price"),
        F.col("cost_price").cast(PRICE).alias("cost_price"),
        F.concat(F.lit("SKU-"), F.col("product_code")).alias("sku"),
        F.lit(True).alias("is_active"),
    )


def ensure_master(spark: SparkSession, star: Star, missing_only: bool = False) -> Star:
    """The star with all master records present (or only the added ones)."""
    categories = with_missing(
        star.categories, master_categories(spark), "categories", "category_name")
    frames = {
        "regions": with_missing(
            star.regions, master_regions(spark), "regions", "region_name", missing_only),
        "categories": categories if not missing_only else with_missing(
            star.categories, master_categories(spark), "categories", "category_name", True),
        "products": with_missing(
            star.products, master_products(spark, categories), "products", "product_code",
            missing_only),
    }
    return star.replace(frames)
