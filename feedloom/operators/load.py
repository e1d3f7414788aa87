"""One row per review: its text, its product and what was known of its customer when it was written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.functions.keys import content_key
from feedloom.operators.point_in_time import FEATURES, review_features

LOADED = ["review_id", "review_key", "customer_id", "product_id", "product_name", "product_category", "rating",
          "reviewed_at", "review_text", "text_language", "text_model", *FEATURES]


def with_text(tables: dict[str, DataFrame]) -> DataFrame:
    """Reviews joined to their text and product, with the content key. Reviews without text are left out."""
    if "review_texts" not in tables:
        raise ValueError("no review_texts table: write review text before loading reviews")
    texts = tables["review_texts"].select("review_id", "review_text", F.col("language").alias("text_language"),
                                          F.col("model").alias("text_model"))
    products = tables["products"].select("product_id", "product_name", F.col("category").alias("product_category"))
    # names join the narrow reviews first: the text is shuffled once, by its unique id, never by product
    return (
        tables["reviews"].join(products, "product_id").join(texts, "review_id")
        .withColumn("review_key", content_key("product_name", "review_text"))
        .select([c for c in LOADED if c not in FEATURES])
    )


def load_reviews(tables: dict[str, DataFrame]) -> DataFrame:
    """Every review that has text, with its point-in-time features, in a fixed column order."""
    features = review_features(tables["reviews"], tables["customers"], tables["orders"]).drop("customer_id")
    return with_text(tables).join(features, "review_id").select(LOADED)


def missing_texts(tables: dict[str, DataFrame]) -> DataFrame:
    """Reviews that have no text yet and so are left out of `load_reviews`."""
    reviews = tables["reviews"]
    return reviews.join(tables["review_texts"].select("review_id"), "review_id", "left_anti") \
        if "review_texts" in tables else reviews


def product_catalogue(products: DataFrame) -> DataFrame:
    """The product list as the classifier names it."""
    return products.select("product_name", F.col("category").alias("product_category")) \
        .orderBy("product_category", "product_name")


def distinct_texts(reviews: DataFrame) -> DataFrame:
    """One row: reviews and distinct texts, the saving that scoring by content key gives."""
    return reviews.agg(F.count(F.lit(1)).alias("reviews"), F.countDistinct("review_key").alias("distinct_texts"))


def busiest_customer_history(reviews: DataFrame) -> DataFrame:
    """All reviews of the customer who wrote the most: their features move with time."""
    busiest = reviews.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n")) \
        .orderBy(F.desc("n"), "customer_id").limit(1)
    return reviews.join(busiest.select("customer_id"), "customer_id", "left_semi")
