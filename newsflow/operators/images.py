"""Missing image links, filled from crawled pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsflow.functions.html import social_image_url
from newsflow.operators.filters import without_image


def page_images(pages: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """URL and social image of each crawled page, one row per URL.

    A page that was captured several times gives the image of the first capture, by
    the ``order`` columns, in which one is found; captures that tie there are taken
    by their link. Where ``pages`` has ``final_url``, the address after redirects,
    links are resolved against it.
    """
    base = F.coalesce("final_url", "url") if "final_url" in pages.columns else F.col("url")
    found = pages.select("url", *order, social_image_url(F.col("html"), base).alias("image_url"))
    first = Window.partitionBy("url").orderBy(
        F.col("image_url").isNull(), *[F.asc(c) for c in order], F.asc("image_url"))
    ranked = found.withColumn("_capture", F.row_number().over(first))
    return ranked.filter("_capture = 1").select("url", "image_url")


def extract_images(articles: DataFrame, pages: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """URL and image of every stored article that lacks an image; NULL when none is found.

    Only captures of those articles are searched: the URLs reduce the pages first,
    by broadcast or filter while they are few.
    """
    lacking = without_image(articles).select("url").distinct()
    wanted = pages.join(lacking, "url", "left_semi")
    return lacking.join(page_images(wanted, order), "url", "left")


def backfill_counts(extracted: DataFrame) -> DataFrame:
    """How many articles got an image and how many did not."""
    return extracted.agg(
        F.count_if(F.col("image_url").isNotNull()).alias("updated"),
        F.count_if(F.col("image_url").isNull()).alias("not_found"),
    )
