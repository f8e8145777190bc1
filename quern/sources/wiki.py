"""Pages of an offline corpus: search, lookup, projections; images from files."""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import schema
from quern.functions import images, text
from quern.operators import nodes


def read_pages(spark: SparkSession, path: str | None = None, default: str = "pages.parquet") -> DataFrame:
    """A page table; the default place where none is given or the given one can't be read."""
    place = (path or "").strip() or default
    read = lambda p: spark.read.schema(schema.PAGE_SCHEMA).parquet(p)
    try:
        return read(place)
    except AnalysisException as error:
        if place == default:
            raise
        logging.getLogger("quern").error("%s can't be read, %s is taken: %s", place, default, error)
        return read(default)


def search(pages: DataFrame, query: str, results: int = 2, id_col: str = "title", text_col: str = "content") -> DataFrame:
    """(id, score): the rows that hold the query's words most often; none for an empty query."""
    words = sorted(set(query.lower().split()))
    low = F.lower(F.coalesce(text_col, F.lit("")))
    hits = [(F.size(F.split(low, r"\b" + _quoted(w) + r"\b")) - 1) for w in words]
    score = reduce(lambda a, b: a + b, hits, F.lit(0)).cast("long")
    return pages.select(id_col, score.alias("score")).where("score > 0").orderBy(F.desc("score"), id_col).limit(results)


def _quoted(word: str) -> str:
    return "\\Q" + word.replace("\\E", "") + "\\E"


def page(pages: DataFrame, title: str) -> DataFrame:
    """The page of a title; no row if it is missing."""
    return pages.where(F.col("title") == title)


def fetch(pages: DataFrame) -> DataFrame:
    """Everything ingestion uses of each page, with defaults for what is missing."""
    titles = nodes.section_titles(pages)
    base = pages.select(
        "page_id", "title", F.coalesce("content", F.lit("")).alias("content"), text.intro(F.col("content")).alias("intro"), F.coalesce("categories", F.array().cast("array<string>")).alias("categories"),
        F.coalesce("html", F.lit("")).alias("html"), F.coalesce("images", F.array().cast(schema.PAGE_SCHEMA["images"].dataType)).alias("images"),
    )
    full = base.join(titles, "page_id", "left").withColumn("sections", F.coalesce("sections", F.array().cast(titles.schema["sections"].dataType)))
    return full.withColumn("toc", F.col("sections")).withColumn("section_names", F.transform("sections", lambda s: s["title"]))


def section_content(pages: DataFrame, title: str) -> DataFrame:
    """(page_id, body) of the section of a title; empty where a page has none."""
    rows = nodes.section_rows(pages).where(F.col("title") == title).groupBy("page_id").agg(F.min_by("body", F.struct("section_no", "sub_no")).alias("body"))
    return pages.select("page_id").join(rows, "page_id", "left").withColumn("body", F.coalesce("body", F.lit("")))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Image files as (image_url, image_name, image_data), made PNG; those that fail are left out."""
    files = spark.read.format("binaryFile").load(path)
    rows = files.select(F.col("path").alias("image_url"), text.url_name(F.col("path")).alias("image_name"), images.page_images("content").alias("image_data"))
    return rows.where("image_data is not null")
