"""Requests: JSON arguments to typed columns, and the limits they must keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlweave.functions.urls import cache_key
from crawlweave.options import DEFAULTS, MAX_IMAGE_COUNT, MAX_IMAGE_SIDE, MAX_TEXT_LENGTH, MIN_IMAGE_SIDE, Options

_INT_MAX = 2_147_483_647
# Names of the arguments.
_PATHS = [
    "$.url", "$.text.maxLength", "$.text.startIndex", "$.text.raw", "$.images", "$.images.output", "$.images.maxCount", "$.images.startIndex",
    "$.images.size.maxWidth", "$.images.size.maxHeight", "$.images.size.quality", "$.images.originPolicy", "$.images.layout", "$.security.ignoreRobotsTxt",
]


def parse_requests(df: DataFrame, json_col: str = "args", options: Options = DEFAULTS) -> DataFrame:
    """Add one typed column per option. A value of the wrong JSON type leaves the default.

    ``images`` is a switch or an object; an object switches images on.
    """
    kept = [c for c in df.columns if c != json_col]
    # parsed once, each path read once: the selects stay apart, as their columns are used more than once
    df = df.select(*kept, F.try_parse_json(F.col(json_col)).alias("_json"))
    df = df.select(*kept, *[F.try_variant_get("_json", p, "variant").alias(f"_{p}") for p in _PATHS])
    df = df.select(*kept, *[F.col(f"`_{p}`") for p in _PATHS], *[F.schema_of_variant(F.col(f"`_{p}`")).alias(f"_kind_{p}") for p in _PATHS])

    def kind(path: str) -> Column:
        return F.col(f"`_kind_{path}`")

    def text(path: str) -> Column:
        return F.when(kind(path) == "STRING", F.try_variant_get(F.col(f"`_{path}`"), "$", "string"))

    def flag(path: str) -> Column:
        return F.when(kind(path) == "BOOLEAN", F.try_variant_get(F.col(f"`_{path}`"), "$", "boolean"))

    def whole(path: str) -> Column:
        number = F.try_variant_get(F.col(f"`_{path}`"), "$", "double")
        bounded = F.least(F.greatest(number, F.lit(float(-_INT_MAX))), F.lit(float(_INT_MAX)))
        return F.when(kind(path).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), bounded.cast("int"))

    output = text("$.images.output")
    url = F.coalesce(text("$.url"), F.lit(""))
    return df.select(
        *kept,
        url.alias("url"),
        F.coalesce(whole("$.text.maxLength"), F.lit(options.text_length)).alias("max_length"),
        F.coalesce(whole("$.text.startIndex"), F.lit(0)).alias("start_index"),
        F.coalesce(flag("$.text.raw"), F.lit(False)).alias("raw"),
        F.coalesce(flag("$.images"), kind("$.images").startswith("OBJECT"), F.lit(False)).alias("images_enabled"),
        F.coalesce(whole("$.images.maxCount"), F.lit(options.image_count)).alias("image_count"),
        F.coalesce(whole("$.images.startIndex"), F.lit(0)).alias("image_start"),
        F.coalesce(whole("$.images.size.maxWidth"), F.lit(options.image_max_width)).alias("image_max_width"),
        F.coalesce(whole("$.images.size.maxHeight"), F.lit(options.image_max_height)).alias("image_max_height"),
        F.coalesce(whole("$.images.size.quality"), F.lit(options.image_quality)).alias("image_quality"),
        F.coalesce(text("$.images.originPolicy") == "cross-origin", F.lit(True)).alias("allow_cross_origin"),
        F.coalesce(output.isin("base64", "both"), F.lit(True)).alias("output_base64"),
        F.coalesce(output.isin("file", "both"), F.lit(False)).alias("save_to_file"),
        F.coalesce(text("$.images.layout"), F.lit("merged")).alias("layout"),
        F.coalesce(flag("$.security.ignoreRobotsTxt"), F.lit(True)).alias("ignore_robots"),
        F.when(url == "", "url_required").alias("error_code"),
    )


def validate_requests(df: DataFrame) -> DataFrame:
    """Add ``error_code`` and ``error_detail``; the first broken limit names the error."""

    def outside(name: str, low: int, high: int) -> Column:
        return (F.col(name) < low) | (F.col(name) > high)

    def sides(name: str) -> Column:
        return outside(name, MIN_IMAGE_SIDE, MAX_IMAGE_SIDE)

    detail = (
        F.when(F.col("url").isNull() | (F.col("url") == ""), "URL is required")
        .when(outside("max_length", 0, MAX_TEXT_LENGTH), "maxLength must be between 0 and 1,000,000")
        .when(outside("image_count", 0, MAX_IMAGE_COUNT), "imageMaxCount must be between 0 and 10")
        .when(outside("image_quality", 1, 100), "imageQuality must be between 1 and 100")
        .when(sides("image_max_width"), "imageMaxWidth must be between 100 and 10000")
        .when(sides("image_max_height"), "imageMaxHeight must be between 100 and 10000")
        .when(F.col("start_index") < 0, "startIndex must not be negative")
        .when(F.col("image_start") < 0, "imageStartIndex must not be negative")
    )
    known = F.col("error_code") if "error_code" in df.columns else F.lit(None).cast("string")
    return (
        df.withColumn("error_detail", F.when(known.isNull(), detail))
        .withColumn("error_code", F.coalesce(known, F.when(F.col("error_detail").isNotNull(), "invalid_url")))
    )


def with_cache_key(df: DataFrame, url: str = "url") -> DataFrame:
    return df.withColumn("url_key", cache_key(url))
