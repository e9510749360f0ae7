"""Decisions about images: where they are, which are taken, how large they get, what they are called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlweave.functions.urls import ext_from_mime, resolve_url, safe_stem, url_struct
from crawlweave.operators.output import remaining_images
from crawlweave.options import DEFAULTS


def resolve_image_urls(refs: DataFrame) -> DataFrame:
    """Add ``image_url``; references that cannot be resolved are dropped. ``refs`` has src and url."""
    return refs.withColumn("image_url", resolve_url(F.col("src"), F.col("url"))).where("image_url IS NOT NULL")


def _origin(url: Column) -> Column:
    u = url_struct(url)
    return F.concat(u["scheme"], F.lit("://"), F.lower(u["hostport"]))


def origin_policy(refs: DataFrame, allow_cross_origin: str = "allow_cross_origin") -> DataFrame:
    """Keep same-origin images, and all others where the request allows them."""
    return refs.where(F.col(allow_cross_origin) | (_origin(F.col("image_url")) == _origin(F.col("url"))))


def select_images(refs: DataFrame, requests: DataFrame) -> DataFrame:
    """Images ``[image_start, image_start + image_count)`` per request, in page order.

    The references of a page come as one array, so a request meets one row of its page.
    """
    entry = F.struct(F.col("idx"), F.col("src"), F.col("alt"), F.col("filename"))
    per_page = refs.groupBy("page_id").agg(F.array_sort(F.collect_list(entry)).alias("_all"))
    total = F.size("_all")
    return (
        requests.join(per_page, "page_id")
        .withColumn("remaining_images", remaining_images(total, F.col("image_start"), F.col("image_count")))
        .select(
            *requests.columns, "remaining_images",
            F.posexplode(F.slice(F.col("_all"), F.col("image_start") + 1, F.col("image_count"))).alias("image_no", "_img"),
        )
        .select(*requests.columns, "remaining_images", "image_no",
                F.col("_img.src").alias("src"), F.col("_img.alt").alias("alt"), F.col("_img.filename").alias("filename"))
    )


def fit_dimensions(
    meta: DataFrame, max_w: int | Column = DEFAULTS.image_max_width, max_h: int | Column = DEFAULTS.image_max_height
) -> DataFrame:
    """Add ``fit_width`` and ``fit_height``: inside the box (one for all or two columns), same aspect, never larger than before."""
    w, h = F.col("width").cast("bigint"), F.col("height").cast("bigint")
    outside = (w > max_w) | (h > max_h)
    # the tighter side decides: max_w / w <= max_h / h, without division
    by_width = F.lit(max_w).cast("bigint") * h <= F.lit(max_h).cast("bigint") * w

    def scaled(side: Column, other: int | Column, over: Column) -> Column:
        return F.greatest(F.lit(1), F.call_function("div", side * other, F.greatest(over, F.lit(1)))).cast("int")

    return meta.withColumn(
        "fit_width",
        F.when(~outside | outside.isNull(), F.col("width")).when(by_width, F.lit(max_w)).otherwise(scaled(w, max_h, h)),
    ).withColumn(
        "fit_height",
        F.when(~outside | outside.isNull(), F.col("height")).when(by_width, scaled(h, max_w, w)).otherwise(F.lit(max_h)),
    )


def strip_layout(meta: DataFrame, layout: str | Column = "merged", key: str = "page_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Vertical strip of the images of a page: the strip first, then the single images with their place.

    ``meta`` has ``key``, idx, src, width, height; rows without a size could not be decoded and take
    no part in the strip. ``layout`` is one for all or a column that is the same within a key. The
    columns ``keep`` of single images are kept. A window partition is one key.
    """
    joined = layout.isin("merged", "both") if isinstance(layout, Column) else F.lit(layout in ("merged", "both"))
    on_page = Window.partitionBy(key)
    above = on_page.orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    merged = joined & (F.col("_n") > 1) & F.col("width").isNotNull()
    placed = (
        meta.withColumn("_n", F.count("width").over(on_page))
        .withColumn("_w", F.max("width").over(on_page))
        .withColumn("_y", F.coalesce(F.sum("height").over(above), F.lit(0)))
    )
    singles = placed.select(
        key, (F.col("idx") + 1).cast("int").alias("position"), "src",
        F.col("width").cast("int").alias("width"), F.col("height").cast("bigint").alias("height"),
        F.when(merged, F.call_function("div", F.col("_w") - F.col("width"), F.lit(2))).cast("bigint").alias("x_offset"),
        F.when(merged, F.col("_y")).cast("bigint").alias("y_offset"),
        F.lit(None).cast("string").alias("alt"), *keep,
    )
    if not isinstance(layout, Column) and layout not in ("merged", "both"):
        return singles
    strips = (
        meta.where(joined).groupBy(key)
        .agg(F.count("width").alias("_n"), F.max("width").alias("_w"), F.sum("height").alias("_h"))
        .where("_n > 1")
        .select(
            key, F.lit(0).alias("position"), F.lit("merged").alias("src"), F.col("_w").cast("int").alias("width"),
            F.col("_h").cast("bigint").alias("height"), F.lit(0).cast("bigint").alias("x_offset"),
            F.lit(0).cast("bigint").alias("y_offset"),
            F.concat(F.lit("Merged "), F.col("_n").cast("string"), F.lit(" images")).alias("alt"),
        )
    )
    return strips.unionByName(singles, allowMissingColumns=True)


def answer_images(requests: DataFrame, page_images: DataFrame, landed: DataFrame, max_bytes: int = DEFAULTS.max_image_bytes) -> DataFrame:
    """The images each request is answered with, one row per image and one per strip.

    ``requests`` has request_id, ts, page_id, url (the address images are relative to) and the image arguments;
    ``page_images`` page_id and images (array of src, alt, filename); ``landed`` image_url, mime, width, height,
    n_bytes, of which one row per address counts, the newest if there is ``fetched_at``, else the largest. Of the
    images ``[image_start, image_start + image_count)`` those without an address or of an origin that the request
    leaves out are dropped. Others all have a row; ``image_error`` says why one has no size: no landed image,
    too many bytes, not an image. Sizes fit the request's box, and the strip is that of its layout.
    """
    entry = F.posexplode(F.slice("images", F.col("image_start") + 1, F.col("image_count"))).alias("idx", "_img")
    asked = requests.join(page_images.where(F.size("images") > 0), "page_id")
    refs = asked.select(*requests.columns, entry).select(
        *requests.columns, "idx", F.col("_img.src").alias("src"), F.col("_img.alt").alias("image_alt"), F.col("_img.filename").alias("filename")
    )
    wanted = origin_policy(resolve_image_urls(refs))
    order = ["fetched_at"] if "fetched_at" in landed.columns else []
    one = landed.groupBy("image_url").agg(F.max(F.struct(*order, "n_bytes", "mime", "width", "height")).alias("_landed"))
    met = wanted.join(one, "image_url", "left")
    size = lambda side: F.when(F.col("image_error").isNull(), F.col(f"_landed.{side}"))
    sized = met.withColumn(
        "image_error",
        F.when(F.col("_landed").isNull(), "fetch_failed").when(F.col("_landed.n_bytes") > max_bytes, "image_too_large")
        .when(~F.coalesce((F.col("_landed.width") > 0) & (F.col("_landed.height") > 0), F.lit(False)), "not_an_image"),
    ).withColumn("width", size("width")).withColumn("height", size("height")).withColumn("mime", F.col("_landed.mime")).drop("_landed")
    fitted = fit_dimensions(sized, F.col("image_max_width"), F.col("image_max_height"))
    fitted = safe_filename(fitted.withColumn("width", F.col("fit_width")).withColumn("height", F.col("fit_height")))
    of_request = ("ts", "layout", "image_quality", "output_base64", "save_to_file")
    of_image = ("image_url", "image_alt", "mime", "safe_name", "image_error")
    laid = strip_layout(fitted, F.col("layout"), "request_id", (*of_request, *of_image))
    # a strip has its request's arguments
    own = Window.partitionBy("request_id")
    for c in of_request:
        laid = laid.withColumn(c, F.max(c).over(own))
    strip = F.col("position") == 0
    name = F.when(strip, "merged.jpg").otherwise(F.col("safe_name"))
    done = F.col("image_error").isNull()
    return laid.select(
        "request_id", "position", "src", "image_url", F.when(strip, F.col("alt")).otherwise(F.col("image_alt")).alias("alt"),
        F.when(strip, "image/jpeg").otherwise(F.col("mime")).alias("mime"), "width", "height", "x_offset", "y_offset",
        F.col("image_quality").alias("quality"), name.alias("name"),
        F.when(done & F.col("save_to_file"), F.concat_ws("/", F.date_format("ts", "yyyy-MM-dd"), F.col("request_id").cast("string"), name)).alias("saved_as"),
        (done & F.col("output_base64")).alias("as_base64"), "image_error",
    )


def image_size_gate(meta: DataFrame, max_bytes: int = DEFAULTS.max_image_bytes) -> DataFrame:
    return meta.where(F.col("n_bytes") <= max_bytes)


def safe_filename(refs: DataFrame) -> DataFrame:
    """Add ``safe_name``: cleaned stem, image number and extension."""
    stem = safe_stem(F.col("filename"), F.col("image_url"))
    ext = ext_from_mime(F.coalesce(F.col("mime"), F.lit("")), F.lit(""))
    return refs.withColumn("safe_name", F.concat(stem, F.lit("_"), F.col("idx").cast("string"), F.lit("."), ext))


def image_base64(df: DataFrame, data: str = "data") -> DataFrame:
    """Add ``base64`` on one line; no bytes give an empty text."""
    encoded = F.regexp_replace(F.base64(F.col(data)), "[\r\n]", "")
    return df.withColumn("base64", F.coalesce(encoded, F.lit("")))
