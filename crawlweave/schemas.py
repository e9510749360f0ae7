"""Explicit schemas of the landed tables."""

from pyspark.sql import types as T

PAGES = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])

REQUEST_JSON = T.StructType([
    T.StructField("request_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("args", T.StringType()),
])

FETCH_LOG = T.StructType([
    T.StructField("request_id", T.LongType()),
    T.StructField("attempt", T.IntegerType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("url", T.StringType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("n_bytes", T.LongType()),
    T.StructField("error_code", T.StringType()),
])

ROBOTS_SNAPSHOTS = T.StructType([
    T.StructField("robots_id", T.LongType()),
    T.StructField("host_key", T.StringType()),
    T.StructField("fetched_at", T.TimestampNTZType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("body", T.StringType()),
])

RESOLUTIONS = T.StructType([
    T.StructField("host", T.StringType()),
    T.StructField("ip", T.StringType()),
])

HOPS = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("location", T.StringType()),
])

SNAPSHOTS = T.StructType([
    T.StructField("snapshot_id", T.LongType()),
    T.StructField("url_key", T.StringType()),
    T.StructField("fetched_at", T.TimestampNTZType()),
    T.StructField("page_id", T.LongType()),
])

IMAGE_META = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("idx", T.IntegerType()),
    T.StructField("src", T.StringType()),
    T.StructField("mime", T.StringType()),
    T.StructField("width", T.IntegerType()),
    T.StructField("height", T.IntegerType()),
    T.StructField("n_bytes", T.LongType()),
])

LANDED_IMAGES = T.StructType([
    T.StructField("image_url", T.StringType()),
    T.StructField("mime", T.StringType()),
    T.StructField("width", T.IntegerType()),
    T.StructField("height", T.IntegerType()),
    T.StructField("n_bytes", T.LongType()),
])
