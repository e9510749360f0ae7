"""Which URLs may be fetched at all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlweave.functions.addresses import ip_is_private, is_ip_literal
from crawlweave.functions.urls import is_unparsable, url_struct


def url_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Add scheme, host, port, host_key (host with port), origin, path, query and robots_url."""
    u = F.col("_u")
    named = (u["scheme"] != "") & (u["hostport"] != "")
    return (
        df.withColumn("_u", url_struct(F.col(url)))
        .select(
            *df.columns,
            u["scheme"].alias("scheme"),
            u["host"].alias("host"),
            u["port"].alias("port"),
            F.lower(u["hostport"]).alias("host_key"),
            F.when(named, F.concat(u["scheme"], F.lit("://"), u["hostport"])).alias("origin"),
            u["path"].alias("path"),
            u["query"].alias("query"),
            F.when(named, F.concat(u["scheme"], F.lit("://"), u["authority"], F.lit("/robots.txt"))).alias("robots_url"),
        )
    )


def url_guard(df: DataFrame, allow_localhost: bool = False, blocked_hosts: DataFrame | None = None,
              url: str = "url") -> DataFrame:
    """Add ``host``, ``error_code`` and ``error_detail`` by the shape of the URL alone.

    ``blocked_hosts`` has one column ``host`` in lower case and is matched exactly.
    """
    u = F.col("_u")
    keep = [c for c in df.columns if c not in ("host", "error_code", "error_detail")]
    known = F.col("error_code") if "error_code" in df.columns else F.lit(None).cast("string")
    known_detail = F.col("error_detail") if "error_detail" in df.columns else F.lit(None).cast("string")
    base = df.select(
        *keep, known.alias("_code"), known_detail.alias("_detail"), url_struct(F.col(url)).alias("_u"),
    ).withColumn("host", u["host"])
    if blocked_hosts is None:
        listed = F.lit(False)
    else:
        marks = blocked_hosts.select(F.col("host"), F.lit(True).alias("_listed")).distinct()
        base = base.join(marks, "host", "left")
        listed = F.coalesce(F.col("_listed"), F.lit(False))
    local = (F.col("host") == "localhost") | F.col("host").rlike(r"\.local(?:host)?\z")
    verdict = (
        F.when(F.col("_code").isNotNull(), F.struct(F.col("_code").alias("code"), F.col("_detail").alias("detail")))
        .when(is_unparsable(F.col(url)), _verdict("invalid_url", "cannot be parsed"))
        .when(~u["scheme"].isin("http", "https"), _verdict("scheme_not_allowed", None))
        .when(u["has_userinfo"], _verdict("invalid_url", "URL contains userinfo"))
        .when(F.col("host") == "", _verdict("invalid_url", "host is empty"))
        .when(F.lit(not allow_localhost) & local, _verdict("localhost_blocked", None))
        .when(listed, _verdict("ssrf_blocked", None))
    )
    return (
        base.withColumn("_v", verdict)
        .select(*keep, "host", F.col("_v.code").alias("error_code"), F.col("_v.detail").alias("error_detail"))
    )


def _verdict(code: str, detail: str | None):
    return F.struct(F.lit(code).alias("code"), F.lit(detail).cast("string").alias("detail"))


def private_hosts(resolutions: DataFrame) -> DataFrame:
    """One row per host that has at least one private address, with the smallest such address."""
    return (
        resolutions.withColumn("_private", ip_is_private("ip"))
        .where("_private")
        .groupBy("host").agg(F.min("ip").alias("private_ip"))
    )


def dns_guard(df: DataFrame, resolutions: DataFrame, allow_private: bool = False) -> DataFrame:
    """Add or fill ``error_code`` for hosts with a private address.

    ``df`` has ``host``. Hosts without any answer pass; an address used as host answers for itself.
    """
    code = F.col("error_code") if "error_code" in df.columns else F.lit(None).cast("string")
    detail = F.col("error_detail") if "error_detail" in df.columns else F.lit(None).cast("string")
    keep = [c for c in df.columns if c not in ("error_code", "error_detail")]
    if allow_private:
        return df.select(*keep, code.alias("error_code"), detail.alias("error_detail"))
    bad_ip = F.coalesce(
        F.when(is_ip_literal(F.col("host")) & ip_is_private("host"), F.col("host")), F.col("private_ip")
    )
    blocked = code.isNull() & F.col("_bad_ip").isNotNull()
    return (
        df.join(private_hosts(resolutions.withColumn("host", F.regexp_replace("host", r"\.\z", ""))), "host", "left")
        .withColumn("_bad_ip", bad_ip)
        .select(
            *keep,
            F.when(blocked, "ssrf_blocked").otherwise(code).alias("error_code"),
            F.when(blocked, F.concat("host", F.lit(" resolves to "), "_bad_ip")).otherwise(detail).alias("error_detail"),
        )
    )


def allowed_hosts(df: DataFrame, hosts: DataFrame) -> DataFrame:
    """Keep rows whose host is on the list."""
    return df.join(hosts.select("host"), "host", "left_semi").select(*df.columns)
