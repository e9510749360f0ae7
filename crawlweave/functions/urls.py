"""URL parts and names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# scheme, authority, path, query, fragment
URL_SPLIT = (
    r"(?s)\A(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?\z"
)


def url_struct(url: Column) -> Column:
    """One struct with every part of a URL. Host and scheme are lower case."""

    def part(i: int) -> Column:
        return F.regexp_extract(url, URL_SPLIT, i)

    authority = part(2)
    hostport = F.regexp_replace(authority, r"(?s)\A.*@", "")
    bracketed = hostport.startswith("[")
    host = F.when(bracketed, F.regexp_extract(hostport, r"\A\[([^\]]*)\]", 1)).otherwise(
        F.regexp_extract(hostport, r"\A([^:]*)", 1)
    )
    # neither a zone nor the dot that ends a full name makes another host
    host = F.regexp_replace(host, r"(?:%.*|\.)\z", "")
    port = F.regexp_extract(hostport, r":([0-9]*)\z", 1)
    return F.struct(
        F.lower(part(1)).alias("scheme"),
        authority.alias("authority"),
        authority.contains("@").alias("has_userinfo"),
        hostport.alias("hostport"),
        F.lower(host).alias("host"),
        F.when(bracketed | hostport.contains(":"), port).otherwise(F.lit("")).alias("port"),
        part(3).alias("path"),
        part(4).alias("query"),
    )


def without_dots(path: Column) -> Column:
    """An absolute path with its "." and ".." segments worked off (RFC 3986, 5.2.4)."""
    segments = F.split(F.regexp_replace(path, r"\A/", ""), "/", -1)

    def step(done: Column, s: Column) -> Column:
        return F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(s == ".", done).otherwise(F.concat(done, F.array(s)))

    done = F.aggregate(segments, F.expr("cast(array() as array<string>)"), step)
    closed = F.concat(F.lit("/"), F.array_join(done, "/"), F.when(path.rlike(r"/\.\.?\z") & ~F.array_join(done, "/").isin(""), "/").otherwise(""))
    return F.when(path.rlike(r"/\.\.?(?:/|\z)"), closed).otherwise(path)


def resolve_url(ref: Column, base_url: Column) -> Column:
    """Absolute form of a reference (RFC 3986, 5.2); null if it is empty, not a web address or has no base to stand on."""
    base = url_struct(base_url)
    origin = F.when((base["scheme"] != "") & (base["hostport"] != ""), F.concat(base["scheme"], F.lit("://"), base["hostport"]))
    folder = F.when(base["path"] == "", "/").otherwise(F.regexp_replace(base["path"], r"[^/]*\z", ""))
    path = F.regexp_extract(ref, r"(?s)\A([^?#]*)", 1)
    rest = F.regexp_extract(ref, r"(?s)\A[^?#]*(.*)\z", 1)
    return (
        F.when(ref.isNull() | (ref == ""), F.lit(None))
        .when(ref.rlike(r"\A[hH][tT][tT][pP][sS]?://"), ref)
        .when(ref.rlike(r"\A[a-zA-Z][a-zA-Z0-9+.\-]*:"), F.lit(None))
        .when(ref.startswith("//"), F.concat(base["scheme"], F.lit(":"), ref))
        .when(ref.startswith("/"), F.concat(origin, without_dots(path), rest))
        .when(ref.startswith("?"), F.concat(origin, base["path"], ref))
        .when(ref.startswith("#"), F.concat(F.regexp_replace(base_url, r"(?s)#.*\z", ""), ref))
        .otherwise(F.concat(origin, without_dots(F.concat(folder, path)), rest))
    )


def is_unparsable(url: Column) -> Column:
    """Control characters, blanks in the authority, broken escapes or a port that is no number."""
    authority = F.regexp_extract(url, URL_SPLIT, 2)
    path = F.regexp_extract(url, URL_SPLIT, 3)
    hostport = F.regexp_replace(authority, r"(?s)\A.*@", "")
    return (
        url.rlike(r"[\x00-\x1f\x7f]")
        | authority.rlike(r"[ <>\x22]")
        | F.concat(authority, path).rlike(r"%(?:[^0-9a-fA-F]|[0-9a-fA-F](?:[^0-9a-fA-F]|\z)|\z)")
        | (hostport.startswith("[") & ~hostport.rlike(r"\A\[[^\[\]]*\](?::[0-9]*)?\z"))
        | (~hostport.startswith("[") & hostport.contains(":") & ~hostport.rlike(r"\A[^:]*:[0-9]*\z"))
    )


def cache_key(url: Column | str) -> Column:
    """Hex SHA-256 of the URL as given; nothing is normalised."""
    return F.sha2(F.col(url) if isinstance(url, str) else url, 256)


def filename_from_url(url: Column) -> Column:
    """Last path piece up to a question mark, or ``image.jpg``."""
    last = F.element_at(F.split(url, "/", -1), -1)
    return F.coalesce(F.nullif(F.element_at(F.split(last, r"\?", -1), 1), F.lit("")), F.lit("image.jpg"))


def safe_stem(preferred: Column, fallback_url: Column) -> Column:
    """File name without extension, anything but letters, digits, ``-`` and ``_`` replaced."""
    trimmed = F.regexp_replace(fallback_url, r"/+\z", "")
    base = F.regexp_extract(trimmed, r"([^/]*)\z", 1)
    name = F.coalesce(F.nullif(preferred, F.lit("")), F.nullif(F.nullif(base, F.lit("")), F.lit(".")), F.lit("image"))
    # the extension starts at the last dot after the last slash
    stem = F.regexp_replace(name, r"\.[^./]*\z", "")
    clean = F.regexp_replace(stem, r"[^a-zA-Z0-9_\-]", "_")
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("image"))


def ext_from_mime(mime: Column, fmt: Column) -> Column:
    return (
        F.when(mime.contains("jpeg") | mime.contains("jpg"), "jpg")
        .when(mime.contains("png"), "png")
        .when(mime.contains("gif"), "gif")
        .when(mime.contains("webp"), "webp")
        .when(fmt == "jpeg", "jpg")
        .when(fmt.isin("png", "gif", "webp"), fmt)
        .otherwise("jpg")
    )
