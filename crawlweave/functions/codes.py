"""Error codes as data: category, base text and the message a caller sees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code, category, base text.
ERROR_CODES = [
    ("url_required", None, "url is required"),
    ("invalid_url", None, "invalid URL format"),
    ("scheme_not_allowed", None, "only http and https schemes are allowed"),
    ("ssrf_blocked", "ssrf", "URL resolves to private/reserved address"),
    ("localhost_blocked", "ssrf", "localhost/local hostnames are not allowed"),
    ("robots_disallowed", "robots", "disallowed by robots.txt"),
    ("robots_forbidden", "robots", "robots.txt returned 401/403"),
    ("content_too_large", "size", "response exceeds size limit"),
    ("image_too_large", "size", "image exceeds size limit"),
    ("timeout", "timeout", "request timed out"),
    ("too_many_redirects", "http", "too many redirects"),
    ("fetch_failed", "http", "fetch failed"),
    ("http_client_error", "http", "HTTP client error"),
    ("http_server_error", "http", "HTTP server error"),
    ("extraction_failed", "extraction", "content extraction failed"),
    ("no_content", "extraction", "no content could be extracted"),
]

# Message by code; {} takes the error text. A code not listed shows the error text alone.
MESSAGES = {
    "ssrf_blocked": "Security blocked: {}. This URL resolves to a private or reserved address and cannot be fetched.",
    "localhost_blocked": "Security blocked: {}. This URL resolves to a private or reserved address and cannot be fetched.",
    "robots_disallowed": "This URL is disallowed by robots.txt. You can bypass this by setting security.ignoreRobotsTxt to true (if your client supports it).",
    "robots_forbidden": "The robots.txt for this site returned 401/403. The site may be blocking automated access.",
    "timeout": "The request timed out. The server may be slow or unreachable. Try again later.",
    "content_too_large": "The response exceeds the maximum size limit. Try fetching a smaller page or increasing the limit.",
    "too_many_redirects": "Too many redirects. The URL may be part of a redirect loop.",
    "invalid_url": "Invalid URL: {}",
    "scheme_not_allowed": "Invalid URL: {}",
    "fetch_failed": "Failed to fetch the URL: {}",
    "extraction_failed": "Content extraction failed: {}",
    "no_content": "Content extraction failed: {}",
}

# Codes that end a retry loop at once. Everything else is worth another attempt.
PERMANENT = [
    "ssrf_blocked", "localhost_blocked", "robots_disallowed", "robots_forbidden",
    "content_too_large", "http_client_error", "invalid_url", "scheme_not_allowed",
    "too_many_redirects", "url_required",
]


def error_text(base: Column, detail: Column) -> Column:
    return F.concat(base, F.when(detail.isNull() | (detail == ""), "").otherwise(F.concat(F.lit(": "), detail)))
