"""Web-page content engine on Spark: admission, freshness, extraction and shaping over tables."""

from crawlweave.options import Options

__all__ = ["Options"]
