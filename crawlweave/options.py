"""Job options. Every operator takes them as keyword arguments; nothing reads the environment."""

from __future__ import annotations

from dataclasses import dataclass

# The defaults of a fetch request and of the limits around it.
MAX_TEXT_LENGTH = 1_000_000
MAX_IMAGE_COUNT = 10
MIN_IMAGE_SIDE = 100
MAX_IMAGE_SIDE = 10_000
BROWSER_AGENT = (
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 "
    "(KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36"
)


# The defaults below.
@dataclass(frozen=True)
class Options:
    timeout_ms: int = 12_000
    max_redirects: int = 5
    max_html_bytes: int = 10 * 1024 * 1024
    max_image_bytes: int = 10 * 1024 * 1024
    cache_ttl_s: int = 300
    cache_entries: int = 100
    robots_ttl_s: int = 3600
    rate_per_second: float = 5.0
    rate_burst: int = 10
    max_retries: int = 3
    retry_base_ms: int = 500
    retry_cap_ms: int = 10_000
    text_length: int = 20_000
    image_count: int = 3
    image_max_width: int = 1000
    image_max_height: int = 1600
    image_quality: int = 80
    user_agent: str = BROWSER_AGENT
    allow_localhost: bool = False
    allow_private: bool = False
    limit_rate: bool = True


DEFAULTS = Options()

# A caller that asks for a whole page at once instead of tool-sized slices.
PROMPT_OPTIONS = Options(text_length=50_000)
