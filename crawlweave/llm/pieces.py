"""Long texts a piece at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator

_GAP = re.compile(rb"[\x20\x09-\x0D]")


def word_pieces(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words between ASCII white space, those of about `size` bytes at a time."""
    at = 0
    while len(text) - at > size:
        gap = _GAP.search(text, at + size)
        end = gap.start() if gap else len(text)
        yield text[at:end].split()
        at = end
    yield text[at:].split()
