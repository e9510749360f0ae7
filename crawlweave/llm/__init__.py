"""Operators of a training-data pipeline over `documents`, `pages` and `benchmark`; nothing else in the library imports them."""
