"""All registered queries and their SQL."""

from __future__ import annotations

from .base import ORACLE, QUERIES  # noqa: F401
from . import catalog, events, files, messages, search, streams, stored  # noqa: F401  (each registers its queries)
