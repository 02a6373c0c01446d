"""All registered queries and their SQL."""

from __future__ import annotations

from . import cleaning, imports, lists, models, parties, streams, texts, workbooks  # noqa: F401
from .queries import QUERIES, SQL  # noqa: F401
