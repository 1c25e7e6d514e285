"""All queries by name, and the SQL that each is held against."""

from __future__ import annotations

from quernstone.plans import extra, knowledge, quality, records, search, store  # noqa: F401
from quernstone.plans.registry import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "bm25_topk"
