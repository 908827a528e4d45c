"""All registered queries.  Importing the modules registers them."""

from __future__ import annotations

from chainloom.plans import decode_queries, ingest_queries, relational_queries, serving_queries, streaming_queries  # noqa: F401
from chainloom.plans import registry


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracles() -> dict[str, str]:
    return dict(registry.ORACLES)
