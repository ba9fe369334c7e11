"""All queries of the library proper."""

from tidemark.plans import (  # noqa: F401
    evaluation_queries,
    feature_queries,
    ingest_queries,
    joins_queries,
    live_queries,
    modelling_queries,
    provenance_queries,
    reports_queries,
    scalars_queries,
    sets_queries,
    streams_queries,
    windows_queries,
)
from tidemark.plans.registry import QUERIES, SQL  # noqa: F401

FLAGSHIP = "s01_matched_pair_bootstrap"
