"""Importing this module fills the registry."""

from sparkgauge.plans import (  # noqa: F401
    delivery_queries,
    lifecycle_queries,
    log_queries,
    matching_queries,
    page_queries,
    single_queries,
)
from sparkgauge.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
