"""All registered queries (importing the modules registers them)."""

from renewlens.plans import (  # noqa: F401
    queries_data,
    queries_eval,
    queries_extra,
    queries_models,
)
from renewlens.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
