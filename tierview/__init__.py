"""One logical table served from a hot and a cold tier, as ordinary Spark queries."""

from tierview.functions.boundaries import Boundary, BoundaryError, parse_boundary, sentinel
from tierview.operators.unify import read_range, unify
from tierview.plans.mapping import MappingError, MappingPlan, mapping_report, reconcile
from tierview.plans.spec import ColdSource, PartitionRule, TableSpec, TierConfig, TierPair

__all__ = [
    "Boundary",
    "BoundaryError",
    "ColdSource",
    "MappingError",
    "MappingPlan",
    "PartitionRule",
    "TableSpec",
    "TierConfig",
    "TierPair",
    "mapping_report",
    "parse_boundary",
    "read_range",
    "reconcile",
    "sentinel",
    "unify",
]
