"""Jobs over many tables."""

from tierview.jobs.lifecycle import (
    init_plan,
    refresh_all,
    rollback_plan,
    run_init,
    run_rollback,
    tier_agreement,
    unified,
    unified_range,
    update,
    update_many,
)
from tierview.jobs.results import JobError

__all__ = [
    "JobError",
    "init_plan",
    "refresh_all",
    "rollback_plan",
    "run_init",
    "run_rollback",
    "tier_agreement",
    "unified",
    "unified_range",
    "update",
    "update_many",
]
