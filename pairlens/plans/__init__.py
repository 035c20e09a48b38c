"""Plan helpers: lineage cuts and work tables in the cluster's shared folder."""

from pairlens.plans.worktables import WorkTables

__all__ = ["WorkTables"]
