"""Operators chained to whole analyses."""

from tallmat.plans.workflow import Settings, run

__all__ = ["Settings", "run"]
