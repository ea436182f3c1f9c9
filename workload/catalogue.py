"""Imports every query module; the registry is the catalogue."""

from workload import agreement, calibration, consensus, jobs, selecting, stats, tables  # noqa: F401
from workload.base import REGISTRY

__all__ = ["REGISTRY"]
