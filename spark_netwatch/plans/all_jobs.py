"""Import every job module so the registry is complete."""

from __future__ import annotations

import importlib

MODULES = [
    "flow_jobs",
    "threat_jobs",
    "dpi_jobs",
    "intel_jobs",
    "respond_jobs",
    "clean_jobs",
    "verdict_jobs",
    "feature_jobs",
    "ml_jobs",
    "source_jobs",
    "stream_jobs",
    "misc_jobs",
]


def load():
    for m in MODULES:
        importlib.import_module(f"spark_netwatch.plans.{m}")
    from .registry import JOBS, ORACLE
    return JOBS, ORACLE
