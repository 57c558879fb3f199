"""Named queries and pipelines built from the operators."""

from __future__ import annotations

import importlib

_MODULES = (
    "kairos.plans.q_features",
    "kairos.plans.q_rows",
    "kairos.plans.q_joins",
    "kairos.plans.q_cohort",
    "kairos.plans.q_survival",
    "kairos.plans.q_metrics",
    "kairos.plans.q_text",
    "kairos.plans.q_models",
    "kairos.plans.q_select",
    "kairos.plans.q_sources",
    "kairos.plans.q_workflow",
    "kairos.plans.q_cox",
)


def load_all():
    """Import every query module; returns the registry module."""
    for m in _MODULES:
        importlib.import_module(m)
    from kairos.plans import registry
    return registry
