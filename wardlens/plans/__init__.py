"""Fixture views, presets, composed flows and the query catalogue."""


def load_catalogue():
    """Import every query module so the registry is filled; return (queries, oracle)."""
    from wardlens.plans import (  # noqa: F401
        q_clean,
        q_columns,
        q_fit,
        q_flows,
        q_grid,
        q_lookup,
        q_model,
        q_outcomes,
        q_profile,
        q_xy,
    )
    from wardlens.plans.registry import ORACLE, QUERIES
    return QUERIES, ORACLE
