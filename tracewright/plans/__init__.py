"""Whole queries, composed of the library's operators."""


def load() -> None:
    """Import the modules that register queries."""
    from . import agent_queries, census_queries, episode_queries, ledger_queries, more_queries, verdict_queries  # noqa: F401
