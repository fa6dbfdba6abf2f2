"""Registered queries over the shared test tables, each beside its SQL equivalent."""


def load_all() -> None:
    """Import every module that registers queries."""
    from workload import (  # noqa: F401
        aggregates, extraction, filtering, joins, maintenance, pages, ranking, scalars,
        sections, streams, text_search,
    )
