"""All registered queries."""

from sojourn.plans.registry import ORACLES, QUERIES


def load_all() -> None:
    from sojourn.plans import availability, bookings, catalog, changes, customers, faults, kpis, revenue, scalars, sources, streams, tours  # noqa: F401


load_all()

__all__ = ["ORACLES", "QUERIES"]
