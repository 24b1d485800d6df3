"""Table sources: the order-data model, its CSV loader and the driver binding."""

from churnlens.sources.model import Tables  # noqa: F401
