"""All queries of the library but those of the llm subpackage."""

from quireframe.plans import charts, decks, documents, grid, lookups, more, office, paging, pictures, streams, structures, styles, values  # noqa: F401  each registers its queries
from quireframe.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
