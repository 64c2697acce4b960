"""All verification queries."""

from verification import queries_explore, queries_macro, queries_panel, queries_survival  # noqa: F401
from verification.registry import ORACLES, QUERIES  # noqa: F401
