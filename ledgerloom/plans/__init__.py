"""All registered queries."""

from . import documents, layout, numbers, records, rules, tables, text, views  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401
