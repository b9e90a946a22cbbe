"""Every operator as a named query over the test tables, next to the SQL it is checked against."""

from flowmill.catalog import base, models, rows, streams  # noqa: F401
from flowmill.catalog.registry import ORACLES, QUERIES  # noqa: F401
