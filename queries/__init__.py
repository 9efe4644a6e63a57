"""Every operator as a query over the given tables, next to the SQL it must agree with."""

from __future__ import annotations

from queries.registry import ORACLES, QUERIES  # noqa: F401
from queries import calibration, catalogue, feeds, geometry, matching, products, screening  # noqa: F401
