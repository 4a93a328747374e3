"""All registered queries over the given tables; importing the operator modules registers them."""

from framelake.operators import arbitration, boxes, chain, correction, decoding, dedup, gates, history, joins, limits, more, pixels, plates, quality, rows, serving, tracking  # noqa: F401
from framelake.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
