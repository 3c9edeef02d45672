"""slotwise — venue-booking analytics as lazy Spark DataFrame jobs.

Every operator takes a :class:`slotwise.sources.tables.Tables` bundle (plus
request frames and an explicit ``as_of`` where time matters) and returns a lazy
DataFrame that answers for all owners, users and courts in one pass.
"""

from slotwise.sources.tables import Tables, load_tables

__all__ = ["Tables", "load_tables"]
