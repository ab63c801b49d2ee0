"""All queries of the message store: ``QUERIES`` by name, and ``ORACLES`` with the same in SQL."""

from . import state_queries as state_queries  # registers its queries, as does the next
from . import store_queries as store_queries
from .queries import ORACLES as ORACLES
from .queries import QUERIES as QUERIES
