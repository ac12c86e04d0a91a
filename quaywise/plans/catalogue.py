"""All registered demand queries and their SQL."""

from quaywise.plans import history, models, queries, search, streams, structure, warehouse  # noqa: F401  the others add to the first

QUERIES, ORACLES = queries.QUERIES, queries.ORACLES
