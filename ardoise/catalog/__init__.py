"""Queries on the given tables, each with the SQL it must equal where SQL can say it."""

from ardoise.catalog.registry import ORACLES, QUERIES  # noqa: F401
from ardoise.catalog import basics, cleaning, declared, features, learn, reports  # noqa: F401,E402
