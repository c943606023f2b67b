"""Registered queries over the driver's tables, each with SQL where SQL can express it."""

from . import engine, relational, search

CATALOG = {**search.QUERIES, **relational.QUERIES, **engine.QUERIES}
