"""Registered queries over the test tables, each next to the SQL that states its result."""

from parley.catalog import corpus, files, modeling, review

_PARTS = (corpus, files, modeling, review)
QUERIES = {name: fn for part in _PARTS for name, fn in part.QUERIES.items()}
SQL = {name: text for part in _PARTS for name, text in part.SQL.items()}
