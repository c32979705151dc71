"""All registered queries of the core, and their SQL."""

from grove.plans import audits, queries

QUERIES = queries.QUERIES | audits.QUERIES
SQL = queries.SQL | audits.SQL
