"""Queries of the chromatography operators on the shared tables, each with the SQL that checks it."""
