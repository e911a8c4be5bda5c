"""The change log, and queries that follow it."""
