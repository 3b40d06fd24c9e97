"""Named queries: operators bound to the test tables, each beside its check in SQL."""
