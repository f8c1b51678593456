"""The queries of the library's operators and SQL with the same results."""
