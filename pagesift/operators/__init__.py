"""DataFrame -> DataFrame operators (table generators, filters, joins, windows)."""
