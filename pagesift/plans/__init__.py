"""Query plans: named jobs over the given tables plus their SQL oracles."""
