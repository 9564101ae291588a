"""Barloom: screening and backtesting over panels of bars, as Spark jobs."""
