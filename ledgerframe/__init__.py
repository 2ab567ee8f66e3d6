"""Keyed record tables on Spark: a strict SELECT dialect, a change log and a change feed."""
