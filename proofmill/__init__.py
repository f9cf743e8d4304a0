"""Compliance evidence as DataFrames: rule catalogs, roll-up, structural checks and bundle algebra on Spark."""
