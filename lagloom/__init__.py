"""Distributed-lag and cohort epidemiology on Spark DataFrames."""

__version__ = "0.1.0"
