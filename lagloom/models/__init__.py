"""Bases, distributed-lag designs, model fits by aggregation, predictions."""
