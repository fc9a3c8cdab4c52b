"""Operators for large training corpora: one module per operator, `queries`
registers them. Nothing outside this package imports it."""
