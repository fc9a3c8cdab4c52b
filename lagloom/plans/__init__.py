"""Registered analyses over the supplied tables, each with its SQL twin."""
