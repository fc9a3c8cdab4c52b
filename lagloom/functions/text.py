"""Text expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def str_detect(s: Column | str, pattern: str) -> Column:
    """True where the pattern is found; null text stays null."""
    return (F.col(s) if isinstance(s, str) else s).rlike(pattern)


def str_extract(s: Column | str, pattern: str) -> Column:
    """First match of the pattern, or null."""
    return F.nullif(F.regexp_extract(s, pattern, 0), F.lit(""))


def label(*parts: Column | str, sep: str = " ") -> Column:
    """Paste text; plain strings are taken as text, not as column names."""
    return F.concat_ws(sep, *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def snake_case(name: str) -> str:
    """A column name in lower snake case."""
    name = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name.strip())
    name = name.replace("%", " percent ").replace("#", " number ")
    name = re.sub(r"[^0-9A-Za-z]+", "_", name).strip("_").lower()
    return "x" + name if not name or name[0].isdigit() else name
