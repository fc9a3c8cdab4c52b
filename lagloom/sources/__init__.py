"""Reading, writing and inspecting tables."""

from lagloom.sources.readers import (
    load,
    load_named,
    load_newest,
    load_with_banner,
    manual_rows,
)
from lagloom.sources.writers import export

__all__ = [
    "export",
    "load",
    "load_named",
    "load_newest",
    "load_with_banner",
    "manual_rows",
]
