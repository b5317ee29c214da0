"""Names of columns beside those that a table of documents may have."""

from __future__ import annotations


def free(base: str, columns: list[str]) -> str:
    """base, with underscores until it is no name in columns, whatever the case."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base += "_"
    return base
