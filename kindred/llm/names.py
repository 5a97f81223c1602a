"""Names for working columns beside whatever columns a table has."""

from __future__ import annotations


def free(name: str, taken: list[str]) -> str:
    """name, with as many underscores behind as keep it apart from what is taken, in whatever case."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name
