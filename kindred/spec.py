"""Schema of records: what each feature is, how strong it is, whether it blocks, how pairs are compared on it."""

from __future__ import annotations

from dataclasses import dataclass

TYPES = {"string": "string", "int": "bigint", "float": "double", "date": "timestamp_ntz"}
MISSING = ("", "none", "NULL")
WEAK_USES = ("binary_match", "numerical_difference", "number_matches", "special_date_difference", "levenshtein")
STRONG_USES = ("binary_match", "number_matches")


@dataclass(frozen=True)
class Feature:
    """A set-valued feature. A type that isn't known keeps the column, always empty; ``ignore`` removes it."""

    name: str
    type: str = "string"
    strength: str = "weak"
    blocking: str = ""
    use: str = "binary_match"

    @property
    def column(self) -> str:
        return f"f_{self.name}"

    @property
    def sql_type(self) -> str:
        return TYPES.get(self.type, "string")

    @property
    def blocks(self) -> bool:
        return self.blocking == "block"

    def check(self) -> None:
        allowed = {"weak": WEAK_USES, "strong": STRONG_USES}.get(self.strength)
        if allowed and self.use not in allowed:
            raise ValueError(f"{self.name}: a {self.strength} feature can't be compared by {self.use!r}")


def from_header(rows: list[list[str]]) -> list[Feature]:
    """Features from five rows: names, types, strengths, blocking, pairwise uses."""
    if len(rows) != 5 or len({len(r) for r in rows}) != 1:
        raise ValueError("a header has five rows of one length")
    return [Feature(*column) for column in zip(*rows)]


def to_header(features: list[Feature]) -> list[str]:
    return [",".join(getattr(f, k) for f in features) for k in ("name", "type", "strength", "blocking", "use")]


def carried(features: list[Feature]) -> list[Feature]:
    return [f for f in features if f.type != "ignore"]
