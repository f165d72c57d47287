"""A registry of DataFrame operators, pipelines of them, and a driver loop that refines until it stops gaining."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

Operator = Callable[..., DataFrame]


@dataclass
class Entry:
    name: str
    run: Operator
    description: str = ""
    triggers: list[str] = field(default_factory=list)
    needs: dict[str, str] = field(default_factory=dict)


class Registry:
    """Operators by name; call() checks the columns an operator needs before it runs."""

    def __init__(self) -> None:
        self._entries: dict[str, Entry] = {}

    def register(self, entry: Entry) -> None:
        if entry.name in self._entries:
            raise ValueError(f"{entry.name} is registered already")
        self._entries[entry.name] = entry

    def unregister(self, name: str) -> None:
        self._entries.pop(name, None)

    def names(self) -> list[str]:
        return sorted(self._entries)

    def call(self, name: str, df: DataFrame, **parameters: object) -> DataFrame:
        entry = self._entries[name]
        check_columns(df, entry.needs)
        return entry.run(df, **parameters)

    def search(self, words: str) -> list[str]:
        """Names by how well they fit: most triggers first, then 10 for the name, 5 for the description, 3 a trigger."""
        low = words.lower()

        def worth(e: Entry) -> int:
            parts = low.split()
            return 10 * any(p in e.name.lower() for p in parts) + 5 * any(p in e.description.lower() for p in parts) + 3 * sum(t.lower() in low for t in e.triggers)

        return [e.name for e in sorted(self._entries.values(), key=lambda e: (-worth(e), e.name)) if worth(e)]

    def schema_of(self, name: str, df: DataFrame, **parameters: object) -> dict:
        return self.call(name, df, **parameters).schema.jsonValue()


def check_columns(df: DataFrame, needs: dict[str, str]) -> None:
    have = {f.name: f.dataType.simpleString() for f in StructType(df.schema.fields).fields}
    wrong = {c: t for c, t in needs.items() if have.get(c) != t}
    if wrong:
        raise TypeError(f"columns missing or of another type: {wrong}")


def pipeline(*steps: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """The steps one after another, as one lazy plan."""
    return lambda df: reduce(lambda d, step: d.transform(step), steps, df)


def refine(
    start: DataFrame,
    step: Callable[[DataFrame], DataFrame],
    score: Callable[[DataFrame], float],
    enough: float = 0.8,
    least_gain: float = 0.05,
    most: int = 2,
) -> tuple[DataFrame, list[float]]:
    """Repeats step until the score is enough, gains less than least_gain, or most rounds have run."""
    current, scores = start, [score(start)]
    for _ in range(most):
        if scores[-1] >= enough:
            break
        current = step(current)
        scores.append(score(current))
        if abs(scores[-1] - scores[-2]) < least_gain:
            break
    return current, scores
