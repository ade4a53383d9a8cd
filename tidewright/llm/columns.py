"""Callers' columns kept apart from an operator's own, whatever their names."""

from __future__ import annotations

from pyspark.sql import DataFrame


def numbered(docs: DataFrame, *used: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with its columns named by their places, and the places' names of the ``used`` ones."""
    lowered = [c.lower() for c in docs.columns]
    return docs.toDF(*(f"c{i}" for i in range(len(lowered)))), [f"c{lowered.index(name)}" for name in used]


def free(name: str, taken: list[str]) -> str:
    """The name, with as many underscores behind it as it takes not to be one of ``taken`` in any case."""
    lowered = {c.lower() for c in taken}
    while name.lower() in lowered:
        name += "_"
    return name
