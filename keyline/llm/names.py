"""Column names: what operators add replaces a column of that name; what they use inside must not meet one."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unused(taken: Iterable[str], *names: str) -> list[str]:
    """``names``, each with as many underscores behind it as no taken name has."""
    used, out = {n.lower() for n in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def others(columns: Iterable[str], added: Iterable[str]) -> list[str]:
    """The columns that keep their place beside the added ones."""
    gone = {a.lower() for a in added}
    return [c for c in columns if c.lower() not in gone]


def column(name: str) -> Column:
    """A column by its whole name, whatever signs it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def numbered(df: DataFrame, columns: Iterable[str], prefix: str = "c") -> DataFrame:
    """These columns under plain names: prefix and number."""
    return df.select(*[column(c).alias(f"{prefix}{i}") for i, c in enumerate(columns)])
