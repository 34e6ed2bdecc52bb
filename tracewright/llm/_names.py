"""Names for columns of our own beside a caller's."""

from __future__ import annotations

from collections.abc import Iterable


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """The names, each with underscores added until no column has it in any case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    """The name as a reference that dots and other signs in it don't change."""
    return "`" + name.replace("`", "``") + "`"
