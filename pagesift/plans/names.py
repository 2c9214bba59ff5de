"""Column names that clash with none of a table's."""

from __future__ import annotations


def fresh(taken: list[str], *bases: str) -> list[str]:
    """A name for each base, lengthened until it differs from all taken ones, letter case aside."""
    used = {t.lower() for t in taken}
    out = []
    for base in bases:
        name = base
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def without(taken: list[str], *names: str) -> list[str]:
    """The taken names but those that equal one of ``names``, letter case aside."""
    drop = {n.lower() for n in names}
    return [t for t in taken if t.lower() not in drop]
