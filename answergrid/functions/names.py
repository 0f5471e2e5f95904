"""Column names made from field titles."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

# The length of a cut name without its position, and the prefix of generated names.
POSITION_ROOM = 3
NAME_PREFIX = "field_"


def safe_name(title: str, index: int, max_length: int | None = None) -> str:
    """A column name for the ``index``-th title.  Letters of any script stay.

    A name longer than ``max_length`` is cut and gets its position.
    """
    kept = "".join(c if c.isalnum() or c == "_" or c.isspace() else "_" for c in title)
    name = "_".join(kept.split()).strip("_").lower()
    if not name:
        return f"{NAME_PREFIX}{index}"
    if max_length is not None and len(name) > max_length:
        name = f"{name[: max_length - POSITION_ROOM]}_{index}"
    return NAME_PREFIX + name if name[0].isdigit() else name


def apart(name: str, index: int, taken: set[str]) -> str:
    """The name, with its position while another has it; upper and lower case are one."""
    while name.lower() in taken:
        name = f"{name}_{index}"
    taken.add(name.lower())
    return name


def free_names(taken: Iterable[str], *names: str) -> list[str]:
    """The names for helper columns, longer where a column has one; upper and lower case are one."""
    known = {t.lower() for t in taken}
    out = []
    for name in names:
        while name.lower() in known:
            name += "_"
        known.add(name.lower())
        out.append(name)
    return out


def field_names(
    titles: Sequence[str], taken: Sequence[str] = (), max_length: int | None = None
) -> list[str]:
    """One name per title, distinct from each other and from those ``taken``."""
    known = {t.lower() for t in taken}
    return [apart(safe_name(t, i, max_length), i, known) for i, t in enumerate(titles)]
