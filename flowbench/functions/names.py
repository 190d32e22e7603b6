"""Column-name rules: canonical names, references and collision checks."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Separators that become "_" and characters that disappear.
SEPARATORS = " /-."
DELETED = "()"

_RULE = str.maketrans({**dict.fromkeys(SEPARATORS, "_"), **dict.fromkeys(DELETED)})


def canonical_name(name: object) -> str:
    """``" Flow Bytes/s"`` -> ``"flow_bytes_s"``; idempotent."""
    return re.sub("_{2,}", "_", str(name).strip().lower().translate(_RULE)).strip("_")


def canonical_names(names: Iterable[object]) -> list[str]:
    return [canonical_name(name) for name in names]


def col(name: str) -> Column:
    """Reference a top-level column whatever its name holds (dots, spaces, backticks)."""
    return F.col("`" + name.replace("`", "``") + "`")


def resolve_collisions(names: list[str], originals: list[str], on_collision: str) -> list[str]:
    """Make canonical names unique, or say which original names collide.

    ``on_collision="error"`` raises; ``"suffix"`` appends ``_1``, ``_2`` ... to the later ones.
    """
    if on_collision not in ("error", "suffix"):
        raise ValueError(f"on_collision must be 'error' or 'suffix', not {on_collision!r}")
    repeated = {name for name, times in Counter(names).items() if times > 1}
    if not repeated:
        return names
    if on_collision == "error":
        clashes = "; ".join(
            f"{[o for n, o in zip(names, originals) if n == name]} -> {name!r}"
            for name in sorted(repeated)
        )
        raise ValueError(f"Columns share one normalised name: {clashes}")
    taken, unique = set(names), []
    seen: Counter = Counter()
    for name in names:
        candidate = name
        if seen[name]:
            number = seen[name]
            while (candidate := f"{name}_{number}") in taken:
                number += 1
            taken.add(candidate)
        seen[name] += 1
        unique.append(candidate)
    return unique
