"""Settings of a machine, from a file of KEY=VALUE lines and the environment."""

from __future__ import annotations

import os
from collections.abc import MutableMapping
from pathlib import Path


def load_env(path: str | Path, into: MutableMapping[str, str] | None = None) -> dict[str, str]:
    """Sets what the file names and the environment does not have yet; what was set. A missing file sets nothing.

    Empty lines, lines of # and lines without = say nothing; one pair of like quotes around a value is taken off.
    """
    into = os.environ if into is None else into
    found: dict[str, str] = {}
    if not Path(path).exists():
        return found
    for line in map(str.strip, Path(path).read_text(encoding="utf-8").splitlines()):
        name, sign, value = line.partition("=")
        name, value = name.strip(), value.strip()
        if not sign or not name or line.startswith("#"):
            continue
        if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
            value = value[1:-1]
        if name not in into:
            into[name] = found[name] = value
    return found


def path_of(name: str, default: Path, root: Path, env: MutableMapping[str, str] | None = None) -> Path:
    """A path that a variable names, below root unless it is absolute; default where the variable is unset or empty."""
    value = (os.environ if env is None else env).get(name)
    return root / value if value else default
