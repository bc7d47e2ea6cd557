"""Installed books: version folders with containers in them, newest first."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from pathlib import Path

# Where installations are looked for, folder of the binaries, extension of containers.
BASES = ("/opt/1cv8", "/usr/local/opt/1cv8")
BINARIES, CONTAINER = "bin", ".hbk"


def version(text: str) -> tuple[int, ...] | None:
    """The first number with up to three more behind dots."""
    m = re.search(r"\d+(?:\.\d+){0,3}", text or "")
    return tuple(map(int, m[0].split("."))) if m else None


def dotted_version(text: str) -> tuple[int, ...] | None:
    """The version with the most parts, of those with a dot at least; the first of equals."""
    found = [tuple(map(int, v.split("."))) for v in re.findall(r"\d+(?:\.\d+){1,3}", text or "")]
    return max(found, key=len, default=None)


def installations(bases: Iterable[str | os.PathLike] = BASES) -> list[dict]:
    """``version`` and ``folder`` of every installation that has containers, each folder once, the newest first.

    A version's containers are in its folder or in a ``bin`` folder there."""
    found: dict[Path, tuple[int, ...]] = {}
    for base in map(Path, bases):
        for at in sorted(base.rglob("*")) if base.is_dir() else ():
            number = dotted_version(at.name)
            if not at.is_dir() or number is None:
                continue
            for folder in (at / BINARIES, at):
                if any(f.suffix.lower() == CONTAINER for f in folder.glob("*")):
                    found.setdefault(folder.resolve(), number)
                    break
    ranked = sorted(found.items(), key=lambda x: x[1], reverse=True)
    return [{"version": ".".join(map(str, v)), "folder": str(folder)} for folder, v in ranked]


def newest(bases: Iterable[str | os.PathLike] = BASES) -> str | None:
    return next((x["folder"] for x in installations(bases)), None)
