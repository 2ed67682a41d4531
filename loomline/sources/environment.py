"""Where a run reads and writes: what is given, else what a cluster mounts, else folders beside the program."""

from __future__ import annotations

import os
from dataclasses import dataclass


@dataclass(frozen=True)
class Environment:
    name: str
    raw_dir: str
    cache_dir: str
    log_dir: str
    config: str


def first_with(base: str, suffix: str = ".pdf") -> str:
    """The first folder below ``base``, in the order of paths, that holds a file of the suffix; ``base`` if none does."""
    for at, folders, names in os.walk(base):
        folders.sort()
        if any(n.endswith(suffix) for n in names):
            return at
    return base


def resolve(raw_dir: str | None = None, cache_dir: str | None = None, mounted: str | None = None, work_dir: str | None = None, root: str = ".") -> Environment:
    """Folders that are given come first, then those of a cluster that mounts its input at ``mounted``, then those below ``root``."""
    on_cluster = mounted is not None and os.path.isdir(mounted)
    work = (work_dir or mounted) if on_cluster else root
    return Environment(
        "cluster" if on_cluster else "local",
        raw_dir or (first_with(mounted) if on_cluster else os.path.join(root, "data", "raw")),
        cache_dir or (os.path.join(work, "cache") if on_cluster else os.path.join(root, "data", "cache")),
        work,
        os.path.join(root, "config.yaml"),
    )
