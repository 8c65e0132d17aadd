"""Path rules and file facts, on the driver."""

from __future__ import annotations

import os
from dataclasses import dataclass
from pathlib import Path


def local(path: str) -> str:
    """A plain path for a file: URI; other schemes have no local file."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    elif "://" in path:
        raise ValueError(f"record files need a file system path, not {path}")
    return path


def index_path(path: str) -> str:
    """``x.sst`` -> ``x.index.sst``, ``x`` -> ``x.index``, ``a.b.sst`` -> ``a.b.index.sst``."""
    p = Path(path)
    return str(p.with_name(f"{p.stem}.index{p.suffix}"))


@dataclass(frozen=True)
class FileFacts:
    path: str
    data_exists: bool
    data_size: int | None
    index_path: str
    index_exists: bool
    index_size: int | None


def facts(path: str) -> FileFacts:
    data, index = local(path), index_path(local(path))
    d, i = os.path.isfile(data), os.path.isfile(index)
    return FileFacts(path, d, os.path.getsize(data) if d else None, index, i, os.path.getsize(index) if i else None)


def split_existing(paths: list[str]) -> tuple[list[str], list[str]]:
    """(files that exist, files that do not), both in argument order."""
    there = [p for p in paths if os.path.isfile(local(p))]
    return there, [p for p in paths if not os.path.isfile(local(p))]


def make_dirs(path: str) -> None:
    os.makedirs(path, exist_ok=True)


def absolute(paths: list[str]) -> list[str]:
    """Resolved paths; an error if any is missing."""
    return [str(Path(p).resolve(strict=True)) for p in paths]


def relative(paths: list[str], base: str | None = None) -> tuple[list[str], list[str]]:
    """(paths below the base folder made relative, paths outside it)."""
    root = Path(base or os.getcwd()).resolve()
    inside = [p for p in paths if Path(p).is_relative_to(root)]
    return [str(Path(p).relative_to(root)) for p in inside], [p for p in paths if p not in inside]
